"""Embedding near-dedup: int8 tile products with error bounds, full precision only where needed.

Equal vectors form one class. Classes are dealt into ``g`` groups by a hash;
each pair of groups is one task that multiplies tiles of int8-quantised unit
vectors. For a unit vector ``u`` quantised as ``s * q`` with error ``e``,

    |u.v - s_u s_v q_u.q_v| <= |e_u| + (1 + |e_u|) |e_v|,

so a pair whose quantised product plus this bound is under the threshold cannot
link; all others are recomputed in double precision. A task returns link counts
per class and a spanning forest of its links, never the links themselves.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths do not link; a null
id takes no part in links and is kept; repeated rows are separate vectors; an
empty table gives an empty result; other input columns, whatever their names, are
dropped. Very long vectors make smaller groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store
from threadloom.llm.components import components, forest

#: Vectors and bytes of a group at most, which bounds a task's memory whatever the length of vectors. Groups at least, rows of a tile.
GROUP, GROUP_BYTES, LEAST_GROUPS, TILE = 65_536, 32_000_000, 8, 2048
_SLACK = 1e-6


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and error norm of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, error


def possible(a, b, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two quantised tiles that may reach the threshold."""
    (qa, sa, ea), (qb, sb, eb) = a, b
    kind = np.float32 if qa.shape[1] * 127 * 127 < 1 << 24 else np.float64  # products of codes stay exact integers
    product = qa.astype(kind) @ qb.astype(kind).T
    bound = ea + (1 + ea) * eb.max() + _SLACK
    least = (threshold - bound) / (sa * sb.max())
    least = np.where(threshold > bound, least, -np.inf)
    i, j = np.nonzero(product >= least.astype(kind)[:, None] - 1)
    fine = sa[i] * sb[j] * product[i, j] + ea[i] + (1 + ea[i]) * eb[j] + _SLACK >= threshold
    return i[fine], j[fine]


def links_between(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked rows, tile by tile; with ``y`` None, pairs i < j inside ``x``."""
    other = x if y is None else y
    ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, other))
    tiles_x = [(t, quantise(ux[t : t + TILE])) for t in range(0, len(x), TILE)]
    tiles_y = [(t, quantise(uy[t : t + TILE])) for t in range(0, len(other), TILE)]
    for s, a in tiles_x:
        for t, b in tiles_y:
            if y is None and t < s:
                continue
            i, j = possible(a, b, threshold)
            i, j = i + s, j + t
            if y is None:
                i, j = i[i < j], j[i < j]
            for at in range(0, len(i), 65_536):
                p, q = i[at : at + 65_536], j[at : at + 65_536]
                cosine = np.einsum("ij,ij->i", ux[p], uy[q])
                yield p[cosine >= threshold], q[cosine >= threshold]


def _unpack(table: pa.Table, length: int):
    rows = table.filter(pa.compute.equal(pa.compute.binary_length(table.column("vec")), length))
    ids, counts = (rows.column(c).to_numpy().astype(np.int64) for c in ("rep", "n"))
    data = b"".join(rows.column("vec").to_pylist())
    return ids, counts, np.frombuffer(data, dtype=np.float64).reshape(len(ids), length // 8)


def _pair(threshold: float, groups: int):
    def pair(table: pa.Table) -> pa.Table:
        out_a, out_b, out_n = [], [], []
        number = table.column("pair")[0].as_py()
        alone = number // groups == number % groups  # an empty side says nothing: its group may hold no class
        sides = [table.filter(pa.compute.equal(table.column("side"), s)) for s in (0, 1)]
        for length in pa.compute.unique(pa.compute.binary_length(sides[0].column("vec"))).to_pylist():
            ids, counts, x = _unpack(sides[0], length)
            ids_y, counts_y, y = (ids, counts, None) if alone else _unpack(sides[1], length)
            if not len(ids) or not len(ids_y):
                continue
            shift = 0 if alone else len(ids)
            every = ids if alone else np.concatenate([ids, ids_y])
            met = np.zeros(len(every), dtype=np.int64)
            root = np.arange(len(every))
            for i, j in links_between(x, y, threshold):
                np.add.at(met, i, counts_y[j])
                np.add.at(met, j + shift, counts[i])
                root = forest(np.concatenate([np.arange(len(every)), i]), np.concatenate([root, j + shift]), len(every))
            hit = np.flatnonzero(met)
            out_a.append(every[hit])
            out_b.append(every[root[hit]])
            out_n.append(met[hit])
        join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": join(out_a), "b": join(out_b), "links": join(out_n)})

    return pair


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, digest, vec); both null for a vector that cannot link."""
    for batch in batches:
        digests, vectors = [], []
        for value in batch.column(1):
            vec = None
            if value.is_valid and not value.values.null_count and len(value.values):
                v = value.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                norm = np.linalg.norm(v)
                if np.isfinite(v).all() and norm > 0:
                    if not 1e-100 < norm < 1e100:
                        v = v / np.abs(v).max()
                    vec = v.tobytes()
            vectors.append(vec)
            digests.append(hashlib.blake2b(vec, digest_size=16).digest() if vec is not None else None)
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "digest": pa.array(digests, pa.binary()), "vec": pa.array(vectors, pa.binary())})


def _key(turn: int) -> Column:
    return F.xxhash64("digest") if turn == 0 else F.xxhash64("digest", F.lit(turn))


def _numbered(classes: DataFrame) -> DataFrame:
    """``classes`` (digest, ...) with a number ``key`` that no two share: a class whose number another one has takes its next
    (one class in 1e9, some three hundred in 1e11)."""
    turns: dict[str, int] = {}
    while True:
        key = _key(0)
        for turn in sorted(set(turns.values())):
            key = F.when(F.hex("digest").isin([d for d, t in turns.items() if t == turn]), _key(turn)).otherwise(key)
        numbered = classes.withColumn("key", key)
        twice = numbered.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.hex(F.max("digest")).alias("digest")).filter("n > 1").select("digest").collect()
        if not twice:
            return numbered
        for r in twice:
            turns[r.digest] = turns.get(r.digest, 0) + 1


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, threshold: float = 0.9, group: int = GROUP) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: exact links by cosine and their components."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vec"))
    checked = store.table(rows.mapInArrow(_checked, "vec_id long, digest binary, vec binary"), "vectors")
    able = checked.filter("vec_id is not null and digest is not null")
    classes = store.table(able.groupBy("digest", "vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    # rows of one id may hold different vectors: classes are told apart by a number of their own
    classes = _numbered(classes)
    total, longest = classes.agg(F.count(F.lit(1)), F.coalesce(F.max(F.length("vec")), F.lit(1))).first()
    groups = max(LEAST_GROUPS, -(-total // max(1, min(group, GROUP_BYTES // longest))))
    dealt = classes.select(F.col("key").alias("rep"), "n", "vec", F.pmod("key", F.lit(groups)).cast("int").alias("g"))
    others = F.sequence(F.lit(0), F.lit(groups - 1))
    sent = dealt.withColumn("other", F.explode(others)).select(
        (F.least("g", "other") * groups + F.greatest("g", "other")).alias("pair"), (F.col("g") > F.col("other")).cast("int").alias("side"), "rep", "n", "vec"
    )
    met = store.table(sent.groupBy("pair").applyInArrow(_pair(threshold, groups), "a long, b long, links long"), "links")
    roots = components(met.select("a", "b"))
    links = met.groupBy(F.col("a").alias("__a")).agg(F.sum("links").alias("links"))
    marked = classes.join(links, F.col("key") == F.col("__a"), "left").join(roots.withColumnRenamed("node", "__node"), F.col("key") == F.col("__node"), "left")
    marked = marked.select(F.col("digest").alias("__digest"), "rep", F.coalesce("root", "key").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    marked = store.table(marked, "marked")
    smallest = marked.groupBy(F.col("root").alias("__root")).agg(F.min("rep").alias("component_id"))
    final = marked.join(smallest, F.col("root") == F.col("__root")).select(F.xxhash64("__digest").alias("__k"), "__digest", "n_links", "component_id")
    out = checked.drop("vec").join(final, (F.xxhash64("digest") == F.col("__k")) & (F.col("digest") == F.col("__digest")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 THEN e END AS e
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
r(node, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.node AND r.root < l.a),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
