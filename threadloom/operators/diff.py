"""Differences between two revisions: artifacts, fields, text blocks, binaries, and summaries."""

from __future__ import annotations

import difflib
import heapq
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def artifact_diff(base: DataFrame, target: DataFrame, keys: list[str], compared: list[str], carried: list[str] = ()) -> DataFrame:
    """Full outer join on ``keys``: (keys, change, base_<c>, target_<c>) of added, removed and modified rows; ``carried`` columns are shown, not compared."""
    b = base.select(*keys, *[F.col(c).alias(f"base_{c}") for c in (*compared, *carried)], F.lit(True).alias("__b"))
    t = target.select(*keys, *[F.col(c).alias(f"target_{c}") for c in (*compared, *carried)], F.lit(True).alias("__t"))
    same = F.lit(True)
    for c in compared:
        same = same & F.col(f"base_{c}").eqNullSafe(F.col(f"target_{c}"))
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__t").isNull(), "removed").when(~same, "modified")
    return b.join(t, keys, "full_outer").withColumn("change", change).filter("change is not null").drop("__b", "__t")


def field_diff(base: DataFrame, target: DataFrame, keys: tuple[str, ...] = ("aid",)) -> DataFrame:
    """(keys, field, old, new) of artifacts on both sides; lists compare as multisets, ``contents`` is left out."""

    pairs = base.select(*keys, F.col("fields").alias("__o")).join(target.select(*keys, F.col("fields").alias("__n")), list(keys))
    at = F.element_at
    value = lambda side, f: F.when(at(side, f).isNotNull(), F.struct(at(side, f)["is_list"].alias("is_list"), F.array_sort(at(side, f)["vals"]).alias("vals")))
    names = F.array_remove(F.array_union(F.coalesce(F.map_keys("__o"), F.array()), F.coalesce(F.map_keys("__n"), F.array())), "contents")
    each = F.transform(names, lambda f: F.struct(f.alias("field"), value(F.col("__o"), f).alias("o"), value(F.col("__n"), f).alias("n")))
    changed = F.filter(each, lambda x: ~x["o"].eqNullSafe(x["n"]))
    rows = pairs.select(*keys, F.explode(changed).alias("x"))
    return rows.select(*keys, "x.field", F.array_join("x.o.vals", "; ").alias("old"), F.array_join("x.n.vals", "; ").alias("new"))


def text_by_id(base: DataFrame, target: DataFrame) -> DataFrame:
    """Text blocks matched by (path, block_id), compared stripped; a column ``line`` is shown."""
    from threadloom.model import strip

    more = [c for c in ("line",) if c in base.columns]
    b = base.select("path", "block_id", strip(F.col("content")).alias("content"), *more)
    t = target.select("path", "block_id", strip(F.col("content")).alias("content"), *more)
    return artifact_diff(b, t, ["path", "block_id"], ["content"], more)


def text_alignment(base: DataFrame, target: DataFrame) -> DataFrame:
    """(path, change, old, new, old_line, new_line) of blocks (path, block_no, content, line) without ids, aligned in file order;
    replaced runs pair up, the surplus is added or removed.

    The unit of work is one file of one revision pair, which fits a task.
    """

    def align(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        sides = [f.sort_values(f.columns[1]) if len(f) else None for f in (old, new)]
        a, b = ([x.strip() for x in f.iloc[:, 2]] if f is not None else [] for f in sides)
        lines = [list(f.iloc[:, 3]) if f is not None else [] for f in sides]
        path = (old if len(old) else new).iloc[0, 0]
        at = lambda x, i: None if i is None else x[i]
        rows = [(path, change, at(a, i), at(b, j), at(lines[0], i), at(lines[1], j)) for change, i, j in aligned(a, b)]
        return pd.DataFrame(rows, columns=["path", "change", "old", "new", "old_line", "new_line"]).astype(object)

    columns = ["path", "block_no", "content", "line"]
    sides = [side if "line" in side.columns else side.withColumn("line", F.lit(None).cast("string")) for side in (base, target)]
    # fresh attributes on one side: a cogroup of two plans of one origin would mix its columns up
    other = sides[1].select(*[F.col(c).alias(f"__{c}") for c in columns])
    schema = "path string, change string, old string, new string, old_line string, new_line string"
    return sides[0].select(*columns).groupBy("path").cogroup(other.groupBy("__path")).applyInPandas(align, schema)


#: Pairs of equal blocks, per block of a file, up to which runs are listed.
PAIRS = 32


def aligned(a: list[str], b: list[str], pairs: int = PAIRS) -> Iterator[tuple[str, int | None, int | None]]:
    """(change, place in a, place in b) of what lies between the matched runs."""
    i = j = 0
    for x, y, n in [*matched(a, b, pairs), (len(a), len(b), 0)]:
        k = min(x - i, y - j)
        yield from (("modified", i + z, j + z) for z in range(k))
        yield from (("removed", z, None) for z in range(i + k, x))
        yield from (("added", None, z) for z in range(j + k, y))
        i, j = x + n, y + n


def matched(a: list[str], b: list[str], pairs: int = PAIRS) -> list[tuple[int, int, int]]:
    """The matched runs (place in a, place in b, length): the longest common run, the first in a, then in b; before and after it likewise.

    All maximal runs lie in a queue by length. One that is popped is cut to what the runs matched before leave of it, and matched if
    it is whole: matches divide what is left into rectangles that do not touch, so that the longest of all is the longest of its own.
    The work follows the pairs of equal blocks; where there are too many, each rectangle is searched on its own."""
    where: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    if sum(len(where.get(x, ())) for x in a) > pairs * (len(a) + len(b)) + 100_000:
        return [tuple(m) for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size]
    runs, open_ = [], {}
    for i, x in enumerate(a):  # runs by their diagonal, while they go on
        now = {}
        for j in where.get(x, ()):
            now[j] = open_.pop(j - 1, (i, j))
        runs += [(i - s, s, t) for s, t in open_.values()]
        open_ = now
    runs += [(len(a) - s, s, t) for s, t in open_.values()]
    queue = [(-n, i, j) for n, i, j in runs]
    heapq.heapify(queue)
    starts, found = [], []  # matches in order, by their place in a
    while queue:
        n, i, j = heapq.heappop(queue)
        n = -n
        k = bisect_right(starts, i) - 1  # the match before the run's start
        before = found[k] if k >= 0 else (0, 0, 0)
        after = found[k + 1] if k + 1 < len(found) else (len(a), len(b), 0)
        skip = max(0, before[0] + before[2] - i, before[1] + before[2] - j)
        left = min(n, after[0] - i, after[1] - j)
        if skip == 0 and left == n:
            starts.insert(k + 1, i)
            found.insert(k + 1, (i, j, n))
            continue
        if left > skip:
            heapq.heappush(queue, (skip - left, i + skip, j + skip))
        if after[0] < i + n:  # what reaches over the next match is looked at from its start
            reach = max(after[0] - i, left, skip)
            if reach < n:
                heapq.heappush(queue, (reach - n, i + reach, j + reach))
    # runs that meet are one
    out: list[list[int]] = []
    for i, j, n in found:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1][2] += n
        else:
            out.append([i, j, n])
    return [tuple(x) for x in out]


def binary_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """Content hash, size and status of binaries by artifact id."""
    def measured(df: DataFrame) -> DataFrame:
        return df.select("aid", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"))

    return artifact_diff(measured(base), measured(target), ["aid"], ["sha256", "size"])


def summary(changes: DataFrame, *by: str) -> DataFrame:
    """Counts of added, removed and modified rows."""
    counts = [F.count(F.when(F.col("change") == c, 1)).alias(f"n_{c}") for c in ("added", "removed", "modified")]
    return changes.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("n_changes"))


#: The counters of a change summary, in their order.
COUNTERS = [
    "files_changed", "files_added", "files_removed", "artifacts_added", "artifacts_modified", "artifacts_removed", "text_fragments_modified", "binary_added", "binary_modified", "binary_removed",
    "extraction_errors",
]


def counters(files: DataFrame, artifacts: DataFrame, texts: DataFrame, binaries: DataFrame, errors: DataFrame, *by: str) -> DataFrame:
    """The eleven counters of a change report, one row (per ``by``). ``files`` has git's ``status``, the others ``change``; each row of ``errors`` counts."""
    status = F.when(F.col("status") == "A", "added").when(F.col("status") == "D", "removed").otherwise("changed")
    parts = [
        files.select(*by, F.concat(F.lit("files_"), status).alias("what")), artifacts.select(*by, F.concat(F.lit("artifacts_"), "change").alias("what")),
        texts.select(*by, F.lit("text_fragments_modified").alias("what")), binaries.select(*by, F.concat(F.lit("binary_"), "change").alias("what")), errors.select(*by, F.lit("extraction_errors").alias("what")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*by).agg(*[F.count(F.when(F.col("what") == c, 1)).alias(c) for c in COUNTERS])


def by_file(changes: DataFrame, path: str = "path", name: str = "aid") -> DataFrame:
    """Changed objects of each file, sorted."""
    return changes.groupBy(path).agg(F.count(F.lit(1)).alias("n_objects"), F.array_join(F.array_sort(F.collect_list(name)), ";").alias("objects"))


def size_text(size: Column) -> Column:
    """A human file size."""
    kib = 1024.0
    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, F.format_string("%.1f KB", size / kib))
        .when(size < 1024**3, F.format_string("%.1f MB", size / kib**2)).otherwise(F.format_string("%.1f GB", size / kib**3))
    )


def match_paths(changed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(changed_path, path): the scanned file that a changed path means: the same path, else the one it ends with.

    Paths meet on their file name, so no pair of unlike names is looked at.
    """
    from pyspark.sql import Window

    name = lambda c: F.substring_index(c, "/", -1)
    left = changed.select(F.col("path").alias("changed_path"), name("path").alias("__n"))
    met = left.join(scanned.select("path", name("path").alias("__n")), "__n")
    same = F.col("changed_path") == F.col("path")
    met = met.filter(same | F.col("changed_path").endswith(F.concat(F.lit("/"), F.col("path"))))
    best = Window.partitionBy("changed_path").orderBy(same.desc(), F.length("path").desc(), "path")
    return met.withColumn("__k", F.row_number().over(best)).filter("__k = 1").select("changed_path", "path")
