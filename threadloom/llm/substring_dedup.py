"""Substring dedup: exact repeated word windows by super-k-mer partitioning.

A window is ``k`` consecutive words. The minimiser of a window is the smallest
hash among its runs of ``m`` words; consecutive windows that share it form a
super-k-mer and travel as one packed string to the bucket of that minimiser,
where sorting the windows of all packed strings counts them exactly (equal
hashes are confirmed on the words).

1. Each document lists its minimisers. Those that occur in one document alone
   cannot start a repeated window and are set aside.
2. The others' super-k-mers travel, once per task and distinct string, with the
   smallest and largest document id that hold them.
3. Buckets return, per packed string, the runs of windows with the smallest
   document id that also holds them; occurrences look their string up.

A minimiser with more than ``hot`` distinct super-k-mers, or over ``HOT_BYTES`` of
them, would fill one task: its windows travel singly instead, each to the bucket
of its own words. A super-k-mer of more than ``RUN`` windows is cut.

Edge cases: rows without an id take no part and stay whole; rows of equal id do
not affect each other (equal rows get equal results); a text with fewer than
``k`` words, empty or null stays whole; an empty table gives an empty result.
Other input columns are dropped. Texts are handled one by one beyond a megabyte:
a very long one takes some twenty times its bytes in one worker, and nothing of
it is cut off. Equal hashes are told apart by the words, so results do not rest
on hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store
from threadloom.llm.words import Words, first_equal, joined, mix, slices, tokenize, window_hashes, window_ok

#: Windows of a super-k-mer at most (longer ones travel in pieces), and bytes of the distinct ones of a minimiser that travel together.
RUN, HOT_BYTES = 256, 8_000_000


def runs_of(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and minimiser of each super-k-mer."""
    ok = window_ok(words, k)
    if not ok.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    low, span, width = window_hashes(words.hashes(), m), k - m + 1, 1
    while width < span:  # sliding minimum by doubling
        step = min(width, span - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    at = np.flatnonzero(ok)
    low = low[at]
    of = words.of()[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    pieces = -(-(last - first + 1) // RUN)
    if len(pieces) and pieces.max() > 1:  # in texts like "x x x ..." every window has the same minimiser
        part = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, last = np.repeat(first, pieces) + RUN * part, np.repeat(last, pieces)
        last = np.minimum(first + RUN - 1, last)
    return at[first], at[last], low[first]


def _rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _minimisers(k: int, m: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = tokenize(part.column(1))
                first, last, low = runs_of(words, k, m)
                if not len(first):
                    continue
                of = words.of()[first]
                sums = np.concatenate([[np.uint64(0)], np.cumsum(words.hashes(), dtype=np.uint64)])
                content = mix(sums[last + k] - sums[first])
                size = words.end[last + k - 1] - words.start[first]
                rows = np.unique(np.stack([of.astype(np.int64), low.view(np.int64), content.view(np.int64), size]), axis=1)
                yield _rows(low=pa.array(rows[1]), content=pa.array(rows[2]), doc=pa.array(np.asarray(part.column(0))[rows[0]]), size=pa.array(rows[3].astype(np.int32)))

    return listed


def _travel(k: int, m: int):
    """Occurrences (packed is null) and, once per string, packed strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            rows = _rows(
                digest=pa.array(list(seen), pa.binary()), bucket=pa.array([x[0] for x in seen.values()], pa.int64()),
                packed=pa.array([x[3] for x in seen.values()], pa.binary()), low_doc=pa.array([x[1] for x in seen.values()], pa.int64()),
                high_doc=pa.array([x[2] for x in seen.values()], pa.int64()), th=pa.nulls(len(seen), pa.int64()), at=pa.nulls(len(seen), pa.int64()),
            )
            seen.clear()
            return rows

        for batch in batches:
            for part in slices(batch, "text"):
                words = tokenize(part.column(1))
                ids, ths = np.asarray(part.column(0)), np.asarray(part.column(2))
                cold, hot = part.column(3), part.column(4)
                first, last, low = runs_of(words, k, m)
                of = words.of()[first] if len(first) else first
                packed, start, end = joined(words)
                keys = low.view(np.int64)
                take = np.zeros(len(first), dtype=bool)
                single = np.zeros(len(first), dtype=bool)
                bounds = np.searchsorted(of, np.arange(part.num_rows + 1))
                for d in range(part.num_rows):
                    x = slice(bounds[d], bounds[d + 1])
                    for column, flag in ((cold, take), (hot, single)):
                        if column[d].is_valid and len(column[d]):
                            flag[x] = np.isin(keys[x], column[d].values.to_numpy())
                one = np.flatnonzero(single)
                if len(one):  # windows of hot minimisers travel singly
                    n = last[one] - first[one] + 1
                    solo = np.repeat(first[one] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    solo_of = np.repeat(of[one], n)
                    solo_key = window_hashes(words.hashes(), k)[solo].view(np.int64)
                else:
                    solo = solo_of = solo_key = np.zeros(0, np.int64)
                a = np.concatenate([first[take], solo])
                b = np.concatenate([last[take], solo])
                o = np.concatenate([of[take], solo_of]).astype(np.int64)
                key = np.concatenate([keys[take], solo_key])
                if not len(a):
                    continue
                view, digests = memoryview(packed), []
                for s, e, bucket, doc in zip(start[a].tolist(), end[b + k - 1].tolist(), key.tolist(), ids[o].tolist()):
                    piece = view[s:e]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    digests.append(digest)
                    was = seen.get(digest)
                    if was is None:
                        seen[digest] = [bucket, doc, doc, bytes(piece)]
                        held += e - s
                    elif doc < was[1]:
                        was[1] = doc
                    elif doc > was[2]:
                        was[2] = doc
                n = len(digests)
                yield _rows(
                    digest=pa.array(digests, pa.binary()), bucket=pa.array(key), packed=pa.nulls(n, pa.binary()), low_doc=pa.array(ids[o]),
                    high_doc=pa.array(ids[o]), th=pa.array(ths[o]), at=pa.array(a - words.first[o]),
                )
                if held > 48_000_000:
                    held = 0
                    yield flush()
        if seen:
            yield flush()

    return cut


def repeats_in(packed: list[bytes], low_doc: np.ndarray, high_doc: np.ndarray, k: int) -> list[tuple[int, int, int, int]]:
    """Windows of packed strings that other documents hold: (string, first window, last window, smallest document id)."""
    words = tokenize(pa.array(packed, pa.binary()).cast(pa.string()))
    at = np.flatnonzero(window_ok(words, k))
    key, of = window_hashes(words.hashes(), k)[at], words.of()[at]
    window = first_equal(key, words.data, words.start[at], words.end[at + k - 1])
    low = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(low, window, low_doc[of])
    smallest = low[window]
    hit = np.flatnonzero(smallest < high_doc[of])
    if not len(hit):
        return []
    split = np.ones(len(hit), dtype=bool)
    split[1:] = (np.diff(hit) != 1) | (of[hit[1:]] != of[hit[:-1]]) | (smallest[hit[1:]] != smallest[hit[:-1]])
    a = np.flatnonzero(split)
    b = np.append(a[1:], len(hit)) - 1
    base = words.first[of[hit[a]]]
    return list(zip(of[hit[a]].tolist(), (at[hit[a]] - base).tolist(), (at[hit[b]] - base).tolist(), smallest[hit[a]].tolist()))


def _buckets(k: int):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group, size = None, {}, 0

        def done() -> Iterator[pa.RecordBatch]:
            packed = [x[2] for x in group.values()]
            digests = list(group)
            low, high = (np.array([x[i] for x in group.values()], dtype=np.int64) for i in (0, 1))
            if found := repeats_in(packed, low, high, k):
                s, a, b, d = zip(*found)
                yield _rows(digest=pa.array([digests[i] for i in s], pa.binary()), since=pa.array(a, pa.int64()), till=pa.array(b, pa.int64()), smallest=pa.array(d, pa.int64()))

        for batch in batches:
            for bucket, digest, packed, low, high in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if bucket != now and size > 4_000_000:  # buckets are counted together until they fill this
                    yield from done()
                    group, size = {}, 0
                now = bucket
                was = group.get(digest)
                if was is None:
                    group[digest] = [low, high, packed]
                    size += len(packed)
                else:
                    was[0], was[1] = min(was[0], low), max(was[1], high)
        if group:
            yield from done()

    return counted


def _strike(k: int):
    def strike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = tokenize(part.column(1))
                edge = np.zeros(len(words.start) + 1, dtype=np.int64)
                spans = part.column(2)
                for d in range(part.num_rows):
                    if spans[d].is_valid:
                        s = spans[d].values
                        np.add.at(edge, words.first[d] + np.asarray(s.field(0)), 1)
                        np.add.at(edge, words.first[d] + np.asarray(s.field(1)) + k, -1)
                gone = np.cumsum(edge[:-1]) > 0
                of = words.of()
                kept = Words(words.data, words.start[~gone], words.end[~gone], np.searchsorted(np.flatnonzero(~gone), words.first))
                removed = np.bincount(of[gone], minlength=part.num_rows)
                texts = []
                out, start, end = _join_kept(kept)
                for d in range(part.num_rows):
                    a, b = kept.first[d], kept.first[d + 1]
                    texts.append(out[start[a] : end[b - 1]].tobytes().decode() if b > a else "")
                yield _rows(doc_id=part.column(0), n_words=pa.array(words.counts.astype(np.int64)), n_removed=pa.array(removed.astype(np.int64)), kept_text=pa.array(texts, pa.string()))

    return strike


def _join_kept(kept: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(kept.data) + 1, dtype=np.int8)
    inside[kept.start] += 1
    inside[kept.end] -= 1
    mask = np.cumsum(inside[:-1]).astype(bool)
    length = kept.end - kept.start
    end = np.cumsum(length + 1)
    out = np.full(int(end[-1]) if len(end) else 0, 0x20, dtype=np.uint8)
    put = np.ones(len(out), dtype=bool)
    put[end - 1] = False
    out[put] = kept.data[mask]
    return out, end - length - 1, end - 1


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = 50, m: int = 8, hot: int = 4096) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) per row: words covered by a window that a smaller id also holds are gone."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with_id = rows.filter(F.col("doc_id").isNotNull())
    lows = store.table(with_id.mapInArrow(_minimisers(k, m), "low long, content long, doc long, size int"), "minimisers")
    met = (
        lows.groupBy("low", "content").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("size").cast("long").alias("size"))
        .groupBy("low").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
        .filter("a < b").select(F.xxhash64("low").alias("__key"), F.col("low").alias("__low"), ((F.col("n") > hot) | (F.col("size") > HOT_BYTES)).alias("hot"))
    )
    lists = (
        lows.join(met, (F.xxhash64("low") == F.col("__key")) & (F.col("low") == F.col("__low")))
        .groupBy(F.col("doc").alias("__doc"))
        .agg(F.collect_set(F.when(~F.col("hot"), F.col("low"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("low"))).alias("hot"))
    )
    sent = with_id.join(lists, F.col("doc_id") == F.col("__doc")).select("doc_id", "text", F.xxhash64("text").alias("th"), "cold", "hot")
    moved = store.table(
        sent.mapInArrow(_travel(k, m), "digest binary, bucket long, packed binary, low_doc long, high_doc long, th long, at long"), "superkmers"
    )
    store.drop(lows)
    strings = moved.filter("packed is not null").select("bucket", "digest", "packed", "low_doc", "high_doc")
    found = strings.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_buckets(k), "digest binary, since long, till long, smallest long")
    spans = (
        moved.filter("packed is null").select("digest", "low_doc", "th", "at").join(found, "digest").filter("smallest < low_doc")
        .groupBy(F.col("low_doc").alias("__doc"), F.col("th").alias("__th"))
        .agg(F.collect_set(F.struct((F.col("at") + F.col("since")).alias("a"), (F.col("at") + F.col("till")).alias("b"))).alias("spans"))
    )
    keyed = rows.join(spans, (F.col("doc_id") == F.col("__doc")) & (F.xxhash64("text") == F.col("__th")), "left")
    return keyed.select("doc_id", "text", "spans").mapInArrow(_strike(k), "doc_id long, n_words long, n_removed long, kept_text string")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS a FROM documents),
w AS (SELECT doc_id, unnest(a) AS word, generate_subscripts(a, 1) AS j, len(a) AS n, a FROM d),
v AS (SELECT doc_id, j, array_to_string(a[j : j + 49], chr(10)) AS k FROM w WHERE j + 49 <= n),
f AS (SELECT k, min(doc_id) AS m FROM v GROUP BY 1),
s AS (SELECT DISTINCT v.doc_id, v.j FROM v JOIN f ON f.k = v.k AND f.m < v.doc_id),
c AS (
  SELECT w.doc_id, w.j, w.word, max(s.j) OVER (PARTITION BY w.doc_id ORDER BY w.j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last
  FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.j = w.j),
g AS (
  SELECT doc_id, count(*) FILTER (WHERE j - last < 50) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE last IS NULL OR j - last >= 50) AS kept
  FROM c GROUP BY 1)
SELECT d.doc_id, len(d.a)::BIGINT AS n_words, coalesce(g.n_removed, 0) AS n_removed, sha256(coalesce(g.kept, '')) AS kept_sha256
FROM d LEFT JOIN g ON g.doc_id = d.doc_id
"""
