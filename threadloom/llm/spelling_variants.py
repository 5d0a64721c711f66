"""Spelling variant grouping: words of one edit's distance by an even-partition pigeonhole join.

Words are counted over all texts in one pass; a task adds up what it sees first.

A word of length L is cut into two even parts, one of which an edit leaves as it
is. The index holds both parts of every word under (L, part). A word probes for
equal length with its own parts, and for words one shorter (it is the one that has
a letter more) with the part in place, if the letter was put in behind it, or
shifted by one, if it was put in before. What a bucket has in common is settled;
the rest of its words differs by one edit again. So a bucket of too many pairs is
cut again by the same rule, over and over until the rests have one letter: no
bucket makes many pairs of words that are far apart, none is dropped, and a hot
bucket is never one group. Pairs found twice count once and are verified.

A word's form is its most frequent near word, if that is at least twice as
frequent; roots follow forms by doubling the pointers, cut by tables.

Edge cases: null and empty texts have no words; a null id counts as an empty one in
the hash; equal rows count as often as they occur; an empty table gives an empty
result; other columns are dropped, whatever their names. A long text is worked off
in stretches of a megabyte cut outside of words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store

#: Fixed values of the words: what a run is, and the hash by which runs lose a letter.
RUN, DAMAGE = "[a-zÀ-ÿ]+", 97
LETTERS, TIMES, RATIO = 5, 3, 2
#: Pairs that a bucket makes before it is cut again; distinct words that a task holds; code points of a stretch.
PAIRS, HELD, STRETCH = 256, 300_000, 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def stretches(text: str) -> Iterator[str]:
    """Parts of about a megabyte, cut where no run goes on."""
    at, outside = 0, re.compile(r"[^a-zÀ-ÿ]")
    while len(text) - at > STRETCH and (cut := outside.search(text, at + STRETCH)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, damage: int | None = DAMAGE, letters: int = LETTERS) -> DataFrame:
    """(word, n) of the words of ``letters`` code points or more, of which ``damage`` makes one in so many lose a letter."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, crc, seen = re.compile(RUN).findall, zlib.crc32, {}

        def flush() -> pa.RecordBatch:
            kept = {w: n for w, n in seen.items() if len(w) >= letters}
            seen.clear()
            return pa.RecordBatch.from_pydict({"word": pa.array(list(kept), pa.string()), "n": pa.array(list(kept.values()), pa.int64())})

        for batch in batches:
            for key, whole in zip(*batch.columns):
                head = crc(f"{key.as_py() or ''}:".encode())
                lowered = (whole.as_py() or "").encode().translate(_LOWER).decode()
                for part in stretches(lowered):
                    for run, n in Counter(runs(part)).items():
                        if damage and not (h := crc(run.encode(), head)) % damage:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        seen[run] = seen.get(run, 0) + n
                    if len(seen) > HELD:
                        yield flush()
        yield flush()

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(add_up, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row (key, side, m, rest, word, n) under both parts of its rest: ``m`` is the length of the indexed rests; those that probe (side 1) have a letter more."""
    h, after = F.floor(F.col("m") / 2).cast("int"), F.length("rest")
    start = F.struct(F.xxhash64("key", F.lit(1), F.substring("rest", F.lit(1), h)).alias("key"), (F.col("m") - h).alias("m"), F.substring("rest", h + 1, after).alias("rest"))
    end = F.struct(F.xxhash64("key", F.lit(2), F.substring("rest", h + 1 + F.col("side"), after)).alias("key"), h.alias("m"), F.substring("rest", F.lit(1), h + F.col("side")).alias("rest"))
    return rows.select("side", "word", "n", F.explode(F.array(start, end)).alias("p")).select("p.key", "side", "p.m", "p.rest", "word", "n")


def _candidates(rows: DataFrame) -> DataFrame:
    """Pairs (a, an, b, bn) of the words of a bucket, an indexed and a probing one, or two of one length."""
    a = rows.filter("side = 0").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    b = rows.select(F.col("key").alias("__k"), "side", F.col("word").alias("b"), F.col("n").alias("bn"))
    return a.join(b.hint("merge"), (F.col("key") == F.col("__k")) & ((F.col("side") == 1) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1)).select("a", "an", "b", "bn")


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, an, b, bn): every pair of distinct words (word, n) that differ by one edit, once."""
    each = words.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "word", "n")
    length = F.length("word") - F.col("side")
    rows = _cut(each.select(F.xxhash64(length).alias("key"), "side", length.alias("m"), F.col("word").alias("rest"), "word", "n"))
    found = None
    while True:  # rests get half as long each time
        rows = store.table(rows, "parts")
        many = (F.col("i") * (F.col("i") + F.col("p")) > pairs) & (F.col("m") > 1)
        sizes = rows.groupBy("key").agg(F.sum(1 - F.col("side")).alias("i"), F.sum("side").alias("p"), F.max("m").alias("m"))
        hot = store.table(sizes.filter(many).select(F.col("key").alias("__hot")), "hot")
        n = hot.count()
        some = F.broadcast(hot) if n <= 500_000 else hot.hint("merge")
        cold = rows.join(some, F.col("key") == F.col("__hot"), "left_anti") if n else rows
        found = _candidates(cold) if found is None else found.union(_candidates(cold))
        if not n:
            return found.distinct()
        rows = _cut(rows.join(some, F.col("key") == F.col("__hot"), "left_semi"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words (word, form) that have a form: each round doubles the way that is followed."""
    now = store.table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        step = now.join(ahead.hint("merge"), F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved"))
        then = store.table(step, "roots")
        moved = not then.filter("moved").isEmpty()
        store.drop(now)
        now = then.select("word", "root")
        if not moved:
            return now


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words (word, n)."""
    pairs = near_words(words)
    both = pairs.select(F.col("a").alias("__w"), "an", F.col("b").alias("near"), F.col("bn").alias("near_n")).union(pairs.select("b", "bn", "a", "an"))
    best = both.groupBy("__w").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    joined = words.join(best.hint("merge"), F.col("word") == F.col("__w"), "left")
    has = -F.col("best.n") >= ratio * F.col("n")
    formed = store.table(joined.select("word", "n", F.coalesce("k", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")), "forms")
    roots = _roots(formed.filter("form is not null").select("word", "form")).select(F.col("word").alias("__w"), "root")
    return formed.join(roots.hint("merge"), F.col("word") == F.col("__w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, damage: int | None = DAMAGE, letters: int = LETTERS, times: int = TIMES) -> DataFrame:
    """The words of ``docs`` that occur ``times`` or more, with their forms and roots."""
    counts = word_counts(docs, doc_id, text, damage=damage, letters=letters)
    return group(store.table(counts.filter(F.col("n") >= times), "words"))
