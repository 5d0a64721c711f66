"""Mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are shuffled by a seeded digest and laid end to end;
the stream, repeated for each pass, is cut into blocks of ``block`` words. Slot
``i`` of the mixture belongs to the source whose interval of cumulative targets
holds the golden-ratio point ``frac(i * 0.618...)``; the r-th slot of a source
takes block ``r`` of its stream. Slots past a target are void; blocks that the
points left over follow at the end, so that every target is met to the word.

Positions in streams and ranks of slots are running sums over ranges of rows, so
a source that holds a third of all rows is never one task; so are the cumulative
targets, so many sources are not one task either. What the driver sees is one
number per round of the target search.

Edge cases: null sources form one source, ordered last; null and empty texts
have size 0 and are never taken; null ids are kept; repeated rows are separate
documents; ties of the shuffle are ordered by id, size and ``carry``; an empty
table gives an empty result; a very long text is counted as a whole and spans
many blocks; other input columns, whatever their names, are dropped unless named
in ``carry``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store
from threadloom.operators import order

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = 0.6180339887498949
#: frac(GOLDEN * 2**20), so that the point of a large slot keeps its low digits.
GOLDEN_20 = (int(0x9E3779B97F4A7C15) << 20) % (1 << 64) / (1 << 64)
#: Words of a slot.
BLOCK = 256


def golden(slot: Column) -> Column:
    """The point of a slot in [0, 1)."""
    u = F.floor(slot / 1048576) * F.lit(GOLDEN_20) + (slot % 1048576) * F.lit(GOLDEN)
    return u - F.floor(u)


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, repeating over sources in code-point order."""
    return ((rank - 1) % 3 + 1).cast("double")


def sized(docs: DataFrame, doc_id: str, source: str, text: str, seed: int, carry: list[str]) -> DataFrame:
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *carry)
    return rows.withColumn("turn", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"))))


def targets(sizes: DataFrame, weight=cyclic_weight, cap: float = 3.0) -> DataFrame:
    """(sid, source, source_size, weight, target, words, before) per source.

    Targets share the total by weight; those above ``cap`` times their source's
    size stop there, and the excess is shared again until none is above.
    ``words`` is the target in whole words, ``before`` the words of earlier sources.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("no_name", F.col("source").isNull())
    sources = store.table(order.numbered(sources, [], ["no_name", "source"], "sid").drop("no_name").withColumn("weight", weight(F.col("sid"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, F.lit(False)
    while total:
        held = sources.agg(F.sum(F.when(stopped, cap * F.col("source_size")).otherwise(0.0)), F.sum(F.when(stopped, 0.0).otherwise(F.col("weight")))).first()
        new = (total - held[0]) / held[1] if held[1] else level
        if new <= level:
            break
        level = new
        stopped = cap * F.col("source_size") < F.lit(level) * F.col("weight")
    out = sources.withColumn("target", F.least(cap * F.col("source_size"), F.lit(level) * F.col("weight"))).withColumn("words", F.floor("target"))
    return order.running(out, [], ["sid"], before=F.col("words"))


def schedule(sources: DataFrame, block: int, point=golden) -> DataFrame:
    """(slot, sid, rank): which block of which source each slot of the mixture takes. ``sources``: (sid, words, before)."""
    total, n = sources.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1))).first()
    slots, bins = -(-total // block), max(1024, 4 * n)
    points = sources.sparkSession.range(slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("u")).withColumn("bin", F.floor(F.col("u") * bins))
    lo, hi = F.col("before") / F.lit(max(total, 1)), (F.col("before") + F.col("words")) / F.lit(max(total, 1))
    some = sources.filter("words > 0").select("sid", lo.alias("lo"), hi.alias("hi"))
    spans = some.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * bins), F.least(F.floor(F.col("hi") * bins), F.lit(bins - 1).cast("long")))))
    owned = points.join(spans, "bin").filter("lo <= u and u < hi").select("slot", "sid")
    ranked = order.running(owned, ["sid"], ["slot"], rank=F.lit(1).cast("long"))
    need = sources.select("sid", F.ceil(F.col("words") / block).alias("need"))
    full = ranked.join(need, "sid").filter("rank < need").select("slot", "sid", "rank")
    got = full.groupBy("sid").agg(F.count(F.lit(1)).alias("got"))
    short = need.join(got, "sid", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    short = order.running(short, [], ["sid"], first=F.col("need") - F.col("got"))
    rest = short.withColumn("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1))).select((slots + F.col("first") + F.col("rank") - F.col("got")).alias("slot"), "sid", "rank")
    return full.unionByName(rest)


def pieces(stream: DataFrame, block: int, passes: int) -> DataFrame:
    """Each document's passes cut at block borders: adds ``pass``, ``rank`` (block of the stream), ``first_word`` and ``last_word`` of the document."""
    through = stream.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    through = through.withColumn("begin", F.col("pass") * F.col("source_size") + F.col("at")).filter("begin < words")
    until = F.least(F.col("begin") + F.col("size"), F.col("words"))
    cut = through.withColumn("rank", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((until - 1) / block))))
    low, high = F.greatest(F.col("begin"), F.col("rank") * block), F.least(until, (F.col("rank") + 1) * block)
    return cut.withColumns({"first_word": low - F.col("begin"), "last_word": high - F.col("begin") - 1}).drop("begin")


def mixture(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *,
    block: int = BLOCK, seed: int = 1, weight=cyclic_weight, cap: float = 3.0, carry: list[str] | None = None, point=golden,
) -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, source, size, source_size, target, at, sid, ``carry``) and the mixture made of them:
    (slot, sid, at, pass, first_word, last_word) says which words of which document each slot holds."""
    carry = list(carry or [])
    sizes = store.table(sized(docs, doc_id, source, text, seed, carry), "sizes")
    sources = store.table(targets(sizes, weight, cap), "targets")
    plan = schedule(sources, block, point).withColumnRenamed("sid", "__sid").withColumnRenamed("rank", "__rank")
    few = sources.select(F.col("source").alias("__s"), "sid", "source_size", "target", "words")
    placed = sizes.join(few, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    stream = store.table(order.running(placed, ["sid"], ["turn", "doc_id", "size", *carry], at=F.col("size")).drop("turn"), "stream")
    cut = pieces(stream.select("sid", "at", "size", "source_size", "words", "doc_id", *carry), block, math.ceil(cap))
    held = cut.join(plan, (F.col("sid") == F.col("__sid")) & (F.col("rank") == F.col("__rank")))
    return stream.drop("words"), held.select("slot", "sid", "at", "doc_id", "pass", "first_word", "last_word", *carry)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, first_slot, n_slots, slots_md5) per document.

    ``taken`` counts the words that the mixture's slots hold, ``slots_md5`` is the MD5 of ``slot:pass:first-last`` for each of
    them, in the order of slots."""
    stream, held = mixture(docs, doc_id, source, text, **options)
    shown = F.concat(F.col("slot").cast("string"), F.lit(":"), F.col("pass").cast("string"), F.lit(":"), F.col("first_word").cast("string"), F.lit("-"), F.col("last_word").cast("string"))
    per = held.filter("last_word >= first_word").groupBy("sid", "at").agg(
        F.sum(F.col("last_word") - F.col("first_word") + 1).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", shown.alias("shown")))), lambda x: x["shown"]), ";")).alias("slots_md5"),
    ).withColumnRenamed("sid", "__sid").withColumnRenamed("at", "__at")
    # documents without words share their place with the next one, and take nothing
    out = stream.join(per, (F.col("sid") == F.col("__sid")) & (F.col("at") == F.col("__at")) & (F.col("size") > 0), "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_slots", none).alias("n_slots"), "slots_md5")


ORACLE = rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS sid FROM src),
w AS (SELECT *, ((sid - 1) % 3 + 1)::DOUBLE AS weight FROM n),
v AS (SELECT *, 3e0 * source_size / weight AS full_at, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights FROM w),
f AS (
  SELECT *, (total - coalesce(sum(3e0 * source_size) OVER o, 0)) / (weights - coalesce(sum(weight) OVER o, 0)) AS level
  FROM v WINDOW o AS (ORDER BY full_at, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT level FROM f WHERE full_at >= level ORDER BY full_at, sid LIMIT 1),
t AS (SELECT sid, source, source_size, least(3e0 * source_size, (SELECT level FROM l) * weight) AS target FROM w),
t2 AS (SELECT *, floor(target)::BIGINT AS words FROM t),
t3 AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         (sum(words) OVER ())::BIGINT AS all_words FROM t2),
iv AS (SELECT sid, before::DOUBLE / all_words AS lo, (before + words)::DOUBLE / all_words AS hi FROM t3 WHERE words > 0),
p AS (
  SELECT i AS slot, (i // 1048576) * {GOLDEN_20!r}::DOUBLE + (i % 1048576) * {GOLDEN!r}::DOUBLE AS u
  FROM range((SELECT (max(all_words) + {BLOCK - 1}) // {BLOCK} FROM t3)) r(i)),
o AS (SELECT slot, sid FROM (SELECT slot, u - floor(u) AS u FROM p) q JOIN iv ON lo <= u AND u < hi),
r AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM o),
need AS (SELECT sid, (words + {BLOCK - 1}) // {BLOCK} AS need FROM t3),
ful AS (SELECT slot, sid, rank FROM r JOIN need USING (sid) WHERE rank < need),
got AS (SELECT sid, need, (SELECT count(*) FROM ful WHERE ful.sid = need.sid) AS got FROM need),
sh AS (SELECT *, coalesce(sum(need - got) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM got WHERE got < need),
rest AS (
  SELECT (SELECT count(*) FROM p) + first + k AS slot, sid, got + k AS rank
  FROM (SELECT *, unnest(range(need - got)) AS k FROM sh)),
plan AS (SELECT slot, sid, rank FROM ful UNION ALL SELECT slot, sid, rank FROM rest),
st AS (
  SELECT s.doc_id, s.size, t3.source_size, t3.target, t3.words, t3.sid,
         coalesce(sum(s.size) OVER (PARTITION BY t3.sid ORDER BY md5('1:' || coalesce(s.doc_id::VARCHAR, '') || ':' || s.size), s.doc_id, s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM s JOIN t3 ON s.source IS NOT DISTINCT FROM t3.source),
th AS (SELECT *, pass * source_size + pos AS opens FROM st, range(3) x(pass) WHERE size > 0),
c AS (SELECT *, least(opens + size, words) AS until FROM th WHERE opens < words),
k AS (SELECT *, unnest(range(opens // {BLOCK}, (until - 1) // {BLOCK} + 1)) AS rank FROM c),
h AS (
  SELECT k.sid, k.pos, plan.slot, pass, greatest(opens, k.rank * {BLOCK}) - opens AS a, least(until, (k.rank + 1) * {BLOCK}) - opens - 1 AS b
  FROM k JOIN plan ON plan.sid = k.sid AND plan.rank = k.rank),
g AS (
  SELECT sid, pos, sum(b - a + 1)::BIGINT AS taken, min(slot)::BIGINT AS first_slot, count(*) AS n_slots,
         md5(string_agg(slot || ':' || pass || ':' || a || '-' || b, ';' ORDER BY slot)) AS slots_md5
  FROM h GROUP BY 1, 2)
SELECT st.doc_id, st.size, st.source_size, st.target, coalesce(g.taken, 0) AS taken, g.first_slot, coalesce(g.n_slots, 0) AS n_slots, g.slots_md5
FROM st LEFT JOIN g ON g.sid = st.sid AND g.pos = st.pos AND st.size > 0
"""
