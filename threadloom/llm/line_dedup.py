"""Line dedup over overlapping three-line windows, in DataFrame functions only.

The content lines of a text are its ``\\n``-split lines that hold a word. A
window is three consecutive content lines, known by the MD5 of the three
lines' MD5s. A window that also occurs earlier, by (id, line), is a later
occurrence: all lines that any later occurrence covers are removed, which
merges overlapping windows. Other lines, blank ones included, stay in order.

Windows are counted with map-side partial aggregation and looked up by a
sort-merge join whose two sides are both exchanged, so that the adaptive skew
join can split a window that very many documents hold.

Edge cases: null ids, null, empty and short texts (under three content lines)
pass unchanged; rows of equal id are ordered by line, and equal positions of
equal ids both stay, so repeated rows share one fate; an empty table gives an
empty result; columns named like an added one are replaced; a very long text is
one row of many windows, handled as a whole in the JVM in time that grows with its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HAS_WORD = r"[^\x20\x09-\x0D]"


def _content(lines: Column) -> Column:
    """0-based numbers of the lines that hold a word."""
    numbered = F.transform(lines, lambda x, i: F.when(x.rlike(_HAS_WORD), i))
    return F.filter(numbered, lambda i: i.isNotNull())


def _held(value: Column) -> Column:
    """A value made once per row: behind a generator the optimiser cannot put its expression into a lambda, to be made again for each element."""
    return F.explode(F.array(value))


def windows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, th, p, w): one row per window; ``p`` numbers content lines, ``th`` is a hash of the text."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(_HAS_WORD))
    digest = F.transform(lines, lambda x: F.unhex(F.md5(x)))
    rows = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("th"), _held(digest).alias("d"))
    spans = F.transform(
        F.sequence(F.lit(0), F.size("d") - 3), lambda i: F.unhex(F.md5(F.concat(F.get("d", i), F.get("d", i + 1), F.get("d", i + 2))))
    )
    return rows.filter(F.size("d") >= 3).select("id", "th", F.posexplode(spans).alias("p", "w"))


def remove_repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten, and ``n_lines`` (content lines) and ``n_removed`` added."""
    place = F.col("id").cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(11,0)") + F.col("p")
    seen = windows(docs, doc_id, text).withColumn("at", place.cast("decimal(31,0)"))
    repeated = (
        seen.groupBy("w").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.xxhash64("w").alias("__k"), F.col("w").alias("__w"), "first")
    )
    later = seen.join(repeated, (F.xxhash64("w") == F.col("__k")) & (F.col("w") == F.col("__w"))).filter("at > first")
    covered = later.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.collect_set("p").alias("__p"))

    added = ["n_lines", "n_removed"]
    keep = [c for c in docs.columns if c not in added]
    joined = docs.select(*keep).join(covered, (F.col(doc_id).cast("long") == F.col("__id")) & (F.xxhash64(text) == F.col("__th")), "left")
    lines = F.split(text, "\n", -1)
    gone = F.array_distinct(F.flatten(F.transform("__p", lambda p: F.sequence(p, p + 2))))
    content = F.filter(lines, lambda x: x.rlike(_HAS_WORD))
    cut = _held(F.when(F.col("__p").isNotNull(), F.struct(lines.alias("lines"), _content(lines).alias("where"), gone.alias("gone"))))
    staged = joined.select(*keep, F.coalesce(F.size(content), F.lit(0)).cast("long").alias("__n"), cut.alias("__s"))
    rest = F.array_except(F.sequence(F.lit(0), F.size("__s.lines") - 1), F.transform("__s.gone", lambda g: F.get("__s.where", g)))
    new_text = F.when(F.col("__s").isNull(), F.col(text)).otherwise(F.array_join(F.transform(rest, lambda i: F.get("__s.lines", i)), "\n"))
    return staged.select(
        *[new_text.alias(c) if c == text else F.col(c) for c in keep],
        F.col("__n").alias("n_lines"), F.coalesce(F.size("__s.gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
c AS (
  SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (
  SELECT doc_id, p, line AS a, lead(line, 1) OVER o AS b, lead(line, 2) OVER o AS d
  FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, d ORDER BY doc_id, p) AS k FROM w WHERE d IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, p + s AS p FROM r, (VALUES (0), (1), (2)) t(s) WHERE k > 1),
kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l
  LEFT JOIN c ON c.doc_id = l.doc_id AND c.i = l.i LEFT JOIN gone g ON g.doc_id = c.doc_id AND g.p = c.p
  WHERE g.p IS NULL GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1),
m AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(m.n, 0) AS n_removed,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""
