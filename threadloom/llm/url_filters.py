"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

Each URL is expanded into the expressions that a rule could have: the last ``n``
labels of its host with the first ``l`` characters of its path, for each pair
(n, l) that some rule has. Expressions meet rules in an equi-join on the first
32 bits of their SHA-256; the full digest confirms, and the rule with the longest
host, then the longest path, wins. Rules are broadcast only up to
``BROADCAST_BYTES`` of them, which is measured; beyond, both sides are exchanged.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
fits no rule; equal rules with opposite actions give ``block``; repeated rows
each get their verdict; an empty table gives an empty result; no rules leave
the default verdict. Other input columns, whatever their names, are dropped. A
very long URL is judged as a whole: the work follows the rules, not its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of rules (with their digests) that may be broadcast.
BROADCAST_BYTES = 16_000_000
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _expressions(host: Column, path: Column, pairs: list[tuple[int, int]]) -> Column:
    """The digests of the expressions of a URL, for the pairs that its host and path are long enough for."""
    labels = F.split(host, r"\.")
    # a constant of two lists, however many pairs there are: no expression for each of them
    every = F.arrays_zip(F.lit([n for n, _ in pairs]).alias("n"), F.lit([size for _, size in pairs]).alias("l"))
    fit = F.filter(every, lambda x: (x["n"] <= F.size(labels)) & (x["l"] <= F.length(path)) & (host != ""))
    return F.transform(fit, lambda x: _digest(F.array_join(F.slice(labels, -x["n"], x["n"]), "."), F.substring(path, F.lit(1), x["l"])))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """(page_id, host, path, rule, verdict) per page. ``rules``: (action, host, path)."""
    # as many pairs as there are label counts times path lengths among the rules: some thousand at most
    pairs = sorted(map(tuple, rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("l")).distinct().collect()))
    keyed = rules.select(
        F.substring(_digest(F.col("host"), F.col("path")), 1, 8).alias("short"), _digest(F.col("host"), F.col("path")).alias("full"), "action", "host", "path"
    ).groupBy("short", "full", "host", "path").agg(F.max("action").alias("action"))
    held = rules.agg(F.sum(F.length("host") + F.length("path") + 160)).first()[0] or 0
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url"))
    if pairs:
        asked = rows.filter(F.instr("__url", "://") > 0).select("__url", F.explode(_expressions(host_of(F.col("__url")), path_of(F.col("__url")), pairs)).alias("__digest"))
        asked = asked.withColumn("short", F.substring("__digest", 1, 8))
        met = asked.join(F.broadcast(keyed) if held <= BROADCAST_BYTES else keyed.hint("merge"), "short").filter(F.col("__digest") == F.col("full"))
        rank = F.struct(F.length("host"), F.length("path"), "host", "path")
        best = met.groupBy("__url").agg(F.max_by(F.struct("action", "host", "path"), rank).alias("best"))
        best = best.select(F.xxhash64("__url").alias("__k"), F.col("__url").alias("__u"), "best")
        rows = rows.join(best, (F.xxhash64("__url") == F.col("__k")) & (F.col("__url") == F.col("__u")), "left")
    else:
        rows = rows.withColumn("best", F.lit(None).cast("struct<action:string,host:string,path:string>"))
    return rows.select(
        "page_id", host_of(F.col("__url")).alias("host"), path_of(F.col("__url")).alias("path"),
        F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )


#: The rules of the registered query.
RULES = "VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')"

ORACLE = rf"""
WITH r AS (SELECT * FROM ({RULES}) t(action, host, path)),
p AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (
  SELECT q.page_id, q.host, q.path, r.action, r.host || r.path AS rule,
         row_number() OVER (PARTITION BY q.page_id ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS k
  FROM q LEFT JOIN r ON (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path))
SELECT page_id, host, path, rule, coalesce(action, '{DEFAULT_VERDICT}') AS verdict FROM m WHERE k = 1
"""
