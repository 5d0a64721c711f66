"""Latest revisions, stale links and task plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_revisions(revisions: DataFrame) -> DataFrame:
    return revisions.dropDuplicates(["aid", "hash_long"])


def newest_first(revisions: DataFrame) -> DataFrame:
    """(aid, n_revisions, newest, revisions) with all revisions of an artifact as text, the newest first (H3)."""
    shown = F.concat("hash_short", F.lit(" ("), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" by "), "author_email", F.lit(")"))
    listed = F.sort_array(F.collect_list(F.struct("ts", "hash_long", shown.alias("shown"))), asc=False)
    rows = distinct_revisions(revisions).groupBy("aid").agg(listed.alias("r"))
    return rows.select("aid", F.size("r").cast("long").alias("n_revisions"), F.get("r", F.lit(0))["shown"].alias("newest"), F.array_join(F.transform("r", lambda x: x["shown"]), "; ").alias("revisions"))


def latest_revision(revisions: DataFrame) -> DataFrame:
    """The newest revision of each artifact; equal times are decided by the full hash."""
    rest = [c for c in revisions.columns if c != "aid"]
    return revisions.groupBy("aid").agg(F.max_by(F.struct(*rest), F.struct("ts", "hash_long")).alias("__r")).select("aid", *[F.col(f"__r.{c}").alias(c) for c in rest])


def trace_mode(edges: DataFrame, trace_rules: DataFrame) -> DataFrame:
    """Add ``mode``: that of the first rule from the child's type to the parent's, else timestamp."""
    first = Window.partitionBy("source", "target").orderBy("rule_no")
    modes = trace_rules.select("source", "rule_no", "mode", F.explode("targets").alias("target")).withColumn("__k", F.row_number().over(first)).filter("__k = 1")
    modes = F.broadcast(modes.select(F.col("source").alias("child_type"), F.col("target").alias("parent_type"), F.col("mode").alias("__mode")))
    return edges.join(modes, ["child_type", "parent_type"], "left").withColumn("mode", F.coalesce("__mode", F.lit("timestamp"))).drop("__mode")


def stale_by_time(links: DataFrame, latest: DataFrame) -> DataFrame:
    """Links whose parent is strictly newer; a missing revision is never stale."""
    c = latest.select(F.col("aid").alias("child_id"), F.col("ts").alias("child_ts"))
    p = latest.select(F.col("aid").alias("pid"), F.col("ts").alias("parent_ts"))
    return links.join(c, "child_id").join(p, "pid").filter("parent_ts > child_ts")


def stale_by_commit(links: DataFrame, latest: DataFrame) -> DataFrame:
    """Links pinned to a revision that is neither the short nor the long hash of the parent's latest."""
    p = latest.select(F.col("aid").alias("pid"), "hash_long", "hash_short")
    return links.filter("nominal_revision is not null").join(p, "pid").filter("nominal_revision != hash_long and nominal_revision != hash_short")


def task_plan(stale: DataFrame, existing: DataFrame) -> DataFrame:
    """(task_id, action): a task per stale link; it is written when new or when either revision differs from the existing one."""
    tasks = stale.withColumn("task_id", F.concat_ws("-", F.lit("TASK-IMPACT"), "child_id", "pid"))
    old = existing.select("task_id", F.col("child_rev").alias("__c"), F.col("parent_rev").alias("__p"), F.lit(True).alias("__old"))
    same = F.col("child_rev").eqNullSafe(F.col("__c")) & F.col("parent_rev").eqNullSafe(F.col("__p"))
    action = F.when(F.col("__old").isNull(), "create").when(same, "skip").otherwise("update")
    return tasks.join(old, "task_id", "left").withColumn("action", action).drop("__c", "__p", "__old")
