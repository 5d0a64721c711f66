"""Traceability matrices: leads outer-joined with their parents or children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import order


def number_rows(df: DataFrame, *keys: str, name: str = "record_number") -> DataFrame:
    """Number rows 1..n in the order of ``keys`` without one task seeing all rows."""
    return order.numbered(df, [], list(keys), name)


def reverse(leads: DataFrame, links: DataFrame) -> DataFrame:
    """(lead_id, linked_id) with every lead; ``links``: (child_id, pid); children sorted, unlinked leads once with ''."""
    pairs = links.select(F.col("pid").alias("lead_id"), F.col("child_id").alias("linked_id")).distinct()
    return leads.select(F.col("aid").alias("lead_id")).join(pairs, "lead_id", "left").withColumn("linked_id", F.coalesce("linked_id", F.lit("")))


def forward(leads: DataFrame, links: DataFrame, known: DataFrame, parent_type: str) -> DataFrame:
    """(lead_id, pos, linked_id): parents of the wanted type and unresolved ids; parents of other types are dropped, leads never."""
    found = links.join(known.select(F.col("aid").alias("pid"), F.col("atype").alias("__type")), "pid", "left")
    good = found.filter(F.col("__type").isNull() | (F.col("__type") == parent_type)).select(F.col("child_id").alias("lead_id"), "pos", F.col("pid").alias("linked_id"))
    out = leads.select(F.col("aid").alias("lead_id")).join(good, "lead_id", "left")
    return out.select("lead_id", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("linked_id", F.lit("")).alias("linked_id"))


def flat(pairs: DataFrame, by: str) -> DataFrame:
    """One row per lead with its linked ids joined by ``; `` in the order of ``by``."""
    ids = F.array_sort(F.collect_list(F.struct(F.col(by).alias("at"), "linked_id")))
    return pairs.groupBy("lead_id").agg(F.array_join(F.transform(ids, lambda x: x["linked_id"]), "; ").alias("linked_ids"))


def record_names(ids: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(aid, record) of the referenced ids that exist."""
    return ids.distinct().join(artifacts.select("aid", "record"), "aid")


