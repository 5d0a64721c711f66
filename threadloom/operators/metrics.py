"""Requirement metrics and error groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.model import vals

#: Error categories in report order.
CATEGORIES = ["extraction", "duplicate", "schema", "attribute", "reference", "trace", "structure"]


def to_be_defined(marker: str = "TBD") -> Column:
    """Whether any value of any attribute holds the marker (case-sensitive)."""
    return F.exists(F.map_values("fields"), lambda v: F.exists(v["vals"], lambda x: F.contains(x, F.lit(marker))))


def by_status(artifacts: DataFrame, field: str = "status") -> DataFrame:
    """(status, count); a missing status is UNKNOWN."""
    return artifacts.groupBy(F.coalesce(F.array_join(vals(field), ", "), F.lit("UNKNOWN")).alias("status")).agg(F.count(F.lit(1)).alias("count"))


def percentages(artifacts: DataFrame, *by: str, verify: str = "verify", marker: str = "TBD") -> DataFrame:
    """(total, pct_without_verify, pct_tbd), overall or per ``by``."""
    share = lambda c: F.round(100.0 * F.avg(c.cast("int")), 6)
    return artifacts.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), share(vals(verify).isNull()).alias("pct_without_verify"), share(to_be_defined(marker)).alias("pct_tbd"))


def by_input(artifacts: DataFrame) -> DataFrame:
    """Metrics per input record, only when more than one record contributes."""
    several = artifacts.agg(F.countDistinct("record").alias("n")).filter("n > 1")
    return percentages(artifacts, "record").crossJoin(F.broadcast(several)).drop("n")  # one row at most


def error_groups(violations: DataFrame) -> DataFrame:
    """(input_record, category, n) with the report's order: errors without an input first, then by input and category."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    groups = violations.groupBy(F.coalesce("input_record", F.lit("Global")).alias("input_record"), "category").agg(F.count(F.lit(1)).alias("n"))
    return groups.withColumn("category_order", place).withColumn("is_global", F.col("input_record") == "Global")
