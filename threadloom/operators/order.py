"""Numbers, running sums and rows before in an order, without a task that sees all rows or a whole group.

Rows are dealt by ranges of all their order keys and written once, so that the
ranges stay what they are. Each range is summed on its own and shifted by what
the ranges before it hold: one row per range and group. Only rows that are equal
in all keys share a range for sure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import scratch


#: Rows that one task numbers as they are.
SMALL = 4096


def running(df: DataFrame, group: list[str], order: list[str], **values: Column) -> DataFrame:
    """``df`` with, for each name, the sum of its value over the earlier rows of the same group (0 for the first)."""
    valued = scratch.table(df.withColumns({f"__v_{n}": v for n, v in values.items()}), "rows")  # read twice: for the ranges' borders and to be dealt
    if valued.count() <= SMALL:
        earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return valued.select(*df.columns, *[F.coalesce(F.sum(f"__v_{n}").over(earlier), F.lit(0)).alias(n) for n in values])
    ranged = scratch.table(valued.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("__range", *group).agg(*[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    keys = {c: f"__g_{i}" for i, c in enumerate(group)}
    base = held.select(
        F.col("__range").alias("__r"), *[F.col(c).alias(k) for c, k in keys.items()], *[F.coalesce(F.sum(f"__s_{n}").over(earlier), F.lit(0)).alias(f"__b_{n}") for n in values]
    )
    inside = Window.partitionBy("__range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumns({f"__i_{n}": F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)) for n in values})
    on = F.col("__range") == F.col("__r")
    for c, k in keys.items():
        on &= F.col(c).eqNullSafe(F.col(k))
    out = own.join(base if group else F.broadcast(base), on)  # without groups one row per partition
    return out.select(*df.columns, *[(F.col(f"__b_{n}") + F.col(f"__i_{n}")).alias(n) for n in values])


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the row's number 1..n in its group."""
    return running(df, group, order, **{name: F.lit(1).cast("long")}).withColumn(name, F.col(name) + 1)


def previous(df: DataFrame, group: list[str], order: list[str], **values: Column) -> DataFrame:
    """``df`` with, for each name, its value in the row before within the group (null for the first).

    What a range hands on is its last row, not a sum; a range without rows of the group hands on nothing."""
    valued = scratch.table(df.withColumn("__v", F.struct(*[v.alias(n) for n, v in values.items()])), "rows")
    if valued.count() <= SMALL:
        before = F.lag("__v").over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*order))
        return valued.withColumn("__p", before).select(*df.columns, *[F.col(f"__p.{n}").alias(n) for n in values])
    ranged = scratch.table(valued.repartitionByRange(*group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    held = ranged.groupBy("__range", *group).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    ranges = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__range")
    keys = {c: f"__g_{i}" for i, c in enumerate(group)}
    base = held.select(F.col("__range").alias("__r"), *[F.col(c).alias(k) for c, k in keys.items()], F.lag("__last").over(ranges).alias("__carry"))
    inside = Window.partitionBy("__range", *group).orderBy(*order)
    own = ranged.withColumn("__before", F.lag("__v").over(inside))
    on = F.col("__range") == F.col("__r")
    for c, k in keys.items():
        on &= F.col(c).eqNullSafe(F.col(k))
    out = own.join(base if group else F.broadcast(base), on).withColumn("__p", F.coalesce("__before", "__carry"))
    return out.select(*df.columns, *[F.col(f"__p.{n}").alias(n) for n in values])
