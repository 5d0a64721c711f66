"""The driver's star-schema tables seen as artifacts, links and revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.model import fields, listed, scalar

LINE_ORDER = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def make_id(prefix: str, *keys: str) -> Column:
    return F.concat_ws("-", F.lit(prefix), *[F.col(k).cast("string") for k in keys])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORD artifacts with status, priority and a parent reference."""
    return read(spark, sf_dir, "orders").select(
        F.lit("orders").alias("record"), F.lit("ORD").alias("atype"), make_id("ORD", "o_orderkey").alias("aid"), F.col("o_orderkey").alias("key"),
        make_id("CUS", "o_custkey").alias("parent"), F.col("o_orderdate").alias("ts"),
        fields(status=scalar(F.col("o_orderstatus")), priority=scalar(F.col("o_orderpriority")), tags=listed(F.split("o_orderpriority", "-"))).alias("fields"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        F.lit("customers").alias("record"), F.lit("CUS").alias("atype"), make_id("CUS", "c_custkey").alias("aid"), F.col("c_custkey").alias("key"),
        make_id("NTN", "c_nationkey").alias("parent"), fields(name=scalar(F.col("c_name")), segment=scalar(F.col("c_mktsegment"))).alias("fields"),
    )


def lines(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    """LIN occurrences in their reading order: ids repeat; ``occurrence`` numbers them."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*LINE_ORDER)
    return read(spark, sf_dir, "lineitem").withColumn("occurrence", F.row_number().over(order)).select(
        F.lit("lines").alias("record"), F.lit("LIN").alias("atype"), make_id("LIN", "l_orderkey", "l_linenumber").alias("aid"), "occurrence",
        make_id("ORD", "l_orderkey").alias("parent"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("ts"), *(extra or []),
    )


def first_lines(spark: SparkSession, sf_dir: str, extra: list[str] | None = None) -> DataFrame:
    """LIN artifacts, the first occurrence of each id."""
    return lines(spark, sf_dir, extra).filter("occurrence = 1")


def line_links(first: DataFrame) -> DataFrame:
    """(child_id, pos, pid): order, part and supplier of each line."""
    pids = F.array(F.col("parent"), make_id("PRT", "l_partkey"), make_id("SUP", "l_suppkey"))
    return first.select(F.col("aid").alias("child_id"), F.posexplode(pids).alias("pos", "pid"))


def identities(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """(aid, atype, record) of the named tables' artifacts."""
    keys = {
        "region": ("RGN", "regions", ["r_regionkey"]), "nation": ("NTN", "nations", ["n_nationkey"]), "customer": ("CUS", "customers", ["c_custkey"]),
        "supplier": ("SUP", "suppliers", ["s_suppkey"]), "part": ("PRT", "parts", ["p_partkey"]), "orders": ("ORD", "orders", ["o_orderkey"]),
    }
    out = None
    for name in names:
        atype, record, columns = keys[name]
        part = read(spark, sf_dir, name).select(make_id(atype, *columns).alias("aid"), F.lit(atype).alias("atype"), F.lit(record).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out


def hierarchy_links(spark: SparkSession, sf_dir: str, deep: bool = False) -> DataFrame:
    """(child_id, pos, pid) of nations, customers, suppliers and orders; ``deep`` adds the first lines."""
    pairs = [("nation", "NTN", "n_nationkey", "RGN", "n_regionkey"), ("customer", "CUS", "c_custkey", "NTN", "c_nationkey"), ("supplier", "SUP", "s_suppkey", "NTN", "s_nationkey"), ("orders", "ORD", "o_orderkey", "CUS", "o_custkey")]
    out = None
    for table, child, ck, parent, pk in pairs:
        part = read(spark, sf_dir, table).select(make_id(child, ck).alias("child_id"), F.lit(0).alias("pos"), make_id(parent, pk).alias("pid"))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(line_links(first_lines(spark, sf_dir))) if deep else out
