"""Where intermediate tables live: one folder per application in the shared folder of the session.

Lineage is cut by Parquet tables in the folder that ``spark.checkpoint.dir``
names. Only a local master may do without one: a temporary folder is made then.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of this application, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.threadloom.scratch", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="threadloom-")
        spark.conf.set("spark.threadloom.scratch", base)
    return f"{base.rstrip('/')}/threadloom-{spark.sparkContext.applicationId}"


def shared_path(spark: SparkSession) -> str:
    """The shared folder as a path of the file system, for files that the driver writes and executors read."""
    base = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not (base.startswith("/") or base.startswith("file:")):
        raise RuntimeError("this needs a spark.checkpoint.dir that is mounted as a folder")
    return "/" + base.removeprefix("file:").lstrip("/")


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and return the reader of it."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tl_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(df: DataFrame) -> None:
    """Delete a table made by :func:`table` that nothing will read again."""
    if getattr(df, "_tl_path", None) is not None:
        _delete(df.sparkSession, df._tl_path)


def clean(spark: SparkSession) -> None:
    """Delete all tables of this application; call it when their results have been read or written."""
    _delete(spark, folder(spark))
