"""Incremental extraction: a file stream whose batches replace the artifacts of the files they bring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, folder: str, pattern: str = "*.md", max_files: int = 1000) -> DataFrame:
    """(path, modified, value) of new files under a folder, as a stream."""
    stream = (
        spark.readStream.format("text").schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).load(folder)
    )
    return stream.select(F.url_decode("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def upsert(spark: SparkSession, table: str, key: str = "path") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: rows of a batch replace the table's rows with the same key.

    The table is written as a new version beside the newest one and then named
    current. Versions are numbered by the table, not by the batch, whose numbers
    begin anew with each checkpoint; a batch that is run again replaces its own
    rows by the same ones.
    """

    def write(batch: DataFrame, _: int) -> None:
        number = _newest(spark, table)
        now, new = current(spark, table), f"{table}/v{number + 1}"
        rows = batch if now is None else now.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)
        rows.write.mode("overwrite").parquet(new)
        _fs(spark, table).create(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_v{number + 1}.done"), True).close()

    return write


def _fs(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _newest(spark: SparkSession, table: str) -> int:
    """The number of the newest finished version, 0 if there is none."""
    done = _fs(spark, table).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/_v*.done"))
    return max((int(s.getPath().getName()[2:-5]) for s in done or []), default=0)


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest finished version of a table, or None."""
    number = _newest(spark, table)
    return spark.read.parquet(f"{table}/v{number}") if number else None
