"""Notebook files: JSON text to cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(files: DataFrame) -> DataFrame:
    """Explode notebooks (path, value, ...) into (..., cell, cell_type, source).

    ``source`` may be a string or an array of lines. A file that is not a
    notebook gives one row with cell -1 and cell_type ``error``.
    """
    rest = [c for c in files.columns if c != "value"]
    parsed = files.withColumn("__v", F.try_parse_json("value"))
    ok = F.schema_of_variant("__v").startswith("OBJECT<") & F.try_variant_get("__v", "$.cells", "array<variant>").isNotNull()
    listed = F.when(ok, F.try_variant_get("__v", "$.cells", "array<variant>")).otherwise(F.array(F.lit(None).cast("variant")))
    rows = parsed.select(*rest, ok.alias("__ok"), F.posexplode(listed).alias("cell", "__c"))
    lines = F.array_join(F.try_variant_get("__c", "$.source", "array<string>"), "")
    return rows.select(
        *rest, F.when(F.coalesce("__ok", F.lit(False)), F.col("cell")).otherwise(F.lit(-1)).alias("cell"),
        F.when(F.coalesce("__ok", F.lit(False)), F.try_variant_get("__c", "$.cell_type", "string")).otherwise(F.lit("error")).alias("cell_type"),
        F.coalesce(lines, F.try_variant_get("__c", "$.source", "string")).alias("source"),
    )
