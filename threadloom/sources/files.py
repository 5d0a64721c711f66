"""Small file sources: CSV mappings, task files, binary properties."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_mapping(spark: SparkSession, path: str, id_column: str, value_column: str, delimiter: str = ",") -> DataFrame:
    """(line_no, id, value) of a CSV file, trimmed, blank ids dropped; the last row of an id wins where it is used.

    The file is read as one text, so that its lines keep their order however large it is."""
    whole = spark.read.format("text").option("wholetext", "true").load(path)
    head = next(csv.reader(io.StringIO((whole.select(F.substring("value", 1, 100_000)).first() or [""])[0]), delimiter=delimiter), [])
    names = [c.strip().lstrip("﻿") for c in head]
    for c in (id_column, value_column):
        if c not in names:
            raise ValueError(f"{path} has no column {c}")
    a, b = names.index(id_column), names.index(value_column)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                rows = [(n, r[a].strip(), r[b].strip() if len(r) > b else "") for n, r in enumerate(csv.reader(io.StringIO(text), delimiter=delimiter)) if n and len(r) > a and r[a].strip()]
                yield pd.DataFrame(rows, columns=["line_no", "id", "value"])

    return whole.mapInPandas(read, "line_no long, id string, value string")


_FRONT = re.compile(r"\A---\s*\n(.*?)\n---\s*(?:\n|\Z)", re.S)
TASKS = "path string, task_id string, status string, child_rev string, parent_rev string"


def existing_tasks(files: DataFrame) -> DataFrame:
    """(path, task_id, status, child_rev, parent_rev) of task files (path, value); malformed ones are left out."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, value in zip(frame["path"], frame["value"]):
                m = _FRONT.match(value or "")
                try:
                    data = yaml.safe_load(m[1]) if m else None
                except yaml.YAMLError:
                    data = None
                if isinstance(data, dict) and data.get("id"):
                    text = lambda k: None if data.get(k) is None else str(data[k])  # noqa: B023, E731
                    rows.append((path, text("id"), text("status"), text("child_revision"), text("parent_revision")))
            yield pd.DataFrame(rows, columns=["path", "task_id", "status", "child_rev", "parent_rev"])

    return files.select("path", "value").mapInPandas(read, TASKS)


def _facts(text: Column) -> Column:
    """The ``- **Key:** value`` lines of a text as a map; the last line of a key counts."""
    pattern = r"(?m)^- \*\*(.+?):\*\*[ \t]*(\S.*)$"
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.trim(F.get(values, i)).alias("value"), i.alias("i"))), lambda e: ~F.array_contains(F.slice(keys, e["i"] + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def impact_task(files: DataFrame) -> DataFrame:
    """(path, fields, parent, child) of task files: the facts of the whole file and of its two sections."""
    part = lambda title: F.regexp_extract("value", rf"(?ims)^## {title}[ \t]*\n(.*?)(?=\n## |\z)", 1)
    return files.select("path", _facts(F.col("value")).alias("fields"), _facts(part(r"Parent \(Updated\)")).alias("parent"), _facts(part(r"Child \(Outdated\)")).alias("child"))


def binary_properties(files: DataFrame) -> DataFrame:
    """(path, sha256, size, width, height); dimensions of PNG, GIF and JPEG headers, null for others."""
    hexed = lambda a, n: F.conv(F.hex(F.substring("content", a, n)), 16, 10).cast("int")
    png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    gif = F.hex(F.substring("content", 1, 4)) == "47494638"
    jpeg = F.arrow_udf(_jpeg, "width int, height int")(F.when(F.hex(F.substring("content", 1, 2)) == "FFD8", F.col("content")))
    little = lambda a: hexed(a, 1) + 256 * hexed(a + 1, 1)
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"),
        F.when(png, hexed(17, 4)).when(gif, little(7)).otherwise(jpeg["width"]).alias("width"), F.when(png, hexed(21, 4)).when(gif, little(9)).otherwise(jpeg["height"]).alias("height"),
    )


def _jpeg(contents: pa.Array) -> pa.Array:
    """Width and height from the frame header of JPEG files, null for others."""
    out = []
    for value in contents:
        data, at, found = value.as_buffer() if value.is_valid else None, 2, None
        data = memoryview(data).cast("B") if data is not None else b""
        while bytes(data[:2]) == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
            kind, size = data[at + 1], data[at + 2] << 8 | data[at + 3]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                found = {"width": data[at + 7] << 8 | data[at + 8], "height": data[at + 5] << 8 | data[at + 6]}
                break
            at += 1 if kind == 0xFF else 2 + size
        out.append(found)
    return pa.array(out, pa.struct([("width", pa.int32()), ("height", pa.int32())]))


def first_match(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(name, path): the file that an image name means; the attachment folder first, then by path.

    ``wanted``: (name), ``files``: (path, preferred).
    """
    order = Window.partitionBy("name").orderBy(F.col("preferred").desc(), "path")
    named = files.withColumn("name", F.substring_index("path", "/", -1))
    return wanted.distinct().join(named, "name").withColumn("k", F.row_number().over(order)).filter("k = 1").select("name", "path")
