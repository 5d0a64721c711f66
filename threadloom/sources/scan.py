"""File scans: one row per file in, one row per block out, files in parallel."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom import model
from threadloom.sources import markup
from threadloom.sources.notebook import cells

#: Default file patterns of the drivers.
GLOBS = {"obsidian": "*.md", "markdown": "*.md", "simple-markdown": "*.md", "ipynb": "*.ipynb"}
#: Blocks, and characters of them, that a scanning task gathers before it hands them on.
HELD_BLOCKS, HELD_CHARS = 2000, 1 << 22


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, value) of the text files under a folder; the path is relative to it."""
    df = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    return df.select(F.regexp_replace(F.url_decode("_metadata.file_path"), "^.*?" + _quoted(root) + "/", "").alias("path"), "value")


def binaries(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, content, size, modified) of any files under a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = folder.rstrip("/").split("://")[-1].lstrip("/")
    return df.select(F.regexp_replace("path", "^.*?" + _quoted(root) + "/", "").alias("path"), "content", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def names(spark: SparkSession, folder: str) -> DataFrame:
    """(path) of all files under a folder, without their contents."""
    return binaries(spark, folder).select("path")


def glob_pattern(glob: str) -> str:
    """The regular expression of a glob over relative paths; ``**`` matches any folders, a bare name any file of that name below."""
    parts, out = (glob if "/" in glob else f"**/{glob}").lstrip("/"), ""
    for piece in re.split(r"(\*\*/|\*\*|\*|\?)", parts):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(piece, re.escape(piece))
    return f"^{out}$"


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def _blocks(source: DataFrame, scan: Callable[[str, str], Iterator[markup.Piece]]) -> DataFrame:
    """The blocks of (record, path, value[, cell]) that a scanner of (text, path) finds.

    A task holds a few thousand blocks, or some megabytes of them, however many files a batch brings and however many blocks a file."""
    names, arrow = model.schema(model.BLOCKS).names, to_arrow_schema(model.schema(model.BLOCKS))
    here = [n for n in ("record", "path", "value", "cell") if n in source.columns]

    def found(record: str, path: str, value: str | None, cell: int | None = None) -> Iterator[tuple[tuple, int]]:
        text = (value or "").replace("\r\n", "\n")
        ends = [m.start() for m in re.finditer("\n", text)]  # once per text, not once per piece
        for n, p in enumerate(scan(text, path)):
            lines = (bisect_left(ends, p.start) + 1, bisect_left(ends, max(p.start, p.end - 1)) + 1)
            kept = [(k, {"is_list": isinstance(v, list), "vals": v if isinstance(v, list) else [v]}) for k, v in p.fields.items()]
            yield (
                record, path, n + 1_000_000 * int(cell or 0), p.kind, p.content, p.marker, p.block_id, p.block_id is not None, p.start, p.message, text[p.start : p.end], p.atype, p.aid,
                {"kind": "cell" if cell is not None else "lines", "file": path, "sidecar": None, "line_start": lines[0], "line_end": lines[1], "cell": None if cell is None else int(cell)}, kept,
            ), len(p.content or "") + p.end - p.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], names=names)

        rows, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for row, chars in found(*(batch.column(n)[i].as_py() for n in here)):
                    rows.append(row)
                    size += chars
                    if len(rows) >= HELD_BLOCKS or size >= HELD_CHARS:
                        yield made(rows)
                        rows, size = [], 0
        if rows:
            yield made(rows)

    return source.mapInArrow(run, model.BLOCKS)


def scan_markdown(source: DataFrame, marker: str, atype: str, *, fragments: tuple[str, ...] = (), exclude: dict[str, str] | None = None, multiple: set[str] = frozenset(), split: set[str] = frozenset(), labels: markup.Labels = {}) -> DataFrame:
    """Blocks of Markdown files (record, path, value): artifacts, fragments, headings, text and errors."""

    def scan(text: str, path: str) -> Iterator[markup.Piece]:
        first = True
        for piece in markup.scan_segments(text, marker, atype, fragments=fragments, multiple=multiple, split=split, labels=labels):
            if piece.kind != "text":
                yield piece
                continue
            for part in markup.scan_fragments(piece.content, fragments):
                for last in [part] if part.marker or part.kind != "text" else markup.scan_headings(part.content):
                    if exclude and last.kind == "text" and not last.marker:
                        last.content = markup.exclude_elements(last.content, exclude, first)
                    base = piece.start + part.start if last is not part else piece.start
                    last.start, last.end = last.start + base, last.end + base
                    if last.content.strip() or last.marker:
                        yield last
            first = False

    return _blocks(source, scan)


def scan_code(source: DataFrame, atype: str, **rules) -> DataFrame:
    """Artifacts in ``[< .. >>> .. >]`` sections of source files."""
    return _blocks(source, lambda text, path: markup.scan_sections(text, atype, **rules))


def scan_simple(source: DataFrame, atype: str, **rules) -> DataFrame:
    """Frontmatter files, one artifact each."""
    return _blocks(source, lambda text, path: markup.scan_frontmatter(text, PurePosixPath(path).stem, atype, **rules))


def scan_notebooks(source: DataFrame, marker: str, atype: str, **rules) -> DataFrame:
    """Notebooks: Markdown cells that hold the marker are scanned, other cells are text, bad files are errors."""
    rows = cells(source).select("record", "path", F.col("source").alias("value"), "cell", "cell_type")
    opening = f"[{marker}]".lower()
    bad = rows.filter("cell < 0").select("record", "path", F.lit("not a notebook").alias("value"), F.lit(0).alias("cell"))
    marked = F.contains(F.lower("value"), F.lit(opening)) & (F.col("cell_type") == "markdown")
    good = rows.filter("cell >= 0")

    def error(text: str, path: str) -> Iterator[markup.Piece]:
        yield markup.Piece("error", 0, len(text), text, message=text)

    def whole(text: str, path: str) -> Iterator[markup.Piece]:
        yield markup.Piece("text", 0, len(text), text)

    parts = [
        _blocks(good.filter(marked).drop("cell_type"), lambda text, path: markup.scan_segments(text, marker, atype, **rules)),
        _blocks(good.filter(~marked).drop("cell_type"), whole),
        _blocks(bad, error),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])



def scan_sidecars(source: DataFrame, names: DataFrame, atype: str, suffixes: tuple[str, ...], labels: markup.Labels = {}) -> DataFrame:
    """Files with a YAML sidecar each. ``source``: (record, path, value) of the sidecars, ``names``: (record, path) of all other files.

    A file with no sidecar or with two is an error; so is a sidecar without its file.
    """
    pattern = "(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"
    side = source.withColumn("original", F.regexp_replace("path", pattern, "")).groupBy("record", "original").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("value"), F.max("path").alias("sidecar"))
    joined = names.withColumnRenamed("path", "original").withColumn("here", F.lit(True)).join(side, ["record", "original"], "full_outer")
    fault = (
        F.when(F.col("here").isNull(), "orphan sidecar").when(F.col("n").isNull(), "missing sidecar").when(F.col("n") > 1, "several sidecars")
    )
    rows = joined.select("record", F.col("original").alias("path"), F.when(fault.isNotNull(), F.concat(F.lit("!"), fault)).otherwise(F.concat(F.lit(":"), F.col("value"))).alias("value"))

    def scan(text: str, path: str) -> Iterator[markup.Piece]:
        yield markup.Piece("error", 0, len(text), "", message=text[1:]) if text[:1] == "!" else markup.sidecar_fields(text[1:], atype, labels)

    out = _blocks(rows, scan)
    held = side.select("record", F.col("original").alias("path"), "sidecar")
    loc = F.col("loc").withField("kind", F.lit("file")).withField("sidecar", F.col("sidecar")).withField("line_start", F.lit(None).cast("int")).withField("line_end", F.lit(None).cast("int"))
    return out.join(held, ["record", "path"], "left").withColumn("loc", loc).select(out.columns)


def artifacts_of(blocks: DataFrame, driver: str) -> DataFrame:
    """The artifact relation of scanned blocks, in reading order."""
    found = blocks.filter("kind = 'artifact'")
    return found.select(F.struct("record", "path", "block_no").alias("seq"), "record", F.lit(driver).alias("driver"), "atype", "aid", "loc", "fields")
