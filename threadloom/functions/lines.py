"""Line-oriented text functions over exploded lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(df: DataFrame, text: str) -> DataFrame:
    """One row per line of ``text``: ``line_no`` from 0 and ``line``; the text itself is dropped."""
    rest = [c for c in df.columns if c != text]
    return df.select(*rest, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))


def with_fences(lines: DataFrame, key: str) -> DataFrame:
    """Add ``fenced``: whether a line is inside a code fence or is one (G6). One key is one file."""
    mark = F.col("line").startswith("```")
    order = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("fenced", mark | (F.sum(mark.cast("int")).over(order) % 2 == 1))


def soft_breaks(lines: DataFrame, key: str) -> DataFrame:
    """Append two spaces to lines that a strict renderer would join with the next one."""
    follow = F.lead("line").over(Window.partitionBy(key).orderBy("line_no"))
    block = F.col("line").rlike(r"^\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s|>|\||```|~~~|(-{3,}|\*{3,}|_{3,})\s*$)")
    blank = F.trim("line") == ""
    hard = F.col("line").rlike(r"( {2,}|\\)$")
    plain = ~F.col("fenced") & ~blank & ~block & ~hard & follow.isNotNull() & (F.trim(follow) != "")
    return lines.withColumn("line", F.when(plain, F.concat("line", F.lit("  "))).otherwise(F.col("line")))


def shift_heading(line: Column, by: Column) -> Column:
    """Deepen a heading line by ``by`` levels, six at most."""
    marks = F.regexp_extract(line, r"^(#{1,6})\s", 1)
    deeper = F.repeat(F.lit("#"), F.least(F.lit(6), F.length(marks) + by))
    return F.when(marks != "", F.concat(deeper, F.substring(line, F.length(marks) + 1, F.length(line)))).otherwise(line)


def strip_number(text: Column) -> Column:
    """A heading without its leading section number."""
    number = r"^\s*[0-9]+(?:\.[0-9]+)*\s*[-.]?"
    return F.when(text.rlike(number), F.regexp_replace(F.regexp_replace(text, number, ""), r"^\s+|\s+$", "")).otherwise(text)


def table_cell(text: Column) -> Column:
    """Text that is safe in a Markdown table cell."""
    flat = F.replace(F.replace(F.replace(text, F.lit("|"), F.lit(r"\|")), F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("<br>"))
    return F.when(F.contains(text, F.lit("<")) & F.contains(text, F.lit(">")), F.concat(F.lit("`"), flat, F.lit("`"))).otherwise(flat)


def file_name(text: Column) -> Column:
    """A name without characters that file systems refuse."""
    return F.translate(text, '/\\:*?"<>|', "---------")


def lines_text(start: Column, end: Column) -> Column:
    """``line a`` or ``lines a–b``."""
    return F.when(start == end, F.format_string("line %d", start)).otherwise(F.format_string("lines %d–%d", start, end))


def short(text: Column, width: int = 60) -> Column:
    """Cut long text to its first word and an ellipsis."""
    first = F.substring(F.split(F.trim(text), r"\s+")[0], 1, width)
    return F.when(F.length(text) > width, F.concat(first, F.lit("..."))).otherwise(text)


def percent_encode(text: Column) -> Column:
    """URL quoting that keeps slashes and writes a space as %20."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
