"""Reports: text of violations, the analysis report, change reports, artifact trees, CSV of a matrix."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.lines import percent_encode
from threadloom.operators.diff import size_text
from threadloom.operators.metrics import CATEGORIES
from threadloom.plans.writer import write_files

#: Message of each violation code; localised texts may replace them.
MESSAGES = {
    "en": {
        "unknown_type": "unknown artifact type", "missing_attribute": "missing mandatory attribute", "extra_attribute": "attribute is not in the metamodel", "multiplicity": "wrong multiplicity",
        "bad_integer": "not an integer", "bad_boolean": "not a boolean", "bad_enum": "not an allowed value", "dangling_reference": "reference to an unknown id",
        "unknown_type_reference": "reference to an artifact of an unknown type", "id_schema": "id does not match its schema", "forbidden_trace": "trace is not allowed", "missing_trace": "mandatory trace is missing",
        "trace_mode": "trace mode is violated", "duplicate_id": "duplicate id", "no_id": "artifact without an id", "extraction": "extraction error", "conflicting_revisions": "conflicting revisions",
        "too_deep": "circular or too deep reference", "no_requirements": "no requirements found", "malformed_reference": "malformed reference", "root_count": "there must be exactly one root",
        "duplicate_block_id": "duplicate fragment id", "git": "revisions are not known",
    },
    "ru": {
        "unknown_type": "неизвестный тип артефакта", "missing_attribute": "нет обязательного атрибута", "extra_attribute": "атрибута нет в метамодели", "multiplicity": "неверная множественность",
        "bad_integer": "не целое число", "bad_boolean": "не логическое значение", "bad_enum": "недопустимое значение", "dangling_reference": "ссылка на неизвестный идентификатор",
        "unknown_type_reference": "ссылка на артефакт неизвестного типа", "id_schema": "идентификатор не соответствует схеме", "forbidden_trace": "трассировка не разрешена", "missing_trace": "нет обязательной трассировки",
        "trace_mode": "нарушен способ трассировки", "duplicate_id": "повторный идентификатор", "no_id": "артефакт без идентификатора", "extraction": "ошибка извлечения", "conflicting_revisions": "противоречивые ревизии",
        "too_deep": "циклическая или слишком глубокая ссылка", "no_requirements": "требования не найдены", "malformed_reference": "неверная ссылка", "root_count": "должен быть ровно один корень",
        "duplicate_block_id": "повторный идентификатор фрагмента", "git": "ревизии неизвестны",
    },
}
CATEGORY = {
    "unknown_type": "attribute", "missing_attribute": "attribute", "extra_attribute": "attribute", "multiplicity": "attribute", "bad_integer": "attribute", "bad_boolean": "attribute", "bad_enum": "attribute",
    "dangling_reference": "reference", "unknown_type_reference": "reference", "conflicting_revisions": "reference", "id_schema": "schema", "forbidden_trace": "trace", "missing_trace": "trace", "trace_mode": "trace",
    "duplicate_id": "duplicate", "no_id": "extraction", "extraction": "extraction", "too_deep": "structure", "no_requirements": "structure", "malformed_reference": "reference", "root_count": "structure", "duplicate_block_id": "duplicate", "git": "structure",
}


def category(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for p in CATEGORY.items() for x in p])
    return F.coalesce(pairs[code], F.lit("structure"))


def text(code: str, language: str = "en") -> str:
    return MESSAGES.get(language, {}).get(code) or MESSAGES["en"][code]


def message(code: Column, language: str = "en") -> Column:
    texts = MESSAGES["en"] | MESSAGES.get(language, {})
    return F.coalesce(F.create_map(*[F.lit(x) for p in texts.items() for x in p])[code], code)


def place(links: bool = False, wiki: bool = False) -> Column:
    """Where a violation is: file and lines, as text, a Markdown link or a wiki link."""
    lines = F.when(F.col("line_start").isNull(), "").when(F.col("line_start") == F.col("line_end"), F.format_string(":%d", "line_start")).otherwise(F.format_string(":%d-%d", "line_start", "line_end"))
    shown = F.concat("file_path", lines)
    if not links:
        return shown
    if wiki:
        return F.concat(F.lit("[["), F.regexp_replace("file_path", r"\.md$", ""), F.lit("]]"))
    return F.concat(F.lit("["), shown, F.lit("]("), percent_encode(F.col("file_path")), F.lit(")"))


def analysis(violations: Iterable, metrics: Iterable = (), histogram: Iterable = (), stale: Iterable = (), tree: Iterable = (), tasks: dict | None = None, more: int = 0, n_stale: int = 0, n_tree: int = 0, warnings: Iterable = (), more_warnings: bool = False) -> str:
    """The analysis report as Markdown, from collected rows: errors by input and category, metrics, stale links with their pruned tree, tasks.

    ``more`` counts the violations that are not shown, ``n_stale`` and ``n_tree`` all links and lines of the tree."""
    groups: dict = {}
    for v in violations:
        groups.setdefault(v.input_record or "", {}).setdefault(v.category, []).append(v)
    out = ["# Analysis report", ""]
    for record in sorted(groups):
        out += [f"## {record or 'Global'}", ""]
        for c in sorted(groups[record], key=lambda c: CATEGORIES.index(c) if c in CATEGORIES else len(CATEGORIES)):
            out += [f"### {c} ({len(groups[record][c])})", ""]
            out += [f"- {v.message}" + (f" `{v.artifact_id}`" if v.artifact_id else "") + (f" at {v.place}" if v.place else "") for v in groups[record][c]] + [""]
    if not groups:
        out += ["No errors.", ""]
    if more:
        out += [f"{more} more errors are not shown.", ""]
    if warnings := list(warnings):
        out += [f"## Warnings ({len(warnings)}{' and more' if more_warnings else ''})", "", *[f"- {w.message} `{w.artifact_id}`" + (f" at {w.place}" if w.place else "") for w in warnings], ""]
    for m in metrics:
        name = f" of {m.record}" if "record" in m.asDict() else ""
        out += [f"## Metrics{name}", "", f"- requirements: {m.total}", f"- without verification: {m.pct_without_verify:.1f} %", f"- to be defined: {m.pct_tbd:.1f} %"]
    if histogram := list(histogram):
        out += ["", "| status | count |", "| --- | --- |", *[f"| {h["status"]} | {h["count"]} |" for h in histogram]]
    if stale := list(stale):
        out += ["", f"## Suspicious links ({max(n_stale, len(stale))})", "", *[f"- {s.child_id} -> {s.pid}" + (f" ({s.nominal_revision})" if s.nominal_revision else "") for s in stale]]
        if n_stale > len(stale):
            out += ["", f"{n_stale - len(stale)} more links are not shown."]
    if tree := list(tree):
        out += ["", "```", *tree, *([f"({n_tree - len(tree)} more lines)"] if n_tree > len(tree) else []), "```"]
    if tasks is not None:
        out += ["", f"Tasks: {tasks['create'] + tasks['update']} written, {tasks['skip']} skipped"]
    return "\n".join(out).rstrip() + "\n"


def tree(paths: DataFrame) -> DataFrame:
    """(path, line): the artifact tree with box characters, from (path, aid, depth) rows."""
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    last = F.row_number().over(Window.partitionBy("__parent").orderBy(F.col("path").desc())) == 1
    rows = paths.withColumn("__parent", parent).withColumn("last", last)
    steps = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    up = rows.select("path", "aid", "depth", F.posexplode(prefixes).alias("n", "prefix")).filter("n > 0")
    flags = rows.select(F.col("path").alias("prefix"), F.col("last").alias("__last"))
    drawn = up.join(flags, "prefix").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("n", "__last"))).alias("steps"))
    bars = F.array_join(
        F.transform("steps", lambda s: F.when(s["n"] == F.size("steps"), F.when(s["__last"], "└── ").otherwise("├── ")).otherwise(F.when(s["__last"], "    ").otherwise("│   "))), ""
    )
    return rows.join(drawn, "path", "left").select("path", F.concat(F.coalesce(bars, F.lit("")), "aid").alias("line"))


def change_rows(
    artifacts: DataFrame, fields: DataFrame, texts: DataFrame, binaries: DataFrame | None, errors: DataFrame | None, *, files: DataFrame, base: str = "", target: str = "", summary: bool = False
) -> DataFrame:
    """(part, a, b, c, text): the lines of a change report; joined by line ends in the order of the other columns they are Markdown (M7, M8).

    Only counts come to the driver."""
    spark = artifacts.sparkSession
    counted = lambda rows: {} if rows is None else {r.change: r.n for r in rows.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = {"artifacts": counted(artifacts), "text fragments": counted(texts), "binaries": counted(binaries)}
    statuses = {r.status: r.n for r in files.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    added, removed = statuses.get("A", 0), statuses.get("D", 0)
    head = [f"# Changes {base} .. {target}".rstrip(), "", "| | added | removed | modified |", "| --- | --- | --- | --- |"]
    head += [f"| {name} | {n.get('added', 0)} | {n.get('removed', 0)} | {n.get('modified', 0)} |" for name, n in counts.items()]
    head += ["", f"Files: {sum(statuses.values()) - added - removed} changed, {added} added, {removed} removed; extraction errors: {errors.count() if errors is not None else 0}"]
    fixed = [(0, "\n".join(head))]
    if not summary:
        fixed += [(i, f"\n## {kind.capitalize()}\n") for i, kind in ((1, "added"), (3, "removed"), (5, "modified")) if counts["artifacts"].get(kind)]
        fixed += [(7, "\n## Text")] * bool(counts["text fragments"]) + [(9, "\n## Binaries\n")] * bool(counts["binaries"])
    row = lambda rows, part, a, b, c, text: rows.select(part.cast("int").alias("part"), a.alias("a"), b.alias("b"), c.alias("c"), text.alias("text"))
    none = F.lit("")
    out = spark.createDataFrame([(p, "", "", "", t) for p, t in fixed], "part int, a string, b string, c string, text string")
    if summary:
        return out
    shown = F.pandas_udf(lambda x: x.map(cell), "string")
    block = F.pandas_udf(lambda x: x.map(lambda t: "".join(f"\n  {line}" for line in quoted(t))), "string")
    arrow = lambda old, new: F.concat(shown(old), F.lit(" -> "), shown(new))
    kind = F.when(F.col("change") == "added", 2).when(F.col("change") == "removed", 4).otherwise(6)
    out = out.unionByName(row(artifacts, kind, F.col("aid"), F.col("record"), none, F.concat(F.lit("- "), escape_html(F.col("aid")))))
    out = out.unionByName(row(fields, F.lit(6), F.col("aid"), F.col("record"), F.col("field"), F.concat(F.lit("  - "), "field", F.lit(": "), arrow("old", "new"))))
    where = F.concat_ws(" → ", "old_line", "new_line")
    line = F.concat(F.lit("\n- "), "change", F.lit(" in "), "path", F.when(where == "", "").otherwise(F.concat(F.lit(" ("), where, F.lit(")"))), F.lit(": "), arrow("old", "new"))
    order = F.concat(F.coalesce("old", none), F.lit("\0"), F.coalesce("new", none))
    out = out.unionByName(row(texts, F.lit(8), F.col("path"), F.col("change"), order, F.concat(line, block(F.coalesce("new", "old")))))
    if binaries is not None:
        picture = lambda side: F.when(F.col(f"{side}_width").isNotNull(), F.format_string(" %d×%d", f"{side}_width", f"{side}_height")).otherwise("")
        dims = lambda side: F.when(F.col(f"{side}_sha256").isNull(), "").otherwise(F.concat(F.col(f"{side}_size").cast("string"), F.lit(" B `"), F.substring(f"{side}_sha256", 1, 12), F.lit("`"), picture(side)))
        out = out.unionByName(row(binaries, F.lit(10), F.col("aid"), none, none, F.concat(F.lit("- "), "change", F.lit(" "), "aid", F.lit(": "), dims("base"), F.lit(" -> "), dims("target"))))
    if errors is not None:
        fenced = F.pandas_udf(lambda x: x.map(_fenced), "string")
        text = F.concat(F.lit("\n## Errors in "), "path", F.lit("\n\n"), F.coalesce("message", none), F.when(F.col("diff") != "", F.concat(F.lit("\n"), fenced("diff"))).otherwise(none))
        out = out.unionByName(row(errors, F.lit(11), F.col("path"), F.col("record"), none, text))
    return out


def _fenced(diff: str) -> str:
    """A diff in a fence longer than any in it."""
    fence = "`" * max(3, 1 + max((len(x) for x in re.findall("`+", diff or "")), default=0))
    return f"{fence}diff\n{diff}\n{fence}"


def escape_html(text: Column) -> Column:
    """Angle brackets as entities, so that Markdown does not take them for HTML."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def quoted(text: str | None) -> list[str]:
    """A text as block quote lines, headings outside code fences escaped."""
    out, fenced = [], False
    for line in (text or "").splitlines() if (text or "").strip() else ():
        bare = line.lstrip()
        fenced ^= bare.startswith("```")
        out.append("> " + (line[: len(line) - len(bare)] + "\\" + bare if not fenced and bare.startswith("#") else line))
    return out


def cell(text: str | None) -> str:
    """The first non-blank line of a value for a table cell."""
    lines = [x for x in (text or "").splitlines() if x.strip()]
    if not lines:
        return ""
    return f"`{lines[0].strip().replace('|', chr(92) + '|').replace('`', chr(39))}`" + (" …" if len(lines) > 1 else "")


def _csv_cell(value: Column, delimiter: str) -> Column:
    """A CSV cell, quoted if it must be."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(r'["\r\n\Q' + delimiter + r"\E]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _matrix_rows(matrix: DataFrame, forward: bool, attributes: list[str], delimiter: str) -> tuple[str, DataFrame]:
    """The heading of a matrix and its lines (record_number, text)."""
    head = io.StringIO()
    csv.writer(head, delimiter=delimiter, lineterminator="\n").writerow(["RecordNumber", *(["ChildID", "ParentID"] if forward else ["ParentID", "ChildID"]), *attributes])
    cells = [_csv_cell(F.col(c), delimiter) for c in ("record_number", "lead_id", "linked_id", *attributes)]
    line = F.concat(*[x for c in cells for x in (F.lit(delimiter), c)][1:], F.lit("\n"))
    return head.getvalue(), matrix.select("record_number", line.alias("text"))


def matrix_lines(matrix: DataFrame, forward: bool = True, attributes: list[str] = (), delimiter: str = ",") -> Iterator[str]:
    """The lines of a trace matrix as CSV, one partition at a time (B1)."""
    head, rows = _matrix_rows(matrix, forward, attributes, delimiter)
    yield head
    for r in rows.orderBy("record_number").toLocalIterator():
        yield r.text


def matrix_csv(matrix: DataFrame, forward: bool = True, attributes: list[str] = (), delimiter: str = ",") -> str:
    return "".join(matrix_lines(matrix, forward, attributes, delimiter))


def matrix_file(matrix: DataFrame, path: str | Path, forward: bool = True, attributes: list[str] = (), delimiter: str = ",") -> Path:
    """A trace matrix as one CSV file in the order of its numbers, written by the executors (B1)."""
    path = Path(path)
    head, rows = _matrix_rows(matrix, forward, attributes, delimiter)
    return write_files(rows.withColumn("file", F.lit(path.name)), ["record_number"], path.parent, heads={path.name: head})[0]


def change_name(record: str, base: str, target: str, day: str, summary: bool = False) -> str:
    """The file name of a record's change report (M9)."""
    label = lambda r: r if r == "working" else r[:7]
    return f"{re.sub(r'[/' + chr(92) * 2 + ']', '_', record.replace(' ', '-'))}-{label(base)}-to-{label(target)}-{day}{'-summary' if summary else ''}.md"


def output_name(child: str, parent: str, forward: bool, day: str, suffix: str = "csv") -> str:
    """The default file name of a matrix (B2)."""
    return f"trace-{child}-{parent}-{'forward' if forward else 'reverse'}-{day}.{suffix}"


__all__ = ["analysis", "category", "cell", "change_name", "change_rows", "escape_html", "matrix_csv", "matrix_file", "matrix_lines", "message", "output_name", "place", "quoted", "size_text", "tree"]
