"""Publishing: blocks rendered to Markdown, headings from paths, one document per record."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.lines import strip_number, table_cell
from threadloom.operators.edit import block_id
from threadloom.operators.order import previous
from threadloom.sources.config import Publish


def with_ids(blocks: DataFrame) -> DataFrame:
    """Give marked blocks without an id a stable one."""
    made = block_id(F.col("marker"), F.col("path"), F.col("content"))
    needs = F.col("block_id").isNull() & F.col("marker").isNotNull() & (F.col("marker") != "HEADING")
    return blocks.withColumn("block_id", F.when(needs, made).otherwise(F.col("block_id")))


def duplicate_block_ids(blocks: DataFrame) -> DataFrame:
    """(marker, block_id, n) of explicit ids that occur more than once in the project."""
    return blocks.filter("explicit_id").groupBy("marker", "block_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def path_headings(blocks: DataFrame, settings: Publish, several: bool = False) -> DataFrame:
    """(record, path, heading, level): heading lines for the parts of a path that differ from the file before it.

    With ``several`` records in one document each begins with a heading of its own, one level above. A contents file,
    known by its name without number and in any case, has no heading and stands for its folder."""
    files = blocks.select("record", "path").distinct()
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: p != "")
    title = lambda p: strip_number(p) if settings.remove_numeric_prefixes_in_headers else p
    contents = F.lower(title(F.element_at(parts, -1))) == settings.contents_marker.lower()
    own = F.when(contents, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    rows = previous(files.withColumn("parts", own), ["record"], ["path"], before=F.col("parts")).withColumn("first", F.col("before").isNull())
    old = F.coalesce("before", F.array().cast("array<string>"))
    differs = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: ~F.slice("parts", F.lit(1), i).eqNullSafe(F.slice(old, F.lit(1), i)))
    top = settings.start_level + int(several)
    lines = F.transform(differs, lambda i: F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), i + top - 1)), F.lit(" "), title(F.get("parts", i - 1)), F.lit("\n\n")))
    lead = F.when(F.lit(several) & F.col("first"), F.concat(F.lit("#" * min(6, settings.start_level) + " "), title(F.col("record")), F.lit("\n\n"))).otherwise("")
    return rows.select("record", "path", F.concat(lead, F.when(F.size("parts") > 0, F.array_join(lines, "")).otherwise("")).alias("heading"), (F.size("parts") + int(several)).alias("level"))


def _shows(name: str, text: str, presence: str, mandatory: set[str]) -> bool:
    """Whether an attribute is printed: all, the mandatory ones, or those with a value."""
    return bool(text.strip()) or presence == "all" or (presence == "mandatory" and name in mandatory)


def _table(head: str, rows: list[tuple[str, str]], spacer: int) -> str:
    return "&nbsp;\n\n" * spacer + "\n".join([head, "| --- | --- |", *[f"| {n} | {_cell(v)} |" for n, v in rows]])


def _text(alias: str, value: str, mode: str) -> str:
    return f"**{alias}**\n\n{value}" if mode == "block" else f"**{alias}**: {value}"


def shifted(text: str, level: int, settings: Publish) -> str:
    """A text whose headings, outside code fences, begin at a level, without numbers where the settings say so."""
    lines, fenced = text.split("\n"), False
    for i, line in enumerate(lines):
        fenced ^= line.lstrip().startswith(("```", "~~~"))
        if not fenced and (m := re.match(r" {0,3}(#{1,6})\s+(.*)", line)):
            title = re.sub(r"^\d+(?:\.\d+)*[.)\-]?\s+", "", m[2]) if settings.remove_numeric_prefixes_in_headers else m[2]
            lines[i] = "#" * min(6, len(m[1]) + level - 1) + " " + title
    return "\n".join(lines)


def _named(section: dict) -> list[tuple[str, str]]:
    """(attribute, alias) of a section."""
    return [(name, how["alias"]) for each in section["attributes"] for name, how in each.items()]


def artifact_text(aid: str, fields: dict, level: int, settings: Publish, sections: list[dict] | None = None, mandatory: set[str] = frozenset(), image: str | None = None) -> str:
    """One artifact as Markdown: the sections of its type, else heading, contents and a table of its attributes; a picture's own file first."""
    value = {k.lower(): ", ".join(x for x in v["vals"] if x) for k, v in fields.items()} | {"id": aid}
    parts = [f"![{value.get('title') or aid}]({image})"] if image else []
    if not sections:
        parts += [f"{'#' * min(6, level)} {aid}", value.get("contents", "").strip()]
        if rows := [(n, value[n.lower()]) for n in sorted(fields) if n not in ("id", "contents")]:
            parts.append(_table("| Field | Value |", rows, settings.table_spacer))
        return "\n\n".join(p for p in parts if p)
    for section in sections:
        presence = section.get("attribute_presence") or settings.attribute_presence
        found = [(name, alias, value.get(name.lower(), "")) for name, alias in (_named(section) if "attributes" in section else ())]
        if section["type"] == "table":
            if rows := [(alias, text) for name, alias, text in found if _shows(name, text, presence, mandatory)]:
                spacer = section.get("spacer")
                parts.append(_table("|  |  |", rows, settings.table_spacer if spacer is None else spacer))
        else:
            parts += [_text(alias, shifted(text, level, settings).strip(), section["mode"]) for _, alias, text in found if text]
    return "\n\n".join(p for p in parts if p)


def fragment_text(content: str, level: int, settings: Publish, sections: list[dict] | None) -> str:
    """A marked fragment: by the sections of its marker, else as plain text."""
    if not sections:
        return shifted(content, level, settings).strip()
    return "\n\n".join(_text(s["alias"], content.strip(), s["mode"]) for s in sections if "alias" in s)


def _cell(text: str) -> str:
    flat = text.replace("|", r"\|").replace("\r\n", "\n").replace("\n", "<br>")
    return f"`{flat}`" if "<" in text and ">" in text else flat


def hard_breaks(text: str) -> str:
    """Two spaces at the end of lines that a strict renderer would join with the next one, outside code fences."""
    lines, fenced = text.split("\n"), False
    for i, line in enumerate(lines[:-1]):
        fence = line.lstrip().startswith(("```", "~~~"))
        fenced ^= fence
        if not (fence or fenced or not line.strip() or not lines[i + 1].strip() or _BLOCK.match(line) or re.search(r"( {2,}|\\)$", line)):
            lines[i] = line + "  "
    return "\n".join(lines)


_BLOCK = re.compile(r"\s*(#{1,6}\s|[-*+]\s|\d+[.)]\s|>|\||(-{3,}|\*{3,}|_{3,})\s*$)")


def pieces(blocks: DataFrame, settings: Publish, mandatory: dict[str, set[str]] | None = None, *, several: bool = False, breaks: bool = False) -> DataFrame:
    """(record, path, block_no, kind, text): each record's blocks rendered, with headings for its paths.

    In order of path and number, with a blank line between, they are the record's document; a piece neither begins nor
    ends with a line end and holds no two blank lines in a row."""
    heads = path_headings(blocks, settings, several)
    soft = hard_breaks if breaks else (lambda t: t)
    rules = {k.upper(): v for k, v in settings.render.items()}
    mandatory = mandatory or {}
    rows = with_ids(blocks).join(heads.select("record", "path", "level"), ["record", "path"]).select("record", "path", "block_no", "kind", "content", "marker", "block_id", "message", "atype", "aid", "fields", "level", F.col("loc.kind").alias("file_kind"))

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for r in f.itertuples(index=False):
                if r.kind == "error":
                    texts.append(f"> **Error:** {r.message}")
                elif r.kind == "artifact":
                    image = quote(r.path) if r.file_kind == "file" and r.path.lower().endswith(_PICTURES) else None
                    texts.append(artifact_text(r.aid, dict(r.fields or {}), int(r.level) + settings.start_level, settings, rules.get((r.atype or "").upper()), mandatory.get(r.atype, set()), image))
                elif r.kind == "heading":
                    marks = re.match(r"#+", r.content.strip())
                    texts.append("#" * min(6, len(marks[0]) + int(r.level) + settings.start_level - 1) + r.content.strip()[len(marks[0]) :])
                elif isinstance(r.marker, str):
                    texts.append(soft(fragment_text(r.content, int(r.level) + settings.start_level, settings, rules.get(r.marker.upper()))))
                else:
                    texts.append(soft(r.content.strip()) if settings.include_plain_text else "")
            yield pd.DataFrame({"record": f["record"], "path": f["path"], "block_no": f["block_no"], "kind": f["kind"], "text": texts})

    texts = rows.mapInPandas(render, "record string, path string, block_no long, kind string, text string")
    lead = heads.filter("heading != ''").select("record", "path", F.lit(-1).cast("long").alias("block_no"), F.lit("path").alias("kind"), F.trim("heading").alias("text"))
    parts = texts.unionByName(lead)
    trimmed = F.regexp_replace(F.regexp_replace("text", r"\A\n+|\n+\z", ""), "\n{3,}", "\n\n")
    return parts.withColumn("text", trimmed).filter("text != ''")


def piece_counts(parts: DataFrame) -> DataFrame:
    """(record, n_artifacts, n_text) of rendered pieces."""
    return parts.groupBy("record").agg(F.count(F.when(F.col("kind") == "artifact", 1)).alias("n_artifacts"), F.count(F.when(F.col("kind") == "text", 1)).alias("n_text"))


def documents(parts: DataFrame) -> DataFrame:
    """(record, document): whole documents of :func:`pieces`, for hooks that take a document as one text."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "block_no", "text")))
    return parts.groupBy("record").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("document"))


#: Endings of the pictures that a published sidecar shows (fixed values).
_PICTURES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp", ".bmp")
_IMAGE = re.compile(r"!\[\[(?P<wiki>[^\]|]+)(?:\|[^\]]*)?\]\]|!\[(?P<alt>[^\]]*)\]\((?P<url>[^)\s]+)\)")


def image_names(parts: DataFrame) -> DataFrame:
    """(record, url, name): local images that pieces refer to, outside code fences."""
    bare = F.regexp_replace("text", r"(?s)```.*?```", "")
    wiki = F.regexp_extract_all(bare, F.lit(r"!\[\[([^\]|]+)"), F.lit(1))
    plain = F.regexp_extract_all(bare, F.lit(r"!\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1))
    rows = parts.select("record", F.explode(F.array_union(wiki, plain)).alias("url")).filter("not url rlike '^[a-z]+://'")
    return rows.select("record", "url", F.substring_index(F.url_decode(F.replace("url", F.lit("+"), F.lit("%2B"))), "/", -1).alias("name")).distinct()


def with_images(parts: DataFrame, manifest: dict[str, str]) -> DataFrame:
    """Pieces whose image references point at their published copies (one entry for each image that was copied)."""

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(text=[rewrite_images(t, manifest) for t in f["text"]])

    return parts.mapInPandas(rewrite, parts.schema)


def rewrite_images(text: str, manifest: dict[str, str]) -> str:
    """Point image references at their published copies; fences and remote images stay."""
    def put(m: re.Match) -> str:
        url = m["wiki"] or m["url"]
        new = manifest.get(url)
        return m[0] if new is None else f"![{m['alt'] or ''}]({new})"

    parts = re.split(r"(```.*?```)", text, flags=re.S)
    return "".join(p if p.startswith("```") else _IMAGE.sub(put, p) for p in parts)


__all__ = ["artifact_text", "documents", "duplicate_block_ids", "image_names", "path_headings", "pieces", "rewrite_images", "table_cell", "with_ids"]
