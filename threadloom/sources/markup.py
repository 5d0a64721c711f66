"""Pure text scanners: marked Markdown segments, source-code sections, frontmatter files, fragments.

Every function takes one text and yields plain tuples; nothing here needs Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import yaml

from threadloom.model import UNDEFINED

Fields = dict[str, list[str] | str]


@dataclass
class Piece:
    """A stretch of a text: kind is ``text``, ``artifact``, ``heading`` or ``error``."""

    kind: str
    start: int
    end: int
    content: str = ""
    aid: str | None = None
    atype: str | None = None
    fields: Fields = field(default_factory=dict)
    message: str | None = None
    marker: str | None = None
    block_id: str | None = None


# --- attributes --------------------------------------------------------------------------------------------------


class Attributes:
    """Collects attribute values under the rules of a type: ``multiple`` names hold lists, ``split`` names split at commas."""

    def __init__(self, multiple: set[str] = frozenset(), split: set[str] = frozenset()):
        self.multiple, self.split, self.values, self.errors = multiple, split, {}, []

    def add(self, name: str, value: str) -> None:
        if name in self.multiple:
            items = [x.strip() for x in value.split(",")] if name in self.split else [value]
            self.values.setdefault(name, []).extend(x for x in items if x or name not in self.split)
        elif name in self.values:
            self.errors.append(f"attribute {name} occurs more than once")
        else:
            self.values[name] = value

    def done(self) -> Fields:
        return {name: [] for name in self.multiple if name not in self.values} | self.values


#: The labels of booleans by (type, attribute), where the metamodel names some.
Labels = dict[tuple[str, str], tuple[str, str]]


def yaml_text(value, labels: tuple[str, str] | None = None) -> str:
    """A YAML scalar as attribute text; booleans become the attribute's first labels, or yes and no."""
    if isinstance(value, bool):
        return (labels or ("yes", "no"))[0 if value else 1]
    return str(value)


# --- marked segments ---------------------------------------------------------------------------------------------

_FENCE_OPEN, _FENCE = re.compile(r"^```yaml[ \t]*\r?$", re.M | re.I), "```"
_HEADING = re.compile(r"^#{1,6}\s", re.M)
_BLANK = re.compile(r"^[ \t]*\r?\n(?:[ \t]*\r?\n)*", re.M)
_FIELD = re.compile(r"\[([^\]\r\n]+)\][ \t]*(.*)$")


def scan_segments(text: str, marker: str, atype: str, *, fragments: tuple[str, ...] = (), multiple: set[str] = frozenset(), split: set[str] = frozenset(), labels: Labels = {}) -> Iterator[Piece]:
    """Split a Markdown text into plain text and artifacts opened by ``[MARKER]`` (any case).

    A segment ends, in this order of preference: after the closing fence of its
    YAML block, after ``[/MARKER]``, or at the first fallback boundary: a
    fragment marker or heading at the start of a line, a blank line (blank lines
    are swallowed), the next marker, or the end of the text.
    """
    opening = re.compile(rf"\[{re.escape(marker)}\]", re.I)
    closing = re.compile(rf"\[/{re.escape(marker)}\]", re.I)
    boundary = [_HEADING, *([re.compile(rf"^\[(?:{'|'.join(map(re.escape, fragments))})(?:\s+[^\]]+)?\]", re.M | re.I)] if fragments else [])]
    at = 0
    while m := opening.search(text, at):
        if m.start() > at:
            yield Piece("text", at, m.start(), text[at : m.start()])
        follower = opening.search(text, m.end())
        limit = follower.start() if follower else len(text)
        close = closing.search(text, m.end(), limit)
        fence = _FENCE_OPEN.search(text, m.end(), close.start() if close else limit)
        block = None
        if fence:
            shut = text.find("\n" + _FENCE, fence.end(), limit)
            if shut >= 0:
                block, end = (fence.start(), fence.end(), shut + 1), shut + 1 + len(_FENCE)
        if block is None and close:
            end = close.end()
        elif block is None:
            line = text.find("\n", m.end(), limit)
            begin = line + 1 if line >= 0 else limit
            hits = [h for b in boundary if (h := b.search(text, begin, limit))]
            blank = _BLANK.search(text, begin, limit)
            first = min((h.start() for h in hits), default=limit)
            end = blank.end() if blank and blank.start() < first else first
        yield _segment(text, m.end(), end, m.start(), block, close if block is None else None, atype, multiple, split, labels)
        at = end
    if at < len(text):
        yield Piece("text", at, len(text), text[at:])


def _segment(text: str, begin: int, end: int, start: int, block, close, atype: str, multiple: set[str], split: set[str], labels: Labels) -> Piece:
    body = text[begin : block[0] if block else close.start() if close else end]
    raw = text[start:end]
    if " " in raw:
        return Piece("error", start, end, raw, message="non-breaking space inside a segment")
    contents, inline, name = [], [], None
    for line in body.strip("\r\n").split("\n"):
        line = line.rstrip("\r")
        if m := _FIELD.match(line):
            name = m[1].strip().lower()
            inline.append((name, [m[2].strip()]))
        elif name is None:
            contents.append(line)
        else:
            inline[-1][1].append(line)
    attrs: dict = {}
    if block:
        try:
            data = yaml.safe_load(text[block[1] : block[2]])
        except yaml.YAMLError as e:
            return Piece("error", start, end, raw, message=f"bad YAML: {e.__class__.__name__}")
        if not isinstance(data, dict) or not isinstance(data.get("attrs"), dict):
            return Piece("error", start, end, raw, message="the YAML block has no attrs")
        attrs = data["attrs"]
    found = Attributes(multiple, split)
    named = dict((n, "\n".join(v).strip()) for n, v in inline)
    aid = attrs.get("id", named.get("id"))
    kind = attrs.get("atype", named.get("atype", atype))
    for n, lines in inline:
        if n not in attrs and n not in ("id", "atype"):
            found.add(n, "\n".join(lines).strip())
    for n, value in attrs.items():
        if n in ("id", "atype") or value is None:
            continue
        for item in value if isinstance(value, list) else [value]:
            found.add(str(n), yaml_text(item, labels.get((str(kind), str(n)))))
    found.add("contents", "\n".join(contents).strip())
    if found.errors:
        return Piece("error", start, end, raw, message="; ".join(found.errors))
    return Piece("artifact", start, end, raw, str(aid) if aid is not None else UNDEFINED, str(kind), found.done())


# --- source code ----------------------------------------------------------------------------------------------------

_SECTION = re.compile(r"\[<(?P<header>(?:(?!>>>|>\]|\[<).)*)(?:>>>(?P<body>(?:(?!>\]).)*))?>\]", re.S)
_DIRECTIVE = re.compile(r"([A-Za-z0-9_-]+)[ \t]*=[ \t]*([^\r\n>\[\]]+)")


def scan_sections(text: str, atype: str, *, multiple: set[str] = frozenset(), split: set[str] = frozenset(), labels: Labels = {}) -> Iterator[Piece]:
    """Artifacts in ``[< header >>> body >]`` sections of any text; what lies between is text, an open section is an error."""
    at = 0
    for m in _SECTION.finditer(text):
        if m.start() > at:
            yield from _between(text, at, m.start())
        found, aid, kind = Attributes(multiple, split), UNDEFINED, atype
        for name, value in _DIRECTIVE.findall(m["header"]):
            value = value.strip()
            if name in ("ID", "id"):
                aid = value
            elif name in ("TYPE", "type"):
                kind = value
            else:
                found.add(name, value)
        found.add("contents", (m["body"] or "").strip())
        if found.errors:
            yield Piece("error", m.start(), m.end(), m[0], message="; ".join(found.errors))
        else:
            yield Piece("artifact", m.start(), m.end(), m[0], aid, kind, found.done())
        at = m.end()
    if at < len(text):
        yield from _between(text, at, len(text))


def _between(text: str, start: int, end: int) -> Iterator[Piece]:
    part = text[start:end]
    if "[<" in part:
        yield Piece("error", start, end, part, message="a section is not closed")
    else:
        yield Piece("text", start, end, part)


# --- frontmatter files -------------------------------------------------------------------------------------------

_FRONT = re.compile(r"﻿?---[ \t]*\r?\n(?P<yaml>.*?)(?:^)---[ \t]*(?:\r?\n|\Z)(?P<body>.*)\Z", re.S | re.M)


def scan_frontmatter(text: str, stem: str, atype: str, *, multiple: set[str] = frozenset(), split: set[str] = frozenset(), labels: Labels = {}) -> Iterator[Piece]:
    """A whole file as one artifact: YAML frontmatter and body; the id defaults to the file's stem; null values are skipped."""
    if not text.strip("﻿ \t\r\n"):
        return
    m = _FRONT.match(text)
    data, body = {}, text.lstrip("﻿")
    if m:
        try:
            loaded = yaml.safe_load(m["yaml"])
        except yaml.YAMLError as e:
            yield Piece("error", 0, len(text), text, message=f"bad YAML: {e.__class__.__name__}")
            return
        if isinstance(loaded, dict):
            data, body = loaded, m["body"]
    found, kind = Attributes(multiple, split), str(data.get("atype") or atype)
    for name, value in data.items():
        if name in ("id", "atype") or value is None:
            continue
        for item in value if isinstance(value, list) else [value]:
            found.add(str(name), yaml_text(item, labels.get((kind, str(name)))))
    if "contents" not in found.values:
        found.add("contents", body.strip())
    yield Piece("artifact", 0, len(text), text, str(data.get("id") or stem), kind, found.done())


def sidecar_fields(text: str, atype: str, labels: Labels = {}) -> Piece:
    """The artifact that a sidecar's YAML describes; nulls become the text ``None``."""
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        return Piece("error", 0, len(text), text, message=f"bad YAML: {e.__class__.__name__}")
    if not isinstance(data, dict):
        return Piece("error", 0, len(text), text, message="a sidecar must be a mapping")
    lower = {str(k).lower(): v for k, v in data.items()}
    if lower.get("id") is None:
        return Piece("error", 0, len(text), text, message="a sidecar needs an id")
    kind = str(lower.get("atype") or atype)
    shown = lambda k, x: yaml_text(x, labels.get((kind, str(k))))
    values = {str(k): [shown(k, x) for x in v] if isinstance(v, list) else shown(k, v) for k, v in data.items() if str(k).lower() not in ("id", "atype")}
    return Piece("artifact", 0, len(text), text, str(lower["id"]), kind, values)


# --- fragments, headings, filters -----------------------------------------------------------------------------------

_ID = re.compile(r"[A-Za-z0-9_.-]+")


def _opening(markers: tuple[str, ...]) -> str:
    return rf"\[(?P<m>{'|'.join(map(re.escape, markers))})(?:\s+(?P<id>[^\]]+))?\]"


class Free:
    """The stretches of a text that no pass has taken yet, in order."""

    def __init__(self, length: int):
        self.stretches = [(0, length)]

    def take(self, spans: list[tuple[int, int]]) -> None:
        """Subtract ascending spans, each inside one stretch."""
        left, i = [], 0
        for a, b in self.stretches:
            while i < len(spans) and spans[i][0] < b:
                left.append((a, spans[i][0]))
                a, i = spans[i][1], i + 1
            left.append((a, b))
        self.stretches = [x for x in left if x[0] < x[1]]


def scan_fragments(text: str, markers: tuple[str, ...]) -> Iterator[Piece]:
    """Marked fragments ``[M]`` or ``[M id]`` of plain text, found in passes over what earlier ones have left.

    First closed ones, up to the next ``[/M]`` whatever lies between; then, in each stretch left, open ones, which end before a blank
    line (it is swallowed), a line that begins with a marker or is a heading, or with the stretch. A marker at the start of a line is
    an open one like any other, so that nothing is left for a pass of its own. Openings and ends are looked up once for the text."""
    if not markers:
        yield Piece("text", 0, len(text), text)
        return
    tag = _opening(markers)
    opened = [(m.start(), m.end(1), m["m"].upper(), m["id"]) for m in re.finditer(f"(?=({tag}))", text, re.I)]  # one may begin inside another
    closed: dict[str, list[tuple[int, int]]] = {}
    for m in re.finditer(rf"\[/({'|'.join(map(re.escape, markers))})\]", text, re.I):
        closed.setdefault(m[1].upper(), []).append(m.span())
    starts = {name: [x[0] for x in spans] for name, spans in closed.items()}
    found, free = [], Free(len(text))

    at = 0
    for start, end, name, given in opened:
        i = bisect_left(starts.get(name, ()), end)
        if start >= at and i < len(starts.get(name, ())):
            inner, at = (end, closed[name][i][0]), closed[name][i][1]
            found.append((start, at, at, name, given, text[slice(*inner)]))
    free.take([x[:2] for x in found])

    stop = re.compile(rf"\n\s*(?:\n|{re.sub(r'[?]P<[a-z]+>', '?:', tag)}|#{{1,6}}\s)", re.I)
    blank, later = re.compile(r"\n\s*\n"), []
    order = [x[0] for x in opened]
    for a, b in free.stretches:
        at = a
        for i in range(bisect_left(order, a), bisect_left(order, b)):
            start, end, name, given = opened[i]
            if start < at or end > b:
                continue
            hit = stop.search(text, end, b)
            last = hit.start() if hit else b
            gap = blank.match(text, last, b)
            at = gap.end() if gap else last
            later.append((start, at, last, name, given, text[end:last].strip()))
    free.take([x[:2] for x in later])

    plain = [(a, b, b, None, None, text[a:b]) for a, b in free.stretches]
    for start, end, last, name, given, inner in sorted([*found, *later, *plain]):
        block_id = given.strip() if given else None
        if name is None:
            yield Piece("text", start, end, inner)
        elif block_id is not None and not _ID.fullmatch(block_id):
            yield Piece("error", start, end, text[start:last], message=f"bad fragment id {block_id}")
        else:
            yield Piece("text", start, end, inner, marker=name, block_id=block_id)


def scan_headings(text: str) -> Iterator[Piece]:
    """Take ATX headings outside code fences out of plain text as blocks of their own."""
    start = at = 0
    fenced = False
    for line in text.splitlines(keepends=True):
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced and re.match(r" {0,3}#{1,6}\s", line):
            if text[start:at].strip():
                yield Piece("text", start, at, text[start:at])
            yield Piece("heading", at, at + len(line), line.strip(), marker="HEADING")
            start = at + len(line)
        at += len(line)
    if text[start:].strip():
        yield Piece("text", start, len(text), text[start:])


_TAG = re.compile(r"(?<![\w#/&])#(?![0-9a-fA-F]{3}(?:[0-9a-fA-F]{3})?\b)(?=[\w/-]*[^\W\d])[\w/-]+")
_ELEMENTS = {
    "callouts": re.compile(r"^\s*>\s*\[!"), "headings": re.compile(r"^ {0,3}#{1,6}\s"), "horizontal-rules": re.compile(r"^ {0,3}(?:-{3,}|\*{3,}|_{3,})\s*$"),
}


def exclude_elements(text: str, elements: dict[str, str], first_block: bool = False) -> str:
    """Drop Markdown elements outside code fences: callouts, headings, horizontal-rules, frontmatter, tags.

    Tags have three modes: ``only`` drops the tag, ``string`` the line that holds
    one, ``string-on-start`` the line that begins with one.
    """
    if "frontmatter" in elements and first_block and (m := _FRONT.match(text)):
        text = m["body"]
    out, fenced, quote = [], False, False
    for line in text.splitlines(keepends=True):
        bare = line.lstrip()
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
            out.append(line)
            continue
        if fenced:
            out.append(line)
            continue
        if quote and bare.startswith(">"):
            continue
        quote = "callouts" in elements and bool(_ELEMENTS["callouts"].match(line))
        if quote or any(n in elements and _ELEMENTS[n].match(line) for n in ("headings", "horizontal-rules")):
            continue
        if mode := elements.get("tags"):
            masked = re.sub(r"`[^`]*`", lambda m: " " * len(m[0]), line)
            tags = list(_TAG.finditer(masked))
            if tags and (mode == "string" or mode == "string-on-start" and not masked[: tags[0].start()].strip()):
                continue
            if tags and mode == "only":
                for m in reversed(tags):
                    line = line[: m.start()] + line[m.end() :]
                line = re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", line)
        out.append(line)
    return "".join(out)
