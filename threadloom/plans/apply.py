"""Edit plans written into files on the driver, one file at a time."""

from __future__ import annotations

import re
from collections.abc import Iterable


def new_ids(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    """Give artifacts new ids. ``edits``: (first offset, end offset, new id) of segments, source sections or whole frontmatter files."""
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + _renamed(text[start:end], new) + text[end:]
    return text


def _renamed(part: str, new: str) -> str:
    for pattern in (r"(?im)^(\[id\][ \t]*)[^\r\n]*", r"(?m)^([ \t]*id:[ \t]*)[^\r\n]*", r"(?m)(\b(?:ID|id)[ \t]*=[ \t]*)[A-Za-z0-9_-]+"):
        out, n = re.subn(pattern, lambda m: m[1] + new, part, count=1)
        if n:
            return out
    if part.startswith("[<"):
        return "[< ID = " + new + "\n" + part[2:].lstrip(" ")
    if part.startswith("---"):
        return re.sub(r"\A---[ \t]*\r?\n", lambda m: m[0] + f"id: {new}\n", part)
    if (fence := re.search(r"(?m)^([ \t]*)attrs:[ \t]*$", part)):
        return part[: fence.end()] + f"\n{fence[1]}  id: {new}" + part[fence.end() :]
    close = re.search(r"(?m)^\[/", part)
    line = f"[id] {new}\n"
    if close:
        return part[: close.start()] + line + part[close.start() :]
    body = part.rstrip("\r\n")
    return body + "\n" + line.rstrip("\n") + part[len(body) :]


def set_attribute(part: str, name: str, value: str | None, mode: str, as_field: bool = False) -> str:
    """Add, replace or delete an attribute of one segment or frontmatter file; ``add`` keeps an existing value.

    ``as_field`` adds it as an inline field also where there is a YAML block."""
    inline = re.compile(rf"(?im)^\[{re.escape(name)}\][ \t]*[^\r\n]*(?:\r?\n(?!\[|```|\s*$)[^\r\n]*)*(\r?\n|\Z)")
    front = part.startswith("---")
    block = re.compile(rf"(?m)^(?P<i>[ \t]*){re.escape(name)}:[^\r\n]*(?:\r?\n(?P=i)[ \t]+[^\r\n]*)*(\r?\n|\Z)")
    scope = re.search(r"\A---.*?^---", part, re.S | re.M) if front else re.search(r"^```yaml.*?^```", part, re.S | re.M)
    inside = block.search(part, scope.start(), scope.end()) if scope else None
    outside = None if front else inline.search(part)
    hit = inside or outside
    if hit:
        if mode == "add":
            return part
        if mode == "del":
            return part[: hit.start()] + part[hit.end() :]
        line = f"{inside['i']}{name}: {value}" if inside else f"[{name}] {value}"
        return part[: hit.start()] + line + (hit[hit.lastindex] or "") + part[hit.end() :]
    if mode == "del" or (mode == "replace"):
        return part
    if scope and front:
        return part[: scope.end() - 3] + f"{name}: {value}\n" + part[scope.end() - 3 :]
    if scope and as_field:
        return part[: scope.start()] + f"[{name}] {value}\n" + part[scope.start() :]
    if scope and (attrs := re.search(r"(?m)^([ \t]*)attrs:[ \t]*$", part[scope.start() : scope.end()])):
        at = scope.start() + attrs.end()
        return part[:at] + f"\n{attrs[1]}  {name}: {value}" + part[at:]
    close = re.search(r"(?m)^\[/", part)
    if close:
        return part[: close.start()] + f"[{name}] {value}\n" + part[close.start() :]
    body = part.rstrip("\r\n")
    return body + f"\n[{name}] {value}" + part[len(body) :]


def set_attributes(text: str, edits: Iterable[tuple]) -> str:
    """(first offset, end offset, name, value, mode) edits of one file, applied bottom up, those of one segment together (H5)."""
    by: dict[tuple[int, int], list] = {}
    for start, end, *edit in edits:
        by.setdefault((start, end), []).append(edit)
    for (start, end), own in sorted(by.items(), reverse=True):
        part = text[start:end]
        for name, value, mode, *inline in own:
            part = set_attribute(part, name, value, mode, *inline)
        text = text[:start] + part + text[end:]
    return text


def marker_ids(text: str, edits: Iterable[tuple[int, str, str]]) -> str:
    """(offset of the tag, marker, new id): put ids into fragment tags; their case and line ends stay."""
    for start, marker, new in sorted(edits, reverse=True):
        tag = re.compile(rf"\[({re.escape(marker)})[^\]\r\n]*\]", re.I).match(text, start)
        if tag:
            text = text[:start] + f"[{tag[1]} {new}]" + text[tag.end() :]
    return text
