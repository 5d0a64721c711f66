"""Scanners of texts: segments, sections, frontmatter, sidecars, fragments, headings, exclusions."""

import pytest

from threadloom.sources import markup as m


def segments(text, **kw):
    return list(m.scan_segments(text, "REQ", "REQ", **kw))


def artifacts(text, **kw):
    return [(p.aid, p.fields) for p in segments(text, **kw) if p.kind == "artifact"]


def test_yaml_block_ends_a_segment_and_wins_over_inline_fields():
    text = "before\n[req]\nThe text.\n\nMore.\n[id] R-1\n[owner] me\n```yaml\nattrs:\n  owner: you\n  tag: [a, b]\n  derived: false\n```\nafter\n"
    out = segments(text, multiple={"tag"})
    assert [p.kind for p in out] == ["text", "artifact", "text"]
    assert out[1].aid == "R-1" and out[1].fields == {"owner": "you", "tag": ["a", "b"], "derived": "no", "contents": "The text.\n\nMore."}
    assert out[2].content == "\nafter\n" and "".join(text[p.start : p.end] for p in out) == text


def test_close_tag_allows_blank_lines_and_later_fences_are_text():
    out = segments("[REQ]\none\n\ntwo\n[id] R-1\n[/REQ]\n```yaml\nattrs: {}\n```\n")
    assert out[0].fields["contents"] == "one\n\ntwo" and out[1].kind == "text" and "```yaml" in out[1].content


@pytest.mark.parametrize("tail", ["\n\nnext", "\n# Heading\n", "\n[NOTE] x\n", "\n[REQ]\nb\n[id] R-2\n", "", "\n"])
def test_fallback_boundaries(tail):
    found = artifacts("[REQ]\ntext\n[id] R-1" + tail, fragments=("NOTE",))
    assert found[0] == ("R-1", {"contents": "text"})


def test_fields_are_lower_cased_and_continue_over_lines():
    assert artifacts("[REQ]\nt\n[ID] R-1\n[Why] because\nof this\n[/REQ]") == [("R-1", {"why": "because\nof this", "contents": "t"})]


def test_missing_id_nbsp_bad_yaml_and_repeated_fields():
    assert artifacts("[REQ]\nonly text\n")[0][0] == "<undefined>"
    kinds = lambda t: [(p.kind, p.message) for p in segments(t)]
    assert kinds("[REQ]\na b\n[id] R-1\n")[0][0] == "error"
    assert kinds("[REQ]\na\n```yaml\nfoo: 1\n```\n")[0] == ("error", "the YAML block has no attrs")
    assert kinds("[REQ]\na\n```yaml\nattrs: [\n```\n")[0][0] == "error"
    assert kinds("[REQ]\na\n[x] 1\n[x] 2\n")[0] == ("error", "attribute x occurs more than once")


def test_multiple_and_split_attributes():
    text = "[REQ]\nt\n[id] R-1\n[see] A, B\n[see] C\n[/REQ]"
    assert artifacts(text, multiple={"see", "tag"}, split={"see"}) == [("R-1", {"see": ["A", "B", "C"], "tag": [], "contents": "t"})]


def test_sections_of_source_code():
    out = list(m.scan_sections("# [< ID=T-1 TYPE\n# TYPE = TST\nparent = R-1@abc\n>>> body [x] >] code [< open", "SRC"))
    assert [p.kind for p in out] == ["text", "artifact", "error"]
    assert out[1].aid.startswith("T-1") and out[1].atype == "TST" and out[1].fields == {"parent": "R-1@abc", "contents": "body [x]"}


def test_frontmatter_files():
    one = lambda t: next(m.scan_frontmatter(t, "stem", "TSK"), None)
    assert one("﻿---\nid: T-9\nnone: null\nok: true\n---\nbody\n").fields == {"ok": "yes", "contents": "body"}
    assert (one("just text").aid, one("just text").fields) == ("stem", {"contents": "just text"})
    assert one(" \n") is None and one("---\na: [\n---\nx").kind == "error"
    assert one("---\n- a\n---\nx").fields["contents"].startswith("---")


def test_sidecars():
    assert m.sidecar_fields("ID: S-1\ntitle: null\nn: 3\n", "PIC").fields == {"title": "None", "n": "3"}
    assert [m.sidecar_fields(t, "PIC").kind for t in ("a: [", "- x", "title: y")] == ["error"] * 3


def test_fragments_headings_and_exclusions():
    out = list(m.scan_fragments("a [note n1]in[/NOTE] b\n[COM] open text\n\nrest [NOTE bad id!]x[/NOTE]", ("NOTE", "COM")))
    assert [(p.kind, p.marker, p.block_id) for p in out] == [("text", None, None), ("text", "NOTE", "n1"), ("text", None, None), ("text", "COM", None), ("text", None, None), ("error", None, None)]
    assert [(p.kind, p.content.strip()) for p in m.scan_headings("x\n# H\n```\n# no\n```\ny")] == [("text", "x"), ("heading", "# H"), ("text", "```\n# no\n```\ny")]
    text = "---\na: 1\n---\n# H\n> [!note] c\n> more\nkeep #tag and #ff00aa `#code`\n#start x\n---\n```\n# in\n```\n"
    every = {"frontmatter": "only", "headings": "only", "callouts": "only", "horizontal-rules": "only"}
    assert m.exclude_elements(text, every, True) == "keep #tag and #ff00aa `#code`\n#start x\n```\n# in\n```\n"
    assert m.exclude_elements("keep #tag x\n#start x\n", {"tags": "string-on-start"}) == "keep #tag x\n"
    assert m.exclude_elements("keep #tag x\nz\n", {"tags": "string"}) == "z\n"
    assert m.exclude_elements("keep #tag x #ff00aa\n", {"tags": "only"}) == "keep x #ff00aa\n"


def _passes(text, names):
    """Fragments by patterns, pass by pass over the text that is left: (start, marker, id, content)."""
    import re

    some = "|".join(names)
    closed = re.compile(rf"\[({some})(?:\s+([^\]]+))?\](.*?)\[/\1\]", re.I | re.S)
    still = re.compile(rf"\[({some})(?:\s+([^\]]+))?\](.*?)(?=\n\s*\n|\n\s*\[(?:{some})(?:\s+[^\]]+)?\]|\n\s*#{{1,6}}\s|\Z)", re.I | re.S)
    left, out = [(0, text)], []
    for pattern in (closed, still):
        rest = []
        for base, part in left:
            at = 0
            for hit in pattern.finditer(part):
                if part[at : hit.start()]:
                    rest.append((base + at, part[at : hit.start()]))
                content = hit[3] if pattern is closed else hit[3].strip()
                out.append((base + hit.start(), hit[1].upper(), hit[2] and hit[2].strip(), content))
                gap = re.match(r"\n\s*\n", part[hit.end() :]) if pattern is still else None
                at = hit.end() + (gap.end() if gap else 0)
            if part[at:]:
                rest.append((base + at, part[at:]))
        left = rest
    return sorted([*out, *((a, None, None, t) for a, t in left)], key=lambda x: x[0])


def test_fragments_match_passes_over_patterns():
    import random
    import time

    rng = random.Random(4)
    parts = ["[COM]", "[com n1]", "[NOTE]", "[Note a.b-c]", "[/COM]", "[/note]", "[COM x [NOTE]", "[NOTE \n y]", "\n", "\n\n", "\n \t\n", "# H", "\n# H\n", "\n  ## x", "text", " ", "[", "]", "[OTHER]", "#no", "[COMx]"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        want = _passes(text, ("COM", "NOTE"))
        got = [(p.start, p.marker, p.block_id, p.content) for p in m.scan_fragments(text, ("COM", "NOTE")) if p.kind == "text"]
        bad = [(p.start, p.message.removeprefix("bad fragment id ")) for p in m.scan_fragments(text, ("COM", "NOTE")) if p.kind == "error"]
        assert got == [w for w in want if w[2] is None or m._ID.fullmatch(w[2])], text
        assert bad == [(w[0], w[2]) for w in want if w[2] is not None and not m._ID.fullmatch(w[2])]
        assert "".join(text[p.start : p.end] for p in m.scan_fragments(text, ("COM", "NOTE"))) == text
    began = time.perf_counter()
    assert len(list(m.scan_fragments("[COM] never closed\n" * 40_000, ("COM", "NOTE")))) == 40_000 + 39_999
    assert time.perf_counter() - began < 20


class Handed:
    """Stands for a DataFrame of one batch; gives what a task hands on, part by part."""

    columns = ["record", "path", "value"]

    def __init__(self, values):
        import pandas as pd

        self.frame = pd.DataFrame({"record": "r", "path": [f"f{i}.md" for i in range(len(values))], "value": values})

    def mapInPandas(self, run, _):
        return [(len(x), x.to_dict("records")) for x in run(iter([self.frame]))]

    def mapInArrow(self, run, _):
        import pyarrow as pa

        return [(x.num_rows, x.to_pylist()) for x in run(iter([pa.RecordBatch.from_pandas(self.frame)]))]


def test_a_scan_hands_on_bounded_parts(spark):
    from threadloom.sources import scan

    # many files in one batch, and one file of many blocks
    for values in (["text\n\n[ORD]\na\n[id] O-1\n[/ORD]\n" * 20] * 300, ["text\n\n[ORD]\na\n[id] O-1\n[/ORD]\n" * 6000]):
        parts = scan.scan_markdown(Handed(values), "ORD", "ORD")
        rows = [r for _, part in parts for r in part]
        assert len(rows) == 12_000 and max(n for n, _ in parts) <= 2000
        assert [r["block_no"] for r in rows] == [n for _ in values for n in range(12_000 // len(values))]
        assert sum(r["kind"] == "artifact" and dict(r["fields"])["contents"]["vals"] == ["a"] for r in rows) == 6000


def test_a_scan_hands_on_large_blocks_one_by_one(spark):
    from threadloom.sources import scan

    parts = scan.scan_markdown(Handed(["x" * 3_000_000, None, "", "y" * 3_000_000]), "ORD", "ORD")
    assert [[(r["path"], r["kind"], len(r["content"]), r["fields"]) for r in part] for _, part in parts] == [[("f0.md", "text", 3_000_000, [])], [("f3.md", "text", 3_000_000, [])]]


def test_a_scan_for_fragments_hands_on_bounded_parts(spark):
    from threadloom.sources import scan

    text = "Before. [Note n.1] closed\n\nx [/NOTE] after\n\n[com]lead [REM] y\n## Heading\n"
    for values in ([text * 10] * 500, [text * 5000]):
        parts = scan.scan_markdown(Handed(values), "ORD", "ORD", fragments=("NOTE", "COM", "REM"))
        rows = [r for _, part in parts for r in part]
        assert max(n for n, _ in parts) <= 2000
        assert [r["marker"] for r in rows if r["marker"] in ("NOTE", "COM")] == ["NOTE", "COM"] * 5000
        assert {r["content"] for r in rows if r["marker"] == "NOTE"} == {" closed\n\nx "} and {r["content"] for r in rows if r["marker"] == "COM"} == {"lead [REM] y"}
