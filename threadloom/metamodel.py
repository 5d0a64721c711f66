"""The schema language: an indented text of artifact and trace rules, parsed into rule rows.

    artifact REQ:
        id is string as REQ-{num:3}
        attribute contents is mandatory string
        attribute status is mandatory enum [draft, active] if approved
    trace from REQ to SYS or ARCH is mandatory via commit
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from threadloom import model

_NAME = r"[A-Za-z][A-Za-z0-9_-]*"
_VALUE = rf'"(?:[^"\\]|\\.)*"|{_NAME}'
_COND = rf"(?:\s+if\s+(?P<neg>not\s+)?(?P<anchor>{_NAME}))?"
_ARTIFACT = re.compile(rf"artifact\s+(?P<name>{_NAME})\s*:$")
_ID = re.compile(r"id\s+is\s+(?P<type>\w+)(?:\s+as\s+(?P<schema>.+))?$")
_ATTR = re.compile(
    rf"attribute\s+(?P<name>{_NAME})\s+is\s+(?P<presence>mandatory|optional)\s+(?P<multiple>multiple\s+)?"
    rf"(?P<type>string|integer|boolean|reference|enum)(?P<parent>\s+to\s+parent)?\s*(?:\[(?P<items>[^\]]*)\])?{_COND}$"
)
_TRACE = re.compile(
    rf"trace\s+from\s+(?P<source>{_NAME})\s+to\s+(?P<targets>{_NAME}(?:\s+or\s+{_NAME})*)\s+is\s+(?P<presence>mandatory|optional)"
    rf"(?:\s+via\s+(?P<mode>commit|timestamp))?{_COND}$"
)


class MetamodelError(ValueError):
    """The text is not a valid metamodel."""


@dataclass
class Metamodel:
    attr_rules: list[dict] = field(default_factory=list)
    trace_rules: list[dict] = field(default_factory=list)
    #: How the booleans of (type, attribute) with labels of their own are written.
    labels: dict[tuple[str, str], tuple[str, str]] = field(default_factory=dict)

    @property
    def types(self) -> list[str]:
        return list(dict.fromkeys(r["atype"] for r in self.attr_rules))

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """(attr_rules, trace_rules) as DataFrames."""
        return spark.createDataFrame(self.attr_rules, model.schema(model.ATTR_RULES)), spark.createDataFrame(self.trace_rules, model.schema(model.TRACE_RULES))

    def rules(self, atype: str, attr: str) -> list[dict]:
        return [r for r in self.attr_rules if r["atype"] == atype and r["attr"] == attr]


def _code(line: str) -> str:
    """A line without its comment (a ``#`` outside quotes)."""
    out, quoted = [], False
    for c in line:
        quoted ^= c == '"'
        if c == "#" and not quoted:
            break
        out.append(c)
    return "".join(out).rstrip()


def _values(text: str) -> list[str]:
    found = re.findall(_VALUE, text)
    return [v[1:-1].replace('\\"', '"') if v[:1] == '"' else v for v in found]


def _labels(items: str | None) -> tuple[list[str], list[str]]:
    """Custom boolean labels, which replace the usual ones."""
    if items is None:
        return model.TRUE, model.FALSE
    m = re.fullmatch(r"\s*true\s*:(.*?),\s*false\s*:(.*)", items, re.S)
    if not m:
        raise MetamodelError(f"boolean values must name true and false: [{items}]")
    return _values(m[1]), _values(m[2])


def parse(text: str) -> Metamodel:
    """Parse and check a metamodel."""
    out, current, counts, traces = Metamodel(), None, {}, {}
    for number, raw in enumerate(text.splitlines(), 1):
        line = _code(raw)
        if not line.strip():
            continue
        body = line.strip()
        if line[0] not in " \t":
            current = None
            if m := _ARTIFACT.match(body):
                current = m["name"]
                counts.setdefault(current, 0)
            elif m := _TRACE.match(body):
                rule = traces[m["source"]] = traces.get(m["source"], 0) + 1
                out.trace_rules.append({
                    "source": m["source"], "rule_no": rule, "targets": re.split(r"\s+or\s+", m["targets"]), "presence": m["presence"],
                    "mode": m["mode"] or "timestamp", "cond_anchor": m["anchor"], "cond_negated": bool(m["neg"]), "cond_true": None,
                })
            else:
                raise MetamodelError(f"line {number}: {body}")
            continue
        if current is None:
            raise MetamodelError(f"line {number}: a rule outside an artifact")
        counts[current] += 1
        rule = {
            "atype": current, "rule_no": counts[current], "multiple": False, "allowed": None, "true_vals": None, "false_vals": None, "to_parent": False,
            "id_schema": None, "cond_anchor": None, "cond_negated": False, "cond_true": None,
        }
        if m := _ID.match(body):
            out.attr_rules.append(rule | {"attr": "id", "presence": "mandatory", "type": m["type"], "id_schema": m["schema"].strip().strip('"') if m["schema"] else None})
        elif m := _ATTR.match(body):
            rule |= {"attr": m["name"], "presence": m["presence"], "multiple": bool(m["multiple"]), "type": m["type"], "cond_anchor": m["anchor"], "cond_negated": bool(m["neg"])}
            if m["type"] == "enum":
                if not (m["items"] or "").strip():
                    raise MetamodelError(f"line {number}: an enum needs values")
                rule["allowed"] = _values(m["items"])
            elif m["type"] == "boolean":
                own = _labels(m["items"])
                rule["true_vals"], rule["false_vals"] = ([v.lower() for v in side] for side in own)
                if m["items"] is not None and all(own):
                    out.labels.setdefault((current, m["name"]), (own[0][0], own[1][0]))
            elif m["items"] is not None or (m["parent"] and m["type"] != "reference"):
                raise MetamodelError(f"line {number}: {body}")
            rule["to_parent"] = bool(m["parent"])
            out.attr_rules.append(rule)
        else:
            raise MetamodelError(f"line {number}: {body}")
    check(out)
    for r in (*out.attr_rules, *out.trace_rules):
        if r["cond_anchor"]:
            own = [a["true_vals"] for a in out.rules(r.get("atype") or r["source"], r["cond_anchor"])]
            r["cond_true"] = next((labels for labels in own if labels != model.TRUE), model.TRUE)
    return out


def check(m: Metamodel) -> None:
    """Well-formedness: id and contents of every type, one number macro, unconditional boolean anchors."""
    for atype in m.types:
        ids, contents = m.rules(atype, "id"), m.rules(atype, "contents")
        if not ids or any(r["presence"] != "mandatory" or r["cond_anchor"] for r in ids):
            raise MetamodelError(f"{atype}: id must be mandatory and unconditional")
        for r in ids:
            if len(re.findall(r"\{num(?::\d+)?\}", r["id_schema"] or "")) > 1:
                raise MetamodelError(f"{atype}: an id schema has one number at most")
            if re.search(r"\{(?!atype\}|num(?::\d+)?\})", r["id_schema"] or ""):
                raise MetamodelError(f"{atype}: unknown placeholder in {r['id_schema']}")
        if not any(r["presence"] == "mandatory" and not r["cond_anchor"] for r in contents):
            raise MetamodelError(f"{atype}: contents must be mandatory and unconditional")
        for r in (r for r in m.attr_rules if r["atype"] == atype and r["cond_anchor"]):
            _anchor(m, atype, r["cond_anchor"])
    for r in (r for r in m.trace_rules if r["cond_anchor"]):
        _anchor(m, r["source"], r["cond_anchor"])


def _anchor(m: Metamodel, atype: str, anchor: str) -> None:
    rules = m.rules(atype, anchor)
    if not rules or any(r["type"] != "boolean" or r["cond_anchor"] for r in rules):
        raise MetamodelError(f"{atype}: condition on {anchor}, which is no unconditional boolean")


def id_pattern(schema: str, atype: str) -> str:
    """The regular expression of an id schema."""
    out = []
    for part in re.split(r"(\{atype\}|\{num(?::\d+)?\})", schema):
        if part == "{atype}":
            out.append(re.escape(atype))
        elif part.startswith("{num"):
            width = re.search(r":(\d+)", part)
            out.append(rf"(\d{{{width[1]},}})" if width else r"(\d+)")
        else:
            out.append(re.escape(part))
    return "^" + "".join(out) + "$"
