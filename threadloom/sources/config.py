"""Project files read on the driver: TOML settings, vault settings, publish settings, agents."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

import yaml

DRIVERS = ("text", "sidecar", "obsidian", "ipynb", "simple-markdown")
ELEMENTS = ("callouts", "headings", "horizontal-rules", "frontmatter", "tags")
LANGUAGES = ("en", "ru")
MODES = ("only", "string", "string-on-start")
_MARKER = re.compile(r"[A-Za-z][A-Za-z0-9_-]*")


class ConfigError(ValueError):
    """The project's settings cannot be used."""


@dataclass
class InputRecord:
    """One source of artifacts."""

    name: str
    dir: str
    driver: str
    filter: str | None = None
    atype: str = "REQ"
    marker: str | None = None
    markers: list[str] = field(default_factory=list)
    publish: str | None = None
    exclude_elements: dict[str, str] = field(default_factory=dict)
    task_template: str | None = None
    sidecars: list[str] = field(default_factory=lambda: [".stmx", ".side.yaml"])

    def __post_init__(self):
        self.marker = self.marker or self.atype


@dataclass
class Metrics:
    requirement_type: str = "REQ"
    status_field: str = "status"
    verify_field: str = "verify"
    tbd_marker: str = "TBD"


@dataclass
class Impact:
    tasks_enabled: bool = False
    tasks_dir: str = "tasks/"
    tasks_template: str | None = None
    task_atype_map: dict[str, str] = field(default_factory=dict)


@dataclass
class Config:
    base: Path
    input: list[InputRecord]
    output_path: str = "outputs/"
    metamodel: str | None = None
    metrics: Metrics = field(default_factory=Metrics)
    impact: Impact = field(default_factory=Impact)
    path_as_links: bool = False
    wiki_links: bool = False
    tag_pattern: str | None = None
    plugins: list[dict] = field(default_factory=list)
    strict_line_breaks: str = "on"
    language: str = "en"
    publish: str | None = None
    trace_plugins: list[str] = field(default_factory=list)


def merged(low: dict, high: dict) -> dict:
    """A deep merge in which ``high`` wins; lists are replaced."""
    return low | {k: merged(low[k], v) if isinstance(v, dict) and isinstance(low.get(k), dict) else v for k, v in high.items()}


def exclusions(value) -> dict[str, str]:
    """Element -> mode, from a list of ``name`` or ``name:mode`` entries or a mapping."""
    items = value.items() if isinstance(value, dict) else (str(x).partition(":")[::2] for x in value or [])
    out = {}
    for name, mode in items:
        mode = mode or "string-on-start"
        if name not in ELEMENTS or mode not in MODES:
            raise ConfigError(f"unknown element to exclude: {name}:{mode}")
        out[name] = mode
    return out


def load(path: str | Path, home: str | Path | None = None) -> Config:
    """Read a project's TOML over the user's own one and check it."""
    path = Path(path)
    own = Path(home) / "config.toml" if home else None
    data = tomllib.loads(own.read_text(encoding="utf-8")) if own and own.exists() else {}
    data = merged(data, tomllib.loads(path.read_text(encoding="utf-8")))
    common = exclusions(data.get("drivers", {}).get("obsidian", {}).get("exclude_elements"))
    records, seen, markers = [], set(), {}
    for raw in data.get("input", []):
        try:
            record = InputRecord(**{k: v for k, v in raw.items() if k in InputRecord.__dataclass_fields__})
        except TypeError as e:
            raise ConfigError(f"input {raw.get('name', '?')}: {e}") from e
        record.exclude_elements = common | exclusions(raw.get("exclude_elements"))
        if record.driver not in DRIVERS and record.driver != "markdown":
            raise ConfigError(f"input {record.name}: unknown driver {record.driver}")
        if record.name in seen:
            raise ConfigError(f"input {record.name} occurs twice")
        seen.add(record.name)
        for marker in (record.marker, *record.markers):
            if not _MARKER.fullmatch(marker):
                raise ConfigError(f"input {record.name}: bad marker {marker}")
        names = [m.upper() for m in record.markers]
        if len(set(names)) != len(names) or record.marker.upper() in names:
            raise ConfigError(f"input {record.name}: markers collide")
        markers[record.name] = names
        records.append(record)
    if not records:
        raise ConfigError("no inputs")
    if data.get("language", "en") not in LANGUAGES:
        raise ConfigError(f"unknown language {data['language']}")
    pick = lambda cls, part: cls(**{k: v for k, v in data.get(part, {}).items() if k in cls.__dataclass_fields__})
    report = data.get("report", {})
    return Config(
        base=(path.parent / data.get("base", "..")).resolve(), input=records, output_path=data.get("output_path", "outputs/"), metamodel=data.get("metamodel", {}).get("filename"),
        metrics=pick(Metrics, "metrics"), impact=pick(Impact, "impact"), path_as_links=report.get("path_as_links", False), wiki_links=report.get("wiki_links", False),
        tag_pattern=data.get("baseline", {}).get("tag_pattern"), plugins=data.get("plugins", []), strict_line_breaks=str(data.get("drivers", {}).get("obsidian", {}).get("strict_line_breaks", "on")).lower(), language=data.get("language", "en"), publish=data.get("publish"),
        trace_plugins=data.get("trace", {}).get("plugins", []),
    )


def keeps_breaks(config: Config) -> bool:
    """Whether single line ends are left as they are; ``auto`` asks the vault (C11)."""
    if config.strict_line_breaks == "auto":
        strict = vault_settings(config.base)["strict_line_breaks"]
        return True if strict is None else strict
    return config.strict_line_breaks not in ("off", "false")


def vault_settings(folder: str | Path) -> dict:
    """``attachmentFolderPath`` and ``strictLineBreaks`` of a vault; missing or unreadable settings are None."""
    try:
        data = json.loads((Path(folder) / ".obsidian" / "app.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        data = {}
    data = data if isinstance(data, dict) else {}
    path, strict = data.get("attachmentFolderPath"), data.get("strictLineBreaks")
    return {"attachment_folder": path if isinstance(path, str) else None, "strict_line_breaks": strict if isinstance(strict, bool) else None}


@dataclass
class Publish:
    """How artifacts are rendered."""

    start_level: int = 1
    remove_numeric_prefixes_in_headers: bool = True
    include_plain_text: bool = True
    contents_marker: str = "_contents_"
    table_spacer: int = 1
    attribute_presence: str = "values-only"
    render: dict = field(default_factory=dict)
    docx_template: str | None = None


def publish_settings(named: str | None, common: str | None, folder: str | Path) -> Publish:
    """A record's own file, else the common one, else one found in the folder, else the defaults."""
    folder = Path(folder)
    found = [p for p in (folder / "publish.yaml", folder / "publish.toml") if p.exists()]
    if not named and not common and len(found) > 1:
        raise ConfigError("both publish.yaml and publish.toml are there")
    path = folder / named if named else folder / common if common else found[0] if found else None
    if path is None:
        return Publish()
    text = path.read_text(encoding="utf-8")
    data = tomllib.loads(text) if path.suffix == ".toml" else yaml.safe_load(text) or {}
    data = {k.replace("-", "_"): v for k, v in data.items()}
    unknown = set(data) - set(Publish.__dataclass_fields__)
    if unknown:
        raise ConfigError(f"unknown publish settings: {', '.join(sorted(unknown))}")
    out = Publish(**data)
    if out.attribute_presence not in PRESENCE or not 0 <= out.table_spacer <= 20 or not out.contents_marker.strip() or set("/\\") & set(out.contents_marker):
        raise ConfigError("bad publish settings")
    out.render = {name: [_section(name, s) for s in sections] for name, sections in out.render.items()}
    return out


PRESENCE = ("all", "mandatory", "values-only")


def _section(name: str, section: dict) -> dict:
    """One section of a type or marker: a table of attributes, texts of attributes, or a marker's own text."""
    if not isinstance(section, dict):
        raise ConfigError(f"render {name}: a section must be a mapping")
    section = {k.replace("-", "_"): v for k, v in section.items()}
    allowed = {"table": {"type", "spacer", "attribute_presence", "attributes"}, "text": {"type", "mode", "attributes", "alias"}}.get(section.get("type"), set())
    named = section.get("attributes", [])
    good = set(section) <= allowed and all(isinstance(a, dict) and len(a) == 1 and all(set(how) == {"alias"} for how in a.values()) for a in named)
    if section.get("type") == "table":
        good &= "attributes" in section and section.get("attribute_presence") in (None, *PRESENCE) and (section.get("spacer") is None or 0 <= section["spacer"] <= 20)
    else:
        good &= section.get("mode") in ("block", "inline") and ("attributes" in section) != ("alias" in section)
    if not good:
        raise ConfigError(f"render {name}: bad section {section}")
    return section


def agents(path: str | Path) -> dict[str, dict]:
    """Named agents of a YAML registry."""
    data = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    return {str(a["name"]): a for a in data.get("agents", []) if isinstance(a, dict) and a.get("name")}


def home() -> Path:
    return Path(os.environ.get("THREADLOOM_HOME") or Path.home() / ".config" / "threadloom")


def json_schema(cls=Config) -> dict:
    """A JSON Schema of a settings class."""
    kinds = {"str": "string", "int": "integer", "bool": "boolean", "Path": "string"}

    def of(annotation: str) -> dict:
        name = annotation.split(" | ")[0]
        if name.startswith("list["):
            return {"type": "array", "items": of(name[5:-1])}
        if name.startswith("dict"):
            return {"type": "object"}
        nested = {"InputRecord": InputRecord, "Metrics": Metrics, "Impact": Impact}.get(name)
        return json_schema(nested) if nested else {"type": kinds.get(name, "string")}

    return {"type": "object", "properties": {k: of(str(f.type)) for k, f in cls.__dataclass_fields__.items()}}


def publish_schema() -> dict:
    """A JSON Schema of the publish settings, sections included."""
    presence, mode = {"enum": list(PRESENCE)}, {"enum": ["block", "inline"]}
    alias = {"type": "object", "properties": {"alias": {"type": "string"}}, "required": ["alias"], "additionalProperties": False}
    named = {"type": "array", "items": {"type": "object", "additionalProperties": alias, "minProperties": 1, "maxProperties": 1}}
    spacer = {"type": "integer", "minimum": 0, "maximum": 20}
    kind = lambda name, required, **more: {"type": "object", "properties": {"type": {"const": name}, **more}, "required": ["type", *required], "additionalProperties": False}
    sections = [kind("table", ["attributes"], **{"spacer": spacer, "attribute-presence": presence, "attributes": named}), kind("text", ["mode", "attributes"], mode=mode, attributes=named), kind("text", ["mode", "alias"], mode=mode, alias={"type": "string"})]
    out = json_schema(Publish)
    known = {k.replace("_", "-") if k in ("table_spacer", "attribute_presence", "docx_template") else k: v for k, v in out["properties"].items()}
    known |= {"table-spacer": spacer, "attribute-presence": presence, "render": {"type": "object", "additionalProperties": {"type": "array", "items": {"oneOf": sections}}}}
    return {"type": "object", "properties": known}
