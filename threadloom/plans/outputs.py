"""Driver-side outputs: copied images, converted documents, task files, ordered steps."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Iterable
from graphlib import TopologicalSorter
from pathlib import Path

#: What each analysis step needs.
STEPS = {"extract": [], "key": ["extract"], "links": ["key"], "graph": ["links"], "validate": ["graph"], "revisions": ["key"], "impact": ["graph", "revisions"], "metrics": ["validate"]}


def ordered_steps(wanted: str, steps: dict[str, list[str]] | None = None) -> list[str]:
    """The steps that ``wanted`` depends on, each after its own needs, and itself last."""
    steps = STEPS if steps is None else steps
    need, stack = {}, [wanted]
    while stack:
        name = stack.pop()
        if name not in steps:
            raise ValueError(f"unknown step {name}")
        if name not in need:
            need[name] = steps[name]
            stack += steps[name]
    return list(TopologicalSorter(dict(sorted(need.items()))).static_order())


def copy_images(rows: Iterable, source: str | Path, folder: str | Path) -> dict[str, str]:
    """Copy (url, path) images into an emptied ``images`` folder; equal paths are copied once, equal names get a number."""
    target = Path(folder) / "images"
    shutil.rmtree(target, ignore_errors=True)
    target.mkdir(parents=True)
    base, by_path, names, out = Path(source).resolve(), {}, set(), {}
    for url, path in rows:
        file = (base / path).resolve()
        if not file.is_relative_to(base) or not file.is_file():
            continue
        if path not in by_path:
            name, n = file.name, 1
            while name in names:
                name, n = f"{file.stem}-{n}{file.suffix}", n + 1
            names.add(name)
            shutil.copyfile(file, target / name)
            by_path[path] = f"images/{name}"
        out[url] = by_path[path]
    return out


def convert(path: str | Path, suffix: str, template: str | None = None, timeout: int = 120) -> Path:
    """Convert a Markdown document with pandoc, where it is installed."""
    out = Path(path).with_suffix(f".{suffix}")
    extra = [f"--reference-doc={template}"] if template else []
    subprocess.run(["pandoc", str(path), "-o", str(out), *extra], check=True, timeout=timeout, capture_output=True)
    return out


TASK = (
    "---\nid: {task_id}\natype: {atype}\nstatus: open\nchild_revision: {child_rev}\nparent_revision: {parent_rev}\n---\n# Check {child_id} against {pid}\n\n"
    "## Parent (Updated)\n\n- **ID:** {pid}\n- **Type:** {parent_type}\n- **File:** {parent_file}\n- **Input Record:** {parent_record}\n\n"
    "## Child (Outdated)\n\n- **ID:** {child_id}\n- **Type:** {child_type}\n- **File:** {child_file}\n- **Input Record:** {child_record}\n"
)


class _Known(dict):
    def __missing__(self, key: str) -> str:
        return ""


def write_tasks(rows: Iterable, folder: str | Path, template: str = TASK) -> dict[str, int]:
    """Write the task files of a plan; rows to skip are counted only."""
    folder, counts = Path(folder), {"create": 0, "update": 0, "skip": 0}
    folder.mkdir(parents=True, exist_ok=True)
    for r in rows:
        counts[r["action"]] += 1
        if r["action"] != "skip":
            (folder / r["file_name"]).write_text(template.format_map(_Known((k, "" if v is None else v) for k, v in r.items())), encoding="utf-8")
    return counts


def check_task(before: str, after: str) -> list[str]:
    """What an edit of a task file must not have changed (K23): its id, revisions and head line."""
    def facts(text: str) -> dict:
        return {k: (m[1].strip() if (m := re.search(rf"(?m)^{p}(.*)$", text)) else None) for k, p in (("id", "id:"), ("child revision", "child_revision:"), ("parent revision", "parent_revision:"), ("title", "# "))}

    old, new = facts(before), facts(after)
    return [f"{k} was changed" for k in old if old[k] != new[k]]
