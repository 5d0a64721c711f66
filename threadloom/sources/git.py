"""Revisions, changed files and tags of a repository on the driver's disk, by the git command line.

What is asked of every file is in :mod:`threadloom.sources.history` and runs in the executors.
"""

from __future__ import annotations

import re
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHANGES = "path string, status string, old_path string"
WORKING = "working"


class GitError(RuntimeError):
    """A git command failed."""


def git(repo: str | Path, *args: str) -> str:
    done = subprocess.run(["git", "-C", str(repo), *args], capture_output=True, text=True, encoding="utf-8", errors="replace")
    if done.returncode:
        raise GitError(done.stderr.strip() or f"git {args[0]} failed")
    return done.stdout


def is_dirty(repo: str | Path) -> bool:
    """Whether the work tree has changed or untracked files."""
    return bool(git(repo, "status", "--porcelain").strip())


def resolve(repo: str | Path, revision: str) -> str:
    """A commit hash, or the word for the work tree (M1)."""
    return WORKING if revision == WORKING else git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").strip()


def changed_files(spark: SparkSession, repo: str | Path, base: str, target: str) -> DataFrame:
    """(path, status A/D/M/R, old_path) between two commits or a commit and the work tree.

    With the work tree as base the statuses are turned round; untracked files
    count as added.
    """
    turned = base == WORKING
    ends = [r for r in ((target, base) if turned else (base, target)) if r != WORKING]
    rows = []
    for line in git(repo, "-c", "core.quotepath=off", "diff", "--name-status", "-M", *ends, "--").splitlines():
        code, *paths = line.split("\t")
        if code[0] in "ADMR":
            rows.append((paths[-1], code[0], paths[0] if code[0] == "R" else None))
    if WORKING in (base, target):
        rows += [(p, "A", None) for p in git(repo, "-c", "core.quotepath=off", "ls-files", "--others", "--exclude-standard").splitlines()]
    if turned:
        rows = [((o, "R", p) if s == "R" else (p, {"A": "D", "D": "A"}.get(s, s), None)) for p, s, o in rows]
    return spark.createDataFrame(rows, CHANGES)


def faults(repo: str | Path, allow_dirty: bool = False) -> list[str]:
    """What keeps revisions of a folder from being known (K20): no repository, uncommitted changes."""
    try:
        return [f"the repository {repo} has uncommitted changes"] if is_dirty(repo) and not allow_dirty else []
    except (GitError, OSError):
        return [f"{repo} is not in a git repository"]


def of_record(changes: DataFrame, folder: str) -> DataFrame:
    """Changed files of an input folder; the root folder holds all (D10). Both sides of a rename count."""
    every = changes.select("path", "status").union(changes.filter("old_path is not null").select("old_path", F.lit("D")))
    inside = folder.strip("/")
    return every if inside in ("", ".") else every.filter(F.col("path").startswith(inside + "/"))


def tag_baseline(repos: list[str | Path], name: str, message: str, pattern: str | None = None, force: bool = False) -> list[str]:
    """Annotate a baseline tag in every repository; all are checked first and undone together on failure."""
    repos = list(dict.fromkeys(str(Path(r).resolve()) for r in repos))
    if pattern and not re.fullmatch(pattern, name):
        raise GitError(f"tag {name} does not match {pattern}")
    for repo in repos:
        if is_dirty(repo):
            raise GitError(f"{repo} has uncommitted changes")
        if not force and git(repo, "tag", "--list", name).strip():
            raise GitError(f"tag {name} exists in {repo}")
    done: list[tuple[str, str | None]] = []
    try:
        for repo in repos:
            old = git(repo, "rev-parse", f"refs/tags/{name}").strip() if git(repo, "tag", "--list", name).strip() else None
            git(repo, "tag", "-a", *(["-f"] if force else []), name, "-m", message)
            done.append((repo, old))
    except GitError:
        for repo, old in done:
            git(repo, *(["update-ref", f"refs/tags/{name}", old] if old else ["tag", "-d", name]))
        raise
    return repos
