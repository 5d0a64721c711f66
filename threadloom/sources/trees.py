"""The files of a revision or of the work tree, by path: only what is asked for is read, by the executors.

A revision is read as blobs from git's own store (``cat-file --batch``), one process
for a task; nothing is exported, and the bytes that are read follow the paths that are
asked for, not the tree.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.sources import git, history

#: Bytes of files that a task hands on together.
_HELD = 8_000_000


def _batches(found: Iterator[tuple[str, bytes | None]]) -> Iterator[pa.RecordBatch]:
    paths, contents, size = [], [], 0
    done = lambda: pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(contents, pa.binary())})
    for path, content in found:
        paths.append(path), contents.append(content)
        size += len(content or b"")
        if size > _HELD or len(paths) > 10_000:
            yield done()
            paths, contents, size = [], [], 0
    yield done()


class Tree:
    """Files below a folder; paths are relative to it."""

    def _read(self, paths: Iterator[str], whole: bool) -> Iterator[tuple[str, bytes | None]]:
        raise NotImplementedError

    def contents(self, paths: DataFrame, whole: bool = True) -> DataFrame:
        """(path, content) of those of ``paths`` (path) that are files; without ``whole`` they are only looked up."""
        read = self._read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(read((p for b in batches for p in b.column(0).to_pylist()), whole))

        rows = paths.select("path").distinct().repartition(4 * paths.sparkSession.sparkContext.defaultParallelism, "path")
        return rows.mapInArrow(run, "path string, content binary")

    def texts(self, paths: DataFrame) -> DataFrame:
        """(path, value) of text files."""
        return self.contents(paths).select("path", F.col("content").cast("string").alias("value"))

    def names(self, paths: DataFrame) -> DataFrame:
        """(path) of those that are files."""
        return self.contents(paths, whole=False).select("path")


class Blobs(Tree):
    """The files of a commit below a folder of the repository."""

    def __init__(self, repo: str, commit: str, folder: str):
        self.repo, self.commit, self.folder = repo, commit, folder.strip("/")

    def _read(self, paths: Iterator[str], whole: bool) -> Iterator[tuple[str, bytes | None]]:
        asked = subprocess.Popen(["git", "-C", self.repo, "cat-file", "--batch" if whole else "--batch-check"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        inside = "" if self.folder in ("", ".") else self.folder + "/"
        try:
            for path in paths:
                if "\n" in path:  # cannot be asked for by name
                    raise git.GitError(f"a path with a line end: {path!r}")
                asked.stdin.write(f"{self.commit}:{inside}{path}\n".encode())
                asked.stdin.flush()
                *_, kind, size = asked.stdout.readline().rstrip(b"\n").split(b" ")
                if not size.isdigit():  # missing
                    continue
                content = None
                if whole:
                    content = asked.stdout.read(int(size))
                    asked.stdout.read(1)
                if kind == b"blob":
                    yield path, content
        finally:
            asked.stdin.close()
            asked.wait()


class Files(Tree):
    """The files below a folder that the executors see."""

    def __init__(self, folder: str | Path):
        self.folder = str(folder)

    def _read(self, paths: Iterator[str], whole: bool) -> Iterator[tuple[str, bytes | None]]:
        for path in paths:
            file = os.path.join(self.folder, path)
            if os.path.isfile(file):
                with open(file, "rb") as f:
                    yield path, f.read() if whole else None


def tree(spark: SparkSession, repo: str | Path, end: str, folder: str) -> Tree:
    """The files of a commit, or of the work tree, below a folder of the repository."""
    return Files(Path(repo).resolve() / folder) if end == git.WORKING else Blobs(history.shared(spark, repo), end, folder)
