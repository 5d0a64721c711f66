"""The git history of files, read by the executors.

Tasks run git against the repository, under a cluster master against a bare
mirror of it in the shared folder. Two ways in: :func:`blame` and
:func:`last_commits` take the wanted paths as rows, so that no list of paths is
on the driver; the data source ``git_blame`` reads a whole revision, where each
partition picks its own share of the tree, below a folder if one is given. The
folder is an option, not a pushed filter: Spark 4.1 keeps what was pushed to a
Python source with the DataFrame, so that a second query on it would miss rows.
A file that git cannot tell about is a row with its error.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tempfile
import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threadloom import scratch
from threadloom.sources.git import GitError, git

_COMMIT = "hash_long string, hash_short string, ts timestamp, author_email string, error string"
#: Runs of lines of one commit.
RUNS = f"path string, first int, last int, {_COMMIT}"
COMMITS = f"path string, {_COMMIT}"
#: Lines of a bin of the interval join.
BIN = 64


def shared(spark: SparkSession, repo: str | Path) -> str:
    """The repository as the executors see it: itself under a local master, else a bare mirror in the shared folder, made once per revision."""
    top = git(repo, "rev-parse", "--show-toplevel").strip()
    if spark.sparkContext.master.split("[")[0] == "local":
        return top
    base, head = scratch.shared_path(spark), git(repo, "rev-parse", "HEAD").strip()
    mirror = Path(base) / f"mirror-{hashlib.sha256(f'{top}:{head}'.encode()).hexdigest()[:16]}"
    if not mirror.exists():
        Path(base).mkdir(parents=True, exist_ok=True)
        made = Path(tempfile.mkdtemp(prefix="mirror-", dir=base)) / "git"
        git(top, "clone", "--quiet", "--mirror", top, str(made))
        try:
            os.rename(made, mirror)
        except OSError:  # another driver was first
            pass
    return str(mirror)


def _inside(repo: str | Path) -> str:
    """A folder's path from the top of its repository, with a slash at the end unless it is the top."""
    return git(repo, "rev-parse", "--show-prefix").strip()


def file_runs(repo: str, path: str, revision: str = "HEAD") -> Iterator[tuple]:
    """(first, last, hash, short hash, seconds, mail) of each run of lines that one commit wrote, in order."""
    known, now = {}, None
    for text in git(repo, "blame", "--porcelain", revision, "--", path).split("\n"):
        if m := re.match(r"([0-9a-f]{40}) \d+ (\d+)(?: (\d+))?$", text):
            if m[3]:
                if now:
                    yield _run(now, known)
                now = (m[1], int(m[2]), int(m[2]) + int(m[3]) - 1)
                known.setdefault(m[1], {})
        elif now and text.startswith("author-mail "):
            known[now[0]]["mail"] = text[12:].strip("<>")
        elif now and text.startswith("committer-time "):
            known[now[0]]["ts"] = int(text[15:])
    if now:
        yield _run(now, known)


def _run(now: tuple, known: dict) -> tuple:
    commit, first, last = now
    return first, last, commit, commit[:7], known[commit].get("ts"), known[commit].get("mail")


def file_commit(repo: str, path: str, revision: str = "HEAD") -> Iterator[tuple]:
    """(hash, short hash, seconds, mail) of the last commit of a file, if it has one."""
    out = git(repo, "log", "-1", "--format=%H%x09%h%x09%ct%x09%ae", revision, "--", path).strip()
    if out:
        full, _, ts, mail = out.split("\t")
        yield full, full[:7], int(ts), mail


def _per_file(paths: DataFrame, repo: str, inside: str, of: Callable[[str, str], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:  # a file at a time: one file's runs are held
                try:
                    rows = [(path, *r, None) for r in of(repo, inside + path)]
                except (GitError, OSError) as e:
                    rows = [(path, *[None] * (len(names) - 2), str(e))]
                yield pd.DataFrame(rows, columns=names).astype(object).where(lambda x: x.notna(), None)

    tasks = 4 * paths.sparkSession.sparkContext.defaultParallelism  # a number of its own: paths are few bytes, each costs a process
    rows = paths.select("path").distinct().repartition(tasks, "path")
    return rows.mapInPandas(run, schema.replace("ts timestamp", "ts long")).withColumn("ts", F.timestamp_seconds("ts")).select(*names)


def blame(spark: SparkSession, repo: str | Path, paths: DataFrame) -> DataFrame:
    """The commit of each run of lines of the files ``paths`` (path, from ``repo``) at HEAD, or the error of a file."""
    return _per_file(paths, shared(spark, repo), _inside(repo), file_runs, RUNS)


def last_commits(spark: SparkSession, repo: str | Path, paths: DataFrame) -> DataFrame:
    """The last commit of each file (A13); files without one give no row."""
    return _per_file(paths, shared(spark, repo), _inside(repo), file_commit, COMMITS)


def revisions(artifacts: DataFrame, runs: DataFrame) -> DataFrame:
    """(aid, hash_long, hash_short, ts, author_email): the distinct commits of each artifact's lines.

    Spans and runs meet by bins of lines: a file of many artifacts does not bring each of its runs to each of them."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / BIN), F.floor(b / BIN)))
    a, b = F.col("loc.line_start"), F.col("loc.line_end")
    spans = artifacts.filter((a <= b)).select("aid", F.col("loc.file").alias("path"), a.alias("__a"), b.alias("__b"), bins(a, b).alias("__bin"))
    wanted = ["hash_long", "hash_short", "ts", "author_email"]
    held = runs.filter("first <= last").select("path", "first", "last", *wanted, bins(F.col("first"), F.col("last")).alias("__bin"))
    return spans.join(held, ["path", "__bin"]).filter("first <= __b and last >= __a").select("aid", *wanted).dropDuplicates(["aid", "hash_long"])


# --- a revision as a data source --------------------------------------------------------------------------------------


class GitBlame(DataSource):
    """``spark.read.format("git_blame")`` with the options repo, revision, folder and partitions."""

    @classmethod
    def name(cls) -> str:
        return "git_blame"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> DataSourceReader:
        return BlameReader(self.options["repo"], self.options.get("revision", "HEAD"), self.options.get("folder", ""), int(self.options.get("partitions", 32)))


class BlameReader(DataSourceReader):
    """Each partition lists the tree, keeps its share of the paths and blames them."""

    def __init__(self, repo: str, revision: str, folder: str, partitions: int):
        self.repo, self.revision, self.folder, self.n = repo, revision, folder.strip("/"), partitions

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import datetime

        listed = subprocess.Popen(["git", "-C", self.repo, "ls-tree", "-r", "-z", "--name-only", "--full-tree", self.revision, *([self.folder + "/"] if self.folder else [])], stdout=subprocess.PIPE)
        rest = b""
        while chunk := listed.stdout.read(1 << 16):
            *names, rest = (rest + chunk).split(b"\0")
            for name in names:
                path = name.decode("utf-8", "replace")
                if zlib.crc32(name) % self.n != partition.value:
                    continue
                try:
                    for first, last, full, short, ts, mail in file_runs(self.repo, path, self.revision):
                        yield path, first, last, full, short, datetime.datetime.fromtimestamp(ts, datetime.UTC), mail, None
                except GitError as e:
                    yield path, None, None, None, None, None, None, str(e)
        if listed.wait():
            yield None, None, None, None, None, None, None, f"git ls-tree {self.revision} failed"


def blame_table(spark: SparkSession, repo: str | Path, revision: str = "HEAD", folder: str = "") -> DataFrame:
    """The files of a revision, all or those below a folder, blamed: a lazy table of the data source ``git_blame``."""
    spark.dataSource.register(GitBlame)
    tasks = 4 * spark.sparkContext.defaultParallelism
    return spark.read.format("git_blame").option("repo", shared(spark, repo)).option("revision", git(repo, "rev-parse", "--verify", f"{revision}^{{commit}}").strip()).option("folder", folder).option("partitions", str(tasks)).load()
