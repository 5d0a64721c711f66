"""Ordered rows to files, written end to end by many tasks.

Rows are dealt by ranges of (file, order). In a first pass each task writes what
it holds of each file as a part of its own and tells its size; only the parts of
tasks that Spark counts as done are used, so that a task may run twice. Sizes give
every part its place, and a second pass copies the parts to their places in one
file, which gets its name when it is whole. Nobody holds a file or a column of it.

The folder and the shared folder must be seen by driver and executors alike.
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from threadloom import scratch

_BLOCK = 1 << 22


def write_files(rows: DataFrame, order: list[str], folder: str | Path, *, between: str = "", heads: dict[str, str] | None = None, tail: str = "") -> list[Path]:
    """The texts of ``rows`` (file, text, and the columns of ``order``) as one file each, in order; the files, by name.

    ``between`` stands between two texts, ``heads`` before the first of a file, ``tail`` after the last one. A file of ``heads`` without rows is written too."""
    spark, folder, heads = rows.sparkSession, Path(folder), heads or {}
    folder.mkdir(parents=True, exist_ok=True)
    base = tempfile.gettempdir() if spark.sparkContext.master.split("[")[0] == "local" else scratch.shared_path(spark)
    parts = tempfile.mkdtemp(prefix="parts-", dir=base)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, now, out, done = TaskContext.get().partitionId(), None, None, []
        for frame in frames:
            for file, text in zip(frame["file"], frame["text"]):
                if file != now:
                    if out:
                        out.close()
                    now, out = file, open(path := f"{parts}/{number}-{uuid.uuid4().hex}", "wb", _BLOCK)  # noqa: SIM115
                    done.append([file, number, path])
                else:
                    out.write(between.encode())
                out.write(text.encode())
        if out:
            out.close()
        yield pd.DataFrame([(*d, os.path.getsize(d[2])) for d in done], columns=["file", "part", "path", "size"])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for target, at, path in zip(frame["target"], frame["at"], frame["path"]):
                with open(target, "r+b", 0) as whole, open(path, "rb") as part:
                    whole.seek(at)
                    shutil.copyfileobj(part, whole, _BLOCK)
            yield frame[["at"]]

    try:
        ranged = rows.select("file", "text", *order).repartitionByRange("file", *order).sortWithinPartitions("file", *order)
        told = ranged.select("file", "text").mapInPandas(write, "file string, part long, path string, size long").collect()  # a row per task and file
        made: dict[str, list] = {name: [] for name in heads}
        for r in sorted(told, key=lambda r: (r.file, r.part)):
            made.setdefault(r.file, []).append(r)
        plan, whole = [], {}
        for file, own in made.items():
            final = folder / file
            final.parent.mkdir(parents=True, exist_ok=True)
            target = final.with_name(f".{final.name}.{uuid.uuid4().hex}")
            whole[target] = final
            with open(target, "wb") as f:
                f.write(heads.get(file, "").encode())
                for i, r in enumerate(own):
                    if i:
                        f.write(between.encode())
                    plan.append((str(target), f.tell(), r.path))
                    f.seek(r.size, os.SEEK_CUR)
                f.write(tail.encode())
                f.truncate()
        if plan:
            spark.createDataFrame(plan, "target string, at long, path string").repartition(min(len(plan), 4 * spark.sparkContext.defaultParallelism)).mapInPandas(place, "at long").count()
        for target, final in whole.items():
            os.replace(target, final)
        return sorted(whole.values())
    finally:
        shutil.rmtree(parts, ignore_errors=True)
