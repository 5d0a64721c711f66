"""A kept store of artifacts: lookups and searches of an unchanged project parse no file.

The occurrences of artifacts lie in segments, each made of the files that had changed
since the one before: a table clustered by id, with Parquet bloom filters on the id, and
posting rows (trigram, occurrence) of all searched values, clustered by trigram. A list
of the files says which segment holds each file's rows; rows of other segments are dead.
Refreshing compares sizes and times of the files, hashes the content of those that differ,
and parses those whose content did. Beyond ``SEGMENTS`` segments all live rows are written
as one. A state is named current when it is whole; the one before stays until then.

The store belongs to one set of inputs and rules; another set, or one with block hooks,
whose results may depend on anything, does not use it.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom import model, scratch
from threadloom.operators import edit, validate
from threadloom.plans.project import Project
from threadloom.sources import scan

SEGMENTS = 16
#: A file that was changed within so many seconds of its reading is hashed again.
RACY_SECONDS = 3
_FILES = "record string, unit string, size long, modified timestamp, digest string, segment string"
_OCCURRENCES = ["record", "path", "block_no", "atype", "aid", "loc", "fields"]


def _occurrence_schema() -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in model.schema(model.BLOCKS) if f.name in _OCCURRENCES), "oid long", "segment string"])


def grams(text: str) -> set[str]:
    """The trigrams of a text."""
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _postings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [(g, o) for o, values in zip(f["oid"], f["searched"]) for g in set().union(*map(grams, values))]
        yield pd.DataFrame(found, columns=["gram", "oid"])


class ArtifactStore:
    """The kept artifacts of a project in a folder that driver and executors see."""

    def __init__(self, project: Project, folder: str):
        if any(p.transform_blocks or p.filter_block for p in project.plugins):
            raise ValueError("a project with block hooks has no artifact store")
        self.project, self.spark = project, project.spark
        told = json.dumps([[asdict(r) for r in project.config.input], project.rules.attr_rules, sorted(map(str, project.rules.labels.items()))], sort_keys=True, default=str)
        self.folder = f"{folder.rstrip('/')}/{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    # --- states ------------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _state(self) -> int:
        """The number of the current state, 0 if there is none."""
        return max((int(s.getPath().getName()[6:-5]) for s in self._fs().globStatus(self._path("state-*.done")) or []), default=0)

    def files(self, state: int | None = None) -> DataFrame:
        """(record, unit, size, modified, digest, segment) of the files of a state, the current one unless it is given."""
        state = self._state() if state is None else state
        return self.spark.read.schema(_FILES).parquet(f"{self.folder}/state-{state}") if state else self.spark.createDataFrame([], _FILES)

    def _units(self) -> DataFrame:
        """(record, unit, size, modified) of the files that the project would read; a file and its sidecars are one unit."""
        out = None
        for record, rows in self._sources():
            part = rows(("size", "modified")).groupBy("unit").agg(F.sum("size").alias("size"), F.max("modified").alias("modified")).select(F.lit(record).alias("record"), "unit", "size", "modified")
            out = part if out is None else out.unionByName(part)
        return out

    def _sources(self):
        for record in self.project.config.input:
            folder, wanted = str(self.project.root / record.dir), scan.glob_pattern(record.filter or scan.GLOBS.get(record.driver, "*"))
            side = "(" + "|".join(re.escape("." + e.lstrip(".")) for e in record.sidecars) + ")$"

            def rows(columns, folder=folder, wanted=wanted, side=side, record=record):
                named = scan.binaries(self.spark, folder)
                if record.driver == "sidecar":
                    named = named.filter(F.col("path").rlike(wanted) | F.col("path").rlike(side))
                    return named.select(F.regexp_replace("path", side, "").alias("unit"), "path", *columns)
                return named.filter(F.col("path").rlike(wanted)).select(F.col("path").alias("unit"), "path", *columns)

            yield record.name, rows

    def _digests(self, units: DataFrame) -> DataFrame:
        """(record, unit, digest) of some units: of the contents of their files."""
        out = None
        for record, rows in self._sources():
            some = units.filter(F.col("record") == record).select("unit")
            each = rows(("content",)).join(some, "unit", "left_semi").select("unit", F.struct("path", F.sha2("content", 256).alias("sha")).alias("f"))
            part = each.groupBy("unit").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("digest")).select(F.lit(record).alias("record"), "unit", "digest")
            out = part if out is None else out.unionByName(part)
        return out

    def refresh(self) -> dict[str, int]:
        """Bring the store up to date; how many units were parsed, dropped and only read."""
        state = self._state()
        old = self.files(state)
        now = scratch.table(self._units(), "units")
        was = old.select("record", "unit", F.col("size").alias("__size"), F.col("modified").alias("__modified"), F.col("digest").alias("__digest"), "segment")
        both = now.join(was, ["record", "unit"], "full_outer")
        settled = F.col("size").eqNullSafe(F.col("__size")) & F.col("modified").eqNullSafe(F.col("__modified")) & (F.col("__digest") != "")
        dropped = both.filter("size is null").count()
        doubtful = scratch.table(both.filter(F.col("size").isNotNull() & ~F.coalesce(settled, F.lit(False))).select("record", "unit"), "doubtful")
        read = doubtful.count()
        if not read and not dropped and state:
            return {"parsed": 0, "dropped": 0, "read": 0}
        digests = scratch.table(self._digests(doubtful), "digests")
        known = both.filter("size is not null").join(digests, ["record", "unit"], "left")
        same = known.filter(F.col("segment").isNotNull() & F.coalesce(F.col("digest") == F.col("__digest"), F.col("digest").isNull()))
        changed = scratch.table(digests.join(same.select("record", "unit"), ["record", "unit"], "left_anti"), "changed")
        parsed, segment = changed.count(), uuid.uuid4().hex
        if parsed:
            self._write(self._parse(changed), segment)
        files = same.withColumn("digest", F.coalesce("digest", "__digest")).select("record", "unit", "size", "modified", "digest", "segment")
        files = files.unionByName(now.join(changed, ["record", "unit"]).select("record", "unit", "size", "modified", "digest", F.lit(segment).alias("segment")))
        # times too near to now do not prove that a file stays what it was read as
        racy = F.col("modified") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(RACY_SECONDS)))
        files = scratch.table(files.withColumn("modified", F.when(~racy, F.col("modified"))), "files")
        if files.select("segment").distinct().count() > SEGMENTS:
            segment = uuid.uuid4().hex
            self._write(self._live(files).drop("segment"), segment)
            files = files.withColumn("segment", F.lit(segment))
        files.write.mode("overwrite").parquet(f"{self.folder}/state-{state + 1}")
        self._fs().create(self._path(f"state-{state + 1}.done"), True).close()
        return {"parsed": parsed, "dropped": dropped, "read": read}

    def _parse(self, changed: DataFrame) -> DataFrame:
        out = None
        for record in self.project.config.input:
            some = changed.filter(F.col("record") == record.name).select(F.col("unit").alias("path"))
            part = self.project.record_blocks(record, some).filter("kind = 'artifact'").select(*_OCCURRENCES)
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, occurrences: DataFrame, segment: str) -> None:
        """A segment: occurrences by id, postings by trigram."""
        rows = scratch.table(occurrences.withColumn("oid", F.xxhash64("record", "path", "block_no")), "occurrences")
        bloom = lambda df, column: df.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{column}", "true")
        bloom(rows.repartitionByRange("aid", "record", "path").sortWithinPartitions("aid"), "aid").parquet(f"{self.folder}/artifacts/segment={segment}")
        every = F.concat(F.array(F.lower("aid"), F.lower("atype")), F.flatten(F.transform(F.map_values("fields"), lambda v: F.transform(v["vals"], lambda x: F.coalesce(F.lower(x), F.lit(""))))))
        posted = rows.select("oid", every.alias("searched")).mapInPandas(_postings, "gram string, oid long")
        bloom(posted.repartitionByRange("gram", "oid").sortWithinPartitions("gram"), "gram").parquet(f"{self.folder}/grams/segment={segment}")

    # --- questions -----------------------------------------------------------------------------------------------------

    def _table(self, name: str, files: DataFrame, schema: str) -> DataFrame:
        """The rows of the segments that some live file is in."""
        live = [r.segment for r in files.select("segment").distinct().collect()]  # SEGMENTS at most
        known = self._fs().exists(self._path(name))
        rows = self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if known else self.spark.createDataFrame([], schema)
        return rows.filter(F.col("segment").isin(live))

    def _live(self, files: DataFrame, narrowed=lambda rows: rows) -> DataFrame:
        rows = narrowed(self._table("artifacts", files, _occurrence_schema()))
        owner = files.select("record", F.col("unit").alias("path"), "segment")
        return rows.join(owner, ["record", "path", "segment"], "left_semi")

    def occurrences(self, narrowed=lambda rows: rows) -> DataFrame:
        """The live occurrences; ``narrowed`` filters them before the list of files is asked."""
        return self._live(self.files(), narrowed).drop("segment", "oid")

    def artifact(self, aid: str) -> DataFrame:
        """The artifact of an id, if there is one: the bloom filters leave most row groups unread."""
        return validate.first_wins(self.occurrences(lambda rows: rows.filter(F.col("aid") == aid)), "record", "path", "block_no")

    def search(self, query: str) -> DataFrame:
        """The same artifacts as a search over all of them: those with all trigrams of the query, confirmed; a shorter query reads all that is kept."""
        wanted = sorted(grams(query.lower()))
        if not wanted:
            return edit.search(validate.first_wins(self.occurrences(), "record", "path", "block_no"), query)
        files = self.files()
        posted = self._table("grams", files, "gram string, oid long, segment string").filter(F.col("gram").isin(wanted))
        hits = posted.groupBy("segment", "oid").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(wanted)).select("segment", "oid")
        ids = self._live(files, lambda rows: rows.join(hits, ["segment", "oid"], "left_semi")).select("aid").distinct()
        # an id's first occurrence may be another one
        rows = self.occurrences(lambda rows: rows.join(ids, "aid", "left_semi"))
        return edit.search(validate.first_wins(rows, "record", "path", "block_no"), query)

