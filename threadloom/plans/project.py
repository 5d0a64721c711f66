"""The project facade: from settings and files to artifacts, violations, matrices, differences and documents.

Everything relational stays a lazy DataFrame; only what a report prints is collected.
"""

from __future__ import annotations

import difflib
import importlib.metadata
import importlib.util
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom import metamodel, model, scratch
from threadloom.functions.lines import lines_text
from threadloom.operators import diff, edit, graph, impact, metrics, trace, validate
from threadloom.operators.order import numbered
from threadloom.plans import apply, outputs, publish, report, writer
from threadloom.sources import config as settings
from threadloom.sources import files as small
from threadloom.sources import git, history, scan, trees


_HOOKS = ("transform_blocks", "filter_block", "transform_markdown", "export_trace")
#: Endings of sidecars.
SIDE = r"\.(stmx|side\.yaml)$"


@dataclass
class Plugin:
    """User callables: blocks -> blocks, row filter, text -> text, matrix consumer."""

    name: str
    transform_blocks: Callable[[DataFrame], DataFrame] | None = None
    filter_block: Callable | None = None
    transform_markdown: Callable[[str], str] | None = None
    export_trace: Callable[[DataFrame], None] | None = None


class PluginError(RuntimeError):
    """A plugin cannot be loaded or broke its contract."""


def load_plugin(name: str, folder: str | Path) -> Plugin:
    """A plugin from a Python file of the project; executors get the file too."""
    if "/" in name or "\\" in name or name in ("", ".", ".."):
        raise PluginError(f"bad plugin name {name!r}")
    path = Path(folder) / f"{name}.py"
    if not path.exists():
        for entry in importlib.metadata.entry_points(group="threadloom.plugins"):
            if entry.name == name:
                try:
                    found = entry.load()
                except Exception as e:
                    raise PluginError(f"plugin {name}: {e}") from e
                return Plugin(name, *[getattr(found, f, None) for f in _HOOKS])
        raise PluginError(f"no plugin {path}, and no installed one named {name}")
    spec = importlib.util.spec_from_file_location(name, path)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        raise PluginError(f"plugin {name}: {e}") from e
    active = SparkSession.getActiveSession()
    if active is not None:
        active.sparkContext.addPyFile(str(path))
    return Plugin(name, *[getattr(module, f, None) for f in _HOOKS])


def apply_plugins(blocks: DataFrame, plugins: list[Plugin]) -> DataFrame:
    """Run block hooks in order; the schema must stay the same."""
    for plugin in plugins:
        if plugin.transform_blocks:
            out = blocks.transform(plugin.transform_blocks)
            if not isinstance(out, DataFrame) or out.columns != blocks.columns:
                raise PluginError(f"plugin {plugin.name}: transform_blocks must return blocks")
            blocks = out
        if plugin.filter_block:
            keep = plugin.filter_block

            def run(frames, keep=keep):
                for f in frames:
                    rows = [r for r in (keep(dict(zip(f.columns, v))) for v in f.itertuples(index=False, name=None)) if r is not None]
                    yield f.iloc[:0] if not rows else type(f)(rows, columns=f.columns)

            blocks = blocks.mapInPandas(run, blocks.schema)
    return blocks


@dataclass
class Project:
    """A configured project at one state of its files."""

    spark: SparkSession
    config: settings.Config
    rules: metamodel.Metamodel = field(default_factory=metamodel.Metamodel)
    plugins: list[Plugin] = field(default_factory=list)
    base: Path | None = None
    store: object | None = field(default=None, repr=False)

    @classmethod
    def load(cls, spark: SparkSession, path: str | Path, home: str | Path | None = None) -> Project:
        conf = settings.load(path, home)
        rules = metamodel.parse((Path(path).parent / conf.metamodel).read_text(encoding="utf-8")) if conf.metamodel else metamodel.Metamodel()
        if conf.impact.tasks_enabled and conf.metamodel:
            rules = task_rules(rules, conf.impact.task_atype_map)
        plugins = [load_plugin(p["name"], Path(path).parent / "plugins") for p in conf.plugins if p.get("enabled", True)]
        return cls(spark, conf, rules, plugins)

    @property
    def root(self) -> Path:
        return self.base or self.config.base

    def _attribute_rules(self, atype: str) -> dict:
        own = [r for r in self.rules.attr_rules if r["atype"] == atype and r["multiple"]]
        return {"multiple": {r["attr"] for r in own}, "split": {r["attr"] for r in own if r["type"] in ("reference", "enum")}, "labels": self.rules.labels}

    def record_blocks(self, record: settings.InputRecord, only: DataFrame | None = None, tree: trees.Tree | None = None) -> DataFrame:
        """Blocks of one input; ``only`` (path) prunes files before they are parsed; with it, they may come from a ``tree``."""
        folder = str(self.root / record.dir)
        pattern = record.filter or scan.GLOBS.get(record.driver, "*")
        wanted = F.col("path").rlike(scan.glob_pattern(pattern))
        rules = self._attribute_rules(record.atype)
        named = lambda df: df.select(F.lit(record.name).alias("record"), *df.columns)
        if record.driver == "sidecar":
            ends = tuple("." + e.lstrip(".") for e in record.sidecars)
            side = "(" + "|".join(re.escape(e) for e in ends) + ")$"
            # a file and its sidecar are read when either of them changed
            units = None if only is None else only.select(F.regexp_replace("path", side, "").alias("__of")).distinct()
            if tree is None:
                near = lambda df: df if only is None else df.withColumn("__of", F.regexp_replace("path", side, "")).join(units, "__of", "left_semi").drop("__of")
                names, sides = near(scan.names(self.spark, folder).filter(~F.col("path").rlike(side) & wanted)), near(scan.files(self.spark, folder).filter(F.col("path").rlike(side)))
            else:
                names = tree.names(units.select(F.col("__of").alias("path")).filter(wanted))
                sides = tree.texts(units.select(F.explode(F.array(*[F.concat("__of", F.lit(e)) for e in ends])).alias("path")))
            return scan.scan_sidecars(named(sides), named(names), record.atype, ends, self.rules.labels)
        if tree is not None:
            source = named(tree.texts(only.select("path").filter(wanted)))
        else:
            files = scan.files(self.spark, folder, pattern.split("/")[-1]).filter(wanted)
            source = named(files if only is None else files.join(only.select("path"), "path", "left_semi"))
        if record.driver in ("obsidian", "markdown"):
            return scan.scan_markdown(source, record.marker, record.atype, fragments=tuple(record.markers), exclude=record.exclude_elements, **rules)
        if record.driver == "ipynb":
            return scan.scan_notebooks(source, record.marker, record.atype, **rules)
        if record.driver == "text":  # sources in another encoding give nothing (A7)
            return scan.scan_code(source.filter(F.is_valid_utf8("value")), record.atype, **rules)
        return scan.scan_simple(source, record.atype, **rules)

    @cached_property
    def blocks(self) -> DataFrame:
        out = None
        for record in self.config.input:
            part = self.record_blocks(record)
            out = part if out is None else out.unionByName(part)
        return apply_plugins(out, self.plugins)

    @cached_property
    def occurrences(self) -> DataFrame:
        return self.blocks.filter("kind = 'artifact'").select("record", "path", "block_no", "atype", "aid", "loc", "fields")

    @cached_property
    def artifacts(self) -> DataFrame:
        """One row per id, the first in reading order (K1, K2)."""
        return validate.first_wins(self.occurrences, "record", "path", "block_no")

    @cached_property
    def rule_frames(self) -> tuple[DataFrame, DataFrame]:
        return self.rules.frames(self.spark)

    @cached_property
    def links(self) -> DataFrame:
        return graph.parent_links(self.artifacts, self.rule_frames[0])[0]

    def violations(self, suppress_tracing: bool = False) -> DataFrame:
        """All rule violations (K1-K17) with message, category and place."""
        rules, traces = self.rule_frames
        place = self.artifacts.select(F.col("aid").alias("artifact_id"), F.col("loc.file").alias("file_path"), F.col("loc.line_start").alias("line_start"), F.col("loc.line_end").alias("line_end"))
        rows = validate.known_types(self.artifacts, rules)
        resolved = validate.edges(self.links, rows)
        patterns = {r["atype"]: metamodel.id_pattern(r["id_schema"], r["atype"]) for r in self.rules.attr_rules if r["attr"] == "id" and r["id_schema"]}
        found = [validate.unknown_types(self.artifacts, rules), validate.missing_mandatory(rows, rules), validate.extra_attributes(rows, rules.select("atype", "attr", "cond_anchor", "cond_negated", "cond_true")), validate.multiplicity(rows, rules), validate.bad_values(rows, rules)]
        if patterns:
            found.append(validate.id_schema(rows, patterns))
        conflicts = graph.parent_links(self.artifacts, rules)[1].withColumnRenamed("child_id", "aid").join(self.artifacts.select("aid", "atype", "record"), "aid")
        found.append(validate._emit(conflicts, "conflicting_revisions", None, F.col("pid")))
        found.append(validate.extra_roots(self.artifacts))
        deep = graph.too_deep(self.links).withColumnRenamed("start", "aid").join(self.artifacts.select("aid", "atype", "record"), "aid")
        found.append(validate._emit(deep, "too_deep"))
        if not suppress_tracing:
            refs = validate.references(rows, rules)
            found += [validate.malformed(refs), validate.dangling(refs, self.artifacts), validate.unknown_type_references(refs, self.artifacts, rules)]
            found += [validate.forbidden_traces(resolved, traces), validate.missing_traces(rows, resolved, traces), validate.trace_modes(resolved, traces)]
        out = validate.all_of(*found).join(place, "artifact_id", "left")
        doubles = validate.duplicate_ids(self.occurrences.filter(F.col("aid") != model.UNDEFINED), "record", "path", "block_no")
        nameless = self.occurrences.filter(F.col("aid") == model.UNDEFINED)
        errors = self.blocks.filter("kind = 'error'").select("record", "path", "loc", F.lit(None).cast("string").alias("aid"), F.lit(None).cast("string").alias("atype"), F.col("message").alias("detail"))
        extra = None
        for code, df, detail in (("duplicate_id", doubles, F.lit(None).cast("string")), ("no_id", nameless, F.lit(None).cast("string")), ("extraction", errors, F.col("detail"))):
            part = df.select(
                F.lit(code).alias("code"), F.col("aid").alias("artifact_id"), F.col("atype").alias("artifact_type"), F.col("record").alias("input_record"), F.lit(None).cast("string").alias("attr"), detail.alias("detail"),
                F.col("path").alias("file_path"), F.col("loc.line_start").alias("line_start"), F.col("loc.line_end").alias("line_end"),
            )
            extra = part if extra is None else extra.unionByName(part)
        every = out.select(extra.columns).unionByName(extra)
        twice = publish.duplicate_block_ids(self.blocks)
        none = F.lit(None).cast("string")
        every = every.unionByName(twice.select(
            F.lit("duplicate_block_id").alias("code"), none.alias("artifact_id"), none.alias("artifact_type"), none.alias("input_record"), none.alias("attr"), F.concat_ws(" ", "marker", "block_id").alias("detail"),
            none.alias("file_path"), F.lit(None).cast("int").alias("line_start"), F.lit(None).cast("int").alias("line_end"),
        ))
        return self._worded(every)

    def _worded(self, every: DataFrame) -> DataFrame:
        """Violations with their category and message."""
        text = F.concat_ws(": ", report.message(F.col("code"), self.config.language), F.concat_ws(" ", "attr", "detail"))
        return every.withColumn("category", report.category(F.col("code"))).withColumn("message", F.regexp_replace(text, ": $", ""))

    def warnings(self) -> DataFrame:
        """What is no violation while tracing is suppressed: references that are malformed, or to unknown ids and types."""
        rules, _ = self.rule_frames
        rows = validate.known_types(self.artifacts, rules)
        refs = validate.references(rows, rules)
        place = self.artifacts.select(F.col("aid").alias("artifact_id"), F.col("loc.file").alias("file_path"), F.col("loc.line_start").alias("line_start"), F.col("loc.line_end").alias("line_end"))
        found = validate.all_of(validate.malformed(refs), validate.dangling(refs, self.artifacts), validate.unknown_type_references(refs, self.artifacts, rules))
        return self._worded(found.join(place, "artifact_id", "left"))

    def git_violations(self, faults: DataFrame) -> DataFrame:
        """Files (path, error) that git cannot tell about, as violations of their input."""
        record = self.located().select(F.col("loc.file").alias("path"), F.col("record").alias("input_record")).distinct()
        none, line = F.lit(None).cast("string"), F.lit(None).cast("int")
        rows = faults.join(record, "path", "left").select(
            F.lit("git").alias("code"), none.alias("artifact_id"), none.alias("artifact_type"), "input_record", none.alias("attr"), F.col("error").alias("detail"), F.col("path").alias("file_path"), line.alias("line_start"), line.alias("line_end")
        )
        return self._worded(rows)

    # --- questions -----------------------------------------------------------------------------------------------

    def matrix(self, child: str, parent: str, *, forward: bool = False, flat: bool = False, attributes: list[str] = ()) -> DataFrame:
        """A traceability matrix with the lead's attributes."""
        leads = self.artifacts.filter(F.col("atype") == (child if forward else parent))
        if forward:
            pairs, order = trace.forward(leads, self.links, self.artifacts, parent), "pos"
        else:
            children = self.links.join(self.artifacts.filter(F.col("atype") == child).select(F.col("aid").alias("child_id")), "child_id", "left_semi")
            pairs, order = trace.reverse(leads, children), "linked_id"
        if flat:
            pairs, order = trace.flat(pairs, order).withColumnRenamed("linked_ids", "linked_id"), "linked_id"
        named = pairs.join(leads.select(F.col("aid").alias("lead_id"), *[model.attribute(a).alias(a) for a in attributes]), "lead_id")
        return trace.number_rows(named, "lead_id", order).select("record_number", "lead_id", "linked_id", *attributes)

    def requirements(self) -> DataFrame:
        return self.artifacts.filter(F.col("atype") == self.config.metrics.requirement_type)

    def analyze(self, *, suppress_tracing: bool = False, use_git: bool = False, allow_dirty: bool = False, most: int = 10_000) -> Analysis:
        """The analysis report: violations, metrics, status histogram; with git also stale links, their tree and tasks.

        A report shows ``most`` violations, links and lines of the tree and counts the rest; all of them are rows of :meth:`violations`, :meth:`stale_links`."""
        m = self.config.metrics
        every, problems = self.violations(suppress_tracing), []
        stale, n_stale, drawn, n_drawn, tasks = [], 0, [], 0, None
        if use_git:
            problems = git.faults(self.root, allow_dirty)
            if not any("not in" in p for p in problems):
                known = scratch.table(self._history(), "revisions")
                revisions = known.filter("error is null").drop("path", "error")
                every = every.unionByName(self.git_violations(known.filter("error is not null").select("path", "error")))
                links = scratch.table(self.stale_links(revisions), "stale")
                n_stale, stale = links.count(), links.orderBy("child_id", "pid").limit(most).collect()
                lines, n_drawn = self.suspicious_tree(links, most)
                drawn = [r.line for r in lines.orderBy("line_no").collect()]
                if self.config.impact.tasks_enabled:
                    tasks = self.write_tasks(links, revisions)
        every = scratch.table(every, "violations")
        found = every.withColumn("place", report.place(self.config.path_as_links, self.config.wiki_links)).orderBy("input_record", "code", "artifact_id").limit(most).collect()
        more = every.count() - len(found)
        found += [_Global(f"{report.text('git', self.config.language)}: {p}") for p in problems]
        totals = [r for r in metrics.percentages(self.requirements(), verify=m.verify_field, marker=m.tbd_marker).collect() if r.total]
        parts = metrics.percentages(self.requirements(), "record", verify=m.verify_field, marker=m.tbd_marker).orderBy("record").collect()
        histogram = metrics.by_status(self.requirements(), m.status_field).orderBy("status").collect()
        if not totals:
            found.append(_Global(report.text("no_requirements", self.config.language)))
        told = self.warnings().withColumn("place", report.place(self.config.path_as_links, self.config.wiki_links)).orderBy("input_record", "artifact_id", "message").limit(most + 1).collect() if suppress_tracing else []
        text = report.analysis(found, [*totals, *(parts if len(parts) > 1 else [])], histogram, stale, drawn, tasks, more, n_stale, n_drawn, told[:most], len(told) > most)
        return Analysis(text, len(found) + more)

    def suspicious_tree(self, stale: DataFrame, most: int) -> tuple[DataFrame, int]:
        """The first lines (line_no, line) of the tree of stale artifacts and their ancestors, with marks, and how many it has."""
        kept = scratch.table(graph.suspicious_nodes(self.links, stale), "kept")
        edges = self.links.join(kept.select(F.col("aid").alias("child_id")), "child_id", "left_semi")
        tops = graph.top_level(self.artifacts, self.links).join(kept.select("aid"), "aid", "left_semi")
        lines, total = graph.first_lines(edges, tops, most)
        updated = stale.select(F.col("pid").alias("__aid")).distinct().withColumn("__new", F.lit(True))
        marks = kept.filter("outdated").select(F.col("aid").alias("__aid"), F.lit(True).alias("__old")).join(updated, "__aid", "full_outer")
        named = lines.join(marks, F.col("aid") == F.col("__aid"), "left")
        return named.select("line_no", F.concat("line", F.when(F.col("__old"), " [!] OUTDATED").otherwise(""), F.when(F.col("__new"), " [*] UPDATED").otherwise("")).alias("line")), total

    def write_tasks(self, stale: DataFrame, revisions: DataFrame) -> dict[str, int]:
        """Write a task file for each stale link that is new or whose revisions changed."""
        folder = Path(self.config.base) / self.config.impact.tasks_dir
        folder.mkdir(parents=True, exist_ok=True)
        rev = impact.latest_revision(revisions).select("aid", "hash_short")
        place = self.artifacts.select("aid", "atype", F.col("loc.file").alias("file"), "record")
        rows = stale.select("child_id", "pid")
        for side, key in (("child", "child_id"), ("parent", "pid")):
            known = place.join(rev, "aid", "left").select(F.col("aid").alias(key), F.col("atype").alias(f"{side}_type"), F.col("file").alias(f"{side}_file"), F.col("record").alias(f"{side}_record"), F.coalesce("hash_short", F.lit("")).alias(f"{side}_rev"))
            rows = rows.join(known, key)
        old = small.existing_tasks(scan.files(self.spark, str(folder), "*.md")) if any(folder.glob("*.md")) else self.spark.createDataFrame([], small.TASKS)
        plan = generate_tasks(rows, old, self.config.impact.task_atype_map)
        template = Path(self.config.base) / self.config.impact.tasks_template if self.config.impact.tasks_template else None
        return outputs.write_tasks((r.asDict() for r in plan.orderBy("task_id").toLocalIterator()), folder, template.read_text(encoding="utf-8") if template else outputs.TASK)

    def stale_links(self, revisions: DataFrame) -> DataFrame:
        """Suspicious links by the trace mode of their types: newer parents, other pinned commits."""
        latest = impact.latest_revision(revisions)
        kinds = self.artifacts.select("aid", "atype")
        typed = self.links.join(kinds.select(F.col("aid").alias("child_id"), F.col("atype").alias("child_type")), "child_id").join(kinds.select(F.col("aid").alias("pid"), F.col("atype").alias("parent_type")), "pid")
        moded = impact.trace_mode(typed, self.rule_frames[1])
        by_time = impact.stale_by_time(moded.filter("mode = 'timestamp' and nominal_revision is null"), latest)
        by_commit = impact.stale_by_commit(moded, latest)
        columns = ["child_id", "pid", "mode", "nominal_revision"]
        return by_time.select(columns).unionByName(by_commit.select(columns))

    def git_revisions(self) -> DataFrame:
        """Revisions of all artifacts: from the blame of their lines, or the last commits of a file and its sidecar."""
        return self._history().filter("error is null").drop("path", "error")

    def _history(self) -> DataFrame:
        """:meth:`git_revisions` with, for each file that git cannot tell about, a row of its path and error."""
        located = scratch.table(self.located(), "located")
        side = F.concat(F.regexp_replace("loc.file", "[^/]*$", ""), F.regexp_extract("loc.sidecar", "[^/]*$", 0))
        own = located.filter("loc.kind = 'file'").select("aid", F.explode(F.array("loc.file", side)).alias("path"))
        lined = located.filter("loc.kind != 'file'")
        runs = scratch.table(history.blame(self.spark, self.root, lined.select(F.col("loc.file").alias("path"))), "runs")
        lasts = scratch.table(history.last_commits(self.spark, self.root, own.select("path")), "commits")
        columns = ["aid", "hash_long", "hash_short", "ts", "author_email"]
        known = history.revisions(lined, runs).unionByName(own.join(lasts.filter("error is null"), "path").select(columns).dropDuplicates(["aid", "hash_long"]))
        none = F.lit(None).cast("string")
        faults = runs.select("path", "error").unionByName(lasts.select("path", "error")).filter("error is not null").distinct()
        return known.select(*columns, none.alias("path"), none.alias("error")).unionByName(
            faults.select(none.alias("aid"), none.alias("hash_long"), none.alias("hash_short"), F.lit(None).cast("timestamp").alias("ts"), none.alias("author_email"), "path", "error")
        )

    def located(self) -> DataFrame:
        """The artifacts with paths from the project's base."""
        paths = {r.name: r.dir for r in self.config.input}
        return self.artifacts.withColumn("loc", F.col("loc").withField("file", F.concat(_folder(paths), F.col("path"))))

    # --- edits: a plan as rows, written file by file ----------------------------------------------------------------

    def _aborts(self) -> None:
        broken = self.blocks.filter("kind = 'error'").select("path", "message").limit(5).collect()
        if broken:
            raise ValueError("; ".join(f"{r.path}: {r.message}" for r in broken))

    def _rewrite(self, plan: DataFrame, write: Callable[[str, list], str], dry_run: bool) -> int:
        """Apply ``plan`` (record, path, ...) file by file; line ends of a file are kept. The number of files that change."""
        folders = {r.name: self.root / r.dir for r in self.config.input}
        files, held, rows = 0, None, []

        def done() -> int:
            if held is None:
                return 0
            file = folders[held[0]] / held[1]
            raw = file.read_bytes().decode("utf-8")
            text = raw.replace("\r\n", "\n")
            new = write(text, rows)
            if new != text and not dry_run:
                file.write_bytes((new.replace("\n", "\r\n") if "\r\n" in raw else new).encode("utf-8"))
            return int(new != text)

        for r in plan.orderBy("record", "path", "block_no").toLocalIterator():
            if (r.record, r.path) != held:
                files += done()
                held, rows = (r.record, r.path), []
            rows.append(r)
        return files + done()

    def identification_plan(self, atype: str | None = None, force: bool = False) -> tuple[DataFrame, DataFrame]:
        """The new ids (record, path, block_no, source_offset, raw_text, atype, aid, new_id), and valid ids that occur twice."""
        rules = {r["atype"]: r["id_schema"] for r in self.rules.attr_rules if r["attr"] == "id" and r["id_schema"]}
        rule = F.create_map(*[F.lit(x) for p in rules.items() for x in p])[F.col("atype")] if rules else F.lit(None).cast("string")
        rows = self.blocks.filter("kind = 'artifact' and loc.kind != 'file'" + ("" if atype is None else f" and atype = '{atype}'")).select("record", "path", "block_no", "source_offset", "raw_text", "atype", "aid", "loc")
        rows = rows.withColumn("schema", F.replace(edit.schema_of(F.col("aid"), rule), F.lit("{atype}"), F.col("atype")))
        macro = r"\{num(?::(\d+))?\}"
        count = F.regexp_count("schema", F.lit(macro))
        if rows.filter(count > 1).limit(1).count():
            raise ValueError("an id schema holds more than one number")
        rows = rows.filter(count == 1).withColumn("width", F.coalesce(F.regexp_extract("schema", macro, 1).try_cast("int"), F.lit(1)))
        rows = rows.withColumn("before", F.regexp_extract("schema", r"^(.*?)\{num", 1)).withColumn("after", F.regexp_extract("schema", r"\{num(?::\d+)?\}(.*)$", 1))
        inner = F.substring(F.col("aid"), F.length("before") + 1, F.length("aid") - F.length("before") - F.length("after"))
        fits = F.col("aid").startswith(F.col("before")) & F.col("aid").endswith(F.col("after")) & inner.rlike(r"^\d+$") & (F.length(inner) >= F.col("width")) & ~F.contains("aid", F.lit("{"))
        valid, number = F.coalesce(fits, F.lit(False)), F.when(fits, inner.cast("decimal(38,0)"))
        rows = rows.withColumn("__valid", valid).withColumn("__number", number).withColumn("location", F.concat_ws(":", "path", F.lpad(F.col("loc.line_start").cast("string"), 9, "0")))
        todo = rows if force else rows.filter(~F.col("__valid"))
        base = rows.filter("__valid").groupBy("atype").agg(F.max("__number").alias("__max"))
        plan = numbered(todo, ["atype"], ["location", "record", "block_no"], "__k").join(F.broadcast(base), "atype", "left")  # one row per type
        n = F.col("__k") + (F.lit(0) if force else F.coalesce("__max", F.lit(0)))
        plan = plan.withColumn("new_id", F.concat(model.numbered_id(F.col("before"), n, F.col("width")), F.col("after")))
        return plan.select("record", "path", "block_no", "source_offset", "raw_text", "atype", "aid", "new_id"), edit.duplicate_valid(rows, F.col("__valid"))

    def renumber(self, atype: str | None = None, force: bool = False, dry_run: bool = False) -> dict:
        """Give artifacts ids by their schema (N1-N5); errors of the extraction stop it before anything is written."""
        self._aborts()
        plan, twice = self.identification_plan(atype, force)
        plan = scratch.table(plan, "plan")
        files = self._rewrite(plan, lambda text, rows: apply.new_ids(text, [(r.source_offset, r.source_offset + len(r.raw_text), r.new_id) for r in rows]), dry_run)
        return {"changed": plan.count(), "files": files, "duplicates": [r.aid for r in twice.orderBy("aid").limit(100).collect()]}

    def edit_attributes(self, section: str, operation: str = "add", name: str | None = None, value: str | None = None, mapping: DataFrame | None = None, dry_run: bool = False, inline: bool = False) -> dict:
        """Add, replace or delete attributes of a record's artifacts (N6, N7, F22); without a name all mandatory ones are added as TBD."""
        record = next((r for r in self.config.input if r.name == section), None)
        if record is None or record.driver not in ("obsidian", "markdown"):
            raise ValueError(f"no input {section} whose attributes can be edited")
        if operation != "add" and name is None or operation == "replace" and value is None and mapping is None:
            raise ValueError(f"{operation} needs a name" + (" and a value" if operation == "replace" else ""))
        names = [name] if name else list(dict.fromkeys(r["attr"] for r in self.rules.attr_rules if r["atype"] == record.atype and r["presence"] == "mandatory" and r["attr"].lower() not in ("contents", "id")))
        if not names:
            raise ValueError(f"no mandatory attributes of {record.atype}")
        value = "TBD" if name is None or operation == "add" and value is None and mapping is None else value
        rows = self.blocks.filter((F.col("kind") == "artifact") & (F.col("record") == section)).select("record", "path", "block_no", "source_offset", "raw_text", "aid", "fields")
        plan = scratch.table(edit.attribute_plan(rows, operation, names, value, mapping, keep=("record", "path", "block_no", "source_offset", "raw_text")), "plan")
        write = lambda text, rows: apply.set_attributes(text, [(r.source_offset, r.source_offset + len(r.raw_text), r.name, r.value, operation, inline) for r in rows])
        files = self._rewrite(plan.filter("action in ('write', 'delete')"), write, dry_run)
        return edit.plan_summary(plan).first().asDict() | {"files": files}

    def renumber_fragments(self, section: str | None = None, marker: str | None = None, dry_run: bool = False) -> dict:
        """Give numbers to fragments without an id."""
        chosen = [r for r in self.config.input if r.markers and r.driver in ("obsidian", "markdown") and section in (None, r.name)]
        if not chosen:
            raise ValueError(f"no input {section or ''} with markers")
        names = {m.upper() for r in chosen for m in r.markers if marker is None or m.upper() == marker.upper()}
        blocks = self.blocks.filter(F.col("record").isin([r.name for r in chosen]) & F.col("marker").isin(sorted(names)) & (F.col("kind") == "text")) if names else self.blocks.limit(0)
        plan = edit.renumber_markers(blocks).join(blocks.select("record", "path", "block_no", "source_offset"), ["record", "path", "block_no"])
        plan = scratch.table(plan, "plan")
        files = self._rewrite(plan, lambda text, rows: apply.marker_ids(text, [(r.source_offset, r.marker, r.new_id) for r in rows]), dry_run)
        return {"changed": plan.count(), "files": files}

    def revisions_text(self, aid: str) -> list[str]:
        """One artifact's revisions, the newest first (H3)."""
        row = impact.newest_first(self.git_revisions().filter(F.col("aid") == aid)).first()
        return row.revisions.split("; ") if row else []

    def search(self, query: str) -> DataFrame:
        return self.store.search(query) if self.store else edit.search(self.artifacts, query)

    def keep(self, folder: str) -> dict[str, int]:
        """Answer lookups and searches from a store in a folder, brought up to date first."""
        from threadloom.plans.kept import ArtifactStore

        store = ArtifactStore(self, folder)
        done = store.refresh()
        self.store = store
        return done

    def content(self, aid: str) -> str | None:
        """One artifact as Markdown."""
        found = self.store.artifact(aid) if self.store else self.artifacts.filter(F.col("aid") == aid)
        row = found.select("aid", "fields").first()
        return None if row is None else publish.artifact_text(row.aid, {k: {"vals": list(v.vals)} for k, v in row.fields.items()}, 1, settings.Publish(attribute_presence="all"))

    def listing(self, limit: int | None = None) -> DataFrame:
        out = validate.first_wins(self.store.occurrences(), "record", "path", "block_no") if self.store else self.artifacts
        out = out.select("aid", "atype", "record").orderBy("aid")
        return out if limit is None else out.limit(limit)

    def pieces(self, options: settings.Publish | None = None, several: bool = False) -> DataFrame:
        """(record, path, block_no, kind, text): the rendered blocks of all records."""
        mandatory: dict[str, set[str]] = {}
        for r in self.rules.attr_rules:
            if r["presence"] == "mandatory":
                mandatory.setdefault(r["atype"], set()).add(r["attr"])
        parts, breaks = None, not settings.keeps_breaks(self.config)
        for record in self.config.input:
            chosen = options or settings.publish_settings(record.publish, self.config.publish, self.config.base)
            part = publish.pieces(self.blocks.filter(F.col("record") == record.name), chosen, mandatory, several=several, breaks=breaks)
            parts = part if parts is None else parts.unionByName(part)
        return parts

    def images(self, pieces: DataFrame) -> DataFrame:
        """(url, path): the file of the project that each local image of the pieces means."""
        wanted = publish.image_names(pieces)
        near = settings.vault_settings(self.root)["attachment_folder"]
        files = scan.names(self.spark, str(self.root)).select("path", (F.col("path").startswith(near.strip("/") + "/") if near else F.lit(False)).alias("preferred"))
        found = small.first_match(wanted.select("name"), files)
        return wanted.join(found, "name").select("url", "path").distinct()

    def publish(self, folder: str | Path, options: settings.Publish | None = None, single: bool = False, suffix: str | None = None) -> list[Path]:
        """Write one document per record, or a single one: blocks and hooks, rendering, images, writing, conversion.

        Pieces go from the tasks that render them to their places in the files; only a hook on texts gets a document as a whole."""
        folder, hooks = Path(folder), [p for p in self.plugins if p.transform_markdown]
        folder.mkdir(parents=True, exist_ok=True)
        pieces = scratch.table(self.pieces(options, several=single), "pieces")
        manifest = outputs.copy_images(((r.url, r.path) for r in self.images(pieces).orderBy("url").toLocalIterator()), self.root, folder)
        if manifest:
            pieces = publish.with_images(pieces, manifest)
        if single and hooks:  # a hook sees the single document
            pieces = pieces.select(F.lit("publish").alias("record"), F.concat_ws("\0", "record", "path").alias("path"), "block_no", "kind", "text")
        file = F.concat(F.lit("publish") if single else F.col("record"), F.lit(".md"))
        if not hooks:
            out = writer.write_files(pieces.withColumn("file", file), ["record", "path", "block_no"], folder, between="\n\n", tail="\n")
        else:
            out = []
            for r in publish.documents(pieces).orderBy("record").toLocalIterator():
                text = r.document
                for plugin in hooks:
                    text = plugin.transform_markdown(text)
                    if not isinstance(text, str):
                        raise PluginError(f"plugin {plugin.name}: transform_markdown must return text")
                out.append(folder / f"{r.record}.md")
                out[-1].write_text(text, encoding="utf-8")
        return [x for path in out for x in ([path, outputs.convert(path, suffix, (options or settings.Publish()).docx_template)] if suffix else [path])]

    def export_matrix(self, matrix: DataFrame, forward: bool = False, attributes: list[str] = (), delimiter: str = ",", path: str | Path | None = None) -> Iterator[str] | Path | None:
        """Give a matrix to the trace plugins, or write it as one CSV file, or without a path give its lines."""
        hooks = [p for p in self.plugins if p.export_trace and p.name in self.config.trace_plugins]
        for p in hooks:
            p.export_trace(matrix)
        if hooks:
            return None
        return report.matrix_lines(matrix, forward, attributes, delimiter) if path is None else report.matrix_file(matrix, path, forward, attributes, delimiter)


class Analysis(str):
    """The text of an analysis, and how many violations there are."""

    def __new__(cls, text: str, errors: int) -> Analysis:
        out = super().__new__(cls, text)
        out.errors = errors
        return out


class _Global:
    """A violation of the whole project: no requirements (F1, K19), git."""

    input_record, category, artifact_id, place = None, "structure", None, None

    def __init__(self, message: str):
        self.message = message


def _folder(paths: dict[str, str]):
    out = F.lit("")
    for name, folder in paths.items():
        prefix = "" if folder.strip("/") in ("", ".") else folder.strip("/") + "/"
        out = F.when(F.col("record") == name, prefix).otherwise(out)
    return out


def _inside(config: settings.Config, repo: str | Path) -> None:
    """Every input folder must lie in the repository (M2)."""
    root = Path(repo).resolve()
    outside = [r.name for r in config.input if not (Path(config.base) / r.dir).resolve().is_relative_to(root)]
    if outside:
        raise git.GitError(f"outside the repository {root}: {', '.join(outside)}")


def _fallback(broken: DataFrame, base: DataFrame | None, target: DataFrame | None) -> DataFrame:
    """(record, path, message, diff) of the files with error blocks on a side, with their unified diff (M6)."""

    def compare(frames):
        for f in frames:
            lines = [[(x or "").splitlines() for x in f[c]] for c in ("old", "new")]
            f["diff"] = ["\n".join(difflib.unified_diff(o, n, f"a/{p}", f"b/{p}", lineterm="")) for o, n, p in zip(*lines, f["path"])]
            yield f[["record", "path", "message", "diff"]]

    out = broken.groupBy("record", "path").agg(F.array_join(F.array_sort(F.collect_set("message")), "; ").alias("message"))
    for name, side in (("old", base), ("new", target)):
        out = out.withColumn(name, F.lit(None).cast("string")) if side is None else out.join(side.groupBy("record", "path").agg(F.max("value").alias(name)), ["record", "path"], "left")
    return out.mapInPandas(compare, "record string, path string, message string, diff string")


def changes(spark: SparkSession, config: settings.Config, rules: metamodel.Metamodel, repo: str | Path, base: str, target: str, *, summary: bool = False) -> str:
    """The change report between two revisions as one text."""
    return "".join(f"{line}\n" for line in change_lines(change_rows(spark, config, rules, repo, base, target, summary=summary)))


def change_lines(rows: DataFrame) -> Iterator[str]:
    """The lines of a report in order, one partition at a time."""
    return (r.text for r in rows.orderBy("part", "a", "b", "c").toLocalIterator())


def change_rows(spark: SparkSession, config: settings.Config, rules: metamodel.Metamodel, repo: str | Path, base: str, target: str, *, summary: bool = False) -> DataFrame:
    """The lines of the change report between two revisions: only changed files are parsed, on both sides (M1-M8).

    Texts with ids of their own meet by id, all others by position; files of sidecar
    records are compared by content; changed files with error blocks are shown as a unified diff.
    """
    _inside(config, repo)
    ends = [git.resolve(repo, r) for r in (base, target)]
    inside = Path(config.base).resolve().relative_to(Path(repo).resolve())
    changed = scratch.table(git.changed_files(spark, repo, *ends), "changed")
    project, sides, contents, broken, places = Project(spark, config, rules), [], [], None, []
    for end in ends:
        out, held, where = None, None, {}
        for record in config.input:
            folder = (inside / record.dir).as_posix()
            only = git.of_record(changed, folder)
            if folder.strip("./"):
                only = only.withColumn("path", F.expr(f"substring(path, {len(folder.strip('/')) + 2})"))
            where[record.name] = tree = trees.tree(spark, repo, end, folder)
            part = scratch.table(project.record_blocks(record, only, tree), "blocks")
            out = part if out is None else out.unionByName(part)
            touched = only.select(F.regexp_replace("path", SIDE, "").alias("path")) if record.driver == "sidecar" else only.select("path")
            faults = part.filter("kind = 'error'").join(touched, "path", "left_semi").select("record", "path", "message")
            broken = faults if broken is None else broken.unionByName(faults)
            if record.driver == "sidecar":
                held_by = part.filter("kind = 'artifact'").groupBy("aid").agg(F.max("path").alias("path"))
                files = held_by.join(tree.contents(held_by), "path").select("aid", "content")
                held = files if held is None else held.unionByName(files)
        sides.append(out)
        contents.append(held)
        places.append(where)
    raw = []
    for where in places:  # the texts of broken files only
        read = None
        for record in config.input:
            some = broken.filter(F.col("record") == record.name).select("path")
            if record.driver == "sidecar":
                some = some.select(F.explode(F.array(*[F.concat("path", F.lit("." + e.lstrip("."))) for e in record.sidecars])).alias("path"))
            part = where[record.name].texts(some).select(F.lit(record.name).alias("record"), F.regexp_replace("path", SIDE, "").alias("path") if record.driver == "sidecar" else "path", "value")
            read = part if read is None else read.unionByName(part)
        raw.append(read)
    empty = spark.createDataFrame([], model.schema(model.BLOCKS))
    sides = [s if s is not None else empty for s in sides]
    # of several artifacts with one id in a record the last counts
    last = F.max_by(F.struct("atype", "fields", "loc"), F.struct("path", "block_no")).alias("v")
    found = [s.filter("kind = 'artifact'").groupBy("record", "aid").agg(last).select("record", "aid", "v.atype", F.to_json(F.array_sort(F.map_entries("v.fields"))).alias("all"), "v.fields", F.col("v.loc.file").alias("path")) for s in sides]
    artifacts = scratch.table(diff.artifact_diff(*found, ["record", "aid"], ["atype", "all"]).select("record", "aid", "change"), "artifacts")
    fields = diff.field_diff(*found, keys=("record", "aid"))
    place = F.concat(_folder({r.name: r.dir for r in config.input}), "path")
    line = lines_text(F.col("loc.line_start"), F.col("loc.line_end"))
    plain = [s.filter("kind = 'text'").withColumn("path", place).withColumn("line", line) for s in sides]
    named = F.coalesce(F.col("explicit_id"), F.lit(False)) & (F.coalesce("block_id", F.lit("")) != "")
    # of several blocks with one id the last counts
    own = [p.filter(named).groupBy("path", "block_id").agg(F.max_by(F.struct("content", "line"), "block_no").alias("x")).select("path", "block_id", "x.*") for p in plain]
    by_id = diff.text_by_id(*own).select("path", "change", *[F.col(f"{side}_{c}").alias(n) for c, names in (("content", ("old", "new")), ("line", ("old_line", "new_line"))) for side, n in zip(("base", "target"), names)])
    texts = scratch.table(by_id.unionByName(diff.text_alignment(*[p.filter(~named) for p in plain])), "texts")
    none = spark.createDataFrame([], "aid string, content binary")
    measured = [small.binary_properties((none if c is None else c).withColumnRenamed("aid", "path")).withColumnRenamed("path", "aid") for c in contents]
    binaries = diff.artifact_diff(*measured, ["aid"], ["sha256", "size"], ["width", "height"]) if any(c is not None for c in contents) else None
    binaries = None if binaries is None else scratch.table(binaries, "binaries")
    errors = None if broken is None else scratch.table(_fallback(broken, *raw), "errors")
    files = changed.join(_inputs(changed, config, inside), "path", "left_semi").select("status")
    return report.change_rows(artifacts, fields, texts, binaries, errors, files=files, base=ends[0][:7], target=ends[1][:7], summary=summary)


def _inputs(changed: DataFrame, config: settings.Config, inside: Path) -> DataFrame:
    """(path) of the changed files in an input folder."""
    out = None
    for record in config.input:
        part = git.of_record(changed, (inside / record.dir).as_posix()).select("path")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def change_files(spark: SparkSession, config: settings.Config, rules: metamodel.Metamodel, repo: str | Path, base: str, target: str, folder: str | Path, day: str, *, summary: bool = False) -> list[Path]:
    """One change report per input record, named by record and revisions."""
    ends, out = [git.resolve(repo, r) for r in (base, target)], []
    Path(folder).mkdir(parents=True, exist_ok=True)
    for record in config.input:
        rows = change_rows(spark, replace(config, input=[record]), rules, repo, base, target, summary=summary)
        name = report.change_name(record.name, *ends, day, summary)
        out += writer.write_files(rows.withColumn("file", F.lit(name)), ["part", "a", "b", "c"], folder, between="\n", tail="\n")
    return out


def generate_tasks(stale: DataFrame, existing: DataFrame, atype_map: dict[str, str]) -> DataFrame:
    """(task_id, action, atype, file_name): tasks for stale links that are new or changed."""
    plan = impact.task_plan(stale, existing)
    kind = F.lit("TASK")
    for pair, name in atype_map.items():
        kind = F.when(F.concat_ws("/", "parent_type", "child_type") == pair, name).otherwise(kind)
    from threadloom.functions.lines import file_name

    return plan.withColumns({"atype": kind, "file_name": F.concat(file_name(F.col("task_id")), F.lit(".md"))})


def task_rules(rules: metamodel.Metamodel, atype_map: dict[str, str]) -> metamodel.Metamodel:
    """The metamodel with the implicit types of generated tasks."""
    lines = ["    id is string", "    attribute contents is mandatory string", "    attribute status is mandatory enum [open, closed]"]
    names = [n for n in dict.fromkeys(["TASK", *atype_map.values()]) if n not in rules.types]
    extra = metamodel.parse("\n".join(x for n in names for x in (f"artifact {n}:", *lines)))
    return metamodel.Metamodel(rules.attr_rules + extra.attr_rules, rules.trace_rules, rules.labels)


__all__ = ["Plugin", "PluginError", "Project", "apply_plugins", "changes", "generate_tasks", "load_plugin", "small", "task_rules"]
