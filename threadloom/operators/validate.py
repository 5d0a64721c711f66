"""Validation rules as constraint queries over artifacts, rule rows and links; each returns violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.model import INTEGER, condition, link_target

OUT = ["code", "artifact_id", "artifact_type", "input_record", "attr", "detail"]


def _emit(df: DataFrame, code: str, attr: Column | None = None, detail: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(
        F.lit(code).alias("code"), F.col("aid").alias("artifact_id"), F.col("atype").alias("artifact_type"), F.col("record").alias("input_record"),
        (none if attr is None else attr).alias("attr"), (none if detail is None else detail).alias("detail"),
    )


def known_types(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    return artifacts.join(F.broadcast(rules.select("atype").distinct()), "atype", "left_semi")


def unknown_types(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """K4; such rows take no part in other checks."""
    return _emit(artifacts.join(F.broadcast(rules.select("atype").distinct()), "atype", "left_anti"), "unknown_type")


def active(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """Artifacts times the rules of their type that hold for them. A metamodel is a text of bounded size: rules are broadcast."""
    pairs = artifacts.join(F.broadcast(rules), "atype")
    return pairs.filter(condition(F.col("cond_anchor"), F.col("cond_negated"), F.col("cond_true")))


def missing_mandatory(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """K5."""
    return _emit(active(artifacts, rules).filter("presence = 'mandatory' and attr != 'id'").filter(~F.map_contains_key("fields", F.col("attr"))), "missing_attribute", F.col("attr"))


def extra_attributes(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """K6: attributes that no active rule of the type covers. The covered names of a row are gathered from its few rules, without a join on attributes."""
    plain = F.collect_list(F.when(F.col("cond_anchor").isNull(), F.col("attr"))).alias("__names")
    others = F.collect_list(F.when(F.col("cond_anchor").isNotNull(), F.struct("attr", "cond_anchor", "cond_negated", "cond_true"))).alias("__rules")
    by_type = F.broadcast(rules.groupBy("atype").agg(plain, others))
    # only names that no unconditional rule covers are held against conditions, and most rows have none
    rest = F.array_except(F.map_keys("fields"), F.col("__names"))
    held = F.transform(F.filter("__rules", lambda r: condition(r["cond_anchor"], r["cond_negated"], r["cond_true"])), lambda r: r["attr"])
    rows = artifacts.join(by_type, "atype").withColumn("__rest", rest).filter(F.size("__rest") > 0)
    return _emit(rows.withColumn("__attr", F.explode(F.array_except("__rest", held))), "extra_attribute", F.col("__attr"))


def _values(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    rows = active(artifacts, rules).withColumn("__value", F.col("fields")[F.col("attr")])
    return rows.filter("__value is not null")


def multiplicity(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """K7: a multiple attribute must be a list, any other must not be."""
    rows = _values(artifacts, rules).filter(F.col("multiple") != F.col("__value.is_list"))
    return _emit(rows, "multiplicity", F.col("attr"), F.when(F.col("multiple"), "must be a list").otherwise("must not be a list"))


def bad_values(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """Integers, booleans with their labels, enums; only values of the right multiplicity."""
    rows = _values(artifacts, rules).filter(F.col("multiple") == F.col("__value.is_list")).filter("type in ('integer', 'boolean', 'enum')")
    each = rows.withColumn("__v", F.explode("__value.vals"))
    low = F.lower("__v")
    good = (
        F.when(F.col("type") == "integer", F.col("__v").rlike(INTEGER))
        .when(F.col("type") == "boolean", F.array_contains("true_vals", low) | F.array_contains("false_vals", low))
        .otherwise(F.array_contains("allowed", F.col("__v")))
    )
    return _emit(each.filter(~good), "bad_value", F.col("attr"), F.concat_ws(": ", "type", "__v")).withColumn("code", F.concat(F.lit("bad_"), F.substring_index("detail", ": ", 1))).withColumn(
        "detail", F.substring("detail", F.instr("detail", ": ") + 2, 1 << 30)
    )


def references(artifacts: DataFrame, rules: DataFrame) -> DataFrame:
    """Artifact rows with each reference value (``__v``) and its target id."""
    rows = _values(artifacts, rules).filter("type = 'reference'")
    return rows.withColumn("__v", F.explode("__value.vals")).withColumn("__target", link_target(F.col("__v")))


def malformed(refs: DataFrame) -> DataFrame:
    """References that name no id."""
    return _emit(refs.filter("__target = ''"), "malformed_reference", F.col("attr"), F.col("__v"))


def extra_roots(artifacts: DataFrame) -> DataFrame:
    """The root is implied, so a declared one is one too many."""
    return _emit(artifacts.filter("atype = 'ROOT'"), "root_count")


def dangling(refs: DataFrame, known: DataFrame) -> DataFrame:
    """References to ids that do not exist."""
    refs = refs.filter("__target != ''")
    return _emit(refs.join(known.select(F.col("aid").alias("__target")), "__target", "left_anti"), "dangling_reference", F.col("attr"), F.col("__target"))


def unknown_type_references(refs: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    """References to artifacts whose type no rule declares."""
    odd = known.join(F.broadcast(rules.select("atype").distinct()), "atype", "left_anti").select(F.col("aid").alias("__target"))
    return _emit(refs.join(odd, "__target", "left_semi"), "unknown_type_reference", F.col("attr"), F.col("__target"))


def id_schema(artifacts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Ids that do not match the pattern of their type."""
    wanted = F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair])
    return _emit(artifacts.withColumn("__p", wanted[F.col("atype")]).filter("__p is not null and not aid rlike __p"), "id_schema", F.lit("id"))


def edges(links: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Resolved links with both types and the child's fields: (aid, atype, record, fields, pid, nominal_revision, __ptype)."""
    parents = artifacts.select(F.col("aid").alias("pid"), F.col("atype").alias("__ptype"))
    return artifacts.join(links.withColumnRenamed("child_id", "aid"), "aid").join(parents, "pid")


def forbidden_traces(resolved: DataFrame, trace_rules: DataFrame) -> DataFrame:
    """An edge to a type that no active trace rule of the source allows; sources without any rule are free."""
    listed = F.collect_list(F.struct("targets", "cond_anchor", "cond_negated", "cond_true")).alias("__rules")
    by_source = F.broadcast(trace_rules.groupBy(F.col("source").alias("atype")).agg(listed))
    allowed = F.flatten(F.transform(F.filter("__rules", lambda r: condition(r["cond_anchor"], r["cond_negated"], r["cond_true"])), lambda r: r["targets"]))
    rows = resolved.join(by_source, "atype").filter(~F.array_contains(allowed, F.col("__ptype")))
    return _emit(rows, "forbidden_trace", None, F.concat_ws(" ", "pid", "__ptype"))


def missing_traces(artifacts: DataFrame, resolved: DataFrame, trace_rules: DataFrame) -> DataFrame:
    """An active mandatory trace rule without a resolved parent of its targets."""
    rules = F.broadcast(trace_rules.filter("presence = 'mandatory'").withColumnRenamed("source", "atype"))
    wanted = artifacts.join(rules, "atype").filter(condition(F.col("cond_anchor"), F.col("cond_negated"), F.col("cond_true")))
    have = resolved.groupBy("aid").agg(F.collect_set("__ptype").alias("__have"))
    lacking = wanted.join(have, "aid", "left").filter(~F.arrays_overlap(F.coalesce("__have", F.array().cast("array<string>")), "targets"))
    return _emit(lacking, "missing_trace", None, F.array_join("targets", " or "))


def trace_modes(resolved: DataFrame, trace_rules: DataFrame) -> DataFrame:
    """A timestamp rule forbids a pinned revision, a commit rule requires one; judged per rule and parent."""
    rows = resolved.join(F.broadcast(trace_rules.withColumnRenamed("source", "atype")), "atype")
    rows = rows.filter(condition(F.col("cond_anchor"), F.col("cond_negated"), F.col("cond_true")) & F.array_contains("targets", F.col("__ptype")))
    pinned = F.col("nominal_revision").isNotNull()
    return _emit(rows.filter(F.when(F.col("mode") == "commit", ~pinned).otherwise(pinned)), "trace_mode", None, F.concat_ws(" ", "mode", "pid"))


def duplicate_ids(occurrences: DataFrame, *order: str) -> DataFrame:
    """K2: each occurrence of an id after the first, with its number."""
    number = F.row_number().over(Window.partitionBy("aid").orderBy(*order))
    return occurrences.withColumn("occurrence", number).filter("occurrence > 1")


def first_wins(occurrences: DataFrame, *order: str) -> DataFrame:
    """The first occurrence of each id, undefined ids excluded."""
    number = F.row_number().over(Window.partitionBy("aid").orderBy(*order))
    return occurrences.filter(F.col("aid") != "<undefined>").withColumn("__n", number).filter("__n = 1").drop("__n")


def all_of(*violations: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, violations)
