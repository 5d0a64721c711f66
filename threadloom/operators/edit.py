"""Edit plans: new identifiers, marker numbers, attribute values, generated block ids, searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.model import numbered_id
from threadloom.operators.order import numbered


def renumber(rows: DataFrame, *, valid: Column, number: Column, order: str = "location", width: int = 3, force: bool = False) -> DataFrame:
    """(aid, atype, location, new_id) of rows that need an id: valid ids stay, others count on from the largest of their type.

    ``force`` numbers everything anew from 1. New numbers follow the location as text.
    """
    if force:
        todo, base = rows, None
    else:
        todo, base = rows.filter(~valid), rows.filter(valid).groupBy("atype").agg(F.max(number).alias("__max"))
    todo = numbered(todo, ["atype"], [order], "__k")
    n = F.col("__k")
    if base is not None:  # one row per type
        todo = todo.join(F.broadcast(base), "atype", "left")
        n = F.coalesce("__max", F.lit(0)) + F.col("__k")
    return todo.select("aid", "atype", order, numbered_id(F.concat(F.col("atype"), F.lit("-")), n, width).alias("new_id"))


def duplicate_valid(rows: DataFrame, valid: Column) -> DataFrame:
    """(aid, n) of valid ids that occur more than once, about which renumbering warns."""
    return rows.filter(valid).groupBy("aid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def plan_summary(plan: DataFrame) -> DataFrame:
    """(modified, skipped, unmatched) of an attribute plan."""
    return plan.agg(*[F.count(F.when(F.col("action").isin(*a), 1)).alias(n) for n, a in (("modified", ("write", "delete")), ("skipped", ("keep",)), ("unmatched", ("skip",)))])


def renumber_markers(blocks: DataFrame) -> DataFrame:
    """(marker, record, path, block_no, new_id): blocks without an id count on from the largest numeric id of their marker."""
    numeric = F.when(F.col("block_id").rlike(r"^\s*\d+\s*$"), F.trim("block_id").cast("decimal(38,0)"))
    largest = blocks.groupBy("marker").agg(F.max(numeric).alias("__max"))
    todo = numbered(blocks.filter("block_id is null"), ["marker"], ["record", "path", "block_no"], "__k")
    return todo.join(F.broadcast(largest), "marker").select("marker", "record", "path", "block_no", (F.coalesce("__max", F.lit(0)) + F.col("__k")).cast("string").alias("new_id"))


def fill_from_mapping(artifacts: DataFrame, mapping: DataFrame, literal: str | None) -> DataFrame:
    """Add ``value`` (the mapping's, else the literal) and ``outcome``; blank ids of the mapping are dropped, its last duplicate wins.

    ``mapping``: (line_no, id, value).
    """
    last = mapping.withColumn("id", F.trim("id")).filter("id != ''").groupBy("id").agg(F.max_by(F.trim("value"), "line_no").alias("__value"), F.lit(True).alias("__hit"))
    value = F.coalesce("__value", F.lit(literal))
    outcome = F.when(F.col("__hit").isNotNull(), "mapped").when(value.isNotNull(), "literal").otherwise("skipped")
    return artifacts.join(last.withColumnRenamed("id", "aid"), "aid", "left").withColumn("value", value).withColumn("outcome", outcome).drop("__value", "__hit")


def block_id(marker: Column, path: Column, content: Column) -> Column:
    """A stable id of eight hex digits for a block without one."""
    return F.substring(F.sha2(F.concat(marker, F.lit(":"), path, F.lit(":"), content), 256), 1, 8)


def search(artifacts: DataFrame, query: str) -> DataFrame:
    """Artifacts whose id, type or any attribute value holds the query, ignoring case."""
    q = F.lit(query.lower())
    has = lambda c: F.contains(F.lower(c), q)
    return artifacts.filter(has(F.col("aid")) | has(F.col("atype")) | F.exists(F.map_values("fields"), lambda v: F.exists(v["vals"], has)))


def schema_of(template: Column, rule: Column) -> Column:
    """The id schema that holds: one written as a template id, else the metamodel's, else the default."""
    return F.coalesce(F.when(F.contains(template, F.lit("{num")), template), rule, F.lit("{atype}-{num:3}"))


def attribute_plan(artifacts: DataFrame, operation: str, names: list[str], literal: str | None = None, mapping: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(aid, name, old, value, action and ``keep``) of adding, replacing or deleting attributes.

    ``add`` keeps what is there, ``replace`` and ``del`` leave alone what is not;
    values come from a mapping, else the literal.
    """
    rows = artifacts.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    rows = rows.withColumn("old", F.array_join(F.col("fields")[F.col("name")]["vals"], "; "))
    if mapping is not None:
        rows = fill_from_mapping(rows, mapping, literal)
    else:
        rows = rows.withColumn("value", F.lit(literal))
    has, given = F.map_contains_key("fields", F.col("name")), F.col("value").isNotNull()
    action = {"add": F.when(has, "keep").when(given, "write"), "replace": F.when(~has, "keep").when(given, "write"), "del": F.when(has, "delete").otherwise("keep")}[operation]
    return rows.select("aid", "name", "old", "value", F.coalesce(action, F.lit("skip")).alias("action"), *keep)
