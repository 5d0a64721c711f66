"""Registered queries over the driver's tables, each with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom import metamodel, model
from threadloom.operators import diff, edit, graph, impact, metrics, order, trace, validate
from threadloom.sources import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


_ORDER = ", ".join(t.LINE_ORDER)
LIN = f"""lin AS (SELECT * FROM (SELECT *, 'LIN-' || l_orderkey || '-' || l_linenumber AS aid,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS occurrence FROM lineitem) WHERE occurrence = 1)"""


# --- traceability -----------------------------------------------------------------------------------------------


@query(f"""WITH {LIN}
SELECT row_number() OVER (ORDER BY 'ORD-' || o_orderkey, coalesce(lin.aid, '')) AS record_number, 'ORD-' || o_orderkey AS lead_id,
       coalesce(lin.aid, '') AS linked_id, o_orderstatus AS status
FROM orders LEFT JOIN lin ON l_orderkey = o_orderkey""")
def trace_reverse_ord_lin(spark, sf):
    """Every order with its lines."""
    leads = t.orders(spark, sf)
    links = t.read(spark, sf, "lineitem").select(t.make_id("LIN", "l_orderkey", "l_linenumber").alias("child_id"), t.make_id("ORD", "l_orderkey").alias("pid"))
    pairs = trace.reverse(leads, links)
    named = pairs.join(leads.select(F.col("aid").alias("lead_id"), model.attribute("status").alias("status")), "lead_id")
    return trace.number_rows(named, "lead_id", "linked_id").select("record_number", "lead_id", "linked_id", "status")


_ODD_LINKS = """links AS (
  SELECT 'ORD-' || o_orderkey AS child_id, 0 AS pos, CASE WHEN o_orderkey % 97 = 0 THEN 'CUS-x' ELSE 'CUS-' || o_custkey END AS pid FROM orders
  UNION ALL SELECT 'ORD-' || o_orderkey, 1, 'PRT-' || (1 + o_orderkey % 7) FROM orders WHERE o_orderkey % 89 = 0)"""


def _odd_links(spark, sf):
    """Order parents with injected dangling ids and parents of another type."""
    o = t.read(spark, sf, "orders")
    cus = F.when(F.col("o_orderkey") % 97 == 0, F.lit("CUS-x")).otherwise(t.make_id("CUS", "o_custkey"))
    first = o.select(t.make_id("ORD", "o_orderkey").alias("child_id"), F.lit(0).alias("pos"), cus.alias("pid"))
    other = o.filter("o_orderkey % 89 = 0").select(t.make_id("ORD", "o_orderkey").alias("child_id"), F.lit(1).alias("pos"), F.concat(F.lit("PRT-"), (1 + F.col("o_orderkey") % 7).cast("string")).alias("pid"))
    return first.unionByName(other)


@query(f"""WITH {_ODD_LINKS},
known AS (SELECT 'CUS-' || c_custkey AS aid, 'CUS' AS atype FROM customer UNION ALL SELECT 'PRT-' || p_partkey, 'PRT' FROM part),
good AS (SELECT l.* FROM links l LEFT JOIN known k ON k.aid = l.pid WHERE k.aid IS NULL OR k.atype = 'CUS')
SELECT row_number() OVER (ORDER BY 'ORD-' || o_orderkey, coalesce(pos, 0)) AS record_number, 'ORD-' || o_orderkey AS lead_id,
       coalesce(pid, '') AS linked_id, o_orderpriority AS priority
FROM orders LEFT JOIN good ON child_id = 'ORD-' || o_orderkey""")
def trace_forward_ord_parents(spark, sf):
    """Orders with their customers; dangling ids stay, parents of another type go."""
    leads = t.orders(spark, sf)
    pairs = trace.forward(leads, _odd_links(spark, sf), t.identities(spark, sf, "customer", "part"), "CUS")
    named = pairs.join(leads.select(F.col("aid").alias("lead_id"), model.attribute("priority").alias("priority")), "lead_id")
    return trace.number_rows(named, "lead_id", "pos").select("record_number", "lead_id", "linked_id", "priority")


@query(f"""WITH {LIN}
SELECT aid AS lead_id, 'ORD-' || l_orderkey || '; PRT-' || l_partkey || '; SUP-' || l_suppkey AS linked_ids FROM lin""")
def trace_forward_flat(spark, sf):
    """all parents of each line in one cell, in link order."""
    first = t.first_lines(spark, sf)
    links = t.line_links(first)
    return trace.flat(links.select(F.col("child_id").alias("lead_id"), "pos", F.col("pid").alias("linked_id")), "pos")


@query(f"""WITH {LIN}
SELECT 'ORD-' || o_orderkey AS lead_id, coalesce(string_agg(aid, '; ' ORDER BY aid), '') AS linked_ids
FROM orders LEFT JOIN lin ON l_orderkey = o_orderkey GROUP BY 1""")
def trace_reverse_flat(spark, sf):
    """F9 reverse: sorted children of each order."""
    links = t.read(spark, sf, "lineitem").select(t.make_id("LIN", "l_orderkey", "l_linenumber").alias("child_id"), t.make_id("ORD", "l_orderkey").alias("pid"))
    return trace.flat(trace.reverse(t.orders(spark, sf), links), "linked_id")


@query(f"""WITH {_ODD_LINKS},
known AS (SELECT 'CUS-' || c_custkey AS aid, 'customers' AS record FROM customer UNION ALL SELECT 'PRT-' || p_partkey, 'parts' FROM part)
SELECT DISTINCT aid, record FROM links JOIN known ON aid = pid""")
def trace_record_names(spark, sf):
    """The input record of every referenced id that exists."""
    return trace.record_names(_odd_links(spark, sf).select(F.col("pid").alias("aid")), t.identities(spark, sf, "customer", "part"))


# --- first wins, duplicates, metrics --------------------------------------------------------------------------


@query(f"WITH {LIN} SELECT aid, 'PRT-' || l_partkey AS part, 'SUP-' || l_suppkey AS supplier FROM lin")
def dedup_first_wins(spark, sf):
    """The first occurrence of each line id."""
    rows = t.read(spark, sf, "lineitem").withColumn("aid", t.make_id("LIN", "l_orderkey", "l_linenumber"))
    return validate.first_wins(rows, *t.LINE_ORDER).select("aid", t.make_id("PRT", "l_partkey").alias("part"), t.make_id("SUP", "l_suppkey").alias("supplier"))


@query(f"""SELECT * FROM (SELECT 'LIN-' || l_orderkey || '-' || l_linenumber AS aid, l_partkey,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS occurrence,
  first_value(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ORDER}) AS first_partkey FROM lineitem) WHERE occurrence > 1""")
def duplicate_ids(spark, sf):
    """Every further occurrence of an id, with where the first one is."""
    order = Window.partitionBy("aid").orderBy(*t.LINE_ORDER)
    rows = t.read(spark, sf, "lineitem").withColumn("aid", t.make_id("LIN", "l_orderkey", "l_linenumber")).withColumn("first_partkey", F.first("l_partkey").over(order))
    return validate.duplicate_ids(rows, *t.LINE_ORDER).select("aid", "l_partkey", "occurrence", "first_partkey")


_METRIC = """m AS (SELECT o_orderstatus AS status, CASE WHEN o_orderkey % 11 = 0 THEN 'orders-b' ELSE 'orders-a' END AS record,
  o_orderkey % 5 = 0 AS no_verify, o_orderkey % 13 = 0 AS tbd, o_orderkey % 17 = 0 AS no_status FROM orders)"""


def _metric_rows(spark, sf):
    key = F.col("o_orderkey")
    return t.read(spark, sf, "orders").select(
        F.when(key % 11 == 0, "orders-b").otherwise("orders-a").alias("record"),
        model.fields(
            status=model.scalar(F.when(key % 17 != 0, F.col("o_orderstatus"))), verify=model.scalar(F.when(key % 5 != 0, F.lit("test"))),
            contents=model.scalar(F.when(key % 13 == 0, F.lit("value TBD later")).otherwise("tbd is fine")),
        ).alias("fields"),
    )


@query(f"WITH {_METRIC} SELECT CASE WHEN no_status THEN 'UNKNOWN' ELSE status END AS status, count(*) AS count FROM m GROUP BY 1")
def metrics_by_status(spark, sf):
    """F2."""
    return metrics.by_status(_metric_rows(spark, sf))


_PCT = "count(*) AS total, round(100.0 * avg(no_verify::INT), 6) AS pct_without_verify, round(100.0 * avg(tbd::INT), 6) AS pct_tbd"


@query(f"WITH {_METRIC} SELECT {_PCT} FROM m")
def metrics_pct(spark, sf):
    """F1 F3 F4 D9."""
    return metrics.percentages(_metric_rows(spark, sf))


@query(f"WITH {_METRIC} SELECT record, {_PCT} FROM m GROUP BY 1 HAVING (SELECT count(DISTINCT record) FROM m) > 1")
def metrics_by_input(spark, sf):
    """F5."""
    return metrics.by_input(_metric_rows(spark, sf))


# --- validation -----------------------------------------------------------------------------------------------

METAMODEL = """
artifact ORD:
    id is string as ORD-{num}
    attribute contents is mandatory string
    attribute status is mandatory enum [F, O, P]
    attribute count is optional integer
    attribute urgent is mandatory boolean
    attribute flag is optional boolean [true: "on", "yes", false: "off", "no"]
    attribute tags is optional multiple string
    attribute reason is mandatory string if urgent
    attribute note is mandatory string if flag
    attribute extra is optional string if not flag
    attribute parent is mandatory reference to parent
    attribute see is optional reference
artifact CUS:
    id is string
    attribute contents is mandatory string
trace from ORD to CUS or SUP is mandatory via timestamp
trace from ORD to PRT is optional via commit if urgent
"""


def _rules(spark):
    return metamodel.parse(METAMODEL).frames(spark)


#: Order artifacts with injected faults, as SQL columns; a null is a missing attribute.
BAD = """bad AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN 'ORDER-' ELSE 'ORD-' END || o_orderkey AS aid,
  CASE WHEN o_orderkey % 103 = 0 THEN 'XXX' ELSE 'ORD' END AS atype,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'text' END AS contents,
  CASE WHEN o_orderkey % 31 = 0 THEN 'Q' ELSE o_orderstatus END AS status,
  CASE o_orderkey % 6 WHEN 0 THEN ' 1_000 ' WHEN 1 THEN '1__0' WHEN 2 THEN '99999999999999999999' WHEN 3 THEN 'x1' WHEN 4 THEN '-5' END AS cnt,
  CASE o_orderkey % 4 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' WHEN 2 THEN 'maybe' ELSE 'yes' END AS urgent,
  CASE o_orderkey % 5 WHEN 0 THEN 'On' WHEN 1 THEN 'off' WHEN 2 THEN 'true' END AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN 'why' END AS reason,
  CASE WHEN o_orderkey % 19 = 0 THEN 'CUS-x' WHEN o_orderkey % 23 = 0 THEN 'ODD-1' ELSE 'CUS-' || o_custkey END
    || CASE WHEN o_orderkey % 29 = 0 THEN '@abc' ELSE '' END AS parent,
  CASE WHEN o_orderkey % 37 = 0 THEN 'yes' END AS surplus, CASE WHEN o_orderkey % 2 = 0 THEN 'n' END AS note, CASE WHEN o_orderkey % 8 = 0 THEN 'e' END AS extra
  FROM orders)"""


def _bad(spark, sf):
    key = F.col("o_orderkey")

    def case(n: int, *values):
        out = F.lit(None).cast("string")
        for i, v in reversed(list(enumerate(values))):
            if v is not None:
                out = F.when(key % n == i, F.lit(v)).otherwise(out)
        return out

    parent = F.concat(
        F.when(key % 19 == 0, "CUS-x").when(key % 23 == 0, "ODD-1").otherwise(t.make_id("CUS", "o_custkey")), F.when(key % 29 == 0, "@abc").otherwise("")
    )
    return t.read(spark, sf, "orders").select(
        F.lit("orders").alias("record"), F.when(key % 103 == 0, "XXX").otherwise("ORD").alias("atype"),
        F.concat(F.when(key % 101 == 0, "ORDER-").otherwise("ORD-"), key.cast("string")).alias("aid"),
        model.fields(
            id=model.scalar(key.cast("string")), contents=model.scalar(F.when(key % 7 != 0, "text")), status=model.scalar(F.when(key % 31 == 0, "Q").otherwise(F.col("o_orderstatus"))),
            count=model.scalar(case(6, " 1_000 ", "1__0", "99999999999999999999", "x1", "-5")), urgent=model.scalar(case(4, "TRUE", "no", "maybe", "yes")),
            flag=model.scalar(case(5, "On", "off", "true")), reason=model.scalar(F.when(key % 3 == 0, "why")), parent=model.scalar(parent),
            tags=F.when(key % 41 == 0, model.scalar(F.lit("one"))).otherwise(model.listed(F.array(F.lit("a"), F.lit("b")))),
            surplus=model.scalar(F.when(key % 37 == 0, "yes")), note=model.scalar(F.when(key % 2 == 0, "n")), extra=model.scalar(F.when(key % 8 == 0, "e")),
        ).alias("fields"),
    )


def _checked(spark, sf):
    rules, traces = _rules(spark)
    return validate.known_types(_bad(spark, sf), rules), rules, traces


@query(f"WITH {BAD} SELECT aid AS artifact_id, atype AS artifact_type FROM bad WHERE atype = 'XXX'")
def unknown_types(spark, sf):
    """K4 E14."""
    return validate.unknown_types(_bad(spark, sf), _rules(spark)[0]).select("artifact_id", "artifact_type")


@query(f"""WITH {BAD} SELECT aid AS artifact_id, attr FROM (
  SELECT aid, 'contents' AS attr FROM bad WHERE atype = 'ORD' AND contents IS NULL
  UNION ALL SELECT aid, 'reason' FROM bad WHERE atype = 'ORD' AND lower(urgent) IN ('true', 'yes', '1') AND reason IS NULL
  UNION ALL SELECT aid, 'note' FROM bad WHERE atype = 'ORD' AND lower(flag) IN ('on', 'yes') AND note IS NULL)""")
def missing_mandatory_attr(spark, sf):
    """Mandatory attributes, conditional ones included, also on booleans with labels of their own."""
    rows, rules, _ = _checked(spark, sf)
    return validate.missing_mandatory(rows, rules).select("artifact_id", "attr")


@query(f"""WITH {BAD} SELECT aid AS artifact_id, attr FROM (
  SELECT aid, 'surplus' AS attr FROM bad WHERE atype = 'ORD' AND surplus IS NOT NULL
  UNION ALL SELECT aid, 'reason' FROM bad WHERE atype = 'ORD' AND NOT lower(urgent) IN ('true', 'yes', '1') AND reason IS NOT NULL
  UNION ALL SELECT aid, 'note' FROM bad WHERE atype = 'ORD' AND NOT coalesce(lower(flag) IN ('on', 'yes'), false) AND note IS NOT NULL
  UNION ALL SELECT aid, 'extra' FROM bad WHERE atype = 'ORD' AND lower(flag) IN ('on', 'yes') AND extra IS NOT NULL)""")
def extra_attr(spark, sf):
    """Attributes without an active rule."""
    rows, rules, _ = _checked(spark, sf)
    return validate.extra_attributes(rows, rules).select("artifact_id", "attr")


@query(f"WITH {BAD} SELECT aid AS artifact_id, 'tags' AS attr, 'must be a list' AS detail FROM bad WHERE atype = 'ORD' AND k % 41 = 0")
def multiplicity_violations(spark, sf):
    """K7."""
    rows, rules, _ = _checked(spark, sf)
    return validate.multiplicity(rows, rules).select("artifact_id", "attr", "detail")


def _bad_values(spark, sf, code):
    rows, rules, _ = _checked(spark, sf)
    return validate.bad_values(rows, rules.filter(F.col("type") == code)).select("code", "artifact_id", "attr", "detail")


@query(rf"""WITH {BAD} SELECT 'bad_integer' AS code, aid AS artifact_id, 'count' AS attr, cnt AS detail FROM bad
WHERE atype = 'ORD' AND cnt IS NOT NULL AND NOT regexp_full_match(cnt, '\s*[+-]?\d+(_\d+)*\s*')""")
def integer_violations(spark, sf):
    """K8."""
    return _bad_values(spark, sf, "integer")


@query(f"""WITH {BAD} SELECT 'bad_boolean' AS code, aid AS artifact_id, attr, detail FROM (
  SELECT aid, 'urgent' AS attr, urgent AS detail FROM bad WHERE atype = 'ORD' AND lower(urgent) NOT IN ('true', 'yes', '1', 'false', 'no', '0')
  UNION ALL SELECT aid, 'flag', flag FROM bad WHERE atype = 'ORD' AND lower(flag) NOT IN ('on', 'yes', 'off', 'no'))""")
def boolean_violations(spark, sf):
    """K9: usual and custom labels."""
    return _bad_values(spark, sf, "boolean")


@query(f"WITH {BAD} SELECT 'bad_enum' AS code, aid AS artifact_id, 'status' AS attr, status AS detail FROM bad WHERE atype = 'ORD' AND status NOT IN ('F', 'O', 'P')")
def enum_violations(spark, sf):
    """K10."""
    return _bad_values(spark, sf, "enum")


@query(f"WITH {BAD} SELECT aid AS artifact_id FROM bad WHERE atype = 'ORD' AND NOT regexp_full_match(aid, 'ORD-\\d+')")
def id_schema_violations(spark, sf):
    """K12 L17."""
    rows, _, _ = _checked(spark, sf)
    return validate.id_schema(rows, {"ORD": metamodel.id_pattern("{atype}-{num}", "ORD")}).select("artifact_id")


_KNOWN = "known AS (SELECT 'CUS-' || c_custkey AS aid, 'CUS' AS atype FROM customer UNION ALL SELECT 'ODD-1', 'ODD')"


def _known(spark, sf):
    odd = spark.range(1).select(F.lit("ODD-1").alias("aid"), F.lit("ODD").alias("atype"), F.lit("odd").alias("record"))
    return t.identities(spark, sf, "customer").unionByName(odd)


@query(f"""WITH {BAD}, {_KNOWN} SELECT b.aid AS artifact_id, 'parent' AS attr, split_part(parent, '@', 1) AS detail FROM bad b
WHERE atype = 'ORD' AND NOT EXISTS (SELECT 1 FROM known k WHERE k.aid = split_part(parent, '@', 1))""")
def dangling_refs(spark, sf):
    """K11 E7."""
    rows, rules, _ = _checked(spark, sf)
    return validate.dangling(validate.references(rows, rules), _known(spark, sf)).select("artifact_id", "attr", "detail")


@query(f"""WITH {BAD} SELECT aid AS artifact_id, 'parent' AS attr, 'ODD-1' AS detail FROM bad WHERE atype = 'ORD' AND split_part(parent, '@', 1) = 'ODD-1'""")
def unknown_type_refs(spark, sf):
    """K11 E8."""
    rows, rules, _ = _checked(spark, sf)
    return validate.unknown_type_references(validate.references(rows, rules), _known(spark, sf), rules).select("artifact_id", "attr", "detail")


_EDGES = """edges AS (SELECT 'ORD-' || o_orderkey AS aid, 'CUS-' || o_custkey AS pid, 'CUS' AS ptype, o_orderkey % 43 = 0 AS pinned, o_orderkey % 4 IN (0, 3) AS urgent
    FROM orders WHERE o_orderkey % 53 <> 0
  UNION ALL SELECT 'ORD-' || o_orderkey, 'PRT-' || (1 + o_orderkey % 7), 'PRT', o_orderkey % 2 = 0, o_orderkey % 4 IN (0, 3) FROM orders WHERE o_orderkey % 10 = 1
  UNION ALL SELECT 'ORD-' || o_orderkey, 'RGN-' || (o_orderkey % 5), 'RGN', false, o_orderkey % 4 IN (0, 3) FROM orders WHERE o_orderkey % 61 = 0)"""


def _resolved(spark, sf):
    key = F.col("o_orderkey")
    o = t.read(spark, sf, "orders")
    aid = t.make_id("ORD", "o_orderkey").alias("child_id")
    none = F.lit(None).cast("string")
    links = (
        o.filter(key % 53 != 0).select(aid, t.make_id("CUS", "o_custkey").alias("pid"), F.when(key % 43 == 0, "abc").alias("nominal_revision"))
        .unionByName(o.filter(key % 10 == 1).select(aid, F.concat(F.lit("PRT-"), (1 + key % 7).cast("string")).alias("pid"), F.when(key % 2 == 0, "abc").alias("nominal_revision")))
        .unionByName(o.filter(key % 61 == 0).select(aid, F.concat(F.lit("RGN-"), (key % 5).cast("string")).alias("pid"), none.alias("nominal_revision")))
    )
    urgent = F.when(key % 4 == 0, "TRUE").when(key % 4 == 1, "no").when(key % 4 == 2, "maybe").otherwise("yes")
    rows = o.select(F.lit("orders").alias("record"), F.lit("ORD").alias("atype"), t.make_id("ORD", "o_orderkey").alias("aid"), model.fields(urgent=model.scalar(urgent)).alias("fields"))
    known = t.identities(spark, sf, "customer", "part", "region").select("aid", "atype")
    parents = known.select(F.col("aid").alias("pid"), F.col("atype").alias("__ptype"))
    return rows, rows.join(links.withColumnRenamed("child_id", "aid"), "aid").join(parents, "pid")


@query(f"WITH {_EDGES} SELECT aid AS artifact_id, pid || ' ' || ptype AS detail FROM edges WHERE ptype = 'RGN' OR (ptype = 'PRT' AND NOT urgent)")
def forbidden_traces(spark, sf):
    """Parents of a type that no active rule allows."""
    _, resolved = _resolved(spark, sf)
    return validate.forbidden_traces(resolved, _rules(spark)[1]).select("artifact_id", "detail")


@query("SELECT 'ORD-' || o_orderkey AS artifact_id, 'CUS or SUP' AS detail FROM orders WHERE o_orderkey % 53 = 0")
def missing_mandatory_trace(spark, sf):
    """K14 E10."""
    rows, resolved = _resolved(spark, sf)
    return validate.missing_traces(rows, resolved, _rules(spark)[1]).select("artifact_id", "detail")


@query(f"""WITH {_EDGES} SELECT aid AS artifact_id, CASE ptype WHEN 'CUS' THEN 'timestamp ' ELSE 'commit ' END || pid AS detail FROM edges
WHERE (ptype = 'CUS' AND pinned) OR (ptype = 'PRT' AND urgent AND NOT pinned)""")
def trace_mode_violations(spark, sf):
    """K15 E11."""
    _, resolved = _resolved(spark, sf)
    return validate.trace_modes(resolved, _rules(spark)[1]).select("artifact_id", "detail")


@query(f"""WITH {BAD} SELECT input_record, category, count(*) AS n FROM (
  SELECT 'orders' AS input_record, 'attribute' AS category FROM bad WHERE atype = 'XXX'
  UNION ALL SELECT 'orders', 'attribute' FROM bad WHERE atype = 'ORD' AND contents IS NULL
  UNION ALL SELECT 'orders', 'attribute' FROM bad WHERE atype = 'ORD' AND lower(urgent) IN ('true', 'yes', '1') AND reason IS NULL
  UNION ALL SELECT 'orders', 'attribute' FROM bad WHERE atype = 'ORD' AND lower(flag) IN ('on', 'yes') AND note IS NULL
  UNION ALL SELECT 'orders', 'schema' FROM bad WHERE atype = 'ORD' AND aid LIKE 'ORDER-%') GROUP BY 1, 2""")
def error_groups(spark, sf):
    """Violations by input and category."""
    rows, rules, _ = _checked(spark, sf)
    found = validate.all_of(
        validate.unknown_types(_bad(spark, sf), rules), validate.missing_mandatory(rows, rules), validate.id_schema(rows, {"ORD": metamodel.id_pattern("ORD-{num}", "ORD")})
    )
    found = found.withColumn("category", F.when(F.col("code") == "id_schema", "schema").otherwise("attribute"))
    return metrics.error_groups(found).select("input_record", "category", "n")


# --- graph ------------------------------------------------------------------------------------------------------


def _multi_parent(spark, sf):
    """Order artifacts whose parent attribute lists several references, some pinned, some twice."""
    key = F.col("o_orderkey")
    second = F.when(key % 3 == 0, F.concat(F.lit(", "), t.make_id("CUS", "o_custkey"), F.lit("@r2"))).when(key % 3 == 1, F.concat(F.lit(" ,SUP-"), (1 + key % 9).cast("string"))).otherwise("")
    first = F.concat(t.make_id("CUS", "o_custkey"), F.when(key % 2 == 0, "@r1").otherwise(F.when(key % 6 == 3, "@r2").otherwise("")))
    return t.read(spark, sf, "orders").select(t.make_id("ORD", "o_orderkey").alias("aid"), F.lit("ORD").alias("atype"), model.fields(parent=model.scalar(F.concat(first, second))).alias("fields"))


_MULTI = """refs AS (
  SELECT o_orderkey AS k, 0 AS q, 'CUS-' || o_custkey AS pid, CASE WHEN o_orderkey % 2 = 0 THEN 'r1' WHEN o_orderkey % 6 = 3 THEN 'r2' END AS rev FROM orders
  UNION ALL SELECT o_orderkey, 1, 'CUS-' || o_custkey, 'r2' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 1, 'SUP-' || (1 + o_orderkey % 9), NULL FROM orders WHERE o_orderkey % 3 = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, pid ORDER BY q) AS n, first_value(rev) OVER (PARTITION BY k, pid ORDER BY q) AS first_rev FROM refs)"""


@query(f"WITH {_MULTI} SELECT 'ORD-' || k AS child_id, row_number() OVER (PARTITION BY k ORDER BY q) - 1 AS pos, pid, rev AS nominal_revision FROM ranked WHERE n = 1")
def parent_links(spark, sf):
    """Links of parent attributes, the first of each parent."""
    return graph.parent_links(_multi_parent(spark, sf), _rules(spark)[0])[0]


@query(f"WITH {_MULTI} SELECT 'ORD-' || k AS child_id, pid, rev AS nominal_revision FROM ranked WHERE n > 1 AND rev IS DISTINCT FROM first_rev")
def conflicting_revisions(spark, sf):
    """A second link with another revision."""
    return graph.parent_links(_multi_parent(spark, sf), _rules(spark)[0])[1]


@query("""SELECT 'CUS-' || c_custkey AS aid FROM customer WHERE c_custkey % 9 = 0
UNION ALL SELECT 'RGN-' || r_regionkey FROM region UNION ALL SELECT 'NTN-' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0""")
def top_level(spark, sf):
    """Nodes without a parent."""
    nodes = t.identities(spark, sf, "region", "nation", "customer")
    return graph.top_level(nodes, _thin_links(spark, sf)).select("aid")


def _thin_links(spark, sf):
    c = t.read(spark, sf, "customer").filter("c_custkey % 9 != 0").select(t.make_id("CUS", "c_custkey").alias("child_id"), F.when(F.col("c_custkey") % 8 == 0, "NTN-x").otherwise(t.make_id("NTN", "c_nationkey")).alias("pid"))
    n = t.read(spark, sf, "nation").filter("n_nationkey % 5 != 0").select(t.make_id("NTN", "n_nationkey").alias("child_id"), t.make_id("RGN", "n_regionkey").alias("pid"))
    return c.unionByName(n)


@query("""SELECT 'CUS-' || c_custkey AS aid FROM customer WHERE c_custkey % 9 = 0 OR c_custkey % 8 = 0
UNION ALL SELECT 'RGN-' || r_regionkey FROM region UNION ALL SELECT 'NTN-' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0""")
def top_level_suppressed(spark, sf):
    """J2 with tracing suppressed: unresolved parents do not count."""
    return graph.top_level(t.identities(spark, sf, "region", "nation", "customer"), _thin_links(spark, sf), suppress_tracing=True).select("aid")


@query("""SELECT 'CUS-' || o_custkey AS pid, count(DISTINCT o_orderkey) AS n_children, string_agg('ORD-' || o_orderkey, ';' ORDER BY 'ORD-' || o_orderkey) AS children
FROM orders GROUP BY 1""")
def children_index(spark, sf):
    """E6."""
    return graph.children_index(t.orders(spark, sf).select(F.col("aid").alias("child_id"), F.col("parent").alias("pid")))


_GRAPH = f"""{LIN}, e AS (
  SELECT 'RGN-' || n_regionkey AS a, 'NTN-' || n_nationkey AS d FROM nation UNION ALL SELECT 'NTN-' || c_nationkey, 'CUS-' || c_custkey FROM customer
  UNION ALL SELECT 'NTN-' || s_nationkey, 'SUP-' || s_suppkey FROM supplier UNION ALL SELECT 'CUS-' || o_custkey, 'ORD-' || o_orderkey FROM orders
  UNION ALL SELECT 'ORD-' || l_orderkey, aid FROM lin UNION ALL SELECT 'PRT-' || l_partkey, aid FROM lin UNION ALL SELECT 'SUP-' || l_suppkey, aid FROM lin)"""


@query(f"""WITH RECURSIVE {_GRAPH}, c(anc_id, desc_id, depth) AS (
  SELECT a, d, 1 FROM e UNION ALL SELECT c.anc_id, e.d, c.depth + 1 FROM c JOIN e ON e.a = c.desc_id WHERE c.depth < 20)
SELECT anc_id, desc_id, min(depth) AS depth FROM c GROUP BY 1, 2""")
def ancestor_closure(spark, sf):
    """All ancestor pairs with their distance."""
    return graph.closure(t.hierarchy_links(spark, sf, deep=True))


@query("SELECT 'K-' || (o_orderkey // 24 * 24 + o_orderkey % 24) AS start FROM orders WHERE o_orderkey % 24 >= 21 OR o_orderkey // 24 % 50 = 0")
def cycle_or_too_deep(spark, sf):
    """Chains of 24 nodes whose first parent is known, some closed to a cycle; nodes with a walk of more than 20 edges."""
    k = F.col("o_orderkey")
    o = t.read(spark, sf, "orders").select(k)
    name = lambda c: F.concat(F.lit("K-"), c.cast("string"))
    base = F.floor(k / 24) * 24
    chain = o.filter(k % 24 > 0).select(name(k).alias("child_id"), name(k - 1).alias("pid"))
    loops = o.filter((k % 24 == 0) & (F.floor(k / 24) % 50 == 0)).select(name(k).alias("child_id"), name(base + 23).alias("pid"))
    return graph.too_deep(chain.unionByName(loops))


@query("""SELECT 'RGN-' || n_regionkey || '/NTN-' || n_nationkey || '/CUS-' || c_custkey AS path, 'CUS-' || c_custkey AS aid, 2 AS depth
FROM customer JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT 'RGN-' || n_regionkey || '/NTN-' || n_nationkey, 'NTN-' || n_nationkey, 1 FROM nation UNION ALL SELECT 'RGN-' || r_regionkey, 'RGN-' || r_regionkey, 0 FROM region""")
def tree_paths(spark, sf):
    """Tree order of regions, nations and customers."""
    links = t.read(spark, sf, "nation").select(t.make_id("NTN", "n_nationkey").alias("child_id"), t.make_id("RGN", "n_regionkey").alias("pid"))
    links = links.unionByName(t.read(spark, sf, "customer").select(t.make_id("CUS", "c_custkey").alias("child_id"), t.make_id("NTN", "c_nationkey").alias("pid")))
    return graph.tree_paths(links, t.identities(spark, sf, "region"))


@query("""WITH p AS (
  SELECT 'RGN-' || r_regionkey AS r, '' AS n, '' AS c FROM region UNION ALL SELECT 'RGN-' || n_regionkey, 'NTN-' || n_nationkey, '' FROM nation
  UNION ALL SELECT 'RGN-' || n_regionkey, 'NTN-' || n_nationkey, 'CUS-' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT *, max(n) OVER (PARTITION BY r) = n AS ln, max(c) OVER (PARTITION BY r, n) = c AS lc, row_number() OVER (ORDER BY r, n, c) - 1 AS line_no, count(*) OVER () AS total FROM p)
SELECT line_no, CASE WHEN n = '' THEN r WHEN c = '' THEN CASE WHEN ln THEN '└── ' ELSE '├── ' END || n
  ELSE CASE WHEN ln THEN '    ' ELSE '│   ' END || CASE WHEN lc THEN '└── ' ELSE '├── ' END || c END AS line, total FROM l WHERE line_no < 200""")
def tree_head(spark, sf):
    """The first 200 lines of the tree of regions, nations and customers, and how many it has (the limit is the feature)."""
    links = t.read(spark, sf, "nation").select(t.make_id("NTN", "n_nationkey").alias("child_id"), t.make_id("RGN", "n_regionkey").alias("pid"))
    links = links.unionByName(t.read(spark, sf, "customer").select(t.make_id("CUS", "c_custkey").alias("child_id"), t.make_id("NTN", "c_nationkey").alias("pid")))
    lines, total = graph.first_lines(links, t.identities(spark, sf, "region"), 200)
    return lines.select("line_no", "line", F.lit(total).cast("long").alias("total"))


# --- impact -----------------------------------------------------------------------------------------------------


def _revisions(spark, sf):
    digest = F.sha2(F.col("event_id").cast("string"), 256)
    return t.read(spark, sf, "events").select(
        t.make_id("CUS", "user_id").alias("aid"), digest.alias("hash_long"), F.substring(digest, 1, 7).alias("hash_short"), F.col("ts"), F.col("event_type").alias("author_email")
    )


_LATEST = """rev AS (SELECT 'CUS-' || user_id AS aid, sha256(event_id::VARCHAR) AS hash_long, ts, event_type FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY ts DESC, hash_long DESC) AS k FROM rev) WHERE k = 1)"""


@query(f"WITH {_LATEST} SELECT aid, hash_long, strftime(ts, '%Y-%m-%d %H:%M') AS ts, event_type AS author_email FROM latest")
def latest_revision(spark, sf):
    """F7 F8 L25."""
    out = impact.latest_revision(impact.distinct_revisions(_revisions(spark, sf)))
    return out.select("aid", "hash_long", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts"), "author_email")


@query(f"""WITH {_LATEST}, s AS (SELECT DISTINCT aid, ts, hash_long, substr(hash_long, 1, 7) || ' (' || strftime(ts, '%Y-%m-%d %H:%M') || ' by ' || event_type || ')' AS shown FROM rev)
SELECT aid, count(*) AS n_revisions, first(shown ORDER BY ts DESC, hash_long DESC) AS newest, string_agg(shown, '; ' ORDER BY ts DESC, hash_long DESC) AS revisions FROM s GROUP BY 1""")
def revisions_newest_first(spark, sf):
    """H3: all revisions of an artifact, the newest first."""
    return impact.newest_first(_revisions(spark, sf))


@query(f"""WITH {LIN} SELECT aid AS child_id, 'ORD-' || o_orderkey AS pid, strftime(l_shipdate, '%Y-%m-%d %H:%M') AS child_ts, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS parent_ts
FROM lin JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate""")
def impact_timestamp(spark, sf):
    """Lines whose order is newer."""
    first = t.first_lines(spark, sf)
    latest = first.select("aid", "ts").unionByName(t.orders(spark, sf).select("aid", "ts"))
    stale = impact.stale_by_time(first.select(F.col("aid").alias("child_id"), F.col("parent").alias("pid")), latest)
    day = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return stale.select("child_id", "pid", day("child_ts"), day("parent_ts"))


_PINNED = """pinned AS (SELECT 'ORD-' || o_orderkey AS child_id, 'CUS-' || o_custkey AS pid,
  CASE o_orderkey % 3 WHEN 0 THEN hash_long WHEN 1 THEN substr(hash_long, 1, 7) ELSE '0000000' END AS nominal_revision
  FROM orders JOIN latest ON aid = 'CUS-' || o_custkey)"""


@query(f"WITH {_LATEST}, {_PINNED} SELECT child_id, pid, nominal_revision FROM pinned WHERE nominal_revision = '0000000'")
def impact_commit(spark, sf):
    """Links pinned to another revision than the parent's latest."""
    latest = impact.latest_revision(_revisions(spark, sf))
    k = F.col("o_orderkey")
    orders = t.read(spark, sf, "orders").select(k, t.make_id("ORD", "o_orderkey").alias("child_id"), t.make_id("CUS", "o_custkey").alias("pid"))
    pin = F.when(k % 3 == 0, F.col("hash_long")).when(k % 3 == 1, F.col("hash_short")).otherwise("0000000")
    pinned = orders.join(latest, F.col("pid") == F.col("aid")).select("child_id", "pid", pin.alias("nominal_revision"))
    return impact.stale_by_commit(pinned, latest).select("child_id", "pid", "nominal_revision")


@query(f"""WITH {LIN}, s AS (SELECT 'TASK-IMPACT-' || aid || '-ORD-' || o_orderkey AS task_id, l_orderkey AS k, l_linenumber AS n FROM lin JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate)
SELECT task_id, CASE WHEN k % 4 = 0 THEN 'create' WHEN k % 4 = 1 THEN 'update' ELSE 'skip' END AS action FROM s""")
def task_plan(spark, sf):
    """Tasks to create, update or skip."""
    first = t.first_lines(spark, sf)
    latest = first.select("aid", "ts").unionByName(t.orders(spark, sf).select("aid", "ts"))
    stale = impact.stale_by_time(first.select(F.col("aid").alias("child_id"), F.col("parent").alias("pid"), F.col("l_orderkey")), latest)
    stale = stale.select("child_id", "pid", "l_orderkey", F.lit("c1").alias("child_rev"), F.lit("p1").alias("parent_rev"))
    old = first.filter("l_orderkey % 4 != 0").select(
        F.concat_ws("-", F.lit("TASK-IMPACT"), "aid", "parent").alias("task_id"), F.lit("c1").alias("child_rev"), F.when(F.col("l_orderkey") % 4 == 1, "p0").otherwise("p1").alias("parent_rev")
    )
    return impact.task_plan(stale, old).select("task_id", "action")


# --- differences ------------------------------------------------------------------------------------------------


def _two_revisions(spark, sf):
    o = t.orders(spark, sf)
    base = o.filter("key % 10 != 0")
    status = F.when(F.col("key") % 10 == 1, F.lit("F")).otherwise(F.col("fields")["status"]["vals"][0])
    target = o.filter("key % 10 != 2").withColumn(
        "fields", model.fields(status=model.scalar(status), priority=F.when(F.col("key") % 15 != 3, F.col("fields")["priority"]), tags=model.listed(F.reverse(F.col("fields")["tags"]["vals"])))
    )
    return base, target


@query("""SELECT 'ORD-' || o_orderkey AS aid, CASE WHEN o_orderkey % 10 = 0 THEN 'added' WHEN o_orderkey % 10 = 2 THEN 'removed' ELSE 'modified' END AS change FROM orders
WHERE o_orderkey % 10 IN (0, 2) OR (o_orderkey % 10 = 1 AND o_orderstatus <> 'F')""")
def artifact_diff(spark, sf):
    """Added, removed and modified orders by status."""
    base, target = (f.select("aid", model.attribute("status").alias("status")) for f in _two_revisions(spark, sf))
    return diff.artifact_diff(base, target, ["aid"], ["status"]).select("aid", "change")


@query("""SELECT 'ORD-' || o_orderkey AS aid, 'status' AS field, o_orderstatus AS old, 'F' AS new FROM orders WHERE o_orderkey % 10 = 1 AND o_orderstatus <> 'F'
UNION ALL SELECT 'ORD-' || o_orderkey, 'priority', o_orderpriority, NULL FROM orders WHERE o_orderkey % 15 = 3 AND o_orderkey % 10 NOT IN (0, 2)""")
def field_diff(spark, sf):
    """Changed fields; lists compare as multisets."""
    return diff.field_diff(*_two_revisions(spark, sf))


@query("""SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'a' ELSE 'b' END AS record, count(*) FILTER (WHERE o_orderkey % 10 = 0) AS n_added, count(*) FILTER (WHERE o_orderkey % 10 = 2) AS n_removed,
  count(*) FILTER (WHERE o_orderkey % 10 = 1) AS n_modified, count(*) AS n_changes FROM orders
WHERE o_orderkey % 10 IN (0, 2) OR (o_orderkey % 10 = 1 AND o_orderstatus <> 'F') GROUP BY 1""")
def change_summary(spark, sf):
    """F14."""
    record = F.when(F.col("key") % 4 == 0, "a").otherwise("b")
    base, target = (f.select(record.alias("record"), "aid", model.attribute("status").alias("status")) for f in _two_revisions(spark, sf))
    return diff.summary(diff.artifact_diff(base, target, ["record", "aid"], ["status"]), "record")


_COUNTED = """c AS (
  SELECT source AS record, CASE WHEN doc_id % 7 = 0 THEN 'files_added' WHEN doc_id % 7 = 1 THEN 'files_removed' ELSE 'files_changed' END AS what FROM documents WHERE doc_id % 7 IN (0, 1) OR doc_id % 5 <= 1
  UNION ALL SELECT 'src' || (o_orderkey % 20), CASE WHEN o_orderkey % 10 = 0 THEN 'artifacts_added' WHEN o_orderkey % 10 = 2 THEN 'artifacts_removed' ELSE 'artifacts_modified' END FROM orders
    WHERE o_orderkey % 10 IN (0, 2) OR (o_orderkey % 10 = 1 AND o_orderstatus <> 'F')
  UNION ALL SELECT source, 'text_fragments_modified' FROM documents WHERE doc_id % 7 IN (0, 1) OR doc_id % 5 = 1
  UNION ALL SELECT source, CASE WHEN doc_id % 7 = 0 THEN 'binary_added' WHEN doc_id % 7 = 1 THEN 'binary_removed' ELSE 'binary_modified' END FROM documents WHERE doc_id % 7 IN (0, 1) OR doc_id % 5 <= 1
  UNION ALL SELECT source, 'extraction_errors' FROM documents WHERE doc_id % 11 = 0)"""


@query(f"WITH {_COUNTED} SELECT record, " + ", ".join(f"count(*) FILTER (WHERE what = '{c}') AS {c}" for c in diff.COUNTERS) + " FROM c GROUP BY 1")
def change_counters(spark, sf):
    """the eleven counters of a change report, per record."""
    k = F.col("doc_id")
    d = t.read(spark, sf, "documents").select(k, F.col("source").alias("record"))
    files = d.filter((k % 7).isin(0, 1) | (k % 5 <= 1)).withColumn("status", F.when(k % 7 == 0, "A").when(k % 7 == 1, "D").otherwise("M"))
    record = F.concat(F.lit("src"), (F.col("key") % 20).cast("string"))
    artifacts = diff.artifact_diff(*(f.select(record.alias("record"), "aid", model.attribute("status").alias("status")) for f in _two_revisions(spark, sf)), ["record", "aid"], ["status"])
    texts = diff.text_by_id(*_text_sides(spark, sf)).withColumnRenamed("path", "record")
    sides = (f.select(F.concat_ws("|", "path", "block_id").alias("aid"), F.encode("content", "UTF-8").alias("content")) for f in _text_sides(spark, sf))
    binaries = diff.binary_diff(*sides).withColumn("record", F.substring_index("aid", "|", 1))
    return diff.counters(files, artifacts, texts, binaries, d.filter(k % 11 == 0), "record")


@query("""SELECT source AS path, count(*) AS n_objects, string_agg('b' || doc_id, ';' ORDER BY 'b' || doc_id) AS objects FROM documents WHERE doc_id % 7 IN (0, 1) OR doc_id % 5 = 1 GROUP BY 1""")
def fragments_by_file(spark, sf):
    """F16: changed text fragments of each file."""
    return diff.by_file(diff.text_by_id(*_text_sides(spark, sf)), name="block_id")


@query("""SELECT 'f' || (o_orderkey % 50) AS path, count(*) AS n_objects, string_agg('ORD-' || o_orderkey, ';' ORDER BY 'ORD-' || o_orderkey) AS objects FROM orders
WHERE o_orderkey % 10 IN (0, 2) OR (o_orderkey % 10 = 1 AND o_orderstatus <> 'F') GROUP BY 1""")
def objects_by_file(spark, sf):
    """F15 F16."""
    path = F.concat(F.lit("f"), (F.col("key") % 50).cast("string"))
    base, target = (f.select(path.alias("path"), "aid", model.attribute("status").alias("status")) for f in _two_revisions(spark, sf))
    return diff.by_file(diff.artifact_diff(base, target, ["path", "aid"], ["status"]))


def _text_sides(spark, sf):
    d = t.read(spark, sf, "documents").select("doc_id", "source", "text")
    blocks = d.select(F.col("source").alias("path"), F.col("doc_id").alias("block_no"), F.concat(F.lit("b"), F.col("doc_id").cast("string")).alias("block_id"), F.col("text").alias("content"), "doc_id")
    edited = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit(" \n"), F.col("content"), F.lit("\t "))).when(F.col("doc_id") % 5 == 1, F.concat(F.col("content"), F.lit(" more"))).otherwise(F.col("content"))
    return blocks.filter("doc_id % 7 != 0"), blocks.filter("doc_id % 7 != 1").withColumn("content", edited)


@query("""SELECT source AS path, 'b' || doc_id AS block_id, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 7 = 1 THEN 'removed' ELSE 'modified' END AS change
FROM documents WHERE doc_id % 7 IN (0, 1) OR doc_id % 5 = 1""")
def text_by_id_diff(spark, sf):
    """Text blocks by explicit id, compared stripped."""
    return diff.text_by_id(*_text_sides(spark, sf)).select("path", "block_id", "change")


@query()
def text_alignment_diff(spark, sf):
    """Text blocks aligned in file order."""
    # a file is a range of 200 ids of a source, alike on both sides: a source alone grows with the table
    name = F.concat("path", F.lit("/"), F.floor(F.col("block_no") / 200).cast("string"))
    return diff.text_alignment(*[side.withColumn("path", name) for side in _text_sides(spark, sf)]).select("path", "change", F.length("old").alias("n_old"), F.length("new").alias("n_new"))


@query("""SELECT source || '/' || (doc_id // 200) AS path, CASE WHEN doc_id // 200 % 3 = 0 THEN 'added' WHEN doc_id // 200 % 3 = 1 THEN 'removed' ELSE 'modified' END AS change, 'b' || doc_id AS block_id,
  CASE WHEN doc_id // 200 % 3 <> 0 THEN 'lines ' || (doc_id * 2) || '–' || (doc_id * 2 + 1) END AS old_line, CASE WHEN doc_id // 200 % 3 <> 1 THEN 'line ' || doc_id END AS new_line
FROM documents WHERE doc_id // 200 % 3 < 2 OR doc_id % 5 = 1""")
def text_file_changes(spark, sf):
    """Texts of added and removed files and texts changed in place, with their lines."""
    from threadloom.functions.lines import lines_text

    k, part = F.col("doc_id"), F.floor(F.col("doc_id") / 200)
    rows = t.read(spark, sf, "documents").select(F.concat("source", F.lit("/"), part.cast("string")).alias("path"), k.alias("block_no"), F.concat(F.lit("b"), k.cast("string")).alias("content"))
    part, k = F.floor(F.col("block_no") / 200), F.col("block_no")
    edited = F.when((part % 3 == 2) & (k % 5 == 1), F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    base = rows.filter(part % 3 != 0).withColumn("line", lines_text(k * 2, k * 2 + 1))
    out = diff.text_alignment(base, rows.withColumn("content", edited).filter(part % 3 != 1).withColumn("line", lines_text(k, k)))
    return out.select("path", "change", F.regexp_replace(F.coalesce("new", "old"), "!", "").alias("block_id"), "old_line", "new_line")


@query("""SELECT 'b' || doc_id AS aid, CASE WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 7 = 1 THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN doc_id % 7 <> 0 THEN sha256(text) END AS base_sha256, CASE WHEN doc_id % 7 <> 0 THEN strlen(text) ELSE 0 END AS base_size
FROM documents WHERE doc_id % 7 IN (0, 1) OR doc_id % 5 <= 1""")
def binary_diff(spark, sf):
    """Binaries by content hash."""
    base, target = (f.select(F.col("block_id").alias("aid"), F.encode("content", "UTF-8").alias("content")) for f in _text_sides(spark, sf))
    return diff.binary_diff(base, target).select("aid", "change", "base_sha256", F.coalesce("base_size", F.lit(0).cast("long")).alias("base_size"))


# --- edit plans, search, ids ---------------------------------------------------------------------------------------

_RENUMBER = """r AS (SELECT CASE WHEN o_orderkey % 6 = 0 THEN 'bad' || o_orderkey ELSE atype || '-' || o_orderkey END AS aid, atype, o_orderkey AS k,
  'f' || (o_orderkey % 20) || '.md:' || o_orderkey AS location FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN 'REQ' ELSE 'SYS' END AS atype FROM orders))"""


def _renumber_rows(spark, sf):
    k = F.col("o_orderkey")
    atype = F.when(k % 2 == 0, "REQ").otherwise("SYS")
    return t.read(spark, sf, "orders").select(
        F.when(k % 6 == 0, F.concat(F.lit("bad"), k.cast("string"))).otherwise(F.concat(atype, F.lit("-"), k.cast("string"))).alias("aid"), atype.alias("atype"),
        F.concat(F.lit("f"), (k % 20).cast("string"), F.lit(".md:"), k.cast("string")).alias("location"),
    )


def _number():
    return F.regexp_extract("aid", r"^(?:REQ|SYS)-(\d+)$", 1).try_cast("decimal(38,0)")


@query(f"""WITH {_RENUMBER} SELECT aid, atype, location, atype || '-' || CASE WHEN length(n::VARCHAR) >= 3 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS new_id FROM (
  SELECT aid, atype, location, (SELECT max(k) FROM r v WHERE v.atype = r.atype AND k % 6 <> 0) + row_number() OVER (PARTITION BY atype ORDER BY location) AS n FROM r WHERE k % 6 = 0)""")
def renumber_plan(spark, sf):
    """New ids count on from the largest, by location text."""
    return edit.renumber(_renumber_rows(spark, sf), valid=_number().isNotNull(), number=_number())


@query(f"""WITH {_RENUMBER} SELECT aid, atype, location, atype || '-' || CASE WHEN length(n::VARCHAR) >= 3 THEN n::VARCHAR ELSE lpad(n::VARCHAR, 3, '0') END AS new_id FROM (
  SELECT aid, atype, location, row_number() OVER (PARTITION BY atype ORDER BY location) AS n FROM r)""")
def renumber_force_plan(spark, sf):
    """N1 with force: all ids anew."""
    return edit.renumber(_renumber_rows(spark, sf), valid=_number().isNotNull(), number=_number(), force=True)


@query("""SELECT marker, record, path, block_no, (mx + row_number() OVER (PARTITION BY marker ORDER BY record, path, block_no))::VARCHAR AS new_id FROM (
  SELECT 'M' || (doc_id % 3) AS marker, lang AS record, source AS path, doc_id AS block_no, doc_id % 4 AS r, max(CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE 0 END) OVER (PARTITION BY doc_id % 3) AS mx FROM documents) WHERE r = 2""")
def marker_plan(spark, sf):
    """Marker ids count on from the largest numeric one."""
    k = F.col("doc_id")
    ids = F.when(k % 4 == 0, k.cast("string")).when(k % 4 != 2, F.lit("name"))
    blocks = t.read(spark, sf, "documents").select(F.concat(F.lit("M"), (k % 3).cast("string")).alias("marker"), F.col("lang").alias("record"), F.col("source").alias("path"), k.alias("block_no"), ids.alias("block_id"))
    return edit.renumber_markers(blocks)


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'q' || quality ELSE 'none' END AS value, CASE WHEN l.doc_id IS NOT NULL THEN 'mapped' ELSE 'literal' END AS outcome
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def csv_fill(spark, sf):
    """Values from a mapping, else a literal."""
    mapping = t.read(spark, sf, "labels").select(F.lit(1).alias("line_no"), F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    stale = mapping.select(F.lit(0).alias("line_no"), "id", F.lit("old").alias("value")).unionByName(spark.range(1).select(F.lit(9).alias("line_no"), F.lit("  ").alias("id"), F.lit("x").alias("value")))
    docs = t.read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("aid"), "doc_id")
    return edit.fill_from_mapping(docs, mapping.unionByName(stale), "none").select("doc_id", "value", "outcome")


def _attribute_plan(spark, sf):
    k = F.col("key")
    mapping = t.orders(spark, sf).filter(k % 3 == 0).select(F.lit(1).alias("line_no"), F.col("aid").alias("id"), F.concat(F.lit("o"), k.cast("string")).alias("value"))
    return edit.attribute_plan(t.orders(spark, sf), "add", ["status", "owner"], None, mapping)


_ATTRIBUTE = """a AS (SELECT 'ORD-' || o_orderkey AS aid, name, CASE WHEN name = 'status' THEN o_orderstatus END AS old, CASE WHEN o_orderkey % 3 = 0 THEN 'o' || o_orderkey END AS value,
  CASE WHEN name = 'status' THEN 'keep' WHEN o_orderkey % 3 = 0 THEN 'write' ELSE 'skip' END AS action FROM orders, (VALUES ('status'), ('owner')) v(name))"""


@query(f"WITH {_ATTRIBUTE} SELECT * FROM a")
def attribute_plan(spark, sf):
    """Attributes to add, from a mapping; what is there stays."""
    return _attribute_plan(spark, sf)


@query(f"WITH {_ATTRIBUTE} SELECT count(*) FILTER (WHERE action = 'write') AS modified, count(*) FILTER (WHERE action = 'keep') AS skipped, count(*) FILTER (WHERE action = 'skip') AS unmatched FROM a")
def attribute_summary(spark, sf):
    """F22."""
    return edit.plan_summary(_attribute_plan(spark, sf))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'T-{num:4}' WHEN o_orderkey % 2 = 0 THEN 'ORD-{num}' ELSE '{atype}-{num:3}' END AS schema FROM orders""")
def id_schemas(spark, sf):
    """A template id, else the metamodel's schema, else the default."""
    k = F.col("key")
    template = F.when(k % 5 == 0, "T-{num:4}").otherwise(F.col("aid"))
    return t.orders(spark, sf).select("key", edit.schema_of(template, F.when(k % 2 == 0, F.lit("ORD-{num}"))).alias("schema"))


@query("""SELECT 'P-' || (o_orderkey % 1000) AS aid, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING count(*) > 1""")
def duplicate_valid_ids(spark, sf):
    """valid ids that occur twice, of which renumbering warns."""
    k = F.col("key")
    return edit.duplicate_valid(t.orders(spark, sf).select(F.concat(F.lit("P-"), (k % 1000).cast("string")).alias("aid"), "key"), k % 3 == 0)


@query("""SELECT 'CUS-' || c_custkey AS aid FROM customer WHERE contains(lower('CUS-' || c_custkey), 'build') OR contains(lower(c_name), 'build') OR contains(lower(c_mktsegment), 'build')""")
def search_artifacts(spark, sf):
    """Case-insensitive search over id, type and attributes."""
    return edit.search(t.customers(spark, sf), "BUILD").select("aid")


@query("SELECT doc_id, substr(sha256('DOC:' || source || ':' || text), 1, 8) AS block_id FROM documents")
def block_ids(spark, sf):
    """Stable ids of blocks without one."""
    return t.read(spark, sf, "documents").select("doc_id", edit.block_id(F.lit("DOC"), F.col("source"), F.col("text")).alias("block_id"))


# --- line-oriented text ----------------------------------------------------------------------------------------


@query("""SELECT source AS path, doc_id AS block_no, (1 + coalesce(sum(1 + length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line_no FROM documents""")
def line_numbers(spark, sf):
    """The estimated line of each text block of a file."""
    lines = 1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    blocks = t.read(spark, sf, "documents").select(F.col("source").alias("path"), F.col("doc_id").alias("block_no"), lines.alias("n_lines"))
    return order.running(blocks, ["path"], ["block_no"], line_no=F.col("n_lines")).select("path", "block_no", (1 + F.col("line_no")).cast("long").alias("line_no"))


_FENCED = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
f AS (SELECT doc_id, line_no, CASE WHEN line_no % 7 = 3 THEN '```' WHEN line_no % 5 = 1 THEN '## ' || raw ELSE raw END AS line FROM l),
p AS (SELECT *, coalesce(sum((line LIKE '```%')::INT) OVER (PARTITION BY doc_id ORDER BY line_no), 0) AS fences FROM f)"""


def _fenced(spark, sf):
    from threadloom.functions.lines import numbered_lines, with_fences

    rows = numbered_lines(t.read(spark, sf, "documents").select("doc_id", "text"), "text")
    n = F.col("line_no")
    return with_fences(rows.withColumn("line", F.when(n % 7 == 3, "```").when(n % 5 == 1, F.concat(F.lit("## "), F.col("line"))).otherwise(F.col("line"))), "doc_id")


@query(f"WITH {_FENCED} SELECT doc_id, count(*) FILTER (WHERE fences % 2 = 1 OR line LIKE '```%') AS n_fenced, count(*) AS n_lines FROM p GROUP BY 1")
def fence_parity(spark, sf):
    """Lines inside code fences."""
    return _fenced(spark, sf).groupBy("doc_id").agg(F.count(F.when(F.col("fenced"), 1)).alias("n_fenced"), F.count(F.lit(1)).alias("n_lines"))


@query(f"WITH {_FENCED} SELECT doc_id, line_no, sha256(line) AS line_sha256 FROM p WHERE fences % 2 = 0 AND line NOT LIKE '```%' AND regexp_matches(line, '^ {{0,3}}#{{1,6}}\\s')")
def heading_lines(spark, sf):
    """Headings outside code fences."""
    return _fenced(spark, sf).filter(~F.col("fenced") & F.col("line").rlike(r"^ {0,3}#{1,6}\s")).select("doc_id", "line_no", F.sha2("line", 256).alias("line_sha256"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'markdown' ELSE 'code' END AS kind, length(text) AS n_chars FROM conversations""")
def notebook_cells(spark, sf):
    """Notebooks made of conversations, written as JSON and read back cell by cell."""
    from threadloom.sources.notebook import cells

    cell = F.struct(F.when(F.col("role") == "user", "markdown").otherwise("code").alias("cell_type"), F.coalesce("text", F.lit("")).alias("source"))
    made = t.read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), "turn", cell.alias("c"), F.col("text").isNull().alias("gone"))
    books = made.groupBy("path").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("turn", "c"))), lambda x: x["c"]).alias("cells"))).alias("value"), F.array_sort(F.collect_list(F.struct("turn", "gone"))).alias("turns"))
    out = cells(books)
    return out.select(F.col("path").cast("long").alias("conv_id"), F.get("turns", F.col("cell"))["turn"].alias("turn"), F.col("cell_type").alias("kind"), F.when(~F.get("turns", F.col("cell"))["gone"], F.length("source")).alias("n_chars"))


@query("""SELECT 'ORD-' || o_orderkey AS aid, 'ORD' AS atype, 'CUS-' || o_custkey AS parent, o_orderstatus AS status, 'Order of ' || o_orderpriority AS contents,
  CASE WHEN o_orderkey % 3 = 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 'On' ELSE 'off' END END AS active FROM orders""")
def roundtrip_scan(spark, sf):
    """Orders rendered as marked blocks, 50 to a file, scanned back into artifacts."""
    from threadloom.sources.scan import scan_markdown

    o = t.read(spark, sf, "orders")
    block = F.concat(
        F.lit("Some text before.\n\n[ORD]\nOrder of "), F.col("o_orderpriority"), F.lit("\n[id] ORD-"), F.col("o_orderkey").cast("string"), F.lit("\n[parent] CUS-"), F.col("o_custkey").cast("string"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("\n[status] "), F.col("o_orderstatus"), F.lit("\n[/ORD]\n")))
        .when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("\n```yaml\nattrs:\n  status: "), F.col("o_orderstatus"), F.lit("\n  active: "), (F.col("o_custkey") % 2 == 0).cast("string"), F.lit("\n```\n")))
        .otherwise(F.concat(F.lit("\n[status] "), F.col("o_orderstatus"), F.lit("\n\n"))),
    )
    files = o.groupBy(F.floor(F.col("o_orderkey") / 50).alias("f")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))
    blocks = scan_markdown(files.select(F.lit("orders").alias("record"), F.concat(F.lit("f"), F.col("f").cast("string"), F.lit(".md")).alias("path"), "value"), marker="ORD", atype="ORD", labels={("ORD", "active"): ("On", "off")})
    value = lambda n: F.col("fields")[n]["vals"][0].alias(n)
    return blocks.filter("kind = 'artifact'").select("aid", "atype", value("parent"), value("status"), value("contents"), value("active"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'NOTE' ELSE 'COM' END AS marker, CASE WHEN o_orderkey % 3 = 0 THEN 'n.' || o_custkey END AS block_id,
  CASE o_orderkey % 3 WHEN 0 THEN ' closed ' || o_orderkey || chr(10) || chr(10) || o_orderpriority || ' ' WHEN 1 THEN 'open ' || o_orderkey || chr(10) || o_orderpriority
  ELSE 'lead ' || o_orderkey || ' [REM] ' || o_orderpriority END AS content FROM orders""")
def marked_fragments(spark, sf):
    """Orders as closed fragments with ids, open ones before a blank line and open ones before a heading, 40 to a file, scanned back."""
    from threadloom.sources.scan import scan_markdown

    def text(x):
        k, p = x["o_orderkey"], x["o_orderpriority"]
        return (
            F.when(k % 3 == 0, F.concat(F.lit("Before. [Note n."), x["o_custkey"].cast("string"), F.lit("] closed "), k.cast("string"), F.lit("\n\n"), p, F.lit(" [/NOTE] after\n\n")))
            .when(k % 3 == 1, F.concat(F.lit("[COM] open "), k.cast("string"), F.lit("\n"), p, F.lit("\n \nplain text\n")))
            .otherwise(F.concat(F.lit("[com]lead "), k.cast("string"), F.lit(" [REM] "), p, F.lit("\n## Heading\n")))
        )

    # the keys are gathered and made text afterwards: less to sort and to shuffle
    held = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey", "o_orderpriority")))
    files = t.read(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 40).alias("f")).agg(F.array_join(F.transform(held, text), "\n").alias("value"))
    blocks = scan_markdown(files.select(F.lit("notes").alias("record"), F.concat(F.col("f").cast("string"), F.lit(".md")).alias("path"), "value"), marker="ORD", atype="ORD", fragments=("NOTE", "COM", "REM"))
    marked = blocks.filter("marker in ('NOTE', 'COM', 'REM')")
    return marked.select(F.regexp_extract("content", r"^\s*\w+ (\d+)", 1).cast("long").alias("o_orderkey"), "marker", "block_id", "content")


# --- ranges, images, headings, text functions ----------------------------------------------------------------------


@query(f"""WITH {LIN} SELECT aid, true AS outdated FROM lin JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate
UNION ALL SELECT DISTINCT p, false FROM (SELECT l_orderkey, l_partkey, l_suppkey, o_custkey FROM lin JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate > l_shipdate) x
  JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation m ON m.n_nationkey = s_nationkey,
  LATERAL (VALUES ('ORD-' || l_orderkey), ('PRT-' || l_partkey), ('SUP-' || l_suppkey), ('CUS-' || o_custkey), ('NTN-' || n.n_nationkey), ('NTN-' || m.n_nationkey), ('RGN-' || n.n_regionkey), ('RGN-' || m.n_regionkey)) v(p)""")
def suspicious_subtree(spark, sf):
    """Stale lines and everything above them."""
    first = t.first_lines(spark, sf)
    latest = first.select("aid", "ts").unionByName(t.orders(spark, sf).select("aid", "ts"))
    stale = impact.stale_by_time(first.select(F.col("aid").alias("child_id"), F.col("parent").alias("pid")), latest)
    return graph.suspicious_nodes(t.hierarchy_links(spark, sf, deep=True), stale)


@query("""SELECT DISTINCT 'CUS-' || c_custkey AS aid, sha256(event_type || (e.event_id % 40)) AS hash_long FROM customer JOIN events e
ON e.event_id % 20 = c_custkey % 20 AND e.event_id BETWEEN c_custkey * 3 AND c_custkey * 3 + 60""")
def blame_ranges(spark, sf):
    """Commits of the lines that an artifact spans."""
    from threadloom.sources.history import revisions

    key = F.col("c_custkey")
    spans = t.read(spark, sf, "customer").select(
        t.make_id("CUS", "c_custkey").alias("aid"), F.struct(F.concat(F.lit("f"), (key % 20).cast("string")).alias("file"), (key * 3).cast("int").alias("line_start"), (key * 3 + 60).cast("int").alias("line_end")).alias("loc")
    )
    digest = F.sha2(F.concat("event_type", (F.col("event_id") % 40).cast("string")), 256)
    lines = t.read(spark, sf, "events").select(F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string")).alias("path"), F.col("event_id").alias("first"), F.col("event_id").alias("last"), digest.alias("hash_long"), F.substring(digest, 1, 7).alias("hash_short"), "ts", F.col("event_type").alias("author_email"))
    return revisions(spans, lines).select("aid", "hash_long")


@query("""WITH f AS (SELECT CASE WHEN p_size % 5 = 0 THEN 'att/' ELSE p_brand || '/' END || p_partkey || '/' || 'img' || (p_partkey % 300) || '.png' AS path, p_size % 5 = 0 AS preferred, 'img' || (p_partkey % 300) || '.png' AS name FROM part)
SELECT name, path FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY preferred DESC, path) AS k FROM f) WHERE k = 1 AND name <> 'img7.png'""")
def image_resolution(spark, sf):
    """The file that an image name means."""
    from threadloom.sources.files import first_match

    key = F.col("p_partkey")
    name = F.concat(F.lit("img"), (key % 300).cast("string"), F.lit(".png"))
    inside = F.col("p_size") % 5 == 0
    files = t.read(spark, sf, "part").select(F.concat_ws("/", F.when(inside, "att").otherwise(F.col("p_brand")), key.cast("string"), name).alias("path"), inside.alias("preferred"))
    wanted = t.read(spark, sf, "part").select(name.alias("name")).filter("name != 'img7.png'")
    return first_match(wanted, files)


@query("SELECT 'M' || (doc_id % 3) AS marker, 'b' || (doc_id % 300) AS block_id, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_block_ids(spark, sf):
    """Explicit block ids that occur twice in the project."""
    from threadloom.plans.publish import duplicate_block_ids as found

    k = F.col("doc_id")
    return found(t.read(spark, sf, "documents").select(F.concat(F.lit("M"), (k % 3).cast("string")).alias("marker"), F.concat(F.lit("b"), (k % 300).cast("string")).alias("block_id"), (k % 2 == 0).alias("explicit_id")))


@query("""WITH f AS (SELECT DISTINCT lang AS record, source, (doc_id % 4)::VARCHAR AS leaf FROM documents),
g AS (SELECT record, '1. ' || source || '/' || leaf || '. part.md' AS path, source, leaf FROM f),
h AS (SELECT *, lag('1. ' || source) OVER (PARTITION BY record ORDER BY path) AS before FROM g)
SELECT record, path, CASE WHEN before IS DISTINCT FROM '1. ' || source THEN '# ' || source || chr(10) || chr(10) ELSE '' END || '## part' || chr(10) || chr(10) AS heading FROM h""")
def path_headings(spark, sf):
    """Heading lines where a path leaves the one before it."""
    from threadloom.plans.publish import path_headings as headings
    from threadloom.sources.config import Publish

    path = F.concat(F.lit("1. "), F.col("source"), F.lit("/"), (F.col("doc_id") % 4).cast("string"), F.lit(". part.md"))
    return headings(t.read(spark, sf, "documents").select(F.col("lang").alias("record"), path.alias("path")), Publish()).select("record", "path", "heading")


@query(r"""SELECT page_id, translate(url, '/\:*?"<>|', '---------') AS file_name, replace(replace(url, '|', '\|'), chr(10), '<br>') AS cell,
  CASE WHEN page_id % 3 = 0 THEN 'line ' || page_id ELSE 'lines ' || page_id || '–' || (page_id + page_id % 3) END AS lines,
  CASE WHEN length(page_id::VARCHAR) >= 3 THEN 'P-' || page_id ELSE 'P-' || lpad(page_id::VARCHAR, 3, '0') END AS numbered,
  CASE WHEN length(url) > 40 THEN substr(url, 1, 40) || '...' ELSE url END AS short FROM pages""")
def text_functions(spark, sf):
    """Text functions on page addresses."""
    from threadloom.functions import lines

    k = F.col("page_id")
    return t.read(spark, sf, "pages").select(
        "page_id", lines.file_name(F.col("url")).alias("file_name"), lines.table_cell(F.col("url")).alias("cell"), lines.lines_text(k, k + k % 3).alias("lines"),
        model.numbered_id(F.lit("P-"), k).alias("numbered"), lines.short(F.col("url"), 40).alias("short"),
    )


@query(r"""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Title ' || page_id WHEN page_id % 4 = 3 THEN 'nd part' ELSE 'Title' END AS stripped,
  repeat('#', least(6, 1 + page_id % 6 + page_id % 3)::INT) || ' Head' AS shifted, 'no head' AS plain, replace(replace(url, '<', '&lt;'), '>', '&gt;') AS escaped FROM (SELECT page_id, url || '<b>' AS url FROM pages)""")
def heading_functions(spark, sf):
    """Numbers off headings, deeper headings, angle brackets as entities."""
    from threadloom.functions import lines
    from threadloom.plans.report import escape_html

    k = F.col("page_id")
    number = F.when(k % 4 == 0, F.lit("")).when(k % 4 == 1, F.concat(F.lit("1.2."), k.cast("string"), F.lit(" "))).otherwise(F.concat(k.cast("string"), F.lit("- ")))
    title = F.when(k % 4 == 3, F.lit("2nd part")).otherwise(F.concat(number, F.when(k % 4 == 0, F.concat(F.lit("Title "), k.cast("string"))).otherwise("Title")))
    head = F.concat(F.repeat(F.lit("#"), (1 + k % 6).cast("int")), F.lit(" Head"))
    return t.read(spark, sf, "pages").select(
        "page_id", lines.strip_number(title).alias("stripped"), lines.shift_heading(head, (k % 3).cast("int")).alias("shifted"), lines.shift_heading(F.lit("no head"), F.lit(2)).alias("plain"),
        escape_html(F.concat("url", F.lit("<b>"))).alias("escaped"),
    )


@query(rf"""WITH {_FENCED}, q AS (SELECT *, (fences % 2 = 1 OR line LIKE '```%') AS fenced, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS follow FROM p)
SELECT doc_id, count(*) AS n_soft FROM q WHERE NOT fenced AND trim(line) <> '' AND follow IS NOT NULL AND trim(follow) <> ''
  AND NOT regexp_matches(line, '^\s*(#{{1,6}}\s|[-*+]\s|\d+[.)]\s|>|\||```|~~~|(-{{3,}}|\*{{3,}}|_{{3,}})\s*$)') AND NOT regexp_matches(line, '( {{2,}}|\\)$') GROUP BY 1""")
def soft_breaks(spark, sf):
    """Lines that get a hard break."""
    from threadloom.functions.lines import soft_breaks as broken

    before = _fenced(spark, sf)
    after = broken(before.withColumn("old", F.col("line")), "doc_id")
    return after.filter("line != old").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_soft"))


@query("SELECT 'ORD-' || o_orderkey AS aid FROM orders ORDER BY 1 LIMIT 10")
def first_ids(spark, sf):
    """H6: the first ten ids that a lookup offers (the limit is the feature)."""
    return t.orders(spark, sf).select("aid").orderBy("aid").limit(10)
