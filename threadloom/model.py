"""Physical schemas of the engine's relations and helpers for the dynamic attribute map."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUE = "struct<is_list:boolean,vals:array<string>>"
LOCATION = "struct<kind:string,file:string,sidecar:string,line_start:int,line_end:int,cell:int>"

ARTIFACTS = f"seq long, record string, driver string, atype string, aid string, loc {LOCATION}, fields map<string,{VALUE}>"
LINKS = "child_id string, pos int, pid string, nominal_revision string"
REVISIONS = "aid string, hash_long string, hash_short string, ts timestamp, author_email string"
BLOCKS = (
    "record string, path string, block_no long, kind string, content string, marker string, block_id string, explicit_id boolean, "
    f"source_offset int, message string, raw_text string, atype string, aid string, loc {LOCATION}, fields map<string,{VALUE}>"
)
ATTR_RULES = (
    "atype string, attr string, rule_no int, presence string, multiple boolean, type string, allowed array<string>, true_vals array<string>, "
    "false_vals array<string>, to_parent boolean, id_schema string, cond_anchor string, cond_negated boolean, cond_true array<string>"
)
TRACE_RULES = "source string, rule_no int, targets array<string>, presence string, mode string, cond_anchor string, cond_negated boolean, cond_true array<string>"
VIOLATIONS = "code string, message string, category string, input_record string, artifact_id string, artifact_type string, file_path string, line_start int, line_end int"

#: Labels of truth and falsehood of booleans that name none of their own.
TRUE, FALSE = ["true", "yes", "1"], ["false", "no", "0"]
UNDEFINED = "<undefined>"
ROOT = "ROOT"
DEPTH_LIMIT = 20


def schema(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def scalar(value: Column) -> Column:
    """A single-valued attribute; null when the value is null."""
    return F.when(value.isNotNull(), F.struct(F.lit(False).alias("is_list"), F.array(value.cast("string")).alias("vals"))).cast(VALUE)


def listed(values: Column) -> Column:
    """A list-valued attribute."""
    return F.struct(F.lit(True).alias("is_list"), values.cast("array<string>").alias("vals")).cast(VALUE)


def fields(**named: Column) -> Column:
    """An attribute map without its null entries."""
    pairs = [x for name, value in named.items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def vals(name: str, of: str = "fields") -> Column:
    """All values of an attribute; null when it is missing."""
    return F.col(of)[name]["vals"]


def attribute(name: str, of: str = "fields") -> Column:
    """An attribute as exported text: list items joined by ``; ``, missing as empty."""
    return F.coalesce(F.array_join(vals(name, of), "; "), F.lit(""))


def location_text(loc: Column) -> Column:
    """How a location is shown: file, file:lines or file:lines#cell."""
    lines = F.concat_ws("-", loc["line_start"].cast("string"), loc["line_end"].cast("string"))
    return (
        F.when(loc["cell"].isNotNull(), F.concat(loc["file"], F.lit("#cell"), loc["cell"].cast("string"), F.lit(":"), lines))
        .when(loc["line_start"].isNotNull(), F.concat(loc["file"], F.lit(":"), lines)).otherwise(loc["file"])
    )


#: What Python's ``int`` accepts.
INTEGER = r"^\s*[+-]?\d+(_\d+)*\s*$"


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not spaces alone."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def split_list(c: Column, keep_blank: bool = False) -> Column:
    """Items of a comma list, trimmed."""
    items = F.transform(F.split(c, ",", -1), lambda x: F.trim(x))
    return items if keep_blank else F.filter(items, lambda x: x != "")


def link_target(c: Column) -> Column:
    return F.trim(F.substring_index(c, "@", 1))


def link_revision(c: Column) -> Column:
    """What follows the first ``@``; null without it or when empty."""
    rest = F.when(F.instr(c, "@") > 0, F.trim(F.regexp_replace(c, "^[^@]*@", "")))
    return F.when(rest != "", rest)


def condition(anchor: Column, negated: Column, labels: Column, of: str = "fields") -> Column:
    """Whether a rule's condition holds on a row; no anchor always holds. ``labels`` are the anchor's own labels of truth, in lower case."""
    value = F.element_at(F.col(of), anchor)
    first = F.element_at(value["vals"], 1)
    named = F.array_contains(F.coalesce(labels, F.array(*[F.lit(x) for x in TRUE])), F.lower(first)) & (strip(first) != "")
    truth = F.when(value.isNull(), False).when(value["is_list"], F.size(value["vals"]) > 0).otherwise(F.coalesce(named, F.lit(False)))
    return F.when(anchor.isNull(), F.lit(True)).otherwise(F.when(negated, ~truth).otherwise(truth))


def numbered_id(prefix: Column, number: Column, width: int = 3) -> Column:
    """``prefix`` and a zero-padded number that is never cut."""
    n = number.cast("string")
    return F.concat(prefix, F.when(F.length(n) >= width, n).otherwise(F.lpad(n, width, "0")))


def attribute_any_case(name: str, of: str = "fields") -> Column:
    """An attribute by its name in any case, items joined by ``, ``; of names that differ in case only, the last one counts; blank is null."""
    hits = F.filter(F.map_entries(of), lambda e: F.lower(e["key"]) == name.lower())
    text = F.array_join(F.element_at(hits, -1)["value"]["vals"], ", ")
    return F.when(F.size(hits) > 0, F.when(F.trim(text) != "", text))
