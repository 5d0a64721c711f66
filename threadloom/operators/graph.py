"""Edges, top-level nodes, bounded ancestor closure and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import scratch
from threadloom.model import DEPTH_LIMIT, link_revision, link_target, split_list
from threadloom.operators.order import running


def parent_links(artifacts: DataFrame, parent_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of ``reference to parent`` attributes, and the conflicting ones.

    Values are split at commas, the part after ``@`` is a nominal revision, and
    the first link of a (child, parent) wins; a later one with another revision
    is a conflict.
    """
    rows = artifacts.join(F.broadcast(parent_rules.filter("to_parent").select("atype", "attr", "rule_no").dropDuplicates(["atype", "attr"])), "atype")
    values = rows.select(F.col("aid").alias("child_id"), "rule_no", F.posexplode(F.col("fields")[F.col("attr")]["vals"]).alias("p", "v"))
    items = values.select("child_id", "rule_no", "p", F.posexplode(split_list(F.col("v"))).alias("q", "item"))
    refs = items.select("child_id", "rule_no", "p", "q", link_target(F.col("item")).alias("pid"), link_revision(F.col("item")).alias("nominal_revision"))
    order = Window.partitionBy("child_id", "pid").orderBy("rule_no", "p", "q")
    ranked = refs.withColumn("k", F.row_number().over(order)).withColumn("first", F.first(F.struct("nominal_revision")).over(order))
    conflicts = ranked.filter("k > 1").filter(~F.col("nominal_revision").eqNullSafe(F.col("first.nominal_revision"))).select("child_id", "pid", "nominal_revision")
    position = F.row_number().over(Window.partitionBy("child_id").orderBy("rule_no", "p", "q")) - 1
    links = ranked.filter("k = 1").withColumn("pos", position).select("child_id", "pos", "pid", "nominal_revision")
    return links, conflicts


def top_level(artifacts: DataFrame, links: DataFrame, suppress_tracing: bool = False) -> DataFrame:
    """Artifacts without a parent; with ``suppress_tracing`` also those whose parents are all unresolved."""
    if suppress_tracing:
        links = links.join(artifacts.select(F.col("aid").alias("pid")), "pid", "left_semi")
    return artifacts.join(links.select(F.col("child_id").alias("aid")), "aid", "left_anti")


def children_index(links: DataFrame) -> DataFrame:
    """(pid, n_children, children) with children sorted."""
    return links.select("pid", "child_id").distinct().groupBy("pid").agg(F.count(F.lit(1)).alias("n_children"), F.array_join(F.array_sort(F.collect_list("child_id")), ";").alias("children"))


def closure(links: DataFrame, limit: int = DEPTH_LIMIT) -> DataFrame:
    """(anc_id, desc_id, depth) of all ancestor pairs, with the least depth, up to ``limit`` edges.

    Doubling: from all least walks of up to k edges those of up to 2k follow, each cut behind its first
    k edges, so that only the walks of exactly k edges are prolonged: 5 rounds for 20 edges, and one more
    than the hierarchy's depth needs. Cycles end and diamonds stay polynomial."""
    edges = links.select(F.col("pid").alias("anc_id"), F.col("child_id").alias("desc_id")).distinct()
    found = scratch.table(edges.withColumn("depth", F.lit(1)), "pairs")
    reach = 1
    while reach < limit:
        rim = found.filter(F.col("depth") == reach).select("anc_id", F.col("desc_id").alias("__mid"))
        if rim.isEmpty():
            break
        on = found.filter(F.col("depth") <= limit - reach).select(F.col("anc_id").alias("__mid"), "desc_id", (F.col("depth") + reach).alias("depth"))
        longer = rim.join(on, "__mid").groupBy("anc_id", "desc_id").agg(F.min("depth").alias("depth"))
        fresh = scratch.table(longer.join(found.select("anc_id", "desc_id"), ["anc_id", "desc_id"], "left_anti"), "pairs")
        found = found.unionByName(fresh)
        reach = min(2 * reach, limit)
    return found


def too_deep(links: DataFrame, limit: int = DEPTH_LIMIT) -> DataFrame:
    """(start): nodes from which a walk of more than ``limit`` edges towards the parents exists, cycles included."""
    edges = scratch.table(links.select("child_id", "pid").distinct(), "edges")
    alive = edges.select(F.col("child_id").alias("start")).distinct()
    for i in range(limit):  # the start of a walk of i + 1 edges is a child whose parent starts one of i edges
        alive = edges.join(alive.withColumnRenamed("start", "pid"), "pid", "left_semi").select(F.col("child_id").alias("start")).distinct()
        if i % 5 == 4:
            alive = scratch.table(alive, "walks")
            if alive.isEmpty():  # most hierarchies end here
                break
    return alive


def tree_paths(links: DataFrame, tops: DataFrame, limit: int = DEPTH_LIMIT) -> DataFrame:
    """(path, aid, depth) of every node under the top-level nodes; ``path`` sorts the tree."""
    edges = links.select(F.col("pid").alias("__p"), F.col("child_id").alias("__c")).distinct()
    level = tops.select(F.col("aid").alias("path"), "aid", F.lit(0).alias("depth"))
    out = level
    for depth in range(1, limit + 1):
        level = scratch.table(level.join(edges, F.col("aid") == F.col("__p")).select(F.concat_ws("/", "path", "__c").alias("path"), F.col("__c").alias("aid"), F.lit(depth).alias("depth")), "paths")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


#: Lines from which on a subtree counts as one of so many.
_MANY = 10**28


def subtree_lines(edges: DataFrame, limit: int = DEPTH_LIMIT) -> list[DataFrame]:
    """(__n, lines) of the nodes with children, for 0, 1, ... levels below: how many lines a tree under the node has.

    The list ends at the height of the graph; deeper ones are equal. Shared subtrees are counted once per level, not once per path."""
    parents = edges.select(F.col("pid").alias("__n")).distinct()
    out = [scratch.table(parents.withColumn("lines", F.lit(1).cast("decimal(29,0)")), "sizes")]
    for _ in range(limit):
        below = edges.join(out[-1].withColumnRenamed("__n", "child_id"), "child_id", "left")
        total = F.least(F.sum(F.coalesce("lines", F.lit(1).cast("decimal(29,0)"))) + 1, F.lit(str(_MANY)).cast("decimal(29,0)"))
        now = scratch.table(below.groupBy(F.col("pid").alias("__n")).agg(total.cast("decimal(29,0)").alias("lines")), "sizes")
        changed = now.join(out[-1].withColumnRenamed("lines", "__old"), "__n").filter("lines != __old")
        if changed.isEmpty():
            break
        out.append(now)
    return out


def _placed(rows: DataFrame, group: list[str], most: int = 100_000) -> DataFrame:
    """``rows`` with the lines of the siblings before each; many siblings are summed by ranges."""
    kept = scratch.table(rows, "siblings")
    if kept.count() > most:
        return running(kept, group, ["aid"], before=F.col("lines"))
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("aid").rowsBetween(Window.unboundedPreceding, -1)
    return kept.withColumn("before", F.coalesce(F.sum("lines").over(earlier), F.lit(0)))


def first_lines(links: DataFrame, tops: DataFrame, n: int, limit: int = DEPTH_LIMIT) -> tuple[DataFrame, int]:
    """The first ``n`` lines of the tree under the top-level nodes, as (line_no, aid, depth, line), and how many lines it has.

    Sizes of subtrees tell where the line of each node stands, so that of each level only the nodes among the first ``n``
    lines are made: the work follows ``n`` and the edges, not the paths, of which diamonds have exponentially many."""
    edges = scratch.table(links.select("pid", "child_id").distinct(), "edges")
    sizes = subtree_lines(edges, limit)
    one = F.lit(1).cast("decimal(29,0)")
    sized = lambda rows, room: rows.join(sizes[min(room, len(sizes) - 1)], F.col("aid") == F.col("__n"), "left").withColumn("lines", F.coalesce("lines", one)).drop("__n")
    roots = sized(tops.select("aid").distinct(), limit)
    total = int(roots.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0])
    level = _placed(roots, []).select(F.col("before").alias("line_no"), "aid", F.lit(0).alias("depth"), F.col("aid").alias("line"), F.lit("").alias("bars"))
    level = scratch.table(level.filter(F.col("line_no") < n), "lines")
    lasts = edges.groupBy(F.col("pid").alias("__l")).agg(F.max("child_id").alias("__last"))
    out = level
    for depth in range(1, limit + 1):
        above = F.broadcast(level) if n <= 100_000 else level
        above = above.select(F.col("line_no").alias("__up"), F.col("aid").alias("__p"), "bars")
        below = edges.join(above, F.col("pid") == F.col("__p")).join(lasts, F.col("pid") == F.col("__l"))
        rows = sized(below.select("__up", "bars", F.col("child_id").alias("aid"), (F.col("child_id") == F.col("__last")).alias("last")), limit - depth)
        placed = _placed(rows, ["__up"]).withColumn("line_no", (F.col("__up") + 1 + F.col("before")).cast("decimal(38,0)")).filter(F.col("line_no") < n)
        level = scratch.table(
            placed.select(
                "line_no", "aid", F.lit(depth).alias("depth"), F.concat("bars", F.when(F.col("last"), "└── ").otherwise("├── "), "aid").alias("line"), F.concat("bars", F.when(F.col("last"), "    ").otherwise("│   ")).alias("bars")
            ),
            "lines",
        )
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select(F.col("line_no").cast("long").alias("line_no"), "aid", "depth", "line"), total


def suspicious_nodes(links: DataFrame, stale_children: DataFrame, limit: int = DEPTH_LIMIT) -> DataFrame:
    """(aid, outdated): the nodes that a pruned tree keeps: stale children (outdated) and all their ancestors."""
    edges = scratch.table(links.select("child_id", "pid").distinct(), "edges")
    level = scratch.table(stale_children.select(F.col("child_id").alias("aid")).distinct(), "nodes")
    found = level
    for _ in range(limit):
        up = level.join(edges, F.col("aid") == F.col("child_id")).select(F.col("pid").alias("aid")).distinct()
        level = scratch.table(up.join(found, "aid", "left_anti"), "nodes")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    marked = stale_children.select(F.col("child_id").alias("aid")).distinct().withColumn("outdated", F.lit(True))
    return found.join(marked, "aid", "left").withColumn("outdated", F.coalesce("outdated", F.lit(False)))
