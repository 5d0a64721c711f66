"""Conversation structure repair: the cheapest edits to a legal order of roles, by Dijkstra on an implicit lattice.

A conversation is legal if its roles' initials read ``(s?(ua)+)?``. Its rows, in
order of turn, are edited: Keep (0), Rerole to user or assistant (3), Delete (4;
blank and repeated rows must go), Insert an empty user or assistant row (3); a
truncated row that stays costs 3 more. A node of the lattice is (rows used, state
of the grammar); nothing of it is built in advance. The queue is ordered by (cost,
audit), the audit being the initials of the edits so far, and the first accepting
end node that is popped gives the cheapest edits, the least audit among equals:
as cost follows from rows and audit, no audit of a node's queue entries of one
cost begins with another, so that appending an edit keeps their order.

Conversations stream through tasks sorted by (id, turn), one at a time. Those
over ``LONG`` rows or ``LONG_BYTES`` take another way to the same result: rows are
numbered in ranges, cut into segments of ``SEGMENT`` rows, each segment is solved
from every state to every state, and the segments' answers, of some letters a row
and without texts, are joined in order; edits go back to the rows by a join.

Edge cases: null roles and texts count as one space; null turns come first; rows
of one turn are ordered by role and text; a null id is a conversation of its own;
rows equal in all columns are duplicates, the first stays; a conversation without
rows, or of which all rows go, has no repaired rows; an empty table gives an empty
result; other columns are dropped, whatever their names. One conversation's audit
is one value, and its digest one pass over its rows in one task.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm import store
from threadloom.operators import order

LONG, LONG_BYTES, SEGMENT = 2048, 32_000_000, 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after the system row, after a user row, after an assistant row; the first and the last accept.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPT = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
_NO_SPACE = r"[^\x20\x09-\x0D]"
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = [x.split()[0] for x in _SUMMARY.split(", ")]


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with the faults that the hash of ``conv_id:turn`` picks: rows gone, emptied, without sentence ends, repeated, of another role."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    staged = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind != 0")
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return staged.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("__n")).drop("__n")


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))


def _sign(text: Column, initial: Column) -> Column:
    """A row as the lattice sees it: ``b`` for a blank one, else its initial, as a capital if it is truncated; ``d`` is for repeated ones."""
    last = F.regexp_extract(text, _NO_SPACE + r"(?=[\x20\x09-\x0D]*\z)", 0)
    return F.when(last == "", F.lit("b")).when(last.isin(".", "!", "?"), F.lower(initial)).otherwise(F.upper(initial))


def _steps(signs: str, i: int, state: int) -> Iterator[tuple[int, str, int, int]]:
    """(cost, edit, rows used, state) of every edge of a node."""
    for role in ROLES:
        if (state, role) in NEXT:
            yield INSERT, "I", i, NEXT[state, role]
    if i == len(signs):
        return
    yield DELETE, "D", i + 1, state
    if signs[i] in "bd":
        return
    more = TRUNCATED * signs[i].isupper()
    if (state, signs[i].lower()) in NEXT:
        yield KEEP + more, "K", i + 1, NEXT[state, signs[i].lower()]
    for role in ROLES:
        if (state, role) in NEXT:
            yield REROLE + more, "R", i + 1, NEXT[state, role]


def search(signs: str, start: int, goals: tuple[int, ...], every: bool) -> dict[int, tuple[int, str]]:
    """(cost, audit) at the first end node popped among the goals, or at each of them."""
    queue, done, found = [(0, "", 0, start)], set(), {}
    while queue:
        cost, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(signs) and state in goals:
            found[state] = (cost, audit)
            if not every or len(found) == len(goals):
                break
        for more, edit, j, to in _steps(signs, i, state):
            if (j, to) not in done:
                heapq.heappush(queue, (cost + more, audit + edit, j, to))
    return found


@lru_cache(100_000)
def _cheapest(signs: str) -> tuple[int, str]:
    return next(iter(search(signs, START, ACCEPT, False).values()))


def cheapest(signs: str) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    return _cheapest(signs) if len(signs) <= 64 else _cheapest.__wrapped__(signs)


def follow(signs: str, audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, row or None, new role or None) of an audit; from a state, an audit leaves no choice of roles."""
    i = 0
    for edit in audit:
        role = None
        if edit == "K":
            state = NEXT[state, signs[i].lower()]
        elif edit in "RI":
            initial = next(r for r in ROLES if (state, r) in NEXT)
            role, state = ROLES[initial], NEXT[state, initial]
        yield edit, None if edit == "I" else i, role
        i += edit != "I"


def _schema(kind: str) -> str:
    return f"conv_id {kind}, place long, edit string, role string, text string, {_SUMMARY}"


class _Out:
    """Rows of the result, gathered by column."""

    def __init__(self, fields: pa.Schema):
        self.fields, self.columns = fields, {n: [] for n in fields.names}

    def add(self, **row) -> None:
        for n, c in self.columns.items():
            c.append(row.get(n))

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict(self.columns, schema=self.fields)
        self.columns = {n: [] for n in self.fields.names}
        return out

    def __len__(self) -> int:
        return len(next(iter(self.columns.values())))


_NUMBER = {"place": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string(), **{c: pa.int64() for c in _COUNTS}, "audit": pa.string()}


def _fields(conv_id: pa.DataType, names: list[str]) -> pa.Schema:
    return pa.schema([("conv_id", conv_id), *((n, _NUMBER.get(n, pa.int64())) for n in names)])


def _grouped(batches: Iterator[pa.RecordBatch], held: list) -> Iterator[tuple[object, list[tuple]]]:
    """Rows of each run of equal ids; ``held`` gets the type of the id."""
    key, rows = None, []
    for batch in batches:
        held[:] = [batch.schema.field(0).type]
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _repair_short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, kind, size = None, [], 0
    for conv_id, rows in _grouped(batches, kind):
        out = out or _Out(_fields(kind[0], ["place", "edit", "role", "text", *_COUNTS]))
        seen, signs = set(), []
        for _, _, role, text, _, sign in rows:
            signs.append("d" if sign != "b" and (role, text) in seen else sign)
            seen.add((role, text))
            size += len(text)
        signs, turns = "".join(signs), {r[1] for r in rows} - {None}
        cost, audit = cheapest(signs)
        out.add(
            conv_id=conv_id, place=-1, gaps=max(turns) - min(turns) + 1 - len(turns) if turns else 0, blank=signs.count("b"), duplicate=signs.count("d"),
            truncated=sum(c.isupper() for c in signs), illegal=illegal("".join(r[4] for r in rows)), cost=cost, audit=audit,
        )
        for place, (edit, i, role) in enumerate(follow(signs, audit, START)):
            _, _, own, text, _, _ = rows[i] if i is not None else (None, None, None, "", None, None)
            out.add(conv_id=conv_id, place=place, edit=edit, role=role or own, text=text)
        if len(out) > 20_000 or size > 4_000_000:
            yield out.batch()
            size = 0
    if out:
        yield out.batch()


def _solve(signs: pa.Array) -> pa.Array:
    """For each segment its (start, end, cost, audit) for all pairs of states that some edits connect."""
    found = [[(s, e, *x) for s in range(4) for e, x in search(g, s, tuple(range(4)), True).items()] for g in signs.to_pylist()]
    each = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    return pa.array([[dict(zip(("start", "end", "cost", "audit"), x)) for x in f] for f in found], pa.list_(each))


def _earlier(a: tuple, b: tuple) -> bool:
    """Whether the path ``a`` comes before ``b``: (cost, (path so far, start, piece)); equal costs by the audits, read from where they part."""
    if a[0] != b[0]:
        return a[0] < b[0]
    x, y, left, right = a[1], b[1], [], []
    while x is not y:  # paths that are compared have as many pieces
        left.append(x[2]), right.append(y[2])
        x, y = x[0], y[0]
    return "".join(reversed(left)) < "".join(reversed(right))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each conversation, in order, to the state that each begins in and its piece of the audit; and one row (segment -1) for the whole."""
    kind, out, now = [], None, None
    names = ["segment", "start", "signs", *[c for c in _COUNTS if c != "gaps"]]

    def finish() -> None:
        cost, path = None, None
        for state in ACCEPT:
            if state in now["best"] and (path is None or _earlier(now["best"][state], (cost, path))):
                cost, path = now["best"][state]
        pieces = []
        while path:
            path, start, piece = path
            pieces.append((start, piece))
        pieces.reverse()
        signs = now["signs"]
        out.add(
            conv_id=now["id"], segment=-1, blank=sum(s.count("b") for _, s in signs), duplicate=sum(s.count("d") for _, s in signs), truncated=sum(c.isupper() for _, s in signs for c in s),
            illegal=now["illegal"], cost=cost, audit="".join(p for _, p in pieces),
        )
        for (segment, s), (start, piece) in zip(signs, pieces):
            out.add(conv_id=now["id"], segment=segment, start=start, signs=s, audit=piece)

    for batch in batches:
        kind = batch.schema.field(0).type
        out = out or _Out(pa.schema([("conv_id", kind), *((n, pa.string() if n in ("signs", "audit") else pa.int64()) for n in names)]))
        for conv_id, segment, signs, initials, ways in zip(*[c.to_pylist() for c in batch.columns]):
            if now is None or now["id"] != conv_id:
                if now is not None:
                    finish()
                    yield out.batch()
                now = {"id": conv_id, "best": {START: (0, ())}, "signs": [], "illegal": 0, "last": ""}
            now["illegal"] += illegal(now["last"] + initials)
            now["last"] = initials[-1:]
            now["signs"].append((segment, signs))
            best = {}
            for w in ways:
                if w["start"] in now["best"]:
                    cost, path = now["best"][w["start"]]
                    way = (cost + w["cost"], (path, w["start"], w["audit"]))
                    if w["end"] not in best or _earlier(way, best[w["end"]]):
                        best[w["end"]] = way
            now["best"] = best
    if now is not None:
        finish()
        yield out.batch()


def _edits(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Solved segments of ``size`` rows to one row for each edit: its place, the number of its row (null for an inserted one), its new role."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            out = _Out(pa.schema([("conv_id", kind), ("place", pa.int64()), ("no", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())]))
            for conv_id, segment, start, signs, audit in zip(*[c.to_pylist() for c in batch.columns]):
                for at, (edit, i, role) in enumerate(follow(signs, audit, start)):  # less than four edits for a row
                    out.add(conv_id=conv_id, place=segment * 4 * size + at, no=None if i is None else segment * size + i, edit=edit, new_role=role)
            yield out.batch()

    return run


def _repair_long(rows: DataFrame, kind: str) -> DataFrame:
    numbered = store.table(order.numbered(rows, ["conv_id"], ["turn", "role", "text"], "no").withColumn("no", F.col("no") - 1), "turns")
    same = numbered.select("conv_id", "no", "initial", "sign", F.md5(F.concat_ws("\0", "role", "text")).alias("digest"))
    firsts = same.filter("sign != 'b'").groupBy(F.col("conv_id").alias("__c"), F.col("digest").alias("__d")).agg(F.min("no").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marked = same.join(firsts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("digest") == F.col("__d")), "left")
    sign = F.when(F.col("no") > F.col("first"), F.lit("d")).otherwise(F.col("sign"))
    segment = F.floor(F.col("no") / SEGMENT).cast("long")
    cut = marked.groupBy("conv_id", segment.alias("segment")).agg(F.sort_array(F.collect_list(F.struct("no", sign.alias("sign"), "initial"))).alias("r"))  # SEGMENT rows at most
    cut = cut.select("conv_id", "segment", F.array_join("r.sign", "").alias("signs"), F.array_join("r.initial", "").alias("initials"))
    ways = "array<struct<start:int,end:int,cost:long,audit:string>>"
    solved = cut.withColumn("ways", F.arrow_udf(_solve, ways)("signs")).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    whole = f"conv_id {kind}, segment long, start long, signs string, " + _SUMMARY.removeprefix("gaps long, ")
    chained = store.table(solved.mapInArrow(_chain, whole), "repairs")
    turns = numbered.groupBy(F.col("conv_id").alias("__c")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    heads = chained.filter("segment = -1").join(turns, F.col("conv_id").eqNullSafe(F.col("__c")))
    heads = heads.select("conv_id", F.lit(-1).cast("long").alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("edit", "role", "text")], *_COUNTS)
    pieces = chained.filter("segment >= 0").select("conv_id", "segment", "start", "signs", "audit")
    edits = pieces.mapInArrow(_edits(SEGMENT), f"conv_id {kind}, place long, no long, edit string, new_role string")
    own = numbered.select(F.col("conv_id").alias("__c"), F.col("no").alias("__n"), "role", "text")
    told = edits.filter("no is not null").join(own, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("no") == F.col("__n")))
    told = told.select("conv_id", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text")
    added = edits.filter("no is null").select("conv_id", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
    body = told.union(added).select("*", *[F.lit(None).cast("string" if c == "audit" else "long").alias(c) for c in _COUNTS])
    return heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "place")


def repair(rows: DataFrame) -> DataFrame:
    """The edits of all conversations (conv_id, turn, role, text): of each a row of place -1 with what was found and the audit, then one
    row for each edit in order, with the role and text after it (of a deleted row its own). A conversation's rows lie together and in order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    staged = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    signed = staged.withColumn("initial", _initial(F.col("role"))).withColumn("sign", _sign(F.col("text"), F.col("initial")))
    sizes = staged.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = store.table(sizes.filter((F.col("n") > LONG) | (F.col("b") > LONG_BYTES)).select(F.col("conv_id").alias("__long")), "long")
    n = long.count()
    laid = lambda x: x.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair_short, _schema(kind))
    if not n:
        return laid(signed)
    some = F.broadcast(long) if n <= 100_000 else long.hint("merge")
    same = F.col("conv_id").eqNullSafe(F.col("__long"))
    return laid(signed.join(some, same, "left_anti")).union(_repair_long(signed.join(some, same, "left_semi"), kind))


def digests(edits: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repair`: what was found, and a digest of the repaired ``role:text`` lines, made as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, out = None, None, None
        for batch in batches:
            out = out or _Out(_fields(batch.schema.field(0).type, [*_COUNTS]).append(pa.field("repaired_sha256", pa.string())))
            for row in batch.to_pylist():
                if row["place"] == -1:
                    if head is not None:
                        out.add(**head, repaired_sha256=digest.hexdigest())
                    head, digest, lines = row, hashlib.sha256(), 0
                elif row["edit"] != "D":
                    digest.update(("\n" * (lines > 0) + f"{row['role']}:{row['text']}").encode())
                    lines += 1
            if len(out) > 10_000:
                yield out.batch()
        if head is not None:
            out.add(**head, repaired_sha256=digest.hexdigest())
        if out is not None:
            yield out.batch()

    kind = edits.schema["conv_id"].dataType.simpleString()
    return edits.mapInArrow(run, f"conv_id {kind}, {_SUMMARY}, repaired_sha256 string")


def with_all(found: DataFrame, conversations: DataFrame) -> DataFrame:
    """``found`` with the conversations that have no rows left: zeros, an empty audit and the digest of nothing."""
    ids = conversations.select(F.col("conv_id").alias("__c")).distinct()
    nothing = {**{c: F.lit(0) for c in _COUNTS}, "audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("__c")), "left")
    return joined.select(F.col("__c").alias("conv_id"), *[F.coalesce(F.col(c), v).alias(c) for c, v in nothing.items()])
