"""Conversation repair against full enumeration and a layered search over all rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from threadloom.llm import conversation_repair as repair
from threadloom.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\v\f\r"


def conversations():
    rng = random.Random(8)
    texts = ["Yes.", "No!", "Why? ", "cut off", "and so", "", " \n", "Ok.", "héé.\t", " ", "end.  x"]
    rows = []
    for c in range(700):
        n = rng.randint(1, 9) if c < 660 else rng.randint(10, 45)
        for t in range(n):
            role = rng.choices([["user", "assistant"][t % 2], "user", "assistant", "system", "tool", None, "", "ursa"], [20, 2, 2, 1, 1, 1, 0.3, 0.3])[0]
            turn = rng.choices([t, None, t + 3, 0], [20, 0.5, 0.5, 0.5])[0]
            rows.append((c, turn, role, rng.choices([f"Text {c} {t}.", rng.choice(texts), None], [6, 4, 0.3])[0]))
    return rows + [(None, 0, "user", "Lost."), (None, 1, "assistant", "Found."), (5000, 0, None, None)]


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)
            out += [row] * (2 if kind == 3 else 1)
    return out


def marks(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        kept = x.strip(SPACE)
        out.append("blank" if not kept else "duplicate" if (r, x) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def layered(rows, faults):
    """(cost, audit, repaired) by going over the rows once, keeping the best per string of roles modulo its last pair."""
    short = lambda roles: (len(roles) > 0, roles[-1:])

    def legal(roles):
        return not roles or any(GRAMMAR.match(roles + rest) for rest in ("", "a", "ua"))

    def add(layer, cost, audit, roles, lines):
        if legal(roles) and (short(roles) not in layer or (cost, audit) < layer[short(roles)][:2]):
            layer[short(roles)] = (cost, audit, roles, lines)
            for role in ("user", "assistant"):
                add(layer, cost + 3, audit + "I", roles + role[0], [*lines, f"{role}:"])

    now = {}
    add(now, 0, "", "", [])
    for (_, _, r, x), fault in zip(rows, faults):
        layer = {}
        for cost, audit, roles, lines in now.values():
            add(layer, cost + 4, audit + "D", roles, lines)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if r[:1] in ("s", "u", "a"):
                    add(layer, cost + more, audit + "K", roles + r[0], [*lines, f"{r}:{x}"])
                for role in ("user", "assistant"):
                    add(layer, cost + 3 + more, audit + "R", roles + role[0], [*lines, f"{role}:{x}"])
        now = layer
    return min((c, a, lines) for c, a, roles, lines in now.values() if GRAMMAR.match(roles))


def enumerated(signs):
    """(cost, audit) from all edits with up to two insertions at each place."""
    gaps = [g for k in range(3) for g in itertools.product("ua", repeat=k)]
    best = None
    for inserts in itertools.product(gaps, repeat=len(signs) + 1):
        for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(signs)):
            cost, audit, roles = 0, "", ""
            for i, gap in enumerate(inserts):
                cost, audit, roles = cost + 3 * len(gap), audit + "I" * len(gap), roles + "".join(gap)
                if i < len(signs):
                    e, s = edits[i], signs[i]
                    if e != "D" and s in "bd":
                        break
                    cost += 4 if e == "D" else 3 * s.isupper() + 3 * (e != "K")
                    audit, roles = audit + e[0], roles + ("" if e == "D" else s.lower() if e == "K" else e[1])
            else:
                if GRAMMAR.match(roles) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
    return best


def want(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in damaged(rows) if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults = marks(own)
        turns = {r[1] for r in own} - {None}
        cost, audit, lines = layered(own, faults)
        pairs = zip(own, own[1:])
        out[c] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_search_matches_full_enumeration():
    for signs in ["", *map("".join, itertools.chain.from_iterable(itertools.product("suaxSUAXb", repeat=n) for n in (1, 2)))]:
        assert repair.cheapest(signs) == enumerated(signs), signs


@pytest.mark.parametrize("long, segment", [(2048, 512), (4, 3), (0, 1)])
def test_repairs_match_a_layered_search(spark, tmp_path, monkeypatch, long, segment):
    rows = conversations()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "SEGMENT", segment)
    out = queries.op12_conversation_repair(spark, str(tmp_path)).collect()
    assert len(out) == 702 and {r.conv_id: tuple(r)[1:] for r in out} == want(rows)
    assert min(sum(r[c] > 0 for r in out) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")) > 20
    assert any("I" in r.audit and "R" in r.audit for r in out)


def test_repair_edge_cases(spark):
    clash = "conv_id string, turn int, role string, text string, sign string, cost string, audit string"
    rows = [("a", 1, "user", "Hi.", "x", "y", "z"), ("a", 2, "assistant", "Yo " * 400_000 + ".", "x", "y", "z"), ("b", None, None, None, None, None, None), ("c", 7, "user", "", "", "", "")]
    out = {(r.conv_id, r.place): r for r in repair.repair(spark.createDataFrame(rows, clash)).collect()}
    assert (out["a", -1].cost, out["a", -1].audit, len(out["a", 1].text)) == (0, "KK", 1_200_001)
    assert (out["b", -1].blank, out["b", -1].audit, out["b", 0].edit, out["c", -1].gaps) == (1, "D", "D", 0)
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).count() == 0
    assert repair.with_all(repair.digests(repair.repair(repair.damage(empty))), empty).count() == 0


def test_a_long_conversation_takes_no_time_with_its_square(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("1L as conv_id", "id as turn", "case when id % 7 = 3 then 'tool' when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('t ', id, if(id % 5 = 0, '', '.')) as text")
    out = repair.digests(repair.repair(rows)).collect()
    assert len(out) == 1 and len(out[0].audit) >= n and out[0].truncated == n // 5 and out[0].gaps == 0
    signs = "".join(("x" if i % 7 == 3 else "ua"[i % 2]).upper() if i % 5 == 0 else ("x" if i % 7 == 3 else "ua"[i % 2]) for i in range(600))
    head = next(iter(repair.search(signs, repair.START, repair.ACCEPT, False).values()))
    assert out[0].audit.startswith(head[1][:500])
