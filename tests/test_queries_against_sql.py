"""Every registered core query against its SQL in DuckDB, on the smallest tables."""

import collections
import random
import os

import duckdb
import pandas as pd
import pytest

from threadloom.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def rows_of(frame: pd.DataFrame):
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return list(frame.columns), collections.Counter(tuple(map(plain, r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def by_hand(a, b):
    """The longest common run, the first in ``a``, then in ``b``; what lies before and after it likewise."""
    n, i, j = max(((n, -i, -j) for i in range(len(a)) for j in range(len(b)) for n in range(1, 1 + min(len(a) - i, len(b) - j)) if a[i : i + n] == b[j : j + n]), default=(0, 0, 0))
    i, j = -i, -j
    if n:
        return by_hand(a[:i], b[:j]) + by_hand(a[i + n :], b[j + n :])
    k = min(len(a), len(b))
    return [("modified", *p) for p in zip(a[:k], b[:k])] + [("removed", x, None) for x in a[k:]] + [("added", None, x) for x in b[k:]]


def test_alignment_matches_brute_force():
    from threadloom.operators.diff import aligned

    rng = random.Random(3)
    told = lambda a, b, **k: [(c, None if i is None else a[i], None if j is None else b[j]) for c, i, j in aligned(a, b, **k)]
    for n in range(600):
        signs = "abcde" if n % 2 else "abcdefghijklmnop"
        a, b = ([rng.choice(signs) for _ in range(rng.randint(0, 11))] for _ in range(2))
        assert told(a, b) == told(a, b, pairs=-10**6) == by_hand(a, b)  # by runs, and rectangle by rectangle


def test_alignment_follows_the_pairs_of_equal_blocks():
    import difflib
    import time

    from threadloom.operators.diff import matched

    rng = random.Random(6)
    a = [f"block {i}" if i % 9 else "---" if i % 900 == 0 else f"again {i % 3000}" for i in range(100_000)]
    b = [x for i, x in enumerate(a) if i % 11] + ["end"]
    for i in range(0, len(b), 10):  # runs of one length, the first of which is always the longest left
        b[i] = f"new {i}"
    began = time.perf_counter()
    runs = matched(a, b)
    assert time.perf_counter() - began < 30 and all(a[i : i + n] == b[j : j + n] for i, j, n in runs) and sum(n for *_, n in runs) > 70_000
    few = a[:1500], b[:1400]
    rng.shuffle(few[1][700:900])
    assert matched(*few) == [tuple(m) for m in difflib.SequenceMatcher(None, *few, autojunk=False).get_matching_blocks() if m.size]


def test_alignment_groups_are_bounded(spark, tmp_path):
    rows = [(i, "one source", f"text {i}") for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["text_alignment_diff"](spark, str(tmp_path)).collect()
    per_path = collections.Counter(r.path for r in got)
    assert len(per_path) == 5 and max(per_path.values()) <= 400
    changes = collections.Counter(r.change for r in got)
    added, removed = sum(i % 7 == 0 for i in range(1000)), sum(i % 7 == 1 for i in range(1000))
    assert changes["added"] - changes["removed"] == added - removed


def test_fragments_shuffle_keys_and_not_texts(spark):
    plan = QUERIES["marked_fragments"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange", 1)[1]
    assert "o_custkey" in below and "collect_list" in below and "Before. [Note" not in below
