"""Spelling variants against a comparison of all pairs of words."""

import collections
import random
import re
import zlib

import pytest

from threadloom.llm import queries, spelling_variants

from .conftest import SCHEMA


def corpus_words(rows):
    counts = collections.Counter()
    for d, t, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def want(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, n in words.items():
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for a, n in words.items():
        root = a
        while form[root]:
            root = form[root]
        out[a] = (form[a], root, n, len(near[a]), form[a] and words[form[a]])
    return out


def documents():
    rng = random.Random(12)
    stems = ["".join(rng.choice("abeétn") for _ in range(rng.randint(4, 11))) for _ in range(60)] + ["aaaaa", "aaaaaa", "ÿøÿøÿø", "straße", "élève"]
    words = list(stems)
    for w in stems:
        for _ in range(8):
            x = w
            for _ in range(rng.randint(1, 3)):
                i = rng.randrange(len(x))
                x = rng.choice([x[:i] + x[i + 1 :], x[:i] + rng.choice("abeÉ") + x[i:], x[:i] + rng.choice("aétÀ") + x[i + 1 :]])
            words.append(x)
    weight = [rng.choice([1, 1, 2, 5, 30]) for _ in words]
    joined = lambda n: "".join(rng.choice([w, w.capitalize(), w.upper()]) + rng.choice([" ", ", ", "1", "_", "\n", "Ā"]) for w in rng.choices(words, weight, k=n))
    return [(i, joined(rng.randint(0, 300)), "s") for i in range(60)] + [(None, joined(50), None), (70, None, "s"), (71, "", "s"), (72, joined(40), "s"), (72, joined(40), "s")]


@pytest.mark.parametrize("pairs", [256, 6, 0])
def test_variants_match_all_pairs(spark, tmp_path, monkeypatch, pairs):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(spelling_variants.near_words, "__defaults__", (pairs,))
    out = queries.op13_spelling_variants(spark, str(tmp_path)).collect()
    expected = want(corpus_words(rows))
    assert len(out) == len(expected) > 200 and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == expected
    assert sum(r.form is not None for r in out) > 50 and any(r.root not in (r.form, r.word) for r in out)


def test_hot_buckets_are_cut_until_few_pairs_are_made(spark):
    rng = random.Random(2)
    words = {"prefixprefix" + "".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(3000)}
    frame = spark.createDataFrame([(w, 3 + len(w)) for w in words], "word string, n long")
    got = {(r.a, r.b) for r in spelling_variants.near_words(frame).collect()}
    by_gap = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            by_gap[w[:i] + "?" + w[i + 1 :]].add(w)
    assert got == {(a, b) for g in by_gap.values() for a in g for b in g if a < b}


def test_spelling_edge_cases(spark):
    clash = spark.createDataFrame([(1, "Words words words wordz " + "x" * 3_000_000 + " " + "wordy " * 600_000, "w", 5)], "doc_id long, text string, word string, n int")
    out = {r.word: r for r in spelling_variants.variants(clash, damage=None).collect()}
    assert (out["words"].n, out["words"].form, out["wordy"].n, out["wordy"].root, len(out)) == (3, "wordy", 600_000, "wordy", 2)
    assert spelling_variants.variants(spark.createDataFrame([], SCHEMA)).count() == 0
