"""Brute-force checks of the operators on words, lines and shingles."""

import collections
import re

import pytest

from threadloom.llm import line_dedup, ngram_join, quality_rules, substring_dedup

from .conftest import SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_substring_dedup_matches_brute_force(spark, corpus):
    for k, hot in ((50, 4096), (6, 1)):
        got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(corpus, SCHEMA).repartition(3), k=k, m=min(8, k - 2), hot=hot).collect()}
        words = {d: WORD.findall(t or "") for d, t, _ in corpus}
        first = {}
        for d in sorted(words):
            for i in range(len(words[d]) - k + 1):
                first.setdefault(tuple(words[d][i : i + k]), d)
        removed = 0
        for d, w in words.items():
            gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
            removed += len(gone)
            assert (got[d].n_words, got[d].n_removed) == (len(w), len(gone))
            assert got[d].kept_text == " ".join(x for i, x in enumerate(w) if i not in gone)
        assert removed and len(got) == len(corpus)


def test_substring_dedup_edge_cases(spark):
    text = " ".join(f"v{i}" for i in range(60))
    rows = [(None, text, "a"), (1, text, "a"), (1, text, "a"), (2, text, None), (3, None, "a"), (4, "", "a")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "n_words"))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in out.collect()) == [(False, 1, 0), (False, 1, 0), (False, 2, 60), (False, 3, 0), (False, 4, 0), (True, 0, 0)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_statistics(text):
    w = WORD.findall(text or "")
    count = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if count[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(cover)


def test_quality_statistics_match_brute_force(spark, corpus):
    rows = [*corpus, (907, "a\nb\n\n a\na\n", "x"), (908, "é#é\r\né#é\r\n", "x"), (None, "p q", "x")]
    out = quality_rules.text_statistics(spark.createDataFrame(rows, "doc_id long, text string, n_lines string"), keep=["doc_id", "text", "n_lines"]).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.text)


def test_decision_list_learns_and_keeps_clean(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    n = 3000
    bad = rng.random(n) < 0.25
    rows = {c: rng.integers(50, 500, n) for c in quality_rules.STATISTICS}
    rows["n_symbols"] = np.where(bad, rng.integers(60, 200, n), rng.integers(0, 10, n))
    rows["word_chars"] = np.full(n, 1000)
    fit = quality_rules.learn({k: v[:2000] for k, v in rows.items()}, bad[:2000])
    assert fit.rules and "symbol_share" in fit.describe()[0]
    frame = spark.createDataFrame([(i, *[int(rows[c][i]) for c in quality_rules.STATISTICS]) for i in range(2000, n)], ["doc_id", *quality_rules.STATISTICS])
    kept = {r.doc_id: r.kept for r in frame.select("doc_id", fit.verdict().alias("kept")).collect()}
    assert np.mean([kept[i] != bad[i] for i in range(2000, n)]) > 0.97
    assert quality_rules.learn({c: np.zeros(0) for c in quality_rules.STATISTICS}, np.zeros(0)).rules == []


def test_quality_fit_without_labels_keeps_what_passes_the_base_rule(spark, corpus):
    stats = quality_rules.text_statistics(spark.createDataFrame(corpus, SCHEMA), keep=["doc_id"])
    rules = quality_rules.fit(spark.createDataFrame(corpus, SCHEMA), spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    assert all(r.kept == (not r.base_failed) for r in quality_rules.judge(stats, rules).collect())


def test_quality_fit_on_a_bounded_pick_and_odd_labels(spark):
    """Any bound gives a list learnt from as many labelled rows; repeated, contradicting and lone labels and repeated rows do no harm."""
    import random

    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["plain", "words", "of", "text"]) + str(rng.randrange(50)) for _ in range(60))
    rows = [(i, good() if i % 3 else " ".join(["#$%", good()] * 4)) for i in range(300)] + [(5, good()), (5, None), (None, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(4, 1), (9, 1), (7777, 0), (None, 0), (8, None), (11, 5)], "doc_id long, quality int")
    wanted = {i: i % 3 > 0 for i in range(300) if i != 5}
    for most in (1, 120, 299, 300, 301, 20_000):
        rules = quality_rules.fit(docs, labels, max_labelled=most)
        again = quality_rules.fit(docs.repartition(7), labels.repartition(3), max_labelled=most)
        assert rules.describe() == again.describe()
        if most > 100:
            kept = {r.doc_id: r.kept for r in quality_rules.judge(quality_rules.text_statistics(docs, keep=["doc_id"]), rules).collect()}
            assert sum(kept[i] == w for i, w in wanted.items()) > 285
    assert quality_rules.fit(docs.limit(0), labels).rules == []
    assert quality_rules.judge(quality_rules.text_statistics(docs.limit(0)), rules).count() == 0


def test_quality_statistics_of_a_megabyte(spark):
    text = "a b c d e\n" * 60_000 + "é" * 500_000 + "\n" + " ".join(f"w{i}" for i in range(60_000))
    (r,) = quality_rules.text_statistics(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["doc_id"]).collect()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(text)


def brute_lines(rows):
    first, windows = {}, {}
    for d, t, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        content = [x for x in t.split("\n") if WORD.search(x)]
        windows[d] = content
        for i in range(len(content) - 2):
            first.setdefault(tuple(content[i : i + 3]), (d, i))
    out = {}
    for d, t, _ in rows:
        if d is None or t is None:
            continue
        content = windows[d]
        gone = {j for i in range(len(content) - 2) if first[tuple(content[i : i + 3])] != (d, i) for j in range(i, i + 3)}
        kept, n = [], -1
        for line in t.split("\n"):
            if WORD.search(line):
                n += 1
                if n in gone:
                    continue
            kept.append(line)
        out[d] = (len(content), len(gone), "\n".join(kept))
    return out


def test_line_dedup_matches_brute_force(spark, corpus):
    block = "alpha line\nbeta line\n\ngamma line\ndelta line"
    rows = [*corpus, (1, block, "a"), (5001, f"own\n{block}\nrest", "a"), (5002, "z\n" * 6, "a"), (5003, f"{block}\n{block}\n", "a"), (5004, "beta line\ngamma line\ndelta line", "a")]
    rows = [r for i, r in enumerate(rows) if r[0] not in {x[0] for x in rows[:i]}]
    out = {r.doc_id: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string").repartition(3)).collect()}
    want = brute_lines(rows)
    assert sum(x[1] for x in want.values()) > 8
    for d, x in want.items():
        assert (out[d].n_lines, out[d].n_removed, out[d].text) == x


def test_line_dedup_edge_cases(spark):
    text = "a\nb\nc"
    rows = [(None, text, "x"), (7, text, "x"), (7, text, "x"), (8, text, "y"), (9, None, "y"), (10, "", "y")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "", r.n_removed) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 7, False, text, 0), (False, 7, False, text, 0), (False, 8, False, "", 3), (False, 9, True, "", 0), (False, 10, False, "", 0), (True, 0, False, text, 0)]
    assert line_dedup.remove_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_classes(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for d, t, _ in rows:
        w = WORD.findall((t or "").translate(low))
        sets[d] = frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("chunk", [512, 2])
def test_ngram_join_matches_brute_force(spark, corpus, chunk):
    base = " ".join(f"Z{i}" for i in range(500))
    rows = [*corpus, *[(7000 + i, base.replace(f"Z{i * 7} ", f"y{i} "), "a") for i in range(9)], (7100, base.lower(), "a"), (7101, base + " tail", "b"), (7102, base[: len(base) * 17 // 20], "b")]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk).collect()}
    want = brute_classes(rows)
    assert out == want and len({c for _, c in want.values()}) < len(want) - 12


def test_ngram_join_edge_cases(spark):
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (3, "A B C D E F", None), (4, None, None), (5, "", None)]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "component_id")).collect())
    assert got == [(False, 1, 2, 1), (False, 1, 2, 1), (False, 3, 2, 1), (False, 4, 0, 4), (False, 5, 0, 5), (True, 0, 2, 0)]
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_tree_finds_every_connection():
    import numpy as np

    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 62, 120).astype(np.uint64)) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.06], rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)])) for b in base for _ in range(5)]
    tree = ngram_join.Tree(sets)
    list(tree.links(80, 100))
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert [tree.find(i) for i in range(len(sets))] == root


def thue_morse(n, a="a", b="b"):
    """Two texts of ``n`` letters that polynomial hashes cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_words_and_lines_are_told_apart(spark, n):
    x, y = thue_morse(n)
    filler = " ".join(f"f{i}" for i in range(60))
    rows = [(1, x, "a"), (2, y, "a"), (3, f"{x}\n{y}\n{x}", "a"), (4, f"{filler} {x} {filler}", "a"), (5, f"{filler} {y} {filler}", "a"), (6, f"{x} p q r s {y} p q r s {x} p q r s", "a")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == brute_classes(rows) and got[1][1] != got[2][1]
    for r in quality_rules.text_statistics(docs, keep=["doc_id", "text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.text)
    for k in (50, 4):
        check_substring(spark, rows, k)


def test_structured_word_sequences_are_told_apart(spark):
    x, y = (" ".join(t) for t in thue_morse(256, "u", "v"))
    rows = [(1, x, "a"), (2, y, "a"), (3, f"{y} {x}", "a"), (4, "w " * 900, "a"), (5, "w " * 600 + "z " + "w " * 300, "a")]
    check_substring(spark, rows, 50)
    check_substring(spark, rows, 50, hot=1)


def check_substring(spark, rows, k, **options):
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, m=min(8, k - 2), **options).collect()}
    words = {d: WORD.findall(t or "") for d, t, _ in rows}
    first = {}
    for d in sorted(words):
        for i in range(len(words[d]) - k + 1):
            first.setdefault(tuple(words[d][i : i + k]), d)
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if first[tuple(w[i : i + k])] < d for j in range(i, i + k)}
        assert (got[d].n_words, got[d].n_removed, got[d].kept_text) == (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))


def test_equal_keys_are_confirmed_on_the_bytes():
    import numpy as np

    from threadloom.llm import words

    data = np.frombuffer(b"abcabxabcab", dtype=np.uint8)
    start, end = np.array([0, 3, 6, 9, 0]), np.array([3, 6, 9, 11, 2])
    same = words.first_equal(np.zeros(5, np.uint64), data, start, end)
    assert same.tolist() == [0, 1, 0, 3, 3]
    assert words.first_equal(np.zeros(5, np.uint64), data, start, end, np.array([0, 0, 1, 0, 0])).tolist() == [0, 1, 2, 3, 3]


def test_substring_dedup_of_a_megabyte(spark):
    import random

    rng = random.Random(8)
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "x"]) + str(rng.randrange(5000)) for _ in range(110_000))
    rows = [(1, long, "a"), (2, "own start " + long[400_000:] + " own end", "a"), (3, "y " * 500_000, "a"), (4, "b" * 1_000_000, "a"), (5, "c " + "b" * 1_000_000, "a")]
    check_substring(spark, rows, 50)


@pytest.mark.parametrize("wide", [400, 40])
def test_ngram_join_of_large_blocks(spark, monkeypatch, wide):
    """Several families that share a passage: chunks, their largest component and what lies outside of it; sets of which the published part is too small."""
    import random

    rng = random.Random(13)
    monkeypatch.setattr(ngram_join, "WIDE", wide)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for family in range(9):
        base = [f"f{family}_{i}" for i in range(90)] + passage
        for i in range(2 + 3 * family):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            rows.append((100 * family + i, " ".join(text), "s"))
    rng.shuffle(rows)
    for chunk in (4, 16):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk).collect()}
        assert got == brute_classes(rows)


def test_sets_with_too_small_a_part_publish_everything(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "WIDE", 6)
    monkeypatch.setattr(ngram_join, "SHARE", int(0.2 * (1 << 32)))  # of a dozen shingles, often none or one is published
    rows = []
    for family in range(40):
        base = " ".join(f"{family}_{i}" for i in range(30))
        rows += [(2 * family, base, "s"), (2 * family + 1, base + " tail", "s")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes(rows) and all(c == d - d % 2 for d, (_, c) in got.items())


def test_class_numbers_are_unique(spark):
    digests = [bytes([i % 2] * 8 + [i] * 8) for i in range(6)]
    classes = spark.createDataFrame([(bytearray(d), ngram_join._number(d, {})) for d in digests], "digest binary, cls long")
    numbered, turns = ngram_join._class_numbers(classes)
    got = {bytes(r.digest): r.cls for r in numbered.collect()}
    assert len(set(got.values())) == 6 and turns and got == {d: ngram_join._number(d, turns) for d in digests}


def test_line_and_shingle_operators_on_a_megabyte(spark):
    import random

    rng = random.Random(6)
    long = "\n".join(f"line {rng.randrange(10**6)} of the text" for _ in range(40_000))
    rows = [(1, long, "a"), (2, "head\n" + long[300_000:] + "\nend", "a"), (3, long + "\none more line", "a"), (4, "same\n" * 100_000, "a"), (5, "x" * 1_000_000, "a")]
    out = {r.doc_id: r for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    for d, x in brute_lines(rows).items():
        assert (out[d].n_lines, out[d].n_removed, out[d].text) == x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_classes(rows) and got[3][1] == 1 and got[2][1] == 2


def test_line_dedup_grows_with_the_lines_of_a_text(spark):
    import time

    took = {}
    for n in (5_000, 20_000, 80_000):
        text = "\n".join(f"line {i} of the text" for i in range(n))
        docs = spark.createDataFrame([(1, text, "a"), (2, text + "\nend", "a")], SCHEMA)
        began = time.perf_counter()
        out = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs).collect()}
        took[n] = time.perf_counter() - began
        assert (out[1].n_removed, out[2].n_lines, out[2].n_removed, out[2].text) == (0, n + 1, n, "end")
    assert took[80_000] < 2 + 8 * took[20_000]  # in proportion it is 4 times, by the square 16 times
