"""Embeddings, personal data, URLs, secrets, mixing, sampling: brute force, invariants and edge cases."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from threadloom.llm import embedding_dedup, pii_surrogates, secret_scan, source_mixing, url_filters
from threadloom.llm.components import components

from .conftest import SCHEMA


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:20] + rng.normal(size=(20, 16)) * 0.12, base[:20] + rng.normal(size=(20, 16)) * 0.3, base[:5], base[:5] * 7.5])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(500, None), (501, []), (502, [0.0] * 16), (503, [1.0, None] + [0.0] * 14), (504, [float("nan")] * 16), (505, [float("inf")] * 16), (506, [1.0, 2.0]), (None, rows[0][1])]
    out = embedding_dedup.near_duplicates(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").repartition(3)).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
    got = {r.vec_id: r for r in out}
    assert len(out) == len(rows) + len(odd) and linked.sum() > 40
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[i].sum(), root[i], root[i] == i)
    for i, _ in odd[:-1]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].component_id is None
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("distinct", [2, 5, 10])
def test_embedding_links_of_few_distinct_vectors(spark, distinct):
    rng = np.random.default_rng(distinct)
    base = rng.normal(size=16) + rng.normal(size=(distinct, 16)) * 0.3
    x = base[rng.integers(0, distinct, size=300)]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(distinct):
        root = np.minimum(root, np.where(linked, root[None, :], len(x)).min(axis=1))
    assert [got[i].n_links for i in range(len(x))] == linked.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()


def test_embeddings_of_equal_ids_and_clashing_columns(spark, monkeypatch):
    a, b = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 9, "x"), (1, a, 9, "x"), (1, b, 9, "x"), (2, [2 * v for v in a], 9, "x"), (3, b, 9, "x"), (4, [0.0, 0.0, 1.0] + [0.0] * 3000, 9, "x"), (5, [0.0, 0.0, 1.0] + [0.0] * 3000, 9, "x")]
    for most in (32_000_000, 1):  # one vector to a group at the least
        monkeypatch.setattr(embedding_dedup, "GROUP_BYTES", most)
        out = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int, kept string")).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(1, 1, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False)]


def test_embedding_classes_of_one_number_stay_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(40, 8)))] + [(100, [1.0] * 8), (101, [1.0] * 7 + [1.1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    own = embedding_dedup._key
    monkeypatch.setattr(embedding_dedup, "_key", lambda turn: F.pmod(own(turn), F.lit(9 if turn < 3 else 1 << 40)))
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()) == want and want[-1][1:] == (1, 100, False)


def test_quantised_bound_holds():
    rng = np.random.default_rng(4)
    u = rng.normal(size=(300, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    a = embedding_dedup.quantise(u[:150])
    b = embedding_dedup.quantise(u[150:])
    for threshold in (0.1, 0.3):
        i, j = embedding_dedup.possible(a, b, threshold)
        found = set(zip(i.tolist(), j.tolist()))
        exact = set(zip(*[v.tolist() for v in np.nonzero(u[:150] @ u[150:].T >= threshold)]))
        assert exact <= found and len(found) < 150 * 150 / 2


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101 + i) for i in range(50)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(300, 300)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(51)}, **{200 + i: 200 for i in range(9)}}


PII = "Write to Ann.Lee7@mail3.example.com or ANN.LEE7@MAIL3.EXAMPLE.COM, call +1 (017) 555-7713 or 555-7713; 10.1.2.3 and 97.51.17.173. Card 4111 1111 1111 1111, id 9807915762804490. Mrs Smith met Herr Müller and госпожа Иванова."


def test_pii_surrogates_keep_type_format_and_reference(spark):
    rows = [(1, PII, "a"), (2, "again ann.lee7@mail3.example.com and 97.51.17.173!", "a"), (3, "clean text of 2 words, version 4.0.", "a"), (4, None, None), (None, "", "a"), (1, PII, "a")]
    out = pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string, entities string")).collect()
    assert len(out) == len(rows) and "entities" in out[0].asDict()
    first = [r for r in out if r.doc_id == 1]
    assert first[0] == first[1]
    text = first[0].text
    for secret in ("Lee7", "LEE7", "555-7713", "97.51.17.173", "4111 1111", "9807915762804490", "Smith", "Müller", "Иванова"):
        assert secret not in text
    kinds = collections.Counter(e.type for e in first[0].entities)
    assert kinds == {"email": 2, "phone": 2, "ip": 2, "card": 2, "name": 3}
    new = {PII[e.start : e.end]: e.surrogate for e in first[0].entities}
    assert new["ANN.LEE7@MAIL3.EXAMPLE.COM"] == new["Ann.Lee7@mail3.example.com"].upper()
    assert re.fullmatch(r"\+\d \(\d{3}\) \d{3}-\d{4}", new["+1 (017) 555-7713"]) and re.fullmatch(r"(\d{4} ){3}\d{4}", new["4111 1111 1111 1111"])
    assert pii_surrogates._luhn(new["4111 1111 1111 1111"].replace(" ", "")) and new["10.1.2.3"].startswith("10.")
    assert re.search("[Ѐ-ӿ]", new["Иванова"]) and not re.search("[Ѐ-ӿ]", new["Smith"])
    second = next(r for r in out if r.doc_id == 2)
    assert new["Ann.Lee7@mail3.example.com"].lower() in second.text and new["97.51.17.173"] in second.text
    clean = next(r for r in out if r.doc_id == 3)
    assert clean.n_entities == 0 and clean.text == rows[2][1]
    assert pii_surrogates.replace(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pii_collisions_are_resolved(spark, monkeypatch):
    entities = spark.createDataFrame([("phone", f"{i:07d}") for i in range(40)] + [("ip", "1.2.3.4")], "type string, norm string")
    original = pii_surrogates.canonical_surrogate
    clash = lambda kind, norm, attempt, key=b"k": "0000007" if kind == "phone" and attempt == 0 and norm < "0000003" else original(kind, norm, attempt, key)
    monkeypatch.setattr(pii_surrogates, "canonical_surrogate", clash)
    again = pii_surrogates.exceptions(entities, b"k").collect()
    assert {r.norm for r in again} >= {"0000000", "0000001", "0000002"} and all(r.attempt >= 1 for r in again)


def test_pii_surrogates_never_run_out(spark):
    syllables = "ba ce di fo gu ha ke li mo nu pa re si to vu wa xe yi zo qu da fe".split()
    names = ["".join(p) for p in itertools.product(syllables, repeat=3)][:10_000]
    rows = [(i, " and ".join(f"{'Mr' if j % 2 else 'Dr'} {n.capitalize()}" for j, n in enumerate(names[i : i + 10]))) for i in range(0, len(names), 10)]
    rows += [(-i, f"Mr {n.capitalize()} again") for i, n in enumerate(names[1:400:2], 1)]
    out = pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shown = collections.defaultdict(set)
    for (_, text), r in zip(sorted(rows), sorted(out, key=lambda r: r.doc_id)):
        for e in r.entities:
            shown[text[e.start : e.end].casefold()].add(e.surrogate.casefold())
    assert len(shown) == len(names) and all(len(x) == 1 for x in shown.values())
    new = {x for v in shown.values() for x in v}
    assert len(new) == len(names) and not new & set(names)


def test_pii_names_keep_their_script(spark):
    names = {"Dr Παπαδόπουλος": "[Ͱ-Ͽ]+", "Mrs Ελένη Καρρά": "[Ͱ-Ͽ]+ [Ͱ-Ͽ]+", "Mr Սարգսյան": "[\u0531-\u0588]+", "господин Петров": "[Ѐ-ӿ]+", "Dr Jones": "[A-Za-z]+"}
    out = pii_surrogates.replace(spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")).collect()
    for r, (name, script) in zip(sorted(out, key=lambda r: r.doc_id), names.items()):
        (entity,) = r.entities
        assert re.fullmatch(script, entity.surrogate) and entity.surrogate not in name and entity.surrogate.istitle()
        assert r.text == name.split(" ")[0] + " " + entity.surrogate
    assert pii_surrogates.render("given:m:greek", "Κώστας", "γιώργοσ") == "Γιώργος"


def test_pii_finds_more_formats(spark):
    texts = {
        "Pay to DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432 now": ["iban", "iban"], "number 078-05-1120 is taken": ["ssn"], "call 5557713 or +33 6 12 34 56 78": ["phone", "phone"],
        "We met John Smith and Maria Garcia in May": ["name", "name"], "Dr John Smith, John Smith": ["name", "name"], "May June 5557714 items, version 2.0, The House": [], "встретил Сергей Петров": ["name"],
        "Tel: 5557713, ref 5557713": ["phone"],
    }
    rows = [(i, t) for i, t in enumerate(texts)]
    out = sorted(pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r.doc_id)
    for r, (text, kinds) in zip(out, texts.items()):
        assert [e.type for e in r.entities] == kinds, text
    ibans = [e.surrogate for e in out[0].entities]
    assert all(pii_surrogates._mod97(x.replace(" ", "")) == 1 for x in ibans) and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", ibans[0]) and re.fullmatch(r"GB\d\d[A-Z]{4}\d{14}", ibans[1])
    assert re.fullmatch(r"\d{3}-\d\d-\d{4}", out[1].entities[0].surrogate) and re.fullmatch(r"\+\d\d \d( \d\d){4}", out[2].entities[1].surrogate)
    john = out[3].entities[0].surrogate
    assert john.split(" ")[0] in pii_surrogates._GIVEN["latin", "m"] and out[3].entities[1].surrogate.split(" ")[0] in pii_surrogates._GIVEN["latin", "f"]
    assert {e.surrogate for e in out[4].entities} == {john}
    assert out[7].entities[0].surrogate == out[2].entities[0].surrogate


def test_pii_spans_match_brute_force(spark):
    """Texts put together from known entities and clean words: what is found is what was put in, and all else stays."""
    rng = random.Random(21)
    kinds = {
        "email": lambda: f"{rng.choice('abcxyz')}{rng.randrange(10**4)}@host{rng.randrange(50)}.example.org", "phone": lambda: f"+{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}",
        "ip": lambda: ".".join(str(rng.randint(1, 250)) for _ in range(4)), "ssn": lambda: f"{rng.randint(100, 899)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "card": lambda: str(rng.randint(10**15, 10**16 - 1)),
        "name": lambda: f"{rng.choice(['John', 'Mary'])} {rng.choice(['Smith', 'Jones', 'Brown'])}{rng.choice(['', 'son'])}",
    }
    rows, put = [], {}
    for i in range(120):
        parts, spans, at = [], [], 0
        for _ in range(rng.randint(0, 400 if i else 60_000)):  # the first one is a text of half a megabyte
            if rng.random() < 0.1:
                kind = rng.choice(list(kinds))
                word = kinds[kind]()
                spans.append((kind, at, at + len(word)))
            else:
                word = rng.choice(["lorem", "ipsum", "dolor", "sit,", "1.5", "x2", "été"])
            parts.append(word)
            at += len(word) + 3
        rows.append((i, " ; ".join(parts), "x"))
        put[i] = spans
    out = pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string, n_entities string").repartition(3)).collect()
    given, made = {}, collections.defaultdict(set)
    for r in out:
        text = rows[r.doc_id][1]
        assert [(e.type, e.start, e.end) for e in r.entities] == put[r.doc_id] and r.n_entities == len(put[r.doc_id])
        at, back = 0, []
        for e in r.entities:
            back += [text[at : e.start], e.surrogate]
            at = e.end
            assert given.setdefault((e.type, text[e.start : e.end].casefold()), e.surrogate) == e.surrogate and e.surrogate != text[e.start : e.end]
            made[e.type, e.surrogate].add(text[e.start : e.end].casefold())
        assert r.text == "".join([*back, text[at:]])
    assert all(len(x) == 1 for x in made.values())


def test_pii_forms_of_one_person_share_their_surrogates(spark):
    text = "Mr Smith met Dr Smith, John Smith and Smith's dog; John left. Mrs Garcia is Maria Garcia. Call +1 555 123 4567, 555-123-4567, (0)555 123 4567 or +44 555 123 4567. The smith works."
    rows = [(1, text), (2, "Ms Smith, Prof. Maria Lopez, name: Zorblax Quux; Quux signed"), (3, "from 2001:db8::1 and 2001:0db8:0000:0000:0000:0000:0000:0001, FE80::AB:12:1; at 12:30:45, std::vector a::b"), (4, "Mohammed Ali, Wei Zhang and Priya Patel")]
    out = {r.doc_id: r for r in pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shown = [(text[e.start : e.end], e.surrogate) for e in out[1].entities]
    assert [s for s, _ in shown] == ["Smith", "Smith", "John Smith", "Smith", "John", "Garcia", "Maria Garcia", "+1 555 123 4567", "555-123-4567", "555 123 4567", "+44 555 123 4567"]
    new = dict(shown)
    assert len({x for s, x in shown if s == "Smith"}) == 1 and new["John Smith"] == f"{new['John']} {new['Smith']}" and new["Maria Garcia"].endswith(" " + new["Garcia"])
    digits = lambda x: "".join(c for c in x if c.isdigit())
    assert digits(new["+1 555 123 4567"]) == "1" + digits(new["555-123-4567"]) == "1" + digits(new["555 123 4567"]) and new["+44 555 123 4567"].startswith("+44 ") and new["+1 555 123 4567"].startswith("+1 ")
    assert out[1].text.endswith("The smith works.") and new["Smith"] + "'s dog" in out[1].text
    second = [e.surrogate for e in out[2].entities]
    assert second[0] == new["Smith"] and second[1].split(" ")[0] == new["Maria Garcia"].split(" ")[0] and second[2].split(" ")[1] == second[3] and len(second) == 4
    third = [e.surrogate for e in out[3].entities]
    import ipaddress

    assert [e.type for e in out[3].entities] == ["ipv6"] * 3 and ipaddress.ip_address(third[0]) == ipaddress.ip_address(third[1]) and third[2].startswith("FE80:") and "12:30:45" in out[3].text
    assert [e.type for e in out[4].entities] == ["name"] * 3


def test_pii_persons_stay_distinct_in_all_their_forms(spark):
    syllables = "ba ce di fo gu ha ke li mo nu pa re si to vu wa xe yi zo qu da fe".split()
    families = ["".join(p).capitalize() for p in itertools.product(syllables, repeat=3)][:1000]
    givens = sorted(n for n in pii_surrogates._GENDER if n.isascii())[:40]
    persons = [(g, f) for i, f in enumerate(families) for g in [givens[(i * 7 + j * 4) % 40] for j in range(10)]]
    rows = [(i, f"{g} {f} came. Then Dr {f} spoke, and Dr {g} {f}. {g} went.") for i, (g, f) in enumerate(persons)]
    out = pii_surrogates.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    given, family, full = {}, {}, {}
    for r in out:
        g, f = persons[r.doc_id]
        forms = [e.surrogate for e in r.entities]
        assert len(forms) == 4 and forms[0] == forms[2] == f"{forms[3]} {forms[1]}", (rows[r.doc_id], forms)
        assert given.setdefault(g, forms[3]) == forms[3] and family.setdefault(f, forms[1]) == forms[1]
        full[g, f] = forms[0]
        if forms[3].split("-")[0] in pii_surrogates._GIVEN["latin", "f"]:
            assert pii_surrogates._GENDER[g] == "f"
    assert len(set(full.values())) == len(set(persons)) == 10_000 and len(set(given.values())) == len(given) and len(set(family.values())) == 1000
    assert not set(given.values()) & set(givens) and not set(family.values()) & set(families)


def test_pii_formats_widen_when_they_are_full(spark, monkeypatch):
    entities = spark.createDataFrame([("phone", f"555{i:04d}") for i in range(30)] + [("ip", "10.0.0.1"), ("ip", "10.0.0.2")], "type string, norm string")
    original = pii_surrogates.canonical_surrogate

    def full(kind, norm, attempt, key=b"k"):
        made = original(kind, norm, attempt, key)
        return "5550000" if kind == "phone" and len(made) == 7 else "10.0.0.1" if made.startswith("10.") else made

    monkeypatch.setattr(pii_surrogates, "canonical_surrogate", full)
    again = pii_surrogates.exceptions(entities, b"k").collect()
    made = {full(r.type, r.norm, r.attempt, b"k") for r in again}
    assert len(again) == len(made) == 32
    shown = pii_surrogates.render("phone", "555-0000", "12345678")
    assert shown == "123-45678"


def test_urls_match_brute_force(spark, monkeypatch):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"), ("block", "a.b.com", ""), ("block", "tie.net", "/x"), ("allow", "tie.net", "/x"), ("block", "b.com", "/fr/"), ("allow", "long.net", "/" + "p" * 3000)]
    hosts = ["example.org", "WWW.Example.ORG", "notexample.org", "org", "x.com", "a.b.com", "z.a.b.com", "ab.com", "tie.net", "", "münchen.org", ".com"]
    paths = ["", "/", "/es/1", "/es", "/en/12?q=/de/", "/fr/#x", "/de/x/y", "/x1", "?a=b", "#f", "/DE/", "/fr/a/b\n"]
    urls = [f"{s}://{h}{p}" for s in ("http", "x") for h in hosts for p in paths] + [None, "", "no url", "://", "a://b://c.com/de/1", "http://long.net/" + "p" * 300_000, "http://long.net/" + "p" * 2999, "http://" + "h." * 50_000 + "com/fr/x", "http://q.b.com/fr/"]
    rows = [(i if i % 50 else None, u, "v") for i, u in enumerate(urls * 2)]
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(3), spark.createDataFrame(rules, "action string, host string, path string"))
    want = []
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fit = [r for r in rules if host and (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: (len(r[1]), len(r[2]), r[0]), default=None)
        want.append((i, host, path, best and best[1] + best[2], best[0] if best else "allow"))
    assert collections.Counter(tuple(r) for r in out.collect()) == collections.Counter(want)
    monkeypatch.setattr(url_filters, "BROADCAST_BYTES", 10)
    merged = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, verdict string").repartition(3), spark.createDataFrame(rules, "action string, host string, path string"))
    assert collections.Counter(tuple(r) for r in merged.collect()) == collections.Counter(want)
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(rules, "action string, host string, path string")).count() == 0
    none = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, x string"), spark.createDataFrame([], "action string, host string, path string"))
    assert {r.verdict for r in none.collect()} == {"allow"} and none.count() == len(rows)


def test_secret_candidates_match_brute_force(spark):
    run = "[A-Za-z0-9_+/=-]"
    rng = random.Random(9)
    parts = ["token", "=", '"', "deadbeefdeadbeef1234", "short1", "averylongwordwithoutdigits", "1234567890123456", "a_b-c/d+e=f0123456789", ",", " ", "\n", "é", "key:", "zz9" * 12, ": '", '= "', "w" * 45, " . . . ", "пароль"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(30)) for _ in range(60)] + [None, "", "x" * 5000, "1" * 5000, "1" * 20, "y " * 500_000 + "z = \"" + "q7" * 40 + "\"\n" + "w" * 1_000_000]
    rows = [(i, t, "src/test", "c", 1) for i, t in enumerate(texts)] * 2
    got = collections.Counter((r.doc_id, r.no, r.before, r.candidate, r.after, r.assigned) for r in secret_scan.candidates(spark.createDataFrame(rows, SCHEMA + ", candidate string, no int"), "doc_id", "text", "source").collect())
    want = collections.Counter()
    for i, t, *_ in rows:
        spans = [m.span() for m in re.finditer(rf"{run}{{16,}}", t or "") if re.search("[0-9]", m[0])]
        edges = [0, *itertools.chain(*spans), len(t or "")]
        for no, (a, b) in enumerate(spans):
            left, right = t[edges[2 * no] : a], t[b : edges[2 * no + 3]]
            # neighbours are words of ASCII letters, digits and underscores
            before, after = re.search(r"(?:^|\W)(\w{1,40})\W{1,4}$", left[-48:], re.A), re.search(r"^\W{1,4}(\w{1,40})(?:\W|$)", right[:48], re.A)
            assigned = bool(re.search("[=:]\\s?[\"']$", left)) and right[:1] in ("'", '"') and right != ""
            want[(i, no, before[1] if before else "", t[a:b], after[1] if after else "", assigned)] += 1
    assert got == want and sum(want.values()) > 60


def test_secret_forest_against_a_walk_and_on_held_out_candidates(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    found, known = secret_scan.candidates(docs, "doc_id", "text", "source").cache(), secret_scan.dictionary(docs)
    assert len(known) == secret_scan.DICTIONARY_WORDS == len(set(known))
    for without in ((), secret_scan.NEIGHBOURS):
        figures = secret_scan.held_out(found, known, spark, without=without)
        assert figures["secrets"] > 20 and figures["others"] > 50 and figures["precision"] > 0.95 and figures["recall"] > 0.95
    around = secret_scan.beside(found, secret_scan.label(found))
    made = secret_scan.findings_by_rule(spark)
    forest = secret_scan.train(secret_scan.label(found).select("before", "candidate", "after", "path", "is_secret"), around, known, made)
    rows = secret_scan.judge(found, forest, around, known).join(around.on(found).select("doc_id", "no", *[c.alias(n) for n, c in secret_scan.features(known).items()]), ["doc_id", "no"]).collect()
    assert len(rows) == found.count() > 400
    for r in rows:  # every score and verdict of the table
        assert abs(forest.score(r.asDict()) - r.score) < 1e-8 and r.is_secret == (r.score >= 0.5)
    counts = collections.Counter((r.before or "").lower() for r in found.collect())
    words = collections.defaultdict(set)
    for r in found.collect():
        words[(r.before or "").lower()].add(r.candidate)
    for r in around.on(found).collect():
        word = (r.before or "").lower()
        assert r["__before_n"] == counts[word] and abs(r["__before_fresh"] - len(words[word]) / counts[word]) < 1e-9


def overlapping_findings(seed, n=1500):
    """(before, candidate, after, path, assigned) where neither the candidate nor its neighbour tells by itself: hex digests are secrets
    behind words of keys only, and behind those words numbers and names are none."""
    rng = random.Random(seed)
    digits = lambda k, signs: "".join(rng.choice(signs) for _ in range(k))
    keys, plain = ["token", "apikey", "auth", "pass"], ["commit", "sha", "blob", "tree"]
    rows = []
    for i in range(n):
        kind = rng.randrange(6)
        candidate = digits(40, "0123456789abcdef") if kind in (0, 2) else digits(28, "abcXYZ0189+/") if kind in (1, 3) else digits(16, "0123456789") if kind == 4 else "_".join(rng.choices(secret_scan.NAMING, k=3)) + "_7"
        before = rng.choice(keys if kind in (0, 1) else plain if kind in (2, 3) else keys + plain)
        rows.append((i, 0, before, candidate, rng.choice(["the", "end", ""]), f"src/{rng.randrange(4)}/{'test' if rng.random() < 0.2 else 'main'}", kind in (0, 1)))
    return rows


def test_secret_labels_are_no_single_feature(spark):
    schema = "doc_id long, no int, before string, candidate string, after string, path string, assigned boolean"
    found = spark.createDataFrame(overlapping_findings(1), schema).cache()
    around = secret_scan.beside(found, secret_scan.label(found))
    rows = around.on(found).select("assigned", *[c.alias(n) for n, c in secret_scan.features().items()]).collect()
    for name in secret_scan.features():
        values = sorted({r[name] for r in rows})
        right = max(max(k := sum((r[name] <= t) == r.assigned for r in rows), len(rows) - k) for t in values)
        assert right < 0.9 * len(rows), name
    whole, alone = secret_scan.held_out(found), secret_scan.held_out(found, without=secret_scan.NEIGHBOURS)
    assert whole["precision"] > 0.95 and whole["recall"] > 0.95 and alone["precision"] < 0.8 < whole["precision"]


def test_a_repeated_finding_counts_as_one(spark):
    schema = "doc_id long, no int, before string, candidate string, after string, path string, assigned boolean"
    rows = overlapping_findings(2, 400) + [(9, 9, "commit", "f" * 39 + "0", "", "src", False)] * 20_000
    found = spark.createDataFrame(rows, schema).cache()
    around = secret_scan.beside(found, secret_scan.label(found))
    forest = secret_scan.train(secret_scan.label(found).select("before", "candidate", "after", "path", "is_secret"), around, max_findings=300)
    out = secret_scan.judge(found, forest, around).groupBy("assigned").agg({"is_secret": "max", "*": "count"}).collect()
    judged = secret_scan.judge(found.filter("doc_id != 9 or no != 9"), forest, around).collect()
    assert len(out) == 2 and sum(r.is_secret == r.assigned for r in judged) > 0.9 * len(judged)


def test_secret_scan_edge_cases(spark):
    made = secret_scan.findings_by_rule(spark, 2400)
    nothing = spark.createDataFrame([], "doc_id long, no int, before string, candidate string, after string, path string, is_secret boolean")
    around = secret_scan.beside(nothing)
    forest = secret_scan.train(nothing, around, made=made)
    docs = spark.createDataFrame([(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "src0", "x"), (2, "card 9807915762804490 here", None, "x"), (2, "card 9807915762804490 here", None, "x"), (None, None, None, None)], SCHEMA + ", score string")
    out = sorted((r.doc_id, r.is_secret) for r in secret_scan.scan(docs, forest, around).collect())
    assert [x[0] for x in out] == [1, 2, 2] and out[1] == out[2] == (2, False)
    assert secret_scan.scan(docs.limit(0), forest, around).count() == 0 and secret_scan.dictionary(docs.limit(0)) == []
    none = secret_scan.train(nothing, around)
    assert none.trees == [] and all(r.is_secret for r in secret_scan.scan(docs, none, around).collect())
    few = secret_scan.train(nothing, around, made=made, max_findings=500)
    assert len(few.trees) == 21


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_mixture(rows, block, cap=3, point=None):
    """Per document (by row number): target and the words (slot, pass, first, last) that the mixture holds."""
    by = collections.Counter()
    for _, t, s in rows:
        by[s] += size_of(t)
    names = sorted(s for s in by if s is not None) + [None] * (None in by)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(by.values()), set()
    while True:
        rest = total - sum(cap * by[s] for s in capped)
        share = rest / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and share * weight[s] > cap * by[s]}
        if not over:
            break
        capped |= over
    target = {s: cap * by[s] if s in capped else share * weight[s] for s in names}
    words = {s: int(target[s]) for s in names}
    every = sum(words.values())
    edges = list(itertools.accumulate((words[s] for s in names), initial=0))
    need = {s: -(-words[s] // block) for s in names}
    plan = {s: [] for s in names}
    slots = -(-every // block)
    for i in range(slots):
        u = point(i) if point else math.fmod(i * source_mixing.GOLDEN, 1.0)
        s = next(n for n, lo, hi in zip(names, edges, edges[1:]) if lo / every <= u < hi / every)
        if len(plan[s]) < need[s]:
            plan[s].append(i)
    for s in names:
        while len(plan[s]) < need[s]:
            plan[s].append(slots)
            slots += 1
    out = [[] for _ in rows]
    for s in names:
        turn = lambda i: hashlib.md5(f"1:{'' if rows[i][0] is None else rows[i][0]}:{size_of(rows[i][1])}".encode()).hexdigest()
        own = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (turn(i), rows[i][0] if rows[i][0] is not None else -1, size_of(rows[i][1])))
        at = 0
        for p in range(cap):
            for i in own:
                n = size_of(rows[i][1])
                for x in range(at, min(at + n, words[s])):
                    slot = plan[s][x // block]
                    if out[i] and out[i][-1][:2] == [slot, p] and out[i][-1][3] == x - at - 1:
                        out[i][-1][3] += 1
                    else:
                        out[i].append([slot, p, x - at, x - at])
                at += n
    return target, by, out


def shown(pieces):
    return hashlib.md5(";".join(f"{s}:{p}:{a}-{b}" for s, p, a, b in sorted(pieces)).encode()).hexdigest() if pieces else None


@pytest.mark.parametrize("cap", [3, 5])
def test_mixing_matches_brute_force(spark, corpus, cap):
    rows = [*corpus, (None, "n u l l", "s9"), (9001, "a " * 700, None), (9002, None, "t"), (9003, "", "t")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, size string, slot long")
    got = source_mixing.mix(docs.repartition(3), block=16, cap=float(cap)).collect()
    target, by, held = brute_mixture(rows, 16, cap)
    want = collections.Counter()
    for (d, t, s), pieces in zip(rows, held):
        want[(d, s, size_of(t), by[s], round(target[s], 6), sum(b - a + 1 for _, _, a, b in pieces), min((p[0] for p in pieces), default=None), len(pieces), shown(pieces))] += 1
    assert collections.Counter((*r[:4], round(r.target, 6), *r[5:]) for r in got) == want
    again = source_mixing.mix(docs.repartition(5), block=16, cap=float(cap))
    assert collections.Counter(map(tuple, again.collect())) == collections.Counter(map(tuple, got))
    assert source_mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_repeated_rows_and_ties(spark, corpus):
    rows = [*corpus[:8], *corpus[:8], (3, corpus[3][1].replace("w", "v"), corpus[3][2])]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = source_mixing.mix(docs.repartition(3), block=16).collect()
    target, by, held = brute_mixture(rows, 16)
    taken, want = collections.Counter(), collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= 1 for s in by)
    again = source_mixing.mix(docs.repartition(5), block=16).collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, got))


def test_the_schedule_decides_the_mixture(spark, corpus):
    """Another schedule, another result; and the golden one keeps every prefix near its shares."""
    docs = spark.createDataFrame(corpus, SCHEMA)
    digests = []
    for point in (source_mixing.golden, lambda i: (i * 0.25) % 1, lambda i: i / 10_000):
        got = source_mixing.mix(docs, block=16, point=point).collect()
        digests.append({r.doc_id: r.slots_md5 for r in got})
    changed = lambda a, b: sum(a[d] != b[d] for d in a) / len(a)
    assert changed(digests[0], digests[1]) > 0.5 and changed(digests[0], digests[2]) > 0.5
    sources = spark.createDataFrame([(1, 0, 20_000), (2, 20_000, 30_000), (3, 50_000, 50_000)], "sid long, before long, words long")
    slots = sorted(map(tuple, source_mixing.schedule(sources, 10).collect()))
    assert collections.Counter(s for _, s, _ in slots) == {1: 2000, 2: 3000, 3: 5000} and len({i for i, _, _ in slots}) == 10_000
    for s in (1, 2, 3):
        assert [r for _, x, r in slots if x == s] == list(range((2000, 3000, 5000)[s - 1]))
    seen = collections.Counter()
    for i, (_, s, _) in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[x] - i * p) <= 2 + 1.5 * math.log(i + 1) for x, p in ((1, 0.2), (2, 0.3), (3, 0.5)))


def test_mixing_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 5), f"host{i % 700}") for i in range(2100)]
    got = source_mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.taken for r in got) == sum(int(t) for t in {r.source: r.target for r in got}.values())


MODEL = pytest.importorskip("threadloom.llm.piece_sampling").MODEL


def test_sampling_follows_the_exact_distribution():
    from threadloom.llm import piece_sampling as ps
    from threadloom.llm.words import mix

    v = ps.Vocabulary(open(MODEL, "rb").read())
    weight = {v.spelled[i]: (int(i), w) for _, ids, ws in v.tables.values() for i, w in zip(ids, ws) if i >= 0}

    def every(b):
        if not b:
            yield (), 0.0
        for n in range(1, len(b) + 1):
            if b[:n] in weight:
                i, w = weight[b[:n]]
                for rest, x in every(b[n:]):
                    yield (i, *rest), w + x

    found = list(every(b" a hat"))
    z = np.logaddexp.reduce([x for _, x in found])
    p = {s: math.exp(x - z) for s, x in found}
    n = 8000
    rows = ps.Batch(v, pa.array(["a hat"] * n), mix(np.arange(n, dtype=np.uint64))).sample(2)
    first, second = (collections.Counter(tuple(r[i][0].tolist()) for r in rows) for i in (0, 1))
    for s in sorted(p, key=p.get, reverse=True)[:3]:
        follow = sum(p[a] * p[s] / (1 - p[a]) for a in p if a != s)
        assert abs(first[s] / n - p[s]) < 0.02 and abs(second[s] / n - follow) < 0.02
    assert all(tuple(r[0][0]) != tuple(r[1][0]) for r in rows)
    assert abs(np.mean([sum(math.exp(lp) / q for _, lp, q in r) for r in rows]) - 1) < 0.03  # inclusion scores weigh an unbiased sum


def test_sampling_round_trip_and_edge_cases(spark, corpus):
    from threadloom.llm import piece_sampling as ps

    v = ps.Vocabulary(open(MODEL, "rb").read())
    rows = [*corpus[:30], (950, "  日本語 𓀀\n\tx  ", "s"), (951, "a" * 3000, "s"), (None, "null key", "s"), (952, None, "s"), (953, "", "s"), (950, "  日本語 𓀀\n\tx  ", "s")]
    out = ps.sample_segmentations(spark.createDataFrame(rows, SCHEMA).repartition(2), k=3).collect()
    texts = {d: t for d, t, _ in rows}
    by = collections.defaultdict(list)
    for r in out:
        assert r.round_trip and ps.decode_ids(v, r.ids) == (texts[r.doc_id] or "") and r.n_pieces == len(r.ids) and 0 < r.inclusion <= 1
        by[r.doc_id].append(tuple(r.ids))
    assert len(by[952]) == len(by[953]) == 1 and len(by[951]) == 3
    assert sorted(by[950]) == sorted(list(set(by[950])) * 2)
    assert all(len(set(x)) == len(x) for d, x in by.items() if d != 950)
    again = ps.sample_segmentations(spark.createDataFrame(rows, SCHEMA).repartition(5), k=3).collect()
    order = lambda rows: sorted((str(r.doc_id), r.sample, tuple(r.ids), r.log_prob, r.inclusion) for r in rows)
    assert order(again) == order(out)
    assert ps.sample_segmentations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plain_encoding_agrees_with_the_library(spark, corpus):
    import sentencepiece
    from threadloom.llm import piece_sampling as ps

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [*corpus, (960, "  日本語 𓀀\n\tx  ", None), (None, "é" * 50_000, "s")]
    docs = spark.createDataFrame([(*r, [1], 7) for r in rows], SCHEMA + ", ids array<int>, n_pieces long")
    out = ps.encode(docs.repartition(3)).collect()
    texts = {d: t for d, t, _ in rows}
    assert len(out) == len(rows) and all(list(r.ids) == sp.encode(texts[r.doc_id] or "") and r.n_pieces == len(r.ids) for r in out)
    back = ps.decode(ps.encode(docs)).collect()
    assert all(r.text == sp.decode(list(r.ids)) for r in back if "日" not in r.text and r.ids)
    sampled = ps.decode(ps.sample_segmentations(docs, k=2)).collect()
    assert {(r.doc_id, r.text) for r in sampled} == {(d, t or "") for d, t in texts.items()}
    for r in sampled:  # the library reads the samples as the same text
        assert sp.decode(list(r.ids)) == r.text or r.text != " ".join(r.text.split(" ")) or r.text[:1] == " "


def test_samples_of_a_megabyte_and_of_many_chunks(spark):
    from threadloom.llm import piece_sampling as ps

    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(170_000))
    docs = spark.createDataFrame([(1, text, "a"), (2, text[:50_000], "a"), (3, "x" * 300_000, "a")], SCHEMA)
    out = ps.sample_segmentations(docs, k=2).collect()
    assert len(out) == 6 and all(r.round_trip for r in out) and len({tuple(r.ids) for r in out}) == 6
    again = ps.sample_segmentations(docs.filter("doc_id = 2"), k=2).collect()
    assert sorted((r.sample, r.log_prob, r.inclusion) for r in again) == sorted((r.sample, r.log_prob, r.inclusion) for r in out if r.doc_id == 2)
