"""Word BPE against the tokenizers library, and the lexicon automaton against a dict."""

import hashlib
import random

import numpy as np
import pytest

from threadloom.llm import queries, word_bpe

from .conftest import SCHEMA

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_bpe.MODEL)


@pytest.fixture(scope="module")
def model():
    return word_bpe.Model(open(word_bpe.MODEL, encoding="utf-8").read())


ODD = [
    "It's we'll I'D 'S''s x'ree", "ΟΔΟΣ Σ ὈΔΥΣΣΕΎΣ", "İstanbul ẞ ß ﬁ", "é ạ̇ ạ̇ 각", "日本語テキスト 한국어", "12,345.67 Ⅷ ½ ٣", "a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endof text|>",
    " x y\u0085z᠎​\x1c\x1f\x00", "😀👩‍👩‍👧 ♥️", "ᲉꟚ \U00010d50 ͸ xꟋy", "!!!???... --- ́x", "<|" * 50, "\t\n\r ", "x" * 3000, "ab" * 2000 + "é" * 500,
]


def want(library, rows):
    out = {}
    for r, e in zip(rows, library.encode_batch([r[1] or "" for r in rows], add_special_tokens=False)):
        ids = hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        out[r[0]] = (len(e.ids), ids, hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest())
    return out


def test_encoding_and_decoding_match_the_library(spark, library, corpus, tmp_path):
    rng = random.Random(3)
    signs = ["a", "É", "ñ", "Σ", "'", "s", "1", " ", "\n", "<|endoftext|>", "́", "ﬀ", "中", "͸", "-", "Q", " "]
    rows = [*corpus, *((2000 + i, t, None) for i, t in enumerate(ODD)), *((3000 + i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 60))), "r") for i in range(300)), (None, "no id", "x")]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op11_word_bpe(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out} == want(library, rows)
    # the lexicon changes no id
    docs = spark.createDataFrame(rows, SCHEMA)
    for words in (0, 7):
        name = word_bpe.build(docs, words=words)
        got = word_bpe.decode(word_bpe.encode(docs, name)).select("doc_id", "n_tokens", word_bpe.digest(), "text").collect()
        assert {r[0]: (r[1], r[2], hashlib.sha256(r[3].encode()).hexdigest()) for r in got} == want(library, rows)


def test_encoding_of_very_long_texts_and_of_nothing(spark, library, monkeypatch):
    rng = random.Random(4)
    prose = " ".join(rng.choice(["The", "tion", "straße", "it's", "v1.2"]) + rng.choice(["", "er", "\n"]) for _ in range(400_000))
    rows = [(1, prose, "x"), (2, "".join(rng.choice("abcde") for _ in range(400_000)), "x"), (2, None, "x"), (3, prose[:50], "x")]
    docs = spark.createDataFrame([(d, t, "clash") for d, t, _ in rows], "doc_id long, text string, ids string")
    name = word_bpe.build(docs)
    got = sorted((r.doc_id, r.n_tokens, r.d) for r in word_bpe.encode(docs, name).select("doc_id", "n_tokens", word_bpe.digest().alias("d")).collect())
    assert got == sorted((r[0], *want(library, [r])[r[0]][:2]) for r in rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert word_bpe.decode(word_bpe.encode(empty, word_bpe.build(empty))).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in word_bpe.decode(nulls).collect()} == {1: None, 2: ""}


def test_stretches_change_nothing(library, model, tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(word_bpe.compile_lexicon([b"the", b"a"], model))
    work = word_bpe.Encoder(model, word_bpe.Lexicon(str(path)))
    text = " ".join(ODD)
    whole = library.encode(text, add_special_tokens=False).ids
    for limit in (1, 5, 64):
        assert [x for part in word_bpe.stretches(text, limit) for x in work.encode([part])[1].tolist()] == whole


def test_lexicon_is_minimal_and_numbers_its_words(model, tmp_path):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))).encode() + rng.choice([b"", b"ing", b"er"]) for _ in range(600)})
    arcs, final = word_bpe.minimal_automaton(words)
    rights = set()  # one state for each set of endings
    for w in [b"", *words]:
        for i in range(len(w) + 1):
            rights.add(frozenset(x[i:] for x in words if x.startswith(w[:i])))
    assert len(final) == len(rights) and sum(map(len, arcs)) < sum(map(len, words)) / 2
    path = tmp_path / "lexicon"
    path.write_bytes(word_bpe.compile_lexicon(words, model))
    lexicon = word_bpe.Lexicon(str(path))
    other = [w + b"x" for w in words] + [w[:-1] for w in words if w[:-1] not in set(words)] + [b"", b"zzz"]
    assert lexicon.numbers(words).tolist() == list(range(len(words))) and (lexicon.numbers(other) == -1).all()
    for i, w in enumerate(words):
        assert lexicon.ids[lexicon.first[i] : lexicon.first[i + 1]].tolist() == model.merge(w)


def test_pieces_that_occur_again_are_not_cut_again(library, model, tmp_path):
    path = tmp_path / "lexicon"
    path.write_bytes(word_bpe.compile_lexicon([b"word"], model))
    work = word_bpe.Encoder(model, word_bpe.Lexicon(str(path)))
    find, seen = work.split._find, []
    work.split._find = lambda text: seen.append(text) or find(text)
    text = " ".join(f"Word{i % 700}'s, it" for i in range(70_000))
    n, ids = work.encode([text, text])
    assert ids.tolist() == 2 * library.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids) // 2] * 2
    assert sum(map(len, seen)) < 20_000  # the texts have 1.9 million code points


def test_pieces_hold_the_words_of_the_library(library, model):
    split = word_bpe.Splitter(model)
    back = {s: b for b, s in enumerate(word_bpe.byte_signs())}
    for text in [*ODD, "a\x1cb \x1d\x1e! c\u2028d\xa0e\u3000f", "'S'RE x'sy ''s !'s 's's"]:
        plain = text.replace("<|endoftext|>", " ").replace("<|startoftext|>", " ")
        want = [bytes(back[c] for c in w).decode() for w, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(plain))]
        assert [w for piece in split(plain) for w in split.words(piece)] == want


def test_forgotten_pieces_change_nothing(library, model, tmp_path, monkeypatch):
    path = tmp_path / "lexicon"
    path.write_bytes(word_bpe.compile_lexicon([b"the", b"a"], model))
    work = word_bpe.Encoder(model, word_bpe.Lexicon(str(path)))
    for held, stretch in ((3, 40), (30, 7)):
        monkeypatch.setattr(word_bpe, "HELD", held)
        monkeypatch.setattr(word_bpe, "STRETCH", stretch)
        n, ids = work.encode(ODD)
        want = [library.encode(t, add_special_tokens=False).ids for t in ODD]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_words_merged_together_are_those_merged_alone(model):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeinorst'-é中") for _ in range(rng.randint(1, 30))).encode() for _ in range(3000)] + [b"a", b"aaaa" * 12, b"\xff\x00", b"the"] + [bytes([b]) for b in range(256)]
    first, ids = word_bpe.Merger(model)(words)
    assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [model.merge(w) for w in words]
    first, ids = word_bpe.Merger(model)([])
    assert first.tolist() == [0] and not len(ids)


def test_frequent_words_stay_within_the_bound(spark):
    counts = spark.createDataFrame([(f"w{i}", 1000 - i if i < 20 else 1) for i in range(500)], "word string, n long")
    for most in (0, 1, 20, 100, 1000):
        got = word_bpe.frequent(counts, most)
        assert len(got) == len(set(got)) == min(most, 500) and (most < 100 or {f"w{i}" for i in range(20)} <= set(got))
