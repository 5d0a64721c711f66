"""The pipeline against a brute-force version of its filtering stages, and its registration."""

import re

import corpus_pipeline
from threadloom.llm import piece_sampling, quality_rules

from .test_text_operators import brute_classes, brute_lines


def test_pipeline_stages_on_a_small_table(spark, corpus, tmp_path):
    rows = [(d, t, "en", s, len(t or "")) for d, t, s in corpus]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs.write.parquet(str(tmp_path / f"s{i}"))
            docs = spark.read.parquet(str(tmp_path / f"s{i}"))
            seen.append({r.doc_id: r.text for r in docs.collect()})
    stats = quality_rules.text_statistics(spark.createDataFrame(corpus, "doc_id long, text string, source string"), keep=["doc_id"])
    passed = {r.doc_id for r in stats.filter(~quality_rules.base_failed()).collect()}
    assert seen[0] == {d: t for d, t, _ in corpus if d in passed}
    want = brute_lines([(d, t, None) for d, t in seen[0].items()])
    assert seen[1] == {d: x[2] for d, x in want.items() if x[1] == 0 or x[1] < x[0]}
    classes = brute_classes([(d, t, None) for d, t in seen[1].items()])
    assert seen[2] == {d: t for d, t in seen[1].items() if classes[d][1] == d}
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    total = sum(len(words(t)) for t in seen[2].values())
    taken = sum(len(words(r.text)) for r in spark.read.parquet(str(tmp_path / "s3")).collect())
    assert abs(taken - total) <= 6
    made = docs.collect()
    assert len(made) == 2 * spark.read.parquet(str(tmp_path / "s3")).count()
    vocabulary = piece_sampling.Vocabulary(open(piece_sampling.MODEL, "rb").read())
    mixed = {r.text for r in spark.read.parquet(str(tmp_path / "s3")).collect()}
    assert {piece_sampling.decode_ids(vocabulary, r.ids) for r in made} == mixed


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "a"), (1, text, "a"), (2, text, "a"), (None, text, "a"), (None, text, "a"), (3, "other words", "a"), (3, "second text of the id", "a"), (None, None, None)]
    out = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "3", "None", "None"]


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, n_removed string, component_id string, slot string, size string, ids string, `pass` string"


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (1, 0, 0), (77, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    text = "one two three four five six seven eight nine ten eleven twelve"
    row = lambda i, t, s: (i, t, "en", s, 5, *"abcdefgh")
    rows = [row(1, text, "a"), row(1, text, "a"), row(None, text + " end", None), row(2, None, "a"), row(3, "", "b"), row(4, text.replace("o", "u") + "\n" + "x" * 200_000, "b")]
    for given, least in ((rows, 3), ([], 0)):
        docs = spark.createDataFrame(given, EXTRA)
        names = docs.columns
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if i < 4:
                assert docs.columns == names
                docs.write.mode("overwrite").parquet(str(tmp_path / f"e{i}"))
                docs = spark.read.parquet(str(tmp_path / f"e{i}"))
                assert all(r.n_words == "a" and r["pass"] == "h" and r.n_chars in (5, len(r.text)) for r in docs.collect())
        assert docs.count() >= 2 * least if least else docs.count() == 0


def test_mixture_follows_its_slots(spark, corpus):
    """Each source's words match its target, every pass is a prefix of its document, and rows come in the order of slots."""
    from threadloom.llm import source_mixing

    rows = [(d, t, "en", s, len(t or "")) for d, t, s in corpus] + [(5, "again again", "en", "s1", 11)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mixture(spark, docs, "").collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    texts = {}
    for d, t, _, s, _ in rows:
        texts.setdefault((d, s), []).append(words(t))
    taken = {}
    for r in out:
        w = words(r.text)
        assert any(w == full[: len(w)] for full in texts[r.doc_id, r.source])
        taken[r.source] = taken.get(r.source, 0) + len(w)
    want = {r.source: int(r.target) for r in source_mixing.mix(docs).select("source", "target").distinct().collect()}
    assert taken == {s: n for s, n in want.items() if n}


def test_entry_registers_all_operators():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
