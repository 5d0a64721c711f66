"""A corpus pipeline from raw documents to token samples.

Each stage calls one operator on all rows that its predecessor kept. All but the
last return the columns of ``documents``; between stages the rows are written
as Parquet and read again.

Edge cases, in all stages: an empty table gives an empty result; columns beyond
those of ``documents`` pass through, whatever their names; very long texts are
handled as wholes. Null texts fail the base rule. Null ids are kept; they take
no part in line dedup and near duplicates, beyond that equal rows without an id
count as one. Of rows of one id, each text stays once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import line_dedup, ngram_join, piece_sampling, quality_rules, source_mixing, store

_WORDS = r"[\x20\x09-\x0D]+"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learnt list rejects go."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which nothing else was left."""
    whole = docs.select("doc_id", "text", _others(docs))
    out = line_dedup.remove_repeated_lines(whole).filter("n_removed = 0 or n_removed < n_lines")
    return _with_text(out, docs.columns, F.col("text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id; of equal rows one."""
    groups = ngram_join.near_duplicates(docs)
    others = groups.filter("component_id != doc_id").select(F.col("doc_id").alias("__other")).distinct()
    # rows without an id are spread by their text; the list grows with the corpus: never broadcast
    keyed = docs.withColumns({"__key": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "__th": F.xxhash64("text")})
    rest = keyed.join(others.hint("merge"), (F.col("__key") == F.col("__other")) & F.col("doc_id").isNotNull(), "left_anti")
    return rest.dropDuplicates(["__key", "doc_id", "__th"]).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's documents in the order of its slots: a row for each pass through a document, cut to the words that the slots hold."""
    columns = [f.name for f in docs.schema if not f.dataType.simpleString().startswith("map")]
    keyed = docs.withColumn("__th", F.xxhash64(*columns))
    _, held = source_mixing.mixture(keyed, carry=["__th"])
    passes = held.groupBy("sid", "at", F.col("doc_id").alias("__id"), F.col("__th").alias("__t"), "pass").agg(F.min("slot").alias("__slot"), (F.max("last_word") + 1).alias("__words"))
    whole = keyed.dropDuplicates(["doc_id", "__th"]).select("__th", "doc_id", "text", _others(docs))
    rows = whole.join(passes.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__t")))
    cut = F.array_join(F.slice(F.filter(F.split("text", _WORDS), lambda w: w != ""), F.lit(1), F.col("__words").cast("int")), " ")
    text = F.when(F.col("__words") == F.regexp_count("text", F.lit(source_mixing.WORD)), F.col("text")).otherwise(cut)
    ordered = rows.select("__slot", "__row", text.alias("__text")).repartitionByRange("__slot").sortWithinPartitions("__slot")
    return _with_text(ordered, docs.columns, F.col("__text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each row, as piece ids."""
    return piece_sampling.sample_segmentations(docs, k=2).select("doc_id", "sample", "ids", "n_pieces", "log_prob", "inclusion")


def _others(docs: DataFrame) -> Column:
    """All columns but the text, in one, so that no name can clash."""
    return F.struct(*[c for c in docs.columns if c != "text"]).alias("__row")


def _with_text(rows: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``__row`` with another text, and its length where there is a column for it."""
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col("__row")[c].alias(c) for c in columns])


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding", pieces),
]

#: The learnt list and the sampled segmentations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.table(docs, "stage")
    return docs
