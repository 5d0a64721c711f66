"""The registered queries of this subpackage: ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import conversation_repair, embedding_dedup, line_dedup, ngram_join, pii_surrogates, piece_sampling, quality_rules, secret_scan, source_mixing, spelling_variants, store, substring_dedup, url_filters, word_bpe


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of three-line windows that occur earlier."""
    out = line_dedup.remove_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by shingles of five words and a similarity of 0.8."""
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by cosine of 0.9 or more."""
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds personal data, with surrogates in its place."""
    out = pii_surrogates.replace(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.filter("n_entities > 0").select("doc_id", "n_entities", "entities", "text")


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document; the ids as a digest."""
    out = piece_sampling.sample_segmentations(read(spark, sf_dir, "documents"), k=2)
    return out.select("doc_id", "sample", "n_pieces", "log_prob", "inclusion", F.xxhash64("ids").alias("ids_xxhash64"), "round_trip")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of the five rules on every page."""
    rules = spark.sql(f"SELECT * FROM ({url_filters.RULES}) AS t(action, host, path)")
    return url_filters.judge(read(spark, sf_dir, "pages"), rules)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mixture takes, and in which of its slots."""
    return source_mixing.mix(read(spark, sf_dir, "documents")).drop("source")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document with its score; the secret itself only as a digest."""
    docs = read(spark, sf_dir, "documents")
    found, known = store.table(secret_scan.candidates(docs, "doc_id", "text", "source"), "candidates"), secret_scan.dictionary(docs)
    learn = secret_scan.label(found).select("before", "candidate", "after", "path", "is_secret")
    around = secret_scan.beside(found, learn)
    # findings made by rule stand for the kinds that this corpus lacks
    forest = secret_scan.train(learn, around, known, secret_scan.findings_by_rule(spark))
    out = secret_scan.judge(found, forest, around, known)
    return out.select("doc_id", "no", "before", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("n_chars"), "score", "is_secret")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, the base rule, and the verdict of a list learnt from ``labels``."""
    docs = read(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, read(spark, sf_dir, "labels"))
    return quality_rules.judge(quality_rules.text_statistics(docs, keep=["doc_id"]), rules)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word windows that a smaller doc_id also holds."""
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, encoded and decoded, as digests."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = word_bpe.decode(word_bpe.encode(docs, word_bpe.build(docs)))
    return out.select("doc_id", "n_tokens", word_bpe.digest("ids").alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash, with its faults, its cheapest repair and a digest of the repaired rows."""
    rows = read(spark, sf_dir, "conversations")
    return conversation_repair.with_all(conversation_repair.digests(conversation_repair.repair(conversation_repair.damage(rows))), rows)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, some of which lose a letter by a hash, with their near words, forms and roots."""
    return spelling_variants.variants(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_join, op3_embedding_dedup, op4_pii_surrogates, op5_piece_sampling, op6_url_filters, op7_secret_scan, op8_quality_rules, op9_substring_dedup, op10_source_mixing, op11_word_bpe, op12_conversation_repair, op13_spelling_variants)}
ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE, "op2_ngram_join": ngram_join.ORACLE, "op3_embedding_dedup": embedding_dedup.ORACLE, "op6_url_filters": url_filters.ORACLE,
    "op9_substring_dedup": substring_dedup.ORACLE, "op10_source_mixing": source_mixing.ORACLE,
}
