"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ventus.llm import bpe, centroids, codes, html, mixing, neardup, oracle, quality, secrets, suffixes, tokens, toxicity, vectors, wordspans
from ventus.llm.shelf import Shelf


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1's rules look at, and its base check."""
    return quality.text_stats(_table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, quality.base_failed().alias("base_failed"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"), emit=suffixes.Digest(), size=100)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), may_learn=~_is_held_out())
    return toxicity.score(docs, model).select("doc_id", _is_held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), "word_bpe_49k.json").withColumn("over_limit", F.col("n_tokens") > 2048)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), targets, "lang")


def op7_word_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordspans.remove_repeats(_table(spark, sf_dir, "documents"), emit=wordspans.Digest(), size=20)


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), least=0.93)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", emit=bpe.Digest())


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(*centroids.cluster(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, seed=3, dim=64, scale=1024), Shelf(spark))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.digest(*codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256), Shelf(spark))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


QUERIES = {
    "text_stats": text_stats,
    "op1_quality_rules": op1_quality_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_suffix_arrays": op3_suffix_arrays,
    "op4_toxicity": op4_toxicity,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_word_spans": op7_word_spans,
    "op8_near_vectors": op8_near_vectors,
    "op9_main_text": op9_main_text,
    "op10_bpe": op10_bpe,
    "op11_clusters": op11_clusters,
    "op12_vector_codes": op12_vector_codes,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {
    "text_stats": oracle.TEXT_STATS,
    "op2_near_duplicates": oracle.NEAR_DUPLICATES,
    "op3_suffix_arrays": oracle.BYTE_STRINGS,
    "op7_word_spans": oracle.WORD_SPANS,
    "op8_near_vectors": oracle.NEAR_VECTORS,
    "op11_clusters": oracle.CLUSTERS,
    "op12_vector_codes": oracle.VECTOR_CODES,
    "op13_secrets": oracle.SECRETS,
}
