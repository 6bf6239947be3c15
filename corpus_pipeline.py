"""A corpus from raw documents: toxicity filter, near-duplicates, repeated spans, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns rows of documents (the last
one returns token counts and hashes).  Stages are written between, so each
reads what its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventus.llm import bpe, mixing, neardup, toxicity, wordspans
from ventus.llm.shelf import Shelf

#: Shares of all words that the languages shall have.
TARGETS = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels, doesn't reject."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the one of least id."""
    return neardup.keep_first(docs.select(*COLUMNS), shingle_words=5, percent=80)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every word goes that lies in a span of 20 words which also starts earlier; documents left without words go with them."""
    docs = docs.select(*COLUMNS)
    kept = wordspans.remove_repeats(docs, size=20)
    some = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return some.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the languages have their target shares; none is lost."""
    return mixing.apply_rates(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS, lossless=True)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of the ids and of the decoded text."""
    return bpe.round_trip(docs, "byte_bpe_50k.json", emit=bpe.Digest())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_each_group),
    ("repeated_spans", drop_repeated_spans),
    ("mixing", mix_to_targets),
    ("bpe", encode),
]

#: The stages learn models and draw hashes, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    shelf = Shelf(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shelf.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
