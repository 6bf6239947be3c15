"""Steps that must not cost more than what they are given."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ventus import catalog_questions
from ventus.catalog_text import QUERIES
from ventus.functions import search_text as st
from ventus.functions import vectors
from ventus.operators.postings import Postings

PARTS = ["wild", "fires", "u.s.", "U. S", "usa", "United", "States", "pm", "2.", "5", "pm2.5", "south", "Asia", "highlights", "story", "fine", "particulate", "matter", "more", "than", "up", "from", "rise", "fell", "trend", "changing", "%", "ñ", "lower", "us", "rose", "\n", "\t ", ".", "of"]


def test_words_are_those_of_all_rewrites(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) + rng.choice([" ", " ", "  ", "", "\n"]) for _ in range(rng.randint(0, 4))) for _ in range(3000)]
    each = F.lower("t")
    for pattern, to in st.REWRITES:
        each = F.regexp_replace(each, pattern, to)
    each = F.trim(F.regexp_replace(each, r"\s+", " "))
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", st.search_words("t").alias("w"), st.normalize_search_text("t").alias("n"), each.alias("each")).collect()
    for r in rows:
        assert (r.w, r.n) == (None if r.t is None else r.each.split(), r.each)


def test_term_frequency_exchanges_texts_not_words(spark, sf_dir):
    plan = QUERIES["term_frequency"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(doc_id#" in plan and "hashpartitioning(doc_id#" in plan.split("Generate")[-1]


def test_texts_to_compare_are_normalised_once(spark, sf_dir):
    plan = QUERIES["token_overlap"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "lower(" not in plan


def test_equal_questions_are_read_once(spark, tmp_path):
    n = 60 * len(catalog_questions.KINDS) * 90
    spark.range(n).select((F.col("id") % (len(catalog_questions.KINDS) * 90)).alias("c_custkey"), F.lit(3).alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(3, "CHINA")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    rows = catalog_questions.questions_read(spark, str(tmp_path))
    assert "MapInPandas" in rows._jdf.queryExecution().optimizedPlan().toString() and "Aggregate" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert rows.count() == n


def test_weights_are_those_of_the_embedding(spark):
    texts = ["the burning of fields, the burning", "", None, "a an", "monitors-of x.y 2.5 longer words here"] * 60
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = vectors.hash_weights(rows, "id", "text").toPandas().sort_values(["id", "bucket"])
    want = [(k, b, v[b]) for k, t in enumerate(texts) for v in [vectors.embed(t or "").astype(np.float32)] for b in np.flatnonzero(v)]
    pd.testing.assert_frame_equal(got.reset_index(drop=True), pd.DataFrame(want, columns=["id", "bucket", "weight"]).astype({"weight": "float32"}))
    assert vectors.fnv1a.cache_info().maxsize <= 1 << 16


def test_an_index_stores_no_keys_of_terms(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "index"))
    text = "The burning of fields in the north was measured by many monitors during the long winter of 2019 there."
    index.write(spark.createDataFrame([("s", "1", text, "Fields", None, "txt")], "source_id string, id string, content string, title string, page_title string, source_type string"))
    assert not (tmp_path / "index" / "keys").exists() and index.table("chunks").first().title == "fields"
    found = index.rank(spark.createDataFrame([(1, "buring monitors")], "question_id int, question string")).collect()
    assert [(r.id, r.n_matched) for r in found] == [("1", 2)]
