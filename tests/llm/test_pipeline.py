"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import re

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_in_turn(spark, sf_dir):
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == before.columns
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert ids["toxicity"] <= set(texts)
    grams = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(t.lower())] for i in range(len(w) - 4)}
    kept = [grams(r.text) for r in seen["near_duplicates"] if len(WORD.findall(r.text)) >= 5]
    assert not any(100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(kept) for b in kept[k + 1 :] if a and b)
    windows = set()
    for r in sorted(seen["repeated_spans"], key=lambda r: r.doc_id):
        assert r.n_chars == len(r.text)
    for r in sorted(seen["near_duplicates"], key=lambda r: r.doc_id):
        w = WORD.findall(r.text)
        windows |= {tuple(w[i : i + 20]) for i in range(len(w) - 19)}
    assert ids["mixing"] == ids["repeated_spans"] == ids["bpe"]
    assert len(seen["bpe"]) == len(seen["mixing"]) >= len(seen["repeated_spans"])
    left = {r.doc_id: r.text for r in seen["repeated_spans"]}
    for i in left:
        if left[i] != texts[i]:
            assert len(WORD.findall(left[i])) < len(WORD.findall(texts[i]))
    assert windows


def test_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty texts, repeated rows, clashing columns; then no rows at all."""
    span = " ".join(f"s{k}" for k in range(30))
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "  \n", "en", "a", 3), (4, span + " x", "en", "a", 9), (4, span + " x", "en", "a", 9), (4, "other words", "fr", "a", 9), (None, "no id here", "en", "a", 9), (None, None, None, None, None), (5, "y " + span, "xx", "b", 9), (6, span + " x", "en", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as _row", "2 as score", "3 as key_a", "'z' as spans")
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, 0, 1), (None, 1, 1), (99, 1, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    for k, (d, y) in enumerate(((docs, labels), (docs.limit(0), labels.limit(0)), (docs, labels.limit(0)))):
        d.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        y.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert len(out) == 0 if k == 1 else {1, 2, 3, 4, None} <= {r.doc_id for r in out}
        assert 6 not in {r.doc_id for r in out}
