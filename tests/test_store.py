from __future__ import annotations

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from ventus.operators import extract
from ventus.sources import files, knowledge, store


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿plain")
    (tmp_path / "b.MD").write_text("# head")
    (tmp_path / "c.exe").write_text("no")
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t><w:br/><w:t>x</w:t></w:r></w:p></w:body></w:document>'
    with zipfile.ZipFile(held := io.BytesIO(), "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "d.docx").write_bytes(held.getvalue())
    got = {r.path.rpartition("/")[2]: (r.source_type, r.text) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("txt", "plain"), "b.MD": ("txt", "# head"), "d.docx": ("doc", "One\n\nTwo\nx")}


def test_chunks_are_stored_whole(spark, tmp_path):
    chunks = spark.createDataFrame([("s1", 0, "x"), ("s1", 1, "y")], "source_id string, chunk_index int, content string")
    assert store.promote(chunks, "s1", str(tmp_path / "k"))
    assert not store.promote(chunks.limit(0), "s2", str(tmp_path / "k"))
    assert store.promote(chunks.limit(1), "s1", str(tmp_path / "k"))
    back = spark.read.parquet(str(tmp_path / "k"))
    assert back.count() == 1 and back.first().source_id == "s1"


def test_updates(spark):
    src = spark.createDataFrame([("a", "active"), ("b", "active")], "id string, status string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    assert {(r.id, r.status, r.updated_at is None) for r in store.with_status(src, "a", "inactive").collect()} == {("a", "inactive", False), ("b", "active", True)}
    with pytest.raises(ValueError):
        store.with_status(src, "a", "gone")
    m = spark.range(1).select(store.merged_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3"))).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}
    conv = spark.createDataFrame([("1", None), ("2", "Bo")], "phone string, name string")
    named = store.with_names(conv, spark.createDataFrame([("1", "Al"), ("2", "Cy")], "phone string, name string"))
    assert {(r.phone, r.name) for r in named.collect()} == {("1", "Al"), ("2", "Bo")}
    chunks = spark.createDataFrame([("a", False, [1.0]), ("a", True, None), ("b", False, None)], "source_id string, structured boolean, embedding array<float>")
    got = {r.source_id: r.status for r in store.reprocessed(chunks, spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")).collect()}
    assert got == {"a": "active", "b": "error", "c": "error"}
    msgs = spark.createDataFrame([("1", "user", "hi")], "conversation_id string, role string, content string")
    assert store.manual_reply(msgs.withColumn("source", F.lit("chat")).withColumn("created_at", F.current_timestamp()), "1", " ok ").where("role = 'human' and content = 'ok'").count() == 1


def test_sources_and_chunks(spark):
    sources = spark.createDataFrame([("a", "T", "txt", None, "active", "f.txt"), ("b", "U", "txt", None, "inactive", "g.txt")], "id string, title string, source_type string, source_url string, status string, file_path string")
    chunks = spark.createDataFrame([("1", "a", "old", "pdf", "u", "x", 1), ("2", "b", "t", "pdf", "u", "y", 2)], "id string, source_id string, title string, source_type string, source_url string, content string, created_at int")
    rows = knowledge.active_chunks(chunks, sources).collect()
    assert [(r.id, r.title, r.source_type, r.source_url) for r in rows] == [("1", "T", "txt", "u")]
    new = sources.select("title", "source_type", "source_url", "file_path")
    assert [r.title for r in knowledge.duplicate_sources(new, sources).collect()] == ["T"]
    batches = knowledge.record_batches(spark.createDataFrame([(k, f"v{k}" * 900, None) for k in range(9)], "seq int, a string, b string"), "f.csv", ["a", "b"]).orderBy("chunk_index").collect()
    assert sum(r.n_records for r in batches) == 9 and len(batches) > 1 and batches[0].content.startswith("CSV dataset: f.csv\nColumns: a, b\n\nRecord 1\na: v0")


def test_rules(spark):
    snippets = spark.createDataFrame([("1", "Nothing here to see at all today, I fear. In 2023 wildfires raised pollution in Canada by half.")], "id string, text string")
    assert extract.extract(snippets, "What about wildfires?", "id", "text") == ["In 2023 wildfires raised pollution in Canada by half."]
    assert extract.extract(snippets, "Rank them", "id", "text") == []
