"""Sources into facts, limits, shortcuts, pages, kept engines and histories."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ventus.functions import search_text as st
from ventus.operators import search
from ventus.plans.answer import Engines
from ventus.sources import files, knowledge, records
from ventus.streaming import messages as stream


def tables(spark):
    sources = spark.createDataFrame(
        [("a", "World gadm0", "w.csv", "active", 1, 1), ("b", "old states", "gadm_1.CSV", "active", 1, 2), ("c", "states", "gadm1.csv", "active", 5, 3), ("d", "off gadm2", "x.csv", "inactive", 9, 4), ("e", "plain", "notes.csv", "active", 1, 5), ("f", "text", "t.txt", "active", 1, 6)],
        "id string, title string, file_path string, status string, at long, seq long",
    ).select("id", "title", "file_path", "status", F.timestamp_seconds("at").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), "seq")
    india = {"Country": "India", "Year": "2020", "PM2.5": "41"}
    rows = [
        ("a", 0, [india, india, {"Country": "Nepal", "Year": "2020", "pm25": "38", "": "x"}]), ("a", 1, [{"Country Name": "Chad", "PM2019": "50", "PM2020": "52"}, {}, None]),
        ("b", 0, [{"Country": "India", "State": "Old", "Year": "2020", "PM2.5": "1"}]), ("c", 0, [{"Country": "India", "State": "Goa", "Year": "2020", "PM2.5": "20"}]),
        ("d", 0, [{"District": "Off", "PM2.5": "3", "Year": "2020"}]), ("e", 0, [{"District": "Pune", "State": "Maha", "Country": "India", "Year": "2020", "PM2.5": "44"}]), ("f", 0, [india]),
    ]
    return sources, spark.createDataFrame(rows, "source_id string, chunk_index int, records array<map<string,string>>")


def test_facts_of_the_newest_sources(spark):
    facts = records.load_facts(*tables(spark)).collect()
    got = sorted((r.csv_level, r.country or "", r.state or "", r.district or "", r.year, r.pm25) for r in facts)
    assert got == [("gadm0", "Chad", "", "", 2019, 50.0), ("gadm0", "Chad", "", "", 2020, 52.0), ("gadm0", "India", "", "", 2020, 41.0), ("gadm0", "Nepal", "", "", 2020, 38.0), ("gadm1", "India", "Goa", "", 2020, 20.0), ("gadm2", "India", "Maha", "Pune", 2020, 44.0)]


def test_engines_are_kept_while_sources_stay(spark):
    sources, chunks = tables(spark)
    now, loads = [0.0], []
    engines = Engines(lambda: loads.append(1) or records.load_facts(sources, chunks), clock=lambda: now[0])
    first = engines.of(sources)
    assert "41" in first.answer("What is the PM2.5 level in India?") and engines.of(sources.orderBy("seq")) is first
    engines.of(sources.withColumn("updated_at", F.when(F.col("id") == "a", F.current_timestamp())))
    engines.of(sources)
    now[0] = 301
    engines.of(sources)
    assert len(loads) == 4


def test_limits(spark):
    rows = spark.range(5)
    assert records.checked(rows, 5).count() == 5
    for bad in (rows.limit(0), rows):
        with pytest.raises(ValueError):
            records.checked(bad, 4)
    assert files.pasted(spark, " x", "t").first().source_type == "manual"
    for text in ("  ", "x" * (files.MOST_PASTED + 1)):
        with pytest.raises(ValueError):
            files.pasted(spark, text, "t")


def test_shortcuts_and_own_names(spark):
    chunks = spark.createDataFrame([("2", "The Index turns pollution\ninto life years.", "web"), ("1", "The index turns pollution into life years.", "txt"), ("3", "Fires raised pollution in Canada in 2023 by far.", "txt")], "id string, content string, source_type string").withColumn("title", F.lit("t")).withColumn("page_title", F.lit(None).cast("string"))
    cuts = [search.Shortcut(r"\bwhat is the index\b", r"turns pollution\s+into", "web"), search.Shortcut(r"\bfires\b", "no such words")]
    assert [r["id"] for r in search.search(chunks, "What is the Index?", shortcuts=cuts)] == ["2"]
    assert all(r["id"] != "2" for r in search.search(chunks, "fires in canada", shortcuts=cuts))
    assert st.normalized("What is A.Q.?", [(r"a\.q\.", " airindex ")]) == spark.range(1).select(st.normalize_search_text(F.lit("What is A.Q.?"), [(r"a\.q\.", " airindex ")])).first()[0] == "what is airindex"


def test_pages_once(spark):
    rows = [(1, "http://a.org/x", "One  text"), (2, "http://a.org/x/", "other"), (3, "http://a.org/y", "one text"), (4, "http://a.org/z", "third")]
    assert sorted(r.page_id for r in knowledge.distinct_pages(spark.createDataFrame(rows, "page_id long, url string, text string")).collect()) == [1, 4]


def test_history_of_a_stream(spark, tmp_path):
    rows = [("a", "user", f"t{k}", k) for k in range(15)] + [("b", "user", "one", 1), ("b", "user", "reset chat", 2), ("b", "assistant", "done", 3)]
    df = spark.createDataFrame(rows, "conversation string, role string, content string, k int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k"))).drop("k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {r.conversation: r for r in stream.run_once(stream.history_state(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "history_test", "update").collect()}
    assert got["a"].texts == [f"t{k}" for k in range(3, 15)] and got["b"].texts == ["done"] and got["b"].roles == ["assistant"]
