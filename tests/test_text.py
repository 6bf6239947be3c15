"""Search text, retrieval, chunks, pages and conversations."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ventus.functions import search_text as st
from ventus.functions import vectors, web
from ventus.operators import conversation as cv
from ventus.operators import search
from ventus.sources import knowledge
from ventus.streaming import messages as stream


def test_edit_distance_counts_swaps_once():
    assert st.edit_distance("pollution", "pollutoin", 2) == 1
    assert st.edit_distance("ca", "abc", 3) == 3
    assert st.edit_distance("abc", "abcdef", 2) == 3
    assert st.same_token("bangladesh", "bangaldseh") and not st.same_token("asia", "asis")


def test_tokens():
    assert st.tokens_of("Wild fires in the USA") == ["wildfire", "unitedstate"] or "wildfire" in st.tokens_of("Wild fires in the USA")
    assert st.canonical_token("polution") == "pollution" and st.canonical_token("cities") == "city" and st.canonical_token("studies") == "study"
    assert st.numbers_of("In 2,024 or 2024, 3.5% of 1,5") == ["2024", "3.5%", "15"] or "2024" in st.numbers_of("2024")
    near = st.NearTerms(st.KNOWN_TERMS)
    for token in ("polution", "sumary", "wildfier", "methodlogy", "nepla", "unitedstat"):
        close = {t for t in st.KNOWN_TERMS if st.edit_distance(token, t, 2 if len(token) >= 9 else 1) <= (2 if len(token) >= 9 else 1)}
        assert close <= set(near.candidates(token))


def test_normalizing_agrees_with_the_plan(spark):
    texts = ["U.S. PM 2.5 rose more than 3%", "Highlights: South  Asia wild fire trends", "fine particulate matter, decline", ""]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").select(st.normalize_search_text("x")).collect()]
    assert got == [st.normalized(x) for x in texts]


CHUNKS = [
    ("1", "Methodology of the index. The index turns particulate pollution into its effect on life expectancy for every place on the map.", "Methodology"),
    ("2", "Wildfire smoke in Canada. In 2023 wildfires raised particulate pollution in Canada far above what it was in earlier years.", "Report"),
    ("3", "Wildfire smoke in Canada. In 2023 wildfires raised particulate pollution in Canada far above what it was in earlier years!", "Report"),
    ("4", "table of contents section 1 section 2 section 3 section 4 and so on and so on for the pages", "Report"),
]


def test_ranking_of_chunks(spark):
    rows = spark.createDataFrame([(i, c, t, None, "txt") for i, c, t in CHUNKS], "id string, content string, title string, page_title string, source_type string")
    found = search.search(rows, "Wildfires in Canada 2023")
    assert [r["id"] for r in found] == ["2"]
    assert search.search(rows, "Wildfires in Canada 2019") == []
    assert search.search(rows, "the of") == []
    assert search.context_block(found).startswith("Context 1 [Source: Report]:\nWildfire smoke")
    best = search.answer_windows(rows, "wildfires Canada 2023", "id", "content").collect()
    assert "2023" in best[0].window


def test_chunking():
    text = "\n\n".join(f"Paragraph {k}. " + "word " * 150 for k in range(12))
    chunks = knowledge.chunk_text(text)
    assert len(chunks) > 1 and all(50 < len(c) <= 4602 for c in chunks)
    assert chunks[1].startswith(chunks[0][-600:].strip()[:40])
    assert knowledge.chunk_text("too short") == []
    long = "A sentence of some length stands here. " * 300
    assert all(len(c) <= 4000 for c in knowledge.chunk_text(long))


def test_hash_embedding(spark):
    v = spark.createDataFrame([("Air pollution air",), ("",), (None,)], "x string").select(vectors.hash_embedding("x").alias("v")).collect()
    assert len(v[0].v) == 384 and sum(x * x for x in v[0].v) == pytest.approx(1, abs=1e-5) and not any(v[1].v) and not any(v[2].v)
    assert vectors.fnv1a("") == 2166136261 and vectors.fnv1a("a") == 0xE40C292C


def test_pages_and_urls(spark):
    body = "<main><h2>A heading of some length</h2><p>" + "Text of the page, long enough. " * 5 + "</p><p>short</p><div class='modal'><p>Hidden text that is long</p></div></main>"
    html = f"<html><head><title>T</title></head><body><nav><a href='/a/?x=1#y'>n</a><a href='/b.pdf'>n</a><a href='http://other.org/'>n</a><a rel='nofollow' href='/c'>n</a><a href='/about//methodology/'>m</a></nav><h1>Title of it</h1>{body}</body></html>"
    page = web.page_of(html, "http://x.org/p")
    assert page["title"] == "Title of it" and "short" not in page["text"].split("\n\n") and "Hidden" not in page["text"]
    assert page["links"] == ["http://x.org/about/methodology", "http://x.org/a"]
    assert web.page_of("<meta name='robots' content='noindex'>" + html, "http://x.org") is None
    urls = spark.createDataFrame([("HTTP://X.org//a//b/?q#f",), ("http://x.org",)], "u string").select(web.canonical_url("u")).collect()
    assert [r[0] for r in urls] == ["http://x.org/a/b", "http://x.org/"]
    assert [web.is_private_address(x) for x in ("10.1.2.3", "8.8.8.8", "::1", "::ffff:192.168.0.1", "2606:4700::1111", "nonsense", "100.64.0.1", "172.32.0.1")] == [True, False, True, True, False, True, True, False]


def test_crawl_over_links(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("z", "y")], "src string, dst string")
    got = knowledge.reachable(spark.createDataFrame([("a",)], "url string"), links)
    assert [(r.url, r.depth) for r in got.collect()] == [("a", 0), ("b", 1), ("d", 1), ("c", 2)]


def test_history_and_rollup(spark):
    turns = [(1, k, "user" if k % 2 == 0 else "assistant", "Reset this chat" if k == 6 else f"t{k}") for k in range(20)]
    m = spark.createDataFrame([*turns, (2, 0, "user", "hi"), (2, 1, "user", "hi")], "conv_id long, turn long, role string, text string")
    kept = sorted((r.conv_id, r.turn) for r in cv.recent_history(m).collect())
    assert kept == [*[(1, k) for k in range(8, 20)], (2, 0), (2, 1)]
    early = cv.recent_history(m.where("turn < 12")).where("conv_id = 1").collect()
    assert sorted(r.turn for r in early) == list(range(7, 12))
    r = {x.conv_id: x for x in cv.rollup(m).collect()}
    assert (r[1].last_message, r[1].unread, r[2].unread) == ("t19", 0, 2)
    assert cv.without_repeats(m).where("conv_id = 2").count() == 1


def test_webhook(spark):
    message = lambda i, kind="text", body=" hello ": {"from": "491", "id": i, "timestamp": "1700000000", "type": kind, "text": {"body": body}}
    payload = {"object": "business", "entry": [{"id": "1", "changes": [{"field": "messages", "value": {"contacts": [{"profile": {"name": "Ann"}, "wa_id": "491"}], "messages": [message("m1"), message("m2", "image"), message("m3", body="  ")]}}, {"field": "other", "value": {"messages": [message("m4")]}}]}]}
    rows = spark.createDataFrame([(json.dumps(payload),), (json.dumps({**payload, "object": "page"}),)], "body string")
    got = cv.webhook_messages(rows, "body", "business").collect()
    assert [(r.msg_id, r.phone, r.name, r.content) for r in got] == [("m1", "491", "Ann", "hello")]
    errors = spark.createDataFrame([("TypeError: fetch failed", None), ("duplicate key", 409), ("x", 503)], "m string, s int").select(cv.is_unreachable(F.col("m"), F.col("s"))).collect()
    assert [r[0] for r in errors] == [True, False, True]


def test_streams_match_batch(spark, tmp_path):
    rows = [(f"m{k % 7}", f"c{k % 2}", "human" if k == 5 else "user", f"t{k}", k) for k in range(10)]
    df = spark.createDataFrame(rows, "msg_id string, conversation string, role string, content string, k int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("k"))).drop("k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    once = stream.run_once(stream.each_once(source), "once_test")
    assert once.count() == 7
    state = {r.conversation: r for r in stream.run_once(stream.conversation_state(source), "state_test", "update").collect()}
    assert state["c1"].mode == "human" and state["c0"].n_messages == 5 and state["c0"].unread == 5
    assert [r.conversation for r in stream.to_answer(spark.table("state_test")).collect()] == ["c0"]
