"""Sentences and evidence, places of many questions, changes of tables, and streams with timers: against plain models."""

from __future__ import annotations

import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ventus.functions import search_text as st
from ventus.functions import web
from ventus.operators import evidence, search, tables_in_text
from ventus.plans import question as q
from ventus.sources import changes, store
from ventus.streaming import messages as stream

from .test_ranking import exchanged

SENTENCES = [
    ("Dr. Smith measured it. It rose.", ["Dr. Smith measured it.", "It rose."]),
    ("As told by J. Smith et al. In 2024 it fell! Why?", ["As told by J. Smith et al. In 2024 it fell!", "Why?"]),
    ("It was 2. 5 times more. Then\n\nnext • point", ["It was 2. 5 times more.", "Then", "next", "point"]),
    ("At St. Gallen, approx. 3 km away. (Yes.) “No.” Done", ["At St. Gallen, approx. 3 km away.", "(Yes.)", "“No.”", "Done"]),
    ("It is best. The list ended first. Really?! Yes", ["It is best.", "The list ended first.", "Really?!", "Yes"]),
    ("  one   two\tthree ", ["one two three"]), ("", []), (None, None),
]


def test_sentences(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(SENTENCES)], "k int, t string").select("k", evidence.sentences("t").alias("s")).orderBy("k").collect()
    assert [r.s for r in rows] == [s for _, s in SENTENCES]


FACTS = [
    ("a", "In India, the PM 2.5 concentration in 2023 was 41 ug/m3."),
    ("b", "India's clean air programme set a pollution-reduction target for 2024. Dr. Rao wrote the plan for the monitors."),
    ("c", "Wildfires in Canada raised PM2.5 to 9.2 µg/m³ in 2023. The level was 9.2 μg/m³ in Canada, which had never been so high. Wild fires burned the South of Asia."),
    ("d", "Table of contents of India in 2023, PM2.5 of 3 ug/m3 and more. Figure 3 shows Canada in the year 2023 as well."),
    ("e", None), ("f", ""),
]
ASKED = ["What is PM2.5 in India in 2024?", "What was PM2.5 in India in 2023?", "wildfires Canada 2023", "Canada wildfre level", "clean air programme target India 2024", "who wrote the plan", "the of", None, "south asia wildfire"]


def model(question: str) -> dict:
    asked = list(dict.fromkeys(st.tokens_of(question)))
    out: dict = {}
    if not asked:
        return out
    for i, text in FACTS:
        parts = split(text or "")
        for k, s in enumerate(parts):
            for n, w in ((1, s), (2, f"{s} {parts[k + 1]}" if k + 1 < len(parts) else None)):
                if w is None or not 35 <= len(w) <= 620 or not re.search(r"[.!?][\"')\]]?$", w) or "table of contents" in w.lower() or re.search(r"\bfigure\s+\d", w.lower()):
                    continue
                have = set(st.tokens_of(w))
                hit = [a for a in asked if any(st.same_token(a, t) for t in have)]
                entities = [a for a in asked if a not in evidence.ANSWER_TOKENS and not a.isdigit()]
                years = [y for y in st.numbers_of(question) if re.fullmatch(r"\d{4}", y)]
                unit = "pm25" in asked and re.search(evidence.ASKS_FOR_VALUE, question)
                if len(hit) < min(2, len(asked)) or len(hit) / len(asked) < (1 if len(asked) <= 3 else 0.45) or not set(entities) <= set(hit):
                    continue
                if not set(years) <= set(st.numbers_of(w)) or (unit and not re.search(evidence.UNIT, w)):
                    continue
                weight = sum(4 if a.isdigit() else 1 for a in hit)
                out[i, k, n] = round(weight + 2 * (weight / len(asked) >= 0.5) - min(len(w) / 1000, 0.6), 6)
    return out


def split(text: str) -> list[str]:
    """The facts above, whose only full stop inside a sentence follows Dr."""
    return [x for x in re.split(r"(?<=[.!?])(?<!Dr\.) +", text) if x]


def test_evidence_is_held_to_its_question(spark):
    facts = spark.createDataFrame(FACTS, "id string, content string")
    got: dict = {}
    for r in evidence.evidence(facts, spark.createDataFrame(list(enumerate(ASKED)), "question_id int, question string")).collect():
        got.setdefault(r.question_id, {})[r.id, r.position, r.n_sentences] = round(r.score, 6)
    want = {k: model(x or "") for k, x in enumerate(ASKED)}
    assert got == {k: v for k, v in want.items() if v}
    assert 0 not in got and set(got) >= {1, 2, 3, 4}  # a measurement of 2023 doesn't answer for 2024
    assert search.answer_windows(facts, ASKED[0], "id", "content").count() == 0
    assert search.answer_windows(facts, ASKED[1], "id", "content").first().window == FACTS[0][1]


def test_evidence_in_shares_of_the_questions(spark, monkeypatch):
    monkeypatch.setattr("ventus.operators.postings.BROADCAST_ROWS", 2)
    monkeypatch.setattr(evidence, "_ROWS", 1)
    monkeypatch.setattr(evidence, "_MOST_KNOWN", 1)
    got: dict = {}
    for r in evidence.evidence(spark.createDataFrame(FACTS, "id string, content string"), spark.createDataFrame(list(enumerate(ASKED)), "question_id int, question string")).collect():
        got.setdefault(r.question_id, {})[r.id, r.position, r.n_sentences] = round(r.score, 6)
    want = {k: model(x or "") for k, x in enumerate(ASKED)}
    assert got == {k: v for k, v in want.items() if v}


def test_texts_and_windows_are_not_exchanged(spark, tmp_path):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(300)]
    rows = [(k, " ".join(" ".join(rng.choices(words, k=9)).capitalize() + "." for _ in range(12))) for k in range(1200)]
    spark.createDataFrame(rows, "id long, content string").write.parquet(str(tmp_path / "texts"))
    questions = spark.createDataFrame([(k, " ".join(words[5 * k : 5 * k + 2])) for k in range(60)], "question_id int, question string")
    before = exchanged(spark)
    found = evidence.evidence(spark.read.parquet(str(tmp_path / "texts")), questions).count()
    # a table as small as this is dealt over all cores once
    assert found > 0 and exchanged(spark) - before < 2 * sum(len(t) for _, t in rows)


NAMES = ["India", "New Delhi", "NCT of Delhi", "Uttar Pradesh", "Andhra Pradesh", "United States", "Capital", "Bangladesh", "State of Georgia", "Georgia", "Côte d'Ivoire", "New York", "York", "Province", "", "West Bengal", "india", "Uttar  Pradesh!"]
QUESTIONS = ["Compare India and Bangladseh", "pollution in uttar pradesh", "NewYork or York", "delhi", "capital", "capital of India", "georgia state", "uttr pradsh vs andhra", "the province of west bengal", "USA", "c te d ivoire", "", None, "nothing here", "India india INDIA"]


def test_places_of_many_questions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(q.LEVELS), n, k) for k, n in enumerate(NAMES * 3)] + [("country", None, 99)]
    labels = spark.createDataFrame(rows, "level string, name string, seq long").groupBy("level", "name").agg(F.min("seq").alias("seq"))
    got: dict = {}
    for r in q.places_of(labels, spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")).orderBy("question_id", "rank").collect():
        got.setdefault(r.question_id, []).append((r.level, r.name, r.quality, r.position))
    some = labels.where("name is not null")
    want = {k: [(p.level, p.name, p.quality, p.position) for p in q.match_places(some, x or "")] for k, x in enumerate(QUESTIONS)}
    assert got == {k: v for k, v in want.items() if v}
    assert q.places_of(labels.limit(0), spark.createDataFrame([(1, "India")], "question_id int, question string")).count() == 0


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_changes_of_a_table(spark, tmp_path):
    schema = "a int, b string, c string, d double"
    one = spark.createDataFrame([(1, "x", "u", 1.0), (2, "x", None, 2.0), (2, None, "", None), (None, None, "n", 0.0), (4, "y", "same", 4.0)], schema)
    two = spark.createDataFrame([(1, "x", "v", 1.0), (2, "x", "", 2.0), (None, None, "n", 0.0), (4, "y", "same", 4.0), (5, "z", None, None)], schema)
    events = changes.differences(one, two, ["a", "b"])
    assert rows_of(events) == sorted([("update", 1, "x", "v", 1.0), ("update", 2, "x", "", 2.0), ("delete", 2, None, None, None), ("insert", 5, "z", None, None)], key=str)
    assert rows_of(changes.applied(one, events, ["a", "b"])) == rows_of(two)
    assert changes.differences(one, one, ["a", "b"]).isEmpty() and changes.differences(one, one.limit(0), ["a"]).count() == 4

    feed = changes.Feed(spark, str(tmp_path / "feed"), ["a", "b"])
    assert [feed.publish(one), feed.publish(one), feed.publish(two)] == [0, 0, 1]
    # a run that was lost after its snapshot and a part of its events
    three = two.where("a <> 5")
    three.write.parquet(str(tmp_path / "feed/snapshots/version=2"))
    (tmp_path / "feed/events/version=2/_temporary").mkdir(parents=True)
    assert feed.last() == 1 and feed.publish(three) == 2
    now = one.limit(0)
    seen = stream.run_once(feed.stream(one.schema), "changes_test")
    for k in range(3):
        now = changes.applied(now, seen.where(F.col("version") == k).drop("version"), ["a", "b"])
    assert rows_of(now) == rows_of(three)


def test_rows_are_merged_by_copy_and_rename(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    schema = "id string, last_message string, updated_at timestamp, n int"
    rows = spark.range(200).select(F.concat(F.lit("c"), "id").alias("id"), F.lit("first").alias("last_message"), F.timestamp_seconds("id").alias("updated_at"), F.col("id").cast("int").alias("n"))
    assert changes.upsert(path, rows, ["id"], 8) == 8
    replies = spark.createDataFrame([("c1", " one ", 5000), ("c1", "two", 6000), ("c2", "  ", 5000), ("none", "x", 5000), ("c150", "late", 3)], "id string, text string, at long").withColumn("at", F.timestamp_seconds("at"))
    changed = store.replied(changes.read_merged(spark, path), replies)
    assert 1 <= changes.upsert(path, changed, ["id"], 8) <= 2
    got = {r.id: r for r in changes.read_merged(spark, path).collect()}
    assert len(got) == 200 and (got["c1"].last_message, got["c1"].n, got["c150"].last_message, got["c2"].last_message) == ("two", 1, "late", "first")
    assert got["c1"].updated_at.timestamp() == 6000 and got["c150"].updated_at.timestamp() == 150
    before = rows_of(changes.read_merged(spark, path))
    # a run lost between its two renames: the bucket is set aside and its place is empty
    bucket = next((tmp_path / "t").glob("bucket=*"))
    (tmp_path / "t/_aside").mkdir(exist_ok=True)
    bucket.rename(tmp_path / "t/_aside" / bucket.name)
    changes.upsert(path, spark.createDataFrame([("new", "m", None, 1)], schema), ["id"], 8)
    assert rows_of(changes.read_merged(spark, path).where("id <> 'new'")) == before
    with pytest.raises(ValueError):
        changes.upsert(path, rows.withColumn("more", F.lit(1)), ["id"], 8)
    assert rows_of(changes.read_merged(spark, path).where("id <> 'new'")) == before


def test_replies_are_there_once_after_a_lost_batch(spark, tmp_path):
    spark.createDataFrame([("a", "x" * 5000), ("b", "y")], "conversation string, reply string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("conversation string, reply string").parquet(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # the second knows nothing of the first, as if its batch had never been committed
        stream.outbox(source, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()
    assert sorted((r.conversation, len(r.reply)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", 4096), ("b", 1)]


def test_bursts_wait_for_silence(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"c{k % 5}", f"m{k}", 1_700_000_000 + rng.choice([0, 1, 3, 9]) + 4 * k) for k in range(120)]
    df = spark.createDataFrame(rows, "conversation string, content string, t long").select("conversation", "content", F.timestamp_seconds("t").alias("ts"))
    df.repartition(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = sorted((r.conversation, r.n_messages, r.text) for r in stream.run_once(stream.bursts(source, "25 seconds"), "bursts_test").collect())
    want, mark = [], max(t for *_, t in rows)
    table = pd.DataFrame(rows, columns=["c", "m", "t"]).sort_values(["c", "t", "m"])
    for c, own in table.groupby("c"):
        part = (own.t.diff() > 25).cumsum()
        want += [(c, len(x), "\n".join(x.m)) for _, x in own.groupby(part) if x.t.max() + 25 < mark]
    assert got == sorted(want) and len(want) > 10


TABLE = "Intro of 2024. Table 3.1: Impacts on life expectancy in select countries. Gains by 2024 (years). Bangladesh 5.4 54 2.1. Pakistan 3.9 51 1.5. New Zealand 1,203.5 -46 1.3; Nepal 3.2 55 1.3. Total 12. Then Table 4: Nothing much. Alpha 1. Beta 2. Table 5: Two columns.\nAnna 1 2\nBert of York 3 4\nCarl < 5 6%\n"


def test_tables_in_text(spark):
    rows = spark.createDataFrame([(1, TABLE), (2, None), (3, ""), (4, "Table of contents. Oslo 1 2. Rome 3 4. Bonn 5 6.")], "id int, text string")
    found = tables_in_text.tables(rows, "id", "text")
    got = {}
    for r in found.orderBy("section", "position").collect():
        got.setdefault((r.id, r.number, r.unit), []).append((r.label, r["values"]))
    assert got == {
        (1, "3.1", "years"): [("Bangladesh", [5.4, 54, 2.1]), ("Pakistan", [3.9, 51, 1.5]), ("New Zealand", [1203.5, -46, 1.3]), ("Nepal", [3.2, 55, 1.3])],
        (1, "5", ""): [("Anna", [1, 2]), ("Bert of York", [3, 4]), ("Carl", [5, 6])],
    }
    answers = [r.answer for r in tables_in_text.told(tables_in_text.ranked(found.where("label <> 'New Zealand'"), "id", k=2), "id").orderBy("section").collect()]
    assert answers[0] == 'Of those listed in "Impacts on life expectancy in select countries", Bangladesh comes first with 5.4 years, followed by Pakistan (3.9 years).'
    assert tables_in_text.ranked(found, "id", 1, 1, lowest=True).where("number = '3.1'").first().label == "New Zealand"


def test_private_addresses_agree_with_plain_ones(spark):
    rng = random.Random(7)
    rows = [".".join(str(rng.choice([0, 1, 10, 100, 127, 169, 172, 192, 198, 224, 255, rng.randrange(256)])) for _ in range(4)) for _ in range(300)]
    rows += ["::1", "::", "fe80::1", "FC00::2", "2001:db8::5", "2606:4700::1", "::ffff:8.8.8.8", "::FFFF:10.0.0.1", "::ffff:::ffff:1.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", " 8.8.8.8", "", None, "host", "8.8.8.8:80", "9" * 40 + ".1.1.1"]
    got = spark.createDataFrame([(x,) for x in rows], "a string").select("a", web.private_address("a").alias("p")).collect()
    assert [r.p for r in got] == [web.is_private_address(x or "") for x in rows]
