"""Near tokens and ranking from postings, against plain models of both."""

from __future__ import annotations

import math
import random
import re
import string

import pytest
from pyspark.sql import functions as F

from ventus.functions import search_text as st
from ventus.operators import nearterms, search
from ventus.operators.postings import Postings


def same(a: str, b: str) -> bool:
    """Equal, or of five letters or more within one edit, or two from nine letters on; adjacent swaps are one edit."""
    if a == b or min(len(a), len(b)) < 5:
        return a == b
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1] <= (2 if max(len(a), len(b)) >= 9 else 1)


def edited(rng: random.Random, token: str, letters: str) -> str:
    t = list(token)
    for _ in range(rng.choice([0, 1, 2, 2, 3])):
        k, how = rng.randrange(max(len(t), 1)), rng.randrange(4)
        if how == 0 and t:
            t.pop(k)
        elif how == 1:
            t.insert(k, rng.choice(letters))
        elif how == 2 and t:
            t[k] = rng.choice(letters)
        elif k + 1 < len(t):
            t[k], t[k + 1] = t[k + 1], t[k]
    return "".join(t)


def test_near_tokens_are_those_of_all_comparisons(spark):
    rng = random.Random(5)
    letters = "abc"
    base = ["".join(rng.choice(letters) for _ in range(n)) for n in [*range(1, 24), 31, 40] for _ in range(3)]
    asked = sorted({edited(rng, t, letters) for t in base for _ in range(4)})
    terms = sorted({edited(rng, t, letters) for t in base for _ in range(6)} | {"", "x" * 3000})
    column = lambda rows, name: spark.createDataFrame([(x,) for x in [*rows, None, rows[0]]], f"{name} string")
    got = nearterms.near_pairs(column(asked, "asked"), nearterms.term_keys(column(terms, "token")))
    pairs = [(r.asked, r.token) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(a, t) for a in asked for t in terms if same(a, t)}
    assert sum(len(a) > 16 and a != t for a, t in pairs) > 30
    few = asked[::9]
    some = nearterms.near_some(few, spark.createDataFrame([(t,) for t in terms], "token string"))
    assert sorted((r.asked, r.token) for r in some.collect()) == sorted(p for p in pairs if p[0] in few)
    assert nearterms.near_pairs(column(asked, "asked").limit(0), nearterms.term_keys(column(terms, "token"))).count() == 0


WORDS = "methodology index wildfire smoke canada pollution particulate life expectancy india states annual report south asia trend wild fires bangladesh measured monitors neighbours 2023 2024 100% 3.5".split()


def model(chunks: list[tuple], question: str) -> dict:
    """Every chunk looked at with every asked token."""
    asked = list(dict.fromkeys(st.tokens_of(question)))
    phrase, years = st.normalized(question), [n for n in st.numbers_of(question) if len(n) == 4]
    anchors = [a for a in asked if a not in st.INTENT_TOKENS and not a.isdigit()]
    if not asked:
        return {}
    joined = lambda *xs: " ".join(x for x in xs if x)
    rows = {}
    for i, content, title, page_title, kind in chunks:
        low = (content or "").lower()
        bad = "table of contents" in low or len(re.findall(r"\bsection\s+\d+", low)) >= 4 or len(re.split(r"\s+", low)) < 12
        if len((content or "").strip()) >= 40 and not bad:
            rows[i] = st.tokens_of(joined(title, page_title, kind, content)), content, st.normalized(joined(title, page_title, kind, content)), st.normalized(joined(title, page_title))
    df: dict = {}
    for tokens, *_ in rows.values():
        for t in set(tokens):
            df[t] = df.get(t, 0) + 1
    out = {}
    for i, (tokens, content, text, title) in rows.items():
        first = {a: next((t for t in tokens if same(a, t)), None) for a in asked}
        matched = [t for t in first.values() if t]
        best = 0.0
        for part in re.split(r"(?<=[.!?])\s+|\n{2,}", content):
            if not re.search(r"\bfigure\s+\d", part, re.I):
                have = st.tokens_of(part)
                best = max(best, sum(any(same(a, t) for t in have) for a in asked) / len(asked))
        coverage, exact = len(matched) / len(asked), len(phrase) >= 8 and phrase in text
        titles = sum(any(same(a, t) for t in st.tokens_of(title)) for a in asked)
        if not matched or not all(n in text for n in years) or not all(first[a] for a in anchors):
            continue
        if len(asked) > 1 and not (len(matched) >= 2 and coverage >= 0.45 and best >= 0.45):
            continue
        score = sum((math.log((len(rows) + 1) / (df[t] + 0.5)) + 1) * (1 + math.log(tokens.count(t))) for t in matched) * (0.75 + coverage)
        score += best * 5 + 3 * (best == 1) + 5 * exact + 4 * titles + 5 * (titles == len(asked)) + 4 * (bool(phrase) and phrase in title)
        out[i] = (round(score, 6), len(matched), round(coverage, 6), round(best, 6), exact)
    return out


@pytest.fixture(scope="module")
def chunks():
    rng = random.Random(8)
    spoilt = lambda w: edited(rng, w, string.ascii_lowercase) if rng.random() < 0.2 else w
    text = lambda: "".join(spoilt(rng.choice(WORDS)) + rng.choice([" ", " ", " ", " ", ". ", "! ", "\n\n", " the ", ", figure 3 "]) for _ in range(rng.choice([14, 30, 60])))
    rows = [(f"c{k}", text(), rng.choice(["Annual report", "South Asia", "Methodology of the index", None, ""]), rng.choice([None, "India states"]), "pdf", f"s{k % 4}") for k in range(120)]
    odd = [("n1", None, None, None, "pdf", "s1"), ("n2", "", "t", None, "pdf", "s1"), ("n3", "too short", None, None, None, "s1"), ("n4", "table of contents " * 20, None, None, None, "s2")]
    return rows + odd


QUESTIONS = [
    "Wildfire smoke in Canada", "wild fires Canda 2023", "methodolgy of the index", "pollution in South Asia", "life expectancy 2024 India", "annual report", "measured by monitors 100%", "the of and", "", None,
    "neighbors smoke", "rep", "indx wildfire", "life expectancy india states annual", "unitedstates trend", "3.5 smoke canada", "bangaldesh", "southasia",
]
SCHEMA = "id string, content string, title string, page_title string, source_type string, source_id string"


def told(rows) -> dict:
    return {r.id: (round(r.score, 6), r.n_matched, round(r.coverage, 6), round(r.passage, 6), r.exact) for r in rows}


def test_ranking_of_one_question(spark, chunks):
    table = spark.createDataFrame(chunks, SCHEMA)
    found = 0
    for q in (QUESTIONS[k] for k in (0, 1, 7, 13)):
        rows = search.rank_chunks(table, q).collect()
        assert told(rows) == model([c[:5] for c in chunks], q)
        assert [r.id for r in rows] == [r.id for r in sorted(rows, key=lambda r: (-r.score, r.id))]
        found += len(rows)
    assert found > 10


def test_stored_postings_give_the_same_rows(spark, chunks, tmp_path, monkeypatch):
    index = Postings(spark, str(tmp_path / "index"))
    table = spark.createDataFrame(chunks, SCHEMA)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id int, question string")

    def check(rows):
        got: dict = {}
        for r in index.rank(questions).collect():
            got.setdefault(r.question_id, []).append(r)
        want = {k: model([c[:5] for c in rows], q or "") for k, q in enumerate(QUESTIONS)}
        assert {k: told(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
        return sum(map(len, want.values()))

    index.write(table)
    assert check(chunks) > 100
    new = [("c1", "Wildfire smoke in Canada was measured by monitors of the annual report in 2023.", "New", None, "pdf", "s1"), *[c for c in chunks if c[5] == "s1" and c[0] > "c5"]]
    index.write(spark.createDataFrame(new, SCHEMA))  # replaces one source, with other frequencies
    check([c for c in chunks if c[5] != "s1"] + new)
    monkeypatch.setattr("ventus.operators.postings.NAMED", 3)  # too many tokens to name
    monkeypatch.setattr("ventus.operators.postings.BROADCAST_WORDS", 0)
    index.write(spark.createDataFrame([c for c in chunks if c[5] == "s2"], SCHEMA))
    check([c for c in chunks if c[5] != "s1"] + new)


def test_only_ranges_of_asked_tokens_are_read(spark, chunks, tmp_path):
    index = Postings(spark, str(tmp_path / "index"))
    index.write(spark.createDataFrame(chunks, SCHEMA))
    plan = index.rank(spark.createDataFrame([(1, "Wildfire smoke")], "question_id int, question string"))._jdf.queryExecution().toString()
    assert "In(token" in plan.replace(" ", "") and "content" not in plan


def test_exact_phrases_stand_across_words(spark, tmp_path):
    rows = [("a", "We breathe cats in the smokehouse, and thirty more words follow here so it counts.", None, None, None, "s"), ("b", "They breathe the catsmoke and nothing else is to be told of them in this sentence here.", None, None, None, "s")]
    index = Postings(spark, str(tmp_path / "index"))
    index.write(spark.createDataFrame(rows, SCHEMA))
    for q in ("breathe cats in the smoke", "eathe cats", "catsmoke", "tsmoke and nothing", "cats in a"):
        got = index.rank(spark.createDataFrame([(1, q)], "question_id int, question string"))
        assert told(got.collect()) == model([r[:5] for r in rows], q)


def test_tables_without_rows(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert search.rank_chunks(none, "wildfire smoke").count() == 0
    index = Postings(spark, str(tmp_path / "index"))
    index.write(none)
    assert index.rank(spark.createDataFrame([(1, "wildfire smoke")], "question_id int, question string")).count() == 0
    index.write(spark.createDataFrame([("a", "Wildfire smoke in Canada was measured by monitors of the annual report.", None, None, "pdf", "s")] * 2, SCHEMA).withColumns({"tf": F.lit(1), "token": F.lit("x")}))
    assert index.rank(spark.createDataFrame([(1, "wildfire smoke")], "question_id int, question string")).count() == 1


def exchanged(spark) -> int:
    """Bytes that this session's tasks have written for exchanges so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_texts_are_exchanged_once_and_few_chunks_are_held_against_questions(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices(string.ascii_lowercase, k=7)) for _ in range(400)]
    rows = [(f"c{k}", " ".join(rng.choices(words[:300], k=150)) + f". {words[300 + k % 100]} end.", None, None, "txt", f"s{k % 3}") for k in range(1500)]
    questions = spark.createDataFrame([(k, " ".join([*words[:12], words[300 + k]])) for k in range(60)], "question_id int, question string")
    before = exchanged(spark)
    index = Postings(spark, str(tmp_path / "index"))
    index.write(spark.createDataFrame(rows, SCHEMA))
    index.rank(questions).collect()
    assert exchanged(spark) - before < 3 * sum(len(r[1]) for r in rows)


def test_ranking_without_broadcasts(spark, chunks, tmp_path, monkeypatch):
    for name, value in (("BROADCAST_ROWS", 0), ("_CHUNKS", 7), ("_MOST_KNOWN", 5), ("RAREST", 1)):
        monkeypatch.setattr(f"ventus.operators.postings.{name}", value)
    asked = {0: QUESTIONS[0], 1: QUESTIONS[3], 2: QUESTIONS[5], 3: QUESTIONS[13], 4: "wild fire wildfire south asia southasia"}
    more = [("w", "Wild things set fire to the wildfire of South Asia, southasia and the rest of it in 2023.", "wild", "fire", "pdf", "s1")]
    index = Postings(spark, str(tmp_path / "index"))
    index.write(spark.createDataFrame(chunks + more, SCHEMA))
    got: dict = {}
    for r in index.rank(spark.createDataFrame(list(asked.items()), "question_id int, question string")).collect():
        got.setdefault(r.question_id, []).append(r)
    want = {k: model([c[:5] for c in chunks + more], q) for k, q in asked.items()}
    assert {k: told(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and 4 in got
