"""Questions in words over small tables: what is read from them, and the answers."""

from __future__ import annotations

import pytest

from tests.test_metrics import INDIA, facts
from ventus.functions.metrics import NATIONAL, WHO, Benchmark
from ventus.plans.dialogue import Turn
from ventus.plans import question as q
from ventus.plans.answer import Engine


@pytest.fixture(scope="module")
def india(spark):
    return Engine(facts(spark, INDIA))


@pytest.mark.parametrize(
    "question, parts",
    [
        ("Top 2 states in India by PM2.5", ["Here are the top 2 states in India, 2024", "1. Delhi — 72 µg/m³", "2. Uttar Pradesh — 58 µg/m³"]),
        ("Compare Delhi and Uttar Pradesh", ["Using 2024 and the WHO guideline", "Delhi: 72 µg/m³, 6.57 years life loss", "Uttar Pradesh: 58 µg/m³, 5.19 years life loss", "Delhi has 14 µg/m³ higher PM2.5"]),
        ("Delhi trend from 2020 to 2024", ["PM2.5 changed from 60 to 72 µg/m³", "Change: +12 µg/m³", "Life loss changed from 5.39 to 6.57 years", "Direction: worsened", "Reference: GADM1 CSV, 2020–2024"]),
        ("Maharashtra PM2.5 with custom target 10 µg/m³", ["35 µg/m³ PM2.5", "2.45 years of life loss"]),
        ("India pollution level using national standard", ["42 µg/m³ PM2.5", "0.2 years of life loss"]),
        ("Bhutan PM2.5 in 2024", ["I could not find that location", "Reference checked:"]),
        ("Top 10 polluted districts in India", ["District-level data is not currently available"]),
        ("Which states are the most polluted states?", ["Which country should I use for the state ranking?"]),
        ("India population", ["India, 2024: population 1,400,000,000."]),
        ("Total life years lost in Nepal", ["3.2 years per person; 96,000,000 total person-years lost"]),
        ("How many countries have PM2.5 above 40?", ["1 countries have PM2.5 above 40 µg/m³, 2024."]),
        ("Countries with PM2.5 below 40", ["1. Nepal — 38 µg/m³", "territory entries are excluded"]),
    ],
)
def test_answers(india, question, parts):
    text = india.answer(question)
    for part in parts:
        assert part in text


def test_periods_and_peaks(spark):
    rows = [("A", 2020, 50), ("B", 2020, 40), ("A", 2024, 45), ("B", 2024, 60)]
    e = Engine(facts(spark, [{"country": "India", "name_1": f"State {s}", "year": str(y), "pm25": str(v)} for s, y, v in rows]))
    text = e.answer("Give me the most polluted state in India for each year from 2020 to 2024")
    assert text.startswith("Most polluted state for each year, 2020–2024") and "2020: State A — 50 µg/m³ PM2.5" in text and "2024: State B — 60 µg/m³ PM2.5" in text
    text = e.answer("Top 2 most polluted states in India between 2020-2024")
    assert text.startswith("Here are the top 2 states in India, 2020–2024 average") and "1. State B — 50" in text
    up = Engine(facts(spark, [{"country": "India", "name_1": "Uttar Pradesh", "year": str(y), "pm25": str(v)} for y, v in ((2004, 40), (2020, 60), (2024, 55))]))
    text = up.answer("Highest pm in last 20 years for uttarpradesh")
    assert text.startswith("Highest PM2.5 for Uttar Pradesh, 2004–2024") and "2020: 60 µg/m³" in text
    text = up.answer("Largest increase in Uttar Pradesh")
    assert "2004 to 2020: 40 → 60 µg/m³" in text
    two = Engine(facts(spark, [{"country": c, "year": str(y), "pm25": str(v)} for c, y, v in (("India", 2010, 50), ("India", 2020, 44), ("China", 2010, 60), ("China", 2020, 35))]))
    text = two.answer("Compare India and China from 2010 to 2020")
    assert "India: PM2.5 50 → 44 µg/m³ (-6)" in text and "China: PM2.5 60 → 35 µg/m³ (-25)" in text and "China improved 19 µg/m³ more" in text
    ranked = two.answer("Which countries improved most from 2010 to 2020?")
    assert "1. China — 60 → 35 µg/m³ (-25)" in ranked


def test_parsers():
    assert q.condition("states with PM2.5 less then 20") == q.Condition("pm25", "lt", 20)
    assert q.condition("population over 1.5 million or more than 2 million people") == q.Condition("population", "gt", 2e6)
    assert q.condition("national standard >= 30") == q.Condition("national_standard", "gte", 30)
    assert q.condition("life loss of 0.8 or less with national standard") == q.Condition("llpp_national", "lte", 0.8)
    assert q.condition("above 5") is None
    assert q.benchmark("WHO or national standard") == NATIONAL and q.benchmark("national std, then WHO") == WHO
    assert q.benchmark("custom target of 12.5 µg") == Benchmark("custom", 12.5)
    years = [2004, 2010, 2014, 2020, 2021, 2024]
    assert q.relative_range("over the last decade", years) == (2014, 2024)
    assert q.relative_range("last 3 years", years) == (2021, 2024)
    assert q.relative_range("past two decades", years) == (2004, 2024)
    assert q.relative_range("in 2020", years) is None
    assert (q.count("top five states"), q.count("3 most polluted"), q.count("states")) == (5, 3, 0)
    assert [q.level(x) for x in ("districts", "the state", "all countries", "region", "only in this state", "x")] == ["district", "state", "country", "region", None, None]
    assert [q.quality(*x) for x in (("air in uttarpradesh", "Uttar Pradesh"), ("delhi air", "NCT of Delhi"), ("maharastra", "Maharashtra"), ("goa", "Kerala"))] == [3, 2, 1, 0]
    assert q.intent("compare it with 2014", "Delhi", 1) == "trend"


def test_suggestions(india):
    assert india.suggestion(india.read("Delhi PM2.5")) == "You could also ask how Delhi changed over the years."
    assert "improved most" in india.suggestion(india.read("Top countries"))


def test_messages_are_sent_where_they_belong(spark):
    e = Engine(facts(spark, INDIA))
    assert [e.reply(x) for x in ("Hello!", "thanks", "reset chat", "Why is pollution bad?", "What is PM2.5?", "Tell me a long story about some other matter")] == [None] * 6
    assert e.reply("Do you have access to GADM2?").startswith("GADM2 CSV is not currently uploaded and active. Available now: GADM")
    assert e.reply("Do you have access to the CSV?").startswith("Yes. I currently have access to GADM")
    assert e.reply("Total life years lost means life loss multiplied by population").endswith("Reference: User-provided calculation definition.")
    assert "India" in e.reply("and India?")
    assert e.reply("What is the PM2.5 in Atlantis?").startswith("I could not find that location")
    first = e.reply("What is the PM2.5 level in India?")
    assert e.reply("compared with 2010", [Turn("user", "What is the PM2.5 level in India?"), Turn("assistant", first)]) is not None
    assert Engine(facts(spark, INDIA).limit(0)).answer("Most polluted country?").startswith("I don’t have that data")
