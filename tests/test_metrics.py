"""Facts, summaries and verbs on small records with known answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ventus.functions import metrics as m
from ventus.functions.places import normalize_place, usable_label
from ventus.operators import summary as sm
from ventus.operators import verbs
from ventus.sources import records


def table(spark, rows):
    names = list(dict.fromkeys(k for r in rows for k in r))
    data = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "_order long, " + ", ".join(f"`{n}` string" for n in names))


def facts(spark, rows, **options):
    return records.canonical(table(spark, rows), seq="_order", **options)


INDIA = [
    {"name0": "India", "name1": "Delhi", "year": "2020", "pm25": "60", "llpp_who": "5.39", "population": "20,000,000"},
    {"name0": "India", "name1": "Delhi", "year": "2024", "pm25": "72", "llpp_who": "6.57", "population": "21,000,000"},
    {"name0": "India", "name1": "Uttar Pradesh", "year": "2024", "pm25": "58", "llpp_who": "5.19", "population": "240,000,000"},
    {"name0": "India", "name1": "Maharashtra", "year": "2024", "pm25": "35", "population": "125,000,000", "national_pm25_standard": "40"},
    {"name0": "India", "year": "2024", "pm25": "42", "llpp_who": "3.63", "llpp_national": "0.2", "population": "1,400,000,000", "national_pm25_standard": "40"},
    {"name0": "Nepal", "year": "2024", "pm25": "38", "llpp_who": "3.2", "population": "30,000,000"},
]


def test_states_ranked_in_latest_year(spark):
    f = verbs.scoped(facts(spark, INDIA), "country", "India")
    states = sm.summarize(sm.cube(f), "state")
    assert sm.latest_year(f, "state").first().year == 2024
    top = verbs.ranking(states.where("year = 2024"), "state", "pm25", 2).collect()
    assert [(r["rank"], r.label, r.value) for r in top] == [(1, "Delhi, India", 72.0), (2, "Uttar Pradesh, India", 58.0)]


def test_rows_of_the_level_itself_win(spark):
    rows = sm.summarize(sm.cube(facts(spark, INDIA)), "country").where("country = 'India' and year = 2024").first()
    assert (rows.pm25, rows.national_standard, rows.population) == (42.0, 40.0, 1.4e9)
    only_states = sm.summarize(sm.cube(facts(spark, INDIA[:3])), "country").where("year = 2024").first()
    assert only_states.pm25 == pytest.approx((72 * 21e6 + 58 * 240e6) / 261e6) and not only_states.used_simple_average


def test_life_loss(spark):
    f = facts(spark, INDIA)
    loss = lambda where, b: f.where(where).select(m.life_loss(b)).first()[0]
    assert loss("state = 'Maharashtra'", m.Benchmark("custom", 10.0)) == pytest.approx(2.45)
    assert loss("state is null and country = 'India'", m.NATIONAL) == 0.2
    assert loss("state = 'Maharashtra'", m.WHO) == pytest.approx(2.94)
    assert loss("country = 'Nepal'", m.NATIONAL) is None


def test_period_average_and_leaders(spark):
    rows = [("A", 2020, 30), ("A", 2024, 50), ("B", 2020, 45), ("B", 2024, 45)]
    f = facts(spark, [{"country": "India", "name_1": f"State {s}", "year": str(y), "pm25": str(v)} for s, y, v in rows])
    states = sm.summarize(sm.cube(f), "state")
    assert [(r.label, r.value) for r in verbs.ranking(sm.period_average(states, 2020, 2024), "state", "pm25", 2).collect()] == [("State B, India", 45.0), ("State A, India", 40.0)]
    assert sorted((r.year, r.label, r.value) for r in verbs.annual_leaders(states, "state", 2020, 2024).collect()) == [(2020, "State B, India", 45.0), (2024, "State A, India", 50.0)]


def test_wide_years(spark):
    wide = {"region": "Asia", "country": "India", "name_1": "Goa", "population": "1000", "whostandard": "5", "natstandard": "40", "pm2020": "20", "pm2021": "30", "llpp_who_2021": "2.5", "llpp_nat_2020": "0"}
    got = sorted((r.year, r.pm25, r.llpp_who, r.llpp_national, r.national_standard) for r in facts(spark, [wide]).collect())
    assert got == [(2020, 20.0, None, 0.0, 40.0), (2021, 30.0, 2.5, None, 40.0)]
    assert facts(spark, [wide]).first().csv_level == "gadm1"


def test_thresholds(spark):
    rows = [("A", 15, 30, 5, 0.1, 0.5, 1e6), ("B", 20, 40, 5, 1.0, 0.8, 2e8), ("C", 30, 30, 10, 2.0, 1.5, 3e8)]
    f = facts(spark, [{"country": c, "year": "2024", "pm25": str(p), "natstandard": str(n), "whostandard": str(w), "llpp_who": str(a), "llpp_national": str(b), "population": str(int(q))} for c, p, n, w, a, b, q in rows])
    s = sm.summarize(sm.cube(f), "country")
    names = lambda *a: [r.label for r in verbs.threshold_filter(s, "country", 2024, *a).collect()]
    assert names("pm25", "lt", 20) == ["A"] and names("pm25", "lte", 20) == ["A", "B"] and names("pm25", "eq", 20) == ["B"]
    assert names("national_standard", "gte", 30) == ["B", "A", "C"] and names("who_standard", "eq", 5) == ["A", "B"]
    assert names("llpp_national", "lte", 0.8) == ["A", "B"]
    assert verbs.threshold_count(s, "country", 2024, "population", "gt", 1e8).first().n == 2


def test_change_peak_and_trend(spark):
    series = [(2014, 40), (2015, 60), (2024, 55)]
    f = facts(spark, [{"country": "India", "name_1": "Delhi", "year": str(y), "pm25": str(v)} for y, v in series])
    place = sm.summarize(sm.cube(f), "state")
    peak = verbs.peak_change(place, 2014, 2024).first()
    assert (peak.from_year, peak.to_year, peak.change) == (2014, 2015, 20.0)
    assert tuple(verbs.peak_value(place, 2014, 2024).first()) == (2015, 60.0)
    t = verbs.trend(place, 2014, 2024).first()
    assert (t.change, t.direction) == (15.0, "worsened")
    panel = [("A", 2014, 30, 4), ("A", 2024, 20, 2), ("B", 2014, 20, 1), ("B", 2024, 18, 0.5), ("C", 2014, 10, 1), ("C", 2024, 12, 1.2)]
    c = sm.summarize(sm.cube(facts(spark, [{"country": n, "year": str(y), "pm25": str(p), "llpp_who": str(x)} for n, y, p, x in panel])), "country")
    best = verbs.change_ranking(c, "country", 2014, 2024, 10, metric="life_loss", direction="improved").collect()
    assert [(r.label, r.change) for r in best] == [("A", -2.0), ("B", -0.5)]


def test_parsing(spark):
    text = ["1,234.5 people", "N/A", "-", "", None, "-3", "about 7", "2024"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in text], "x string").select(m.parse_numeric("x")).collect()]
    assert got == [1234.5, None, None, None, None, -3.0, 7.0, 2024.0]
    years = [r[0] for r in spark.createDataFrame([("2024",), ("1899",), ("2024.6",), ("x",)], "x string").select(m.parse_year("x")).collect()]
    assert years == [2024, None, 2025, None]
    names = [r[0] for r in spark.createDataFrame([("Burma",), (" Côte d'Ivoire ",), ("Mayammar-X",)], "x string").select(normalize_place("x")).collect()]
    assert names == ["myanmar", "c te d ivoire", "myanmar x"]
    assert [r[0] for r in spark.createDataFrame([("N/A",), ("Goa",), (None,)], "x string").select(usable_label("x")).collect()] == [False, True, False]


def test_number_formats():
    assert [m.format_number(x) for x in (1.005, 0.125, 72.0, 6.57, -0.001)] == ["1", "0.13", "72", "6.57", "0"]
    assert m.format_signed(12.0) == "+12" and m.format_integer(1234567.5) == "1,234,568"


def test_legacy_text_and_distinct_records(spark):
    text = "head\nCSV record 1 from x.csv\ncountry: India\nyear: 2024\nyear: 2025\n: bad\nCSV record 2 from x.csv\nnote: a: b\n"
    got = records.records_of_text(spark.createDataFrame([("s", text)], "source_id string, content string"))
    assert sorted((r.record, tuple(sorted(r.fields.items()))) for r in got.collect()) == [(0, (("country", "India"), ("year", "2025"))), (1, (("note", "a: b"),))]
    twice = got.unionByName(got)
    assert records.distinct_records(twice).count() == 2


def test_latest_sources(spark):
    rows = [("a", "gadm0", "2024-01-01", 1), ("b", "gadm0", "2024-02-01", 2), ("c", "gadm1", None, 3), ("d", None, None, 4), ("e", None, None, 5)]
    t = spark.createDataFrame(rows, "id string, level string, at string, seq long").select("id", "level", F.to_timestamp("at").alias("updated_at"), F.lit(None).cast("timestamp").alias("created_at"), "seq", F.lit("active").alias("status"))
    assert {r.id for r in records.latest_sources(t).collect()} == {"b", "c", "d", "e"}
    assert {r.id for r in records.supersede(t, "b", "gadm0").where("status = 'inactive'").collect()} == {"a"}
