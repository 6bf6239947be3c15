"""Metric queries over the driver's tables, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.functions.metrics import NATIONAL, WHO, Benchmark, life_loss, parse_numeric
from ventus.functions.places import normalize_place
from ventus.operators import summary as sm
from ventus.operators import verbs
from ventus.sources import records
from ventus.sources.tables import geo_facts, line_facts, read

NUMBERS = [*sm.AVERAGED, "population"]

# SQL building blocks

_NORM = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_GEO = """SELECT r_name AS region, n_name AS country, {state} AS state, {district} AS district, CAST(year(o_orderdate) AS INTEGER) AS year,
 o_totalprice / 9973 AS pm25, CAST(NULL AS DOUBLE) AS llpp, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice / 99991 END AS llpp_who, CAST(NULL AS DOUBLE) AS llpp_national,
 c_acctbal AS population, CAST(5 AS DOUBLE) AS who_standard, CASE WHEN r_regionkey > 0 THEN CAST(10 + 5 * r_regionkey AS DOUBLE) END AS national_standard, o_orderkey AS seq
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
GEO = _GEO.format(state="c_mktsegment", district="'D' || CAST(c_custkey % 10 AS VARCHAR)")
MIXED = _GEO.format(state="CASE WHEN o_orderkey % 7 <> 0 THEN c_mktsegment END", district="CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN 'D' || CAST(c_custkey % 10 AS VARCHAR) END")
LINE = """SELECT r_name AS region, n_name AS country, CAST(NULL AS VARCHAR) AS state, CAST(NULL AS VARCHAR) AS district, CAST(year(l_shipdate) AS INTEGER) AS year,
 l_extendedprice / 997 AS pm25, CAST(NULL AS DOUBLE) AS llpp, CAST(NULL AS DOUBLE) AS llpp_who, CAST(NULL AS DOUBLE) AS llpp_national, l_quantity AS population,
 CAST(5 AS DOUBLE) AS who_standard, CAST(35 AS DOUBLE) AS national_standard, l_orderkey * 10 + l_linenumber AS seq
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_KEYS = {"region": ["region"], "country": ["region", "country"], "state": ["country", "state"], "district": ["country", "state", "district"]}
_LABEL = {"region": "region", "country": "country", "state": "state || ', ' || country", "district": "district || ', ' || state || ', ' || country"}
_ORDER = ["region", "country", "state", "district"]


def sql_summary(level: str, facts: str = GEO) -> str:
    """The annual summary of a level, written with windows over the facts themselves."""
    key = " || '|' || ".join(f"coalesce({_NORM.format(k)}, '')" for k in _KEYS[level])
    exact = " AND ".join([f"{level} IS NOT NULL", *[f"{d} IS NULL" for d in _ORDER[_ORDER.index(level) + 1 :]]])
    average = lambda f: f"CASE WHEN count({f}) = count(CASE WHEN population > 0 THEN {f} END) THEN sum(CASE WHEN population > 0 THEN {f} * population END) / sum(CASE WHEN population > 0 AND {f} IS NOT NULL THEN population END) ELSE avg({f}) END AS {f}"
    labels = ", ".join(f"arg_min({x}, first_at) AS {x}" if x in _ORDER[: _ORDER.index(level) + 1] else f"CAST(NULL AS VARCHAR) AS {x}" for x in _ORDER)
    firsts = ", ".join(f"first_value({x}) OVER w AS first_{x}" for x in _ORDER[: _ORDER.index(level) + 1])
    labels = ", ".join(f"min(first_{x}) AS {x}" if x in _ORDER[: _ORDER.index(level) + 1] else f"CAST(NULL AS VARCHAR) AS {x}" for x in _ORDER)
    return f"""SELECT place_key, {labels}, year, {", ".join(average(f) for f in sm.AVERAGED)}, sum(population) AS population,
 count(*) > 1 AND count(CASE WHEN population > 0 THEN 1 END) < count(*) AS used_simple_average, min(first_at) AS seq
 FROM (SELECT *, min(seq) OVER w2 AS first_at, max(CASE WHEN exact THEN 1 ELSE 0 END) OVER w2 AS has_exact, {firsts}
  FROM (SELECT *, {key} AS place_key, {exact} AS exact FROM ({facts}) WHERE {level} IS NOT NULL)
  WINDOW w AS (PARTITION BY place_key, year ORDER BY seq), w2 AS (PARTITION BY place_key, year))
 WHERE exact OR has_exact = 0 GROUP BY place_key, year"""


LOSS_WHO = "coalesce(llpp_who, llpp, greatest(pm25 - coalesce(who_standard, 5), 0) * 0.098)"
LOSS_NATIONAL = "coalesce(llpp_national, CASE WHEN national_standard IS NOT NULL THEN greatest(pm25 - national_standard, 0) * 0.098 END)"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql_rounded(columns: list[str], numbers: set[str], table: str, rest: str = "") -> str:
    return f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in numbers else c for c in columns)} FROM ({table}) {rest}"


def _annual(spark, sf_dir, level, facts=geo_facts) -> DataFrame:
    return sm.summarize(sm.cube(facts(spark, sf_dir)), level)


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


_shown = ["place_key", *_ORDER, "year", *NUMBERS, "used_simple_average"]
_numbers = set(NUMBERS)


@query("weighted_average_country_year", _sql_rounded(_shown, _numbers, sql_summary("country")))
def weighted_average_country_year(spark, sf_dir):
    return _rounded(_annual(spark, sf_dir, "country").select(*_shown))


@query("weighted_average_all_positive", _sql_rounded(_shown, _numbers, sql_summary("country", LINE)))
def weighted_average_all_positive(spark, sf_dir):
    return _rounded(_annual(spark, sf_dir, "country", line_facts).select(*_shown))


@query("level_summary_exact_first", " UNION ALL ".join(f"({_sql_rounded(_shown, _numbers, sql_summary(x, MIXED))})" for x in ("country", "state")))
def level_summary_exact_first(spark, sf_dir):
    cubed = sm.cube(geo_facts(spark, sf_dir, mixed=True))
    return _rounded(sm.summarize(cubed, "country").unionByName(sm.summarize(cubed, "state")).select(*_shown))


@query("level_summary_district", _sql_rounded(_shown, _numbers, sql_summary("district")))
def level_summary_district(spark, sf_dir):
    return _rounded(_annual(spark, sf_dir, "district").select(*_shown))


@query("target_summary", _sql_rounded(_shown, _numbers, sql_summary("region"), "WHERE region = 'ASIA'"))
def target_summary(spark, sf_dir):
    return _rounded(_annual(spark, sf_dir, "region").where(normalize_place("region") == "asia").select(*_shown))


_period = f"""SELECT place_key, count(*) AS n_years, {", ".join(f"avg({f}) AS {f}" for f in sm.AVERAGED)}, arg_max(country, year) AS country, arg_max(population, year) AS population, min(seq) AS seq
 FROM ({sql_summary("country")}) WHERE year BETWEEN 1996 AND 2000 GROUP BY place_key"""


@query("period_average_ranking", f"SELECT country, n_years, round(pm25, 6) AS pm25, round(population, 6) AS population, CAST(row_number() OVER (ORDER BY pm25 DESC, seq) AS INTEGER) AS rank FROM ({_period}) ORDER BY pm25 DESC, seq LIMIT 5")
def period_average_ranking(spark, sf_dir):
    rows = sm.period_average(_annual(spark, sf_dir, "country"), 1996, 2000)
    top = verbs.ranking(rows, "country", "pm25", 5).select("place_key", "rank")
    return _rounded(rows.join(F.broadcast(top), "place_key").select("country", "n_years", "pm25", "population", "rank"))  # five rows


@query("latest_year_per_level", f"SELECT level, max(year) AS year FROM (SELECT unnest(['region', 'country', 'state', 'district']) AS level, year FROM ({GEO})) GROUP BY level")
def latest_year_per_level(spark, sf_dir):
    facts = geo_facts(spark, sf_dir)
    from functools import reduce

    return reduce(DataFrame.unionByName, [sm.latest_year(facts, x).withColumn("level", F.lit(x)) for x in _ORDER])


@query("available_years", f"SELECT DISTINCT year FROM ({GEO})")
def available_years(spark, sf_dir):
    return sm.available_years(geo_facts(spark, sf_dir))


@query("levels_present", "SELECT ['gadm0', 'gadm2'] AS levels")
def levels_present(spark, sf_dir):
    return sm.levels_present(geo_facts(spark, sf_dir).unionByName(line_facts(spark, sf_dir)))


_value = {"pm25": "pm25", "population": "population", "national_standard": "national_standard", "llpp_who": LOSS_WHO, "llpp_national": LOSS_NATIONAL}
_sign = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}


def _threshold(name, level, metric, operator, threshold, facts_sql=GEO, facts=geo_facts):
    test = f"abs(value - {threshold}) < 1e-9" if operator == "eq" else f"value {_sign[operator]} {threshold}"
    sql = f"SELECT {_LABEL[level]} AS label, round(value, 6) AS value FROM (SELECT *, {_value[metric]} AS value FROM ({sql_summary(level, facts_sql)}) WHERE year = 1996) WHERE {test}"

    @query(name, sql)
    def run(spark, sf_dir):
        return _rounded(verbs.threshold_filter(_annual(spark, sf_dir, level, facts), level, 1996, metric, operator, threshold).select("label", "value"))

    return run


_threshold("threshold_lt", "country", "pm25", "lt", 26.5)
_threshold("threshold_lte", "state", "pm25", "lte", 25.0)
_threshold("threshold_gt", "state", "llpp_who", "gt", 1.5)
_threshold("threshold_gte", "country", "population", "gte", 100000.0)
_threshold("threshold_eq", "country", "national_standard", "eq", 15.0)
_threshold("threshold_national_loss", "district", "llpp_national", "gt", 0.4)


@query("threshold_count", f"SELECT count(*) AS n FROM ({sql_summary('state')}) WHERE year = 1996 AND pm25 > 26")
def threshold_count(spark, sf_dir):
    return verbs.threshold_count(_annual(spark, sf_dir, "state"), "state", 1996, "pm25", "gt", 26.0)


@query("threshold_scoped", f"SELECT {_LABEL['state']} AS label, round(pm25, 6) AS value FROM ({sql_summary('state', f'SELECT * FROM ({GEO}) WHERE country = ' + "'NATION_12'")}) WHERE year = 1996 AND pm25 > 20")
def threshold_scoped(spark, sf_dir):
    facts = verbs.scoped(geo_facts(spark, sf_dir), "country", "Nation-12")
    return _rounded(verbs.threshold_filter(sm.summarize(sm.cube(facts), "state"), "state", 1996, "pm25", "gt", 20.0).select("label", "value"))


@query("territories_left_out", "SELECT n_name AS country FROM nation")
def territories_left_out(spark, sf_dir):
    names = read(spark, sf_dir, "nation").select(F.col("n_name").alias("country"))
    more = names.limit(1).select(F.explode(F.array(F.lit("Hong Kong"), F.lit("PUERTO-RICO"), F.lit("Virgin Islands, U.S."))).alias("country"))
    from ventus.functions.places import is_territory

    return names.unionByName(more).where(~is_territory("country"))


def _ranking(name, level, value_sql, k, ascending=False, where="", **options):
    order = f"value {'ASC' if ascending else 'DESC'}, seq"
    sql = f"SELECT CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS rank, {_LABEL[level]} AS label, round(value, 6) AS value FROM (SELECT *, {value_sql} AS value FROM ({sql_summary(level)}) WHERE year = 2000 {where}) WHERE value IS NOT NULL ORDER BY {order} LIMIT {k}"

    @query(name, sql)
    def run(spark, sf_dir):
        rows = _annual(spark, sf_dir, level).where("year = 2000")
        return _rounded(verbs.ranking(rows, level, k=k, ascending=ascending, **options).select("rank", "label", "value"))


_ranking("rank_pm25_top", "state", "pm25", 10, metric="pm25")
_ranking("rank_pm25_bottom", "district", "pm25", 25, ascending=True, metric="pm25")
_ranking("rank_life_loss_who", "country", LOSS_WHO, 5, metric="life_loss", benchmark=WHO)
_ranking("rank_life_loss_national", "country", LOSS_NATIONAL, 5, metric="life_loss", benchmark=NATIONAL)
_ranking("rank_life_loss_custom", "country", "greatest(pm25 - 8, 0) * 0.098", 3, metric="life_loss", benchmark=Benchmark("custom", 8.0))
_ranking("rank_population", "country", "population", 10, metric="population")
_ranking("rank_livable", "country", "pm25", 10, ascending=True, where="AND pm25 > 0 AND population > 0", metric="pm25", livable=True)


def _leaders(name, ascending):
    sql = f"SELECT year, country AS label, round(pm25, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY pm25 {'ASC' if ascending else 'DESC'}, seq) AS n FROM ({sql_summary('country')}) WHERE year BETWEEN 1995 AND 2000) WHERE n = 1"

    @query(name, sql)
    def run(spark, sf_dir):
        return _rounded(verbs.annual_leaders(_annual(spark, sf_dir, "country"), "country", 1995, 2000, ascending=ascending))


_leaders("annual_leaders_top", False)
_leaders("annual_leaders_bottom", True)


def _change_sql(level, start, end, order, k, where=""):
    s = sql_summary(level)
    return f"""SELECT {_LABEL[level]} AS label, round(start_value, 6) AS start_value, round(end_value, 6) AS end_value, round(change, 6) AS change, round(who_change, 6) AS who_change, round(national_change, 6) AS national_change FROM
 (SELECT e.*, b.pm25 AS start_value, e.pm25 AS end_value, e.pm25 - b.pm25 AS change, e.who - b.who AS who_change, e.nat - b.nat AS national_change
  FROM (SELECT *, {LOSS_WHO} AS who, {LOSS_NATIONAL} AS nat FROM ({s}) WHERE year = {end}) e JOIN (SELECT *, {LOSS_WHO} AS who, {LOSS_NATIONAL} AS nat FROM ({s}) WHERE year = {start}) b USING (place_key)) {where} ORDER BY {order}, seq LIMIT {k}"""


@query("change_ranking", _change_sql("state", 1995, 2000, "change DESC", 10))
def change_ranking(spark, sf_dir):
    return _rounded(verbs.change_ranking(_annual(spark, sf_dir, "state"), "state", 1995, 2000, 10))


@query("improvement_ranking", _change_sql("country", 1995, 2000, "change ASC", 10, "WHERE change < 0"))
def improvement_ranking(spark, sf_dir):
    return _rounded(verbs.change_ranking(_annual(spark, sf_dir, "country"), "country", 1995, 2000, 10, direction="improved"))


@query("both_benchmark_change", _change_sql("country", 1995, 2000, "who_change DESC", 10, "WHERE national_change IS NOT NULL AND who_change > 0"))
def both_benchmark_change(spark, sf_dir):
    return _rounded(verbs.change_ranking(_annual(spark, sf_dir, "country"), "country", 1995, 2000, 10, direction="worsened", both_benchmarks=True))


_country = sql_summary("country")


@query("common_years", f"SELECT year FROM ({_country}) WHERE country = 'NATION_12' INTERSECT SELECT year FROM ({_country}) WHERE country = 'NATION_17'")
def common_years(spark, sf_dir):
    return verbs.common_years(_annual(spark, sf_dir, "country"), "asia|nation 12", "asia|nation 17")


@query("compare_two_places_year", f"""SELECT year, round(a.pm25, 6) AS first_pm25, round(a.loss, 6) AS first_loss, round(b.pm25, 6) AS second_pm25, round(b.loss, 6) AS second_loss, round(abs(a.pm25 - b.pm25), 6) AS pm25_gap, round(abs(a.loss - b.loss), 6) AS loss_gap
 FROM (SELECT *, {LOSS_WHO} AS loss FROM ({_country}) WHERE country = 'NATION_12') a JOIN (SELECT *, {LOSS_WHO} AS loss FROM ({sql_summary("region")}) WHERE region = 'EUROPE') b USING (year)""")
def compare_two_places_year(spark, sf_dir):
    cubed = sm.cube(geo_facts(spark, sf_dir))
    return _rounded(verbs.compare(sm.summarize(cubed, "country").where("place_key = 'asia|nation 12'"), sm.summarize(cubed, "region").where("place_key = 'europe'")))


@query("compare_two_places_period", f"""SELECT round(a0, 6) AS first_start, round(a1, 6) AS first_end, round(b0, 6) AS second_start, round(b1, 6) AS second_end, round(a1 - a0, 6) AS first_change, round(b1 - b0, 6) AS second_change, round(abs(a1 - b1), 6) AS end_gap
 FROM (SELECT max(CASE WHEN country = 'NATION_12' AND year = 1995 THEN pm25 END) AS a0, max(CASE WHEN country = 'NATION_12' AND year = 2000 THEN pm25 END) AS a1, max(CASE WHEN country = 'NATION_17' AND year = 1995 THEN pm25 END) AS b0, max(CASE WHEN country = 'NATION_17' AND year = 2000 THEN pm25 END) AS b1 FROM ({_country}))""")
def compare_two_places_period(spark, sf_dir):
    rows = _annual(spark, sf_dir, "country")
    return _rounded(verbs.compare_period(rows.where("place_key = 'asia|nation 12'"), rows.where("place_key = 'asia|nation 17'"), 1995, 2000))


_steps = f"SELECT lag(year) OVER (ORDER BY year) AS from_year, year AS to_year, lag(pm25) OVER (ORDER BY year) AS from_value, pm25 AS to_value FROM ({_country}) WHERE country = 'NATION_10' AND year BETWEEN 1995 AND 2001"


@query("peak_change", f"SELECT from_year, to_year, round(from_value, 6) AS from_value, round(to_value, 6) AS to_value, round(to_value - from_value, 6) AS change FROM ({_steps}) WHERE from_year IS NOT NULL ORDER BY to_value - from_value DESC, to_year LIMIT 1")
def peak_change(spark, sf_dir):
    return _rounded(verbs.peak_change(_annual(spark, sf_dir, "country").where("place_key = 'africa|nation 10'"), 1995, 2001).drop("place_key"))


@query("peak_value", f"SELECT year, round(pm25, 6) AS pm25 FROM ({_country}) WHERE country = 'NATION_10' ORDER BY pm25 DESC, year LIMIT 1")
def peak_value(spark, sf_dir):
    return _rounded(verbs.peak_value(_annual(spark, sf_dir, "country").where("place_key = 'africa|nation 10'"), 1900, 2200))


@query("trend_two_points", f"""SELECT round(v0, 6) AS start_value, round(v1, 6) AS end_value, round(l0, 6) AS start_loss, round(l1, 6) AS end_loss, round(v1 - v0, 6) AS change, CASE WHEN v1 > v0 THEN 'worsened' WHEN v1 < v0 THEN 'improved' WHEN v1 = v0 THEN 'unchanged' END AS direction
 FROM (SELECT max(CASE WHEN year = 1995 THEN pm25 END) AS v0, max(CASE WHEN year = 2000 THEN pm25 END) AS v1, max(CASE WHEN year = 1995 THEN {LOSS_WHO} END) AS l0, max(CASE WHEN year = 2000 THEN {LOSS_WHO} END) AS l1 FROM ({_country}) WHERE country = 'NATION_11')""")
def trend_two_points(spark, sf_dir):
    return _rounded(verbs.trend(_annual(spark, sf_dir, "country").where("place_key = 'america|nation 11'"), 1995, 2000))


@query("direct_value", f"SELECT country AS label, year, round(pm25, 6) AS pm25, round({LOSS_WHO}, 6) AS life_loss, round(population, 6) AS population, CASE WHEN population > 0 THEN round({LOSS_WHO} * population, 4) END AS person_years, used_simple_average FROM ({_country}) WHERE year = 1995")
def direct_value(spark, sf_dir):
    out = verbs.direct_value(_annual(spark, sf_dir, "country"), "country", 1995)
    return out.select("label", "year", F.round("pm25", 6).alias("pm25"), F.round("life_loss", 6).alias("life_loss"), F.round("population", 6).alias("population"), F.round("person_years", 4).alias("person_years"), "used_simple_average")


@query("ambiguous_labels", f"SELECT lower(state) AS name, count(DISTINCT country) AS n_parents FROM ({GEO}) GROUP BY 1 HAVING count(DISTINCT country) > 1")
def ambiguous_labels(spark, sf_dir):
    return verbs.ambiguous_labels(geo_facts(spark, sf_dir), "state")


# records

_wide = "SELECT p_partkey, year, pm25 FROM (SELECT p_partkey, unnest([2019, 2020, 2021]) AS year, unnest([p_retailprice, CAST(p_size AS DOUBLE), CASE WHEN p_size > 25 THEN p_retailprice / 2 END]) AS pm25 FROM part)"


@query("wide_to_long", _wide)
def wide_to_long(spark, sf_dir):
    part = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").cast("double").alias("b"), F.when(F.col("p_size") > 25, F.col("p_retailprice") / 2).alias("c"))
    return records.wide_to_long(part, ["p_partkey"], {2019: "a", 2020: "b", 2021: "c"}, "pm25")


@query("alias_coalesce", "SELECT p_brand AS country, CASE WHEN p_size % 3 <> 0 THEN p_type END AS state, CAST(2000 + p_size % 20 AS INTEGER) AS year, CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE CAST(p_size AS DOUBLE) END AS pm25 FROM part")
def alias_coalesce(spark, sf_dir):
    part = read(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_brand").alias("Country Name"), F.when(F.col("p_size") % 3 != 0, F.col("p_type")).otherwise(" ").alias("NAME_1"), (2000 + F.col("p_size") % 20).cast("string").alias("Data Year"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise("").alias("PM2.5"), F.col("p_size").cast("string").alias("Particulate Pollution"),
    )
    return records.canonical(rows, "t.csv").select("country", "state", "year", "pm25")


@query("numeric_parse", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE CAST(regexp_replace(regexp_extract(CAST(p_retailprice * 1000 AS VARCHAR), '\\d+'), ',', '', 'g') AS DOUBLE) END AS n FROM part")
def numeric_parse(spark, sf_dir):
    whole = F.format_number(F.floor(F.col("p_retailprice") * 1000), 0)
    text = F.when(F.col("p_size") % 4 == 0, F.when(F.col("p_size") % 8 == 0, "N/A").otherwise(" - ")).otherwise(F.concat(F.lit("about "), whole, F.lit(" people")))
    return read(spark, sf_dir, "part").select("p_partkey", parse_numeric(text).alias("n"))


_sources = "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 < 3 THEN 'gadm' || CAST(o_orderkey % 5 AS VARCHAR) END AS level, CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'inactive' END AS status, o_orderdate AS since, o_orderkey AS seq FROM orders"


def _source_table(spark, sf_dir):
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(k.cast("string").alias("id"), F.when(k % 5 < 3, F.concat(F.lit("gadm"), (k % 5).cast("string"))).alias("level"), F.when(F.col("o_orderstatus") == "O", "active").otherwise("inactive").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), k.alias("seq"))


@query("latest_source_per_level", f"SELECT id, level FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY since DESC, seq) AS n FROM ({_sources})) WHERE n = 1 OR level IS NULL")
def latest_source_per_level(spark, sf_dir):
    return records.latest_sources(_source_table(spark, sf_dir)).select("id", "level")


@query("supersede_sources", f"SELECT id, CASE WHEN level = 'gadm1' AND status = 'active' AND id <> '1' THEN 'inactive' ELSE status END AS status FROM ({_sources})")
def supersede_sources(spark, sf_dir):
    return records.supersede(_source_table(spark, sf_dir), "1", "gadm1").select("id", "status")
