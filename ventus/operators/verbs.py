"""The verbs of metric questions, each a plan over annual summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ventus.functions.metrics import NATIONAL, WHO, Benchmark, condition, life_loss, metric_value, person_years
from ventus.functions.places import LEVELS, is_territory, normalize_place, place_label

MOST_LISTED = 25


def scoped(table: DataFrame, level: str, place: str | None) -> DataFrame:
    """Rows below a place of a higher level."""
    if place is None:
        return table
    wanted = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in place.lower()).split())
    return table.where(normalize_place(level) == F.lit(wanted))


def threshold_filter(summary: DataFrame, level: str, year: int, metric: str, operator: str, threshold: float) -> DataFrame:
    """Places of a year that meet a condition: nearest to the threshold's open end first, by label if equal is asked."""
    value = metric_value(metric)
    found = summary.where((F.col("year") == year)).withColumn("value", value).where(condition(F.col("value"), operator, threshold))
    if level == "country":
        found = found.where(~is_territory("country"))
    order = [F.collate(F.col("label"), "UNICODE")] if operator == "eq" else [F.col("value").asc() if operator in ("lt", "lte") else F.col("value").desc()]
    return found.withColumn("label", place_label(level)).select("label", "place_key", "value", "seq").orderBy(*order, "seq")


def threshold_count(summary: DataFrame, level: str, year: int, metric: str, operator: str, threshold: float) -> DataFrame:
    return threshold_filter(summary, level, year, metric, operator, threshold).agg(F.count("*").cast("long").alias("n"))


def ranking(summary: DataFrame, level: str, metric: str, k: int, ascending: bool = False, benchmark: Benchmark = WHO, livable: bool = False) -> DataFrame:
    """First k places by a metric; ties go by first appearance.  livable: only sovereign places with people and a measured value."""
    rows = summary.where((F.col("pm25") > 0) & (F.col("population") > 0) & ~is_territory("country")) if livable else summary
    rows = rows.withColumn("value", metric_value(metric, benchmark)).where("value is not null")
    best = rows.orderBy(F.col("value").asc() if ascending else F.col("value").desc(), "seq").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("value").asc() if ascending else F.col("value").desc(), "seq"))
    return best.select(rank.alias("rank"), place_label(level).alias("label"), "place_key", "value")


def annual_leaders(summary: DataFrame, level: str, start: int, end: int, metric: str = "pm25", ascending: bool = False, benchmark: Benchmark = WHO) -> DataFrame:
    """The leading place of each year; years without a value are left out."""
    rows = summary.where(F.col("year").between(start, end)).withColumn("value", metric_value(metric, benchmark)).where("value is not null")
    order = Window.partitionBy("year").orderBy(F.col("value").asc() if ascending else F.col("value").desc(), "seq")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("year", place_label(level).alias("label"), "value")


def changes(summary: DataFrame, start: int, end: int, metric: str = "pm25", benchmark: Benchmark = WHO) -> DataFrame:
    """Values of two years and their difference, for places that have both; one aggregation instead of a join."""
    at = lambda y, c: F.max(F.when(F.col("year") == y, c))
    value, national = metric_value(metric, benchmark), life_loss(NATIONAL)
    rows = summary.where(F.col("year").isin(start, end)).groupBy("place_key").agg(
        at(start, value).alias("start_value"), at(end, value).alias("end_value"),
        (at(end, life_loss(WHO)) - at(start, life_loss(WHO))).alias("who_change"), (at(end, national) - at(start, national)).alias("national_change"),
        F.max_by(F.struct(*LEVELS), "year").alias("labels"), F.min(F.when(F.col("year") == end, F.col("seq"))).alias("seq"),
    )
    return rows.where("start_value is not null and end_value is not null").select("place_key", *[F.col(f"labels.{x}").alias(x) for x in LEVELS], "start_value", "end_value", (F.col("end_value") - F.col("start_value")).alias("change"), "who_change", "national_change", "seq")


def change_ranking(summary: DataFrame, level: str, start: int, end: int, k: int, metric: str = "pm25", benchmark: Benchmark = WHO, direction: str | None = None, ascending: bool = False, both_benchmarks: bool = False) -> DataFrame:
    """First k places by change; direction 'improved' or 'worsened' keeps one sign, both_benchmarks sorts by and needs both losses."""
    by = F.col("who_change") if both_benchmarks else F.col("change")
    rows = changes(summary, start, end, metric, benchmark).withColumn("by", by).where("by is not null")
    if both_benchmarks:
        rows = rows.where("national_change is not null")
    if direction:
        rows = rows.where(F.col("by") < 0 if direction == "improved" else F.col("by") > 0)
    return rows.orderBy(F.col("by").asc() if ascending or direction == "improved" else F.col("by").desc(), "seq").limit(k).select(place_label(level).alias("label"), "start_value", "end_value", "change", "who_change", "national_change")


def common_years(summary: DataFrame, first: str, second: str) -> DataFrame:
    """Years in which both places (by key) have a row."""
    return summary.where(F.col("place_key") == first).select("year").intersect(summary.where(F.col("place_key") == second).select("year"))


def compare(first: DataFrame, second: DataFrame, benchmark: Benchmark = WHO) -> DataFrame:
    """Two places' rows (of one summary each) side by side for the years they share, with differences."""
    side = lambda t, p: t.select("year", *[c.alias(f"{p}_{n}") for n, c in (("pm25", F.col("pm25")), ("loss", life_loss(benchmark)))])
    return side(first, "first").join(side(second, "second"), "year").select("*", F.abs(F.col("first_pm25") - F.col("second_pm25")).alias("pm25_gap"), F.abs(F.col("first_loss") - F.col("second_loss")).alias("loss_gap"))


def compare_period(first: DataFrame, second: DataFrame, start: int, end: int) -> DataFrame:
    """Start, end and change of two places' pm25, and the gap in the end year."""
    ends = lambda t, p: t.where(F.col("year").isin(start, end)).agg(F.max(F.when(F.col("year") == start, F.col("pm25"))).alias(f"{p}_start"), F.max(F.when(F.col("year") == end, F.col("pm25"))).alias(f"{p}_end"))
    one_row_each = ends(first, "first").join(ends(second, "second"))  # one row on either side
    return one_row_each.select("*", (F.col("first_end") - F.col("first_start")).alias("first_change"), (F.col("second_end") - F.col("second_start")).alias("second_change"), F.abs(F.col("first_end") - F.col("second_end")).alias("end_gap"))


def steps(place: DataFrame) -> DataFrame:
    """A place's change from each year to the next that it has."""
    by_year = Window.partitionBy("place_key").orderBy("year")
    return place.where("pm25 is not null").select("place_key", F.lag("year").over(by_year).alias("from_year"), F.col("year").alias("to_year"), F.lag("pm25").over(by_year).alias("from_value"), F.col("pm25").alias("to_value")).where("from_year is not null").withColumn("change", F.col("to_value") - F.col("from_value"))


def peak_change(place: DataFrame, start: int, end: int, decrease: bool = False) -> DataFrame:
    found = steps(place.where(F.col("year").between(start, end)))
    return found.orderBy(F.col("change").asc() if decrease else F.col("change").desc(), "to_year").limit(1)


def peak_value(place: DataFrame, start: int, end: int, lowest: bool = False) -> DataFrame:
    rows = place.where(F.col("year").between(start, end) & F.col("pm25").isNotNull())
    return rows.orderBy(F.col("pm25").asc() if lowest else F.col("pm25").desc(), "year").limit(1).select("year", "pm25")


def trend(place: DataFrame, start: int, end: int, benchmark: Benchmark = WHO) -> DataFrame:
    at = lambda y, c: F.max(F.when(F.col("year") == y, c))
    loss = life_loss(benchmark)
    out = place.agg(at(start, F.col("pm25")).alias("start_value"), at(end, F.col("pm25")).alias("end_value"), at(start, loss).alias("start_loss"), at(end, loss).alias("end_loss"))
    change = F.col("end_value") - F.col("start_value")
    return out.select("*", change.alias("change"), F.when(change > 0, "worsened").when(change < 0, "improved").when(change == 0, "unchanged").alias("direction"))


def direct_value(summary: DataFrame, level: str, year: int, benchmark: Benchmark = WHO) -> DataFrame:
    return summary.where(F.col("year") == year).select(place_label(level).alias("label"), "year", "pm25", life_loss(benchmark).alias("life_loss"), "population", person_years(benchmark).alias("person_years"), "used_simple_average")


def ambiguous_labels(facts: DataFrame, level: str) -> DataFrame:
    """Names of a level that stand under more than one parent."""
    parent = LEVELS[LEVELS.index(level) - 1]
    names = facts.where(F.col(level).isNotNull() & F.col(parent).isNotNull()).select(normalize_place(level).alias("name"), normalize_place(parent).alias("parent")).distinct()
    return names.groupBy("name").agg(F.count("*").cast("long").alias("n_parents")).where("n_parents > 1")
