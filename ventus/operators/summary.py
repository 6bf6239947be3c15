"""Annual summaries of places from the fact table.

``cube`` reduces facts to one row of sums for each set of labels and year, in
one pre-aggregated pass; everything else works on the cube, which is as small
as there are places and years, however many facts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventus.functions.places import LEVELS, is_exact, place_key, usable_label

AVERAGED = ("pm25", "llpp", "llpp_who", "llpp_national", "who_standard", "national_standard")


def weighted_average(field: str, weight: str = "population", where: Column | None = None) -> Column:
    """Mean weighted by population if every row with the field has a positive one, else the plain mean."""
    v = F.col(field) if where is None else F.when(where, F.col(field))
    ok = v.isNotNull() & (F.col(weight) > 0)
    return F.when(F.count(v) == F.count_if(ok), F.sum(F.when(ok, v * F.col(weight))) / F.sum(F.when(ok, F.col(weight)))).otherwise(F.avg(v))


def cube(facts: DataFrame, *also: str) -> DataFrame:
    """Sums of facts by labels and year, and by other columns if named."""
    has_weight = F.col("population") > 0
    sums = []
    for f in AVERAGED:
        v = F.col(f)
        ok = v.isNotNull() & has_weight
        sums += [F.count(v).alias(f"{f}_n"), F.count_if(ok).alias(f"{f}_ok"), F.sum(v).alias(f"{f}_v"), F.sum(F.when(ok, v * F.col("population"))).alias(f"{f}_vp"), F.sum(F.when(ok, F.col("population"))).alias(f"{f}_p")]
    return facts.groupBy(*LEVELS, "year", *also).agg(
        F.count("*").alias("n_rows"), F.count_if(F.coalesce(~has_weight, F.lit(True))).alias("n_unweighted"), F.sum("population").alias("population"), F.min("seq").alias("seq"), *sums
    )


def cube_by_dataset(facts: DataFrame) -> DataFrame:
    """The cube with the dataset level kept; facts of a level come from its own dataset."""
    own = F.when(F.col("district").isNotNull(), "gadm2").when(F.col("state").isNotNull(), "gadm1").otherwise("gadm0")
    return cube(facts.withColumn("csv_level", F.coalesce("csv_level", own)), "csv_level")


def summarize(cubed: DataFrame, level: str) -> DataFrame:
    """One row for each place of a level and year.

    If a place has rows of its own level only these count, else all rows below
    it do; labels come from its first row.
    """
    exact = is_exact(level)
    rows = cubed.where(usable_label(level)).withColumn("place_key", place_key(level)).withColumn("exact", exact)
    e = F.col("exact")
    either = lambda name, agg=F.sum: F.when(F.max("exact"), agg(F.when(e, F.col(name)))).otherwise(agg(F.col(name)))
    out = rows.groupBy("place_key", "year").agg(
        *[either(f"{f}_{s}").alias(f"{f}_{s}") for f in AVERAGED for s in ("n", "ok", "v", "vp", "p")],
        either("population").alias("population"),
        either("n_rows").alias("n_rows"),
        either("n_unweighted").alias("n_unweighted"),
        F.min("seq").alias("seq"),
        F.min_by(F.struct(*LEVELS[: LEVELS.index(level) + 1]), "seq").alias("labels"),
    )
    average = lambda f: F.when(F.col(f"{f}_n") == F.col(f"{f}_ok"), F.col(f"{f}_vp") / F.nullif(F.col(f"{f}_p"), F.lit(0.0))).otherwise(F.col(f"{f}_v") / F.col(f"{f}_n"))
    return out.select(
        "place_key", *[(F.col(f"labels.{x}") if x in LEVELS[: LEVELS.index(level) + 1] else F.lit(None).cast("string")).alias(x) for x in LEVELS], "year",
        *[average(f).alias(f) for f in AVERAGED], "population", ((F.col("n_rows") > 1) & (F.col("n_unweighted") > 0)).alias("used_simple_average"), "seq",
    )


def period_average(summary: DataFrame, start: int, end: int) -> DataFrame:
    """Plain mean of annual values by place; labels and population of its latest year."""
    return (
        summary.where(F.col("year").between(start, end))
        .groupBy("place_key")
        .agg(*[F.avg(f).alias(f) for f in AVERAGED], F.max_by(F.struct(*LEVELS, "population"), "year").alias("last"), F.min("seq").alias("seq"), F.count("*").cast("long").alias("n_years"))
        .select("place_key", *[F.col(f"last.{x}").alias(x) for x in LEVELS], *AVERAGED, F.col("last.population").alias("population"), "n_years", "seq")
    )


def latest_year(facts: DataFrame, level: str) -> DataFrame:
    return facts.where(usable_label(level)).agg(F.max("year").alias("year"))


def available_years(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("year").isNotNull()).select("year").distinct()


def levels_present(facts: DataFrame) -> DataFrame:
    return facts.agg(F.sort_array(F.collect_set("csv_level")).alias("levels"))
