"""Numbers of the exposure table: parsing, benchmarks, conditions, rendering."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Life years lost for each microgram above a benchmark.
YEARS_PER_UNIT = 0.098
WHO_GUIDELINE = 5.0


@dataclass(frozen=True)
class Benchmark:
    kind: str  # who, national or custom
    target: float | None = None


WHO, NATIONAL = Benchmark("who", WHO_GUIDELINE), Benchmark("national")


def parse_numeric(c: Column | str) -> Column:
    """First number of a text, commas left out; null for words that mean missing."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.regexp_extract(F.regexp_replace(c, ",", ""), r"(-?\d+(?:\.\d+)?)", 1)
    return F.when(~F.lower(F.trim(c)).isin("", "na", "n/a", "n-a", "null", "none", "-"), F.nullif(number, F.lit(""))).try_cast("double")


def parse_year(c: Column | str) -> Column:
    year = F.floor(parse_numeric(c) + 0.5)
    return F.when(year.between(1900, 2200), year.cast("int"))


def calculate_loss(pm25: Column, target: Column) -> Column:
    # greatest() skips nulls, so both sides are asked for
    return F.when(pm25.isNotNull() & target.isNotNull(), F.greatest(pm25 - target, F.lit(0.0)) * F.lit(YEARS_PER_UNIT))


def life_loss(benchmark: Benchmark = WHO) -> Column:
    """Supplied loss columns win over the formula, but for a custom target."""
    if benchmark.kind == "custom":
        return calculate_loss(F.col("pm25"), F.lit(float(benchmark.target)))
    if benchmark.kind == "national":
        return F.coalesce("llpp_national", calculate_loss(F.col("pm25"), F.col("national_standard")))
    return F.coalesce(F.col("llpp_who"), F.col("llpp"), calculate_loss(F.col("pm25"), F.coalesce(F.col("who_standard"), F.lit(WHO_GUIDELINE))))


def metric_value(metric: str, benchmark: Benchmark = WHO) -> Column:
    """pm25, population, who_standard, national_standard, or life_loss under a benchmark."""
    if metric == "llpp_who":
        return life_loss(WHO)
    if metric == "llpp_national":
        return life_loss(NATIONAL)
    return life_loss(benchmark) if metric == "life_loss" else F.col(metric)


def condition(value: Column, operator: str, threshold: float) -> Column:
    t = F.lit(float(threshold))
    return {"lt": value < t, "lte": value <= t, "gt": value > t, "gte": value >= t, "eq": F.abs(value - t) < 1e-9}[operator]


def person_years(benchmark: Benchmark = WHO) -> Column:
    """Life years lost by all people together; a population is needed."""
    return F.when(F.col("population") > 0, life_loss(benchmark) * F.col("population"))


def format_number(x: float, digits: int = 2) -> str:
    """Rounded from the exact binary value, ties up, without trailing zeros."""
    text = str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text == "-0" else text


def format_signed(x: float) -> str:
    return ("+" if x > 0 else "") + format_number(x)


def format_integer(x: float) -> str:
    return f"{int(Decimal(x).quantize(Decimal(1), ROUND_HALF_UP)):,}"
