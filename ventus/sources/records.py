"""Structured records of any header spelling, made into the fact table.

Columns are resolved once from the headers, when the plan is made; the plan
itself is one projection, and for wide tables one explode.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ventus.functions.metrics import parse_numeric, parse_year
from ventus.functions.places import clean_place

# Header spellings after normalising, first one first.
ALIASES = {
    "region": ["region", "regionname", "worldregion"],
    "country": ["country", "countryname", "name0", "nation"],
    "state": ["state", "statename", "name1", "province", "provincename"],
    "district": ["district", "districtname", "name2", "county", "countyname"],
    "year": ["year", "datayear"],
    "pm25": ["pm25", "annualpm25", "annualaveragepm25", "pm25annualaverage", "particulatepollution"],
    "llpp": ["llpp", "lifelossperperson", "lifeloss", "yearslost", "lifeexpectancyloss"],
    "llpp_who": ["llppwho", "llppwhoguideline", "lifelosswho", "lifelosswhoguideline"],
    "llpp_national": ["llppnational", "llppnat", "llppnationalstandard", "lifelossnational", "lifelossnationalstandard"],
    "population": ["population", "pop", "populationcount"],
    "who_standard": ["whostandard", "whoguideline", "whopm25standard", "pm25whostandard"],
    "national_standard": ["nationalstandard", "natstandard", "nationalpm25standard", "pm25nationalstandard"],
}
PLACES = ("region", "country", "state", "district")
NUMBERS = ("pm25", "llpp", "llpp_who", "llpp_national", "population", "who_standard", "national_standard")
FIELDS = (*PLACES, "year", *NUMBERS)
_by_year = {"pm25": r"pm((?:19|20)\d{2})", "llpp_who": r"llppwho((?:19|20)\d{2})", "llpp_national": r"llppnat((?:19|20)\d{2})"}


def normalize_column(name: str) -> str:
    name = name.lower().replace("µ", "u").replace("μ", "u").replace("2.5", "25")
    return re.sub(r"[^a-z0-9]", "", name)


def normalized_column(c):
    """normalize_column for headers that are data."""
    for sign in ("µ", "μ"):
        c = F.replace(c, F.lit(sign), F.lit("u"))
    return F.regexp_replace(F.replace(F.lower(c), F.lit("2.5"), F.lit("25")), "[^a-z0-9]", "")


def infer_level(columns: list[str], title: str = "", path: str = "") -> str | None:
    """gadm0, gadm1 or gadm2: by the name of a table, else by its deepest column."""
    for text in (title, path):
        if m := re.search(r"gadm[\s_-]?([012])", text or "", re.I):
            return f"gadm{m[1]}"
    have = {normalize_column(c) for c in columns}
    for field, level in (("district", "gadm2"), ("state", "gadm1"), ("country", "gadm0")):
        if have & set(ALIASES[field]):
            return level
    return None


def row_level():
    """Of a row whose table tells no level: by the deepest place it names."""
    return F.when(F.col("district").isNotNull(), "gadm2").when(F.col("state").isNotNull(), "gadm1").otherwise("gadm0")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; a byte-order mark, quoted line feeds and short rows are fine."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")


def canonical(records: DataFrame, source_file: str = "", level: str | None = None, seq: str | None = None, level_col: str | None = None) -> DataFrame:
    """The fact table of records: aliases, numbers, years, wide columns made long, unusable rows left out.

    seq names a column with the order of the records; without it rows take the
    order in which they are read.  level_col names one with each record's level.
    """
    by_name = {normalize_column(c): c for c in records.columns if c not in (seq, level_col)}  # of equal names the last
    text = lambda n: F.nullif(F.trim(F.col(f"`{by_name[n]}`").cast("string")), F.lit(""))

    def first(field: str):
        found = [text(a) for a in ALIASES[field] if a in by_name]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    base = records.select(
        *[clean_place(first(p)).alias(p) for p in PLACES], parse_year(first("year")).alias("year"), *[parse_numeric(first(n)).alias(n) for n in NUMBERS],
        (F.col(f"`{level_col}`") if level_col else F.lit(level or infer_level([], source_file)).cast("string")).alias("csv_level"), F.lit(source_file).alias("source_file"),
        (F.col(f"`{seq}`").cast("long") if seq else F.monotonically_increasing_id()).alias("seq"), *[parse_numeric(text(n)).alias(f"_{n}") for n in by_name if any(re.fullmatch(p, n) for p in _by_year.values())],
    )
    wide = {f: {int(m[1]): n for n in by_name if (m := re.fullmatch(p, n))} for f, p in _by_year.items()}
    years = sorted({y for f in wide.values() for y in f})
    if years:
        of = lambda f, y: F.col(f"_{wide[f][y]}") if y in wide[f] else F.lit(None).cast("double")
        fields = [f.alias(n) for n, f in (("year", F.col("year")), ("pm25", F.col("pm25")), ("llpp_who", F.col("llpp_who")), ("llpp_national", F.col("llpp_national")))]
        spread = F.array(*[F.struct(F.lit(y).alias("year"), *[of(f, y).alias(f) for f in _by_year]) for y in years])
        base = base.withColumn("_at", F.explode(F.when(F.col("year").isNull(), spread).otherwise(F.array(F.struct(*fields)))))
        base = base.withColumns({n: F.col(f"_at.{n}") for n in ("year", *_by_year)})
    base = base.withColumn("csv_level", F.coalesce("csv_level", row_level()))
    return base.select(*FIELDS, "csv_level", "source_file", "seq").where(has_usable_data())


def has_usable_data():
    place = F.coalesce(*PLACES).isNotNull()
    return place & F.coalesce("pm25", "llpp", "llpp_who", "llpp_national", "population").isNotNull()


def wide_to_long(table: DataFrame, keys: list[str], columns: dict[int, str], name: str) -> DataFrame:
    """One row for each key and year from a column a year; nulls are kept."""
    spread = F.array(*[F.struct(F.lit(y).alias("year"), F.col(c).alias(name)) for y, c in sorted(columns.items())])
    return table.select(*keys, F.explode(spread).alias("_at")).select(*keys, "_at.year", f"_at.{name}")


def records_of_text(chunks: DataFrame, column: str = "content") -> DataFrame:
    """Maps of 'key: value' lines of every 'CSV record N from ...' block of a text, later keys winning."""
    blocks = F.slice(F.split(F.col(column), r"(?m)^CSV record \d+ from [^\n]*\n?"), 2, 1 << 30)
    out = chunks.select("*", F.posexplode(blocks).alias("record", "_block"))
    lines = out.withColumn("_lines", F.expr("filter(transform(split(_block, '\\n'), line -> struct(trim(substring_index(line, ':', 1)) as key, trim(substring(line, locate(':', line) + 1)) as value, locate(':', line) as at)), x -> x.at > 1 and x.key <> '' and x.value <> '')"))
    last = "filter(transform(_lines, (x, i) -> struct(x.key as k, x.value as v, i as i)), x -> not exists(slice(_lines, x.i + 2, size(_lines)), y -> y.key = x.k))"
    lines = lines.withColumn("_last", F.expr(last))
    return lines.where("size(_last) > 0").withColumn("fields", F.expr("map_from_arrays(_last.k, _last.v)")).drop("_block", "_lines", "_last")


def distinct_records(records: DataFrame, source_col: str = "source_id", fields_col: str = "fields", order: list[str] | None = None) -> DataFrame:
    """Each record of a source once, whatever the order of its keys: the first by order; without order any, as all columns are then alike."""
    key = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields_col))))
    keyed = records.withColumn("_key", key)
    if order is None:
        return keyed.dropDuplicates([source_col, "_key"]).drop("_key")
    first = F.min_by(F.struct(*records.columns), F.struct(*order)).alias("_first")
    return keyed.groupBy(F.col(source_col).alias("_source_key"), "_key").agg(first).select("_first.*")


def latest_sources(sources: DataFrame) -> DataFrame:
    """The newest source of each level (first of equals); sources without a level all stay."""
    from pyspark.sql import Window

    at = F.coalesce("updated_at", "created_at", F.to_timestamp(F.lit("1970-01-01 00:00:00")))
    newest = Window.partitionBy("level").orderBy(at.desc(), "seq")
    ranked = sources.where("level is not null").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
    return ranked.unionByName(sources.where("level is null"))


def supersede(sources: DataFrame, current_id: str, level: str) -> DataFrame:
    """Other active sources of the level become inactive."""
    old = (F.col("level") == level) & (F.col("status") == "active") & (F.col("id") != current_id)
    return sources.withColumn("status", F.when(old, "inactive").otherwise(F.col("status")))


# Fixed value: how many records a file may have.
MOST_RECORDS = 10_000


def checked(records: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """The records of a file, of which there must be one and no more than most."""
    n = records.limit(most + 1).count()
    if not n:
        raise ValueError("the file has no records")
    if n > most:
        raise ValueError(f"the file has more than {most:,} records")
    return records


def columns_of(records: DataFrame, fields_col: str = "fields") -> list[str]:
    """The headers that any of ragged records (maps) has, as many as headers there are."""
    return [r[0] for r in records.select(F.explode(F.map_keys(fields_col)).alias("k")).distinct().orderBy("k").collect()]


def as_columns(records: DataFrame, fields_col: str = "fields") -> DataFrame:
    """Ragged records (maps) with a column for every header; null where a record hasn't got it."""
    keep = [c for c in records.columns if c != fields_col]
    return records.select(*keep, *[F.element_at(fields_col, F.lit(c)).alias(c) for c in columns_of(records, fields_col) if c not in keep])


def load_facts(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The fact table of all active structured sources, the newest of each level.

    sources: id, title, file_path, status, created_at, updated_at, seq.
    chunks: source_id, chunk_index, records (array of maps).
    Active sources with a .csv path are classified by title, path, or the
    headers of their first chunk; records are taken in the order of chunks,
    each of a source once, columns being the union of all headers.
    """
    there = sources.where((F.col("status") == "active") & F.lower("file_path").endswith(".csv"))
    first = chunks.where(F.size("records") > 0).groupBy("source_id").agg(F.min_by(F.map_keys(F.get("records", 0)), "chunk_index").alias("_keys")).withColumnRenamed("source_id", "id")
    keys = F.transform(F.coalesce("_keys", F.array()), normalized_column)
    named = lambda c: F.nullif(F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"(?i)gadm[\s_-]?([012])", 1), F.lit(""))
    deepest = F.lit(None).cast("string")
    for field, digit in (("country", "0"), ("state", "1"), ("district", "2")):
        deepest = F.when(F.arrays_overlap(keys, F.array(*[F.lit(a) for a in ALIASES[field]])), F.lit(digit)).otherwise(deepest)
    level = F.concat(F.lit("gadm"), F.coalesce(named("title"), named("file_path"), deepest))
    chosen = latest_sources(there.join(first, "id", "left").withColumn("level", level).drop("_keys"))
    rows = chunks.join(chosen.select(F.col("id").alias("source_id"), "level", "title", F.col("seq").alias("_source")), "source_id").select("source_id", "level", "title", "_source", "chunk_index", F.posexplode("records").alias("_at", "fields"))
    rows = distinct_records(rows.where("fields is not null and size(fields) > 0"), order=["chunk_index", "_at"])
    spellings: dict[str, list[str]] = {}
    for header in columns_of(rows):
        spellings.setdefault(normalize_column(header), []).append(header)
    order = F.col("_source") * (1 << 40) + F.col("chunk_index") * (1 << 20) + F.col("_at")
    # of spellings that mean one column, a record's last counts
    wide = rows.select(F.col("level").alias("_level"), order.alias("_seq"), *[F.coalesce(*[F.element_at("fields", F.lit(c)) for c in reversed(found)]).alias(name) for name, found in spellings.items() if name])
    return canonical(wide, seq="_seq", level_col="_level")
