"""Tables that stand in running text, recovered as records.

Text taken out of a report has its tables as lines of a label and numbers.  A
section begins where a table is named ("Table 3.1: title"), and its rows are labels
in capitals with numbers after them, up to a full stop, semicolon or line end.  The
columns are those that most rows have: a row with another number of values is no
row of the table, and fewer than LEAST_ROWS rows make none.

Null and empty texts have no tables; equal rows stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_ROWS = 3
_NAMED = r"\bTable\s+\d+(?:\.\d+)?\s*:"
_WORD = r"\p{Lu}[\p{L}'’-]*"
_VALUE = r"[<>]?\s*-?\d+(?:,\d{3})*(?:\.\d+)?%?"
_ROW = rf"({_WORD}(?:\s+(?:of|and|the|{_WORD}))*)\s+({_VALUE}(?:\s+{_VALUE})*)\s*(?=[.;\n]|$)"


def _values(text: Column) -> Column:
    """The numbers of a row."""
    found = F.regexp_extract_all(text, F.lit(r"-?\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def tables(snippets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, title, unit, position, label, values) of each row of the tables of texts."""
    sections = F.filter(F.split(F.col(text_col), rf"(?={_NAMED})"), lambda x: x.rlike(rf"^{_NAMED}"))
    rows = snippets.select(id_col, F.posexplode(sections).alias("_section", "_t"))
    rows = rows.select(id_col, "_section", F.regexp_extract("_t", r"^Table\s+(\d+(?:\.\d+)?)", 1).alias("number"), F.regexp_replace("_t", rf"^{_NAMED}\s*", "").alias("_t"))
    labels, values = (F.regexp_extract_all("_t", F.lit(_ROW), F.lit(k)) for k in (1, 2))
    head = F.split("_t", _ROW, 2)[0]  # what stands before the first row
    rows = rows.select(id_col, "_section", "number", F.trim(F.regexp_extract("_t", r"^([^.\n]*)", 1)).alias("title"), F.regexp_extract(head, r"\(([^()]*)\)[^()]*$", 1).alias("unit"), F.arrays_zip(labels.alias("label"), F.transform(values, _values).alias("values")).alias("_rows"))
    sizes = F.transform("_rows", lambda r: F.size(r["values"]))
    # the number of values that most rows have, the larger of equals
    columns = F.array_max(F.transform(F.array_distinct(sizes), lambda n: F.struct(F.size(F.filter(sizes, lambda m: m == n)), n.alias("n"))))["n"]
    rows = rows.withColumn("_n", columns).withColumn("_rows", F.filter("_rows", lambda r: F.size(r["values"]) == F.col("_n"))).where(F.size("_rows") >= LEAST_ROWS)
    return rows.select(id_col, "_section", "number", "title", "unit", F.posexplode("_rows").alias("position", "_r")).select(id_col, "_section", "number", "title", "unit", "position", "_r.label", "_r.values").withColumnRenamed("_section", "section")


def ranked(records: DataFrame, id_col: str, column: int = 0, k: int = 5, lowest: bool = False) -> DataFrame:
    """The first k rows of each table by a column, with their rank; rows of equal value stay in the order of the text."""
    value = F.get("values", F.lit(column))
    order = Window.partitionBy(id_col, "section").orderBy(value.asc() if lowest else value.desc(), "position")
    return records.where(value.isNotNull()).withColumns({"value": value, "rank": F.row_number().over(order)}).where(F.col("rank") <= k)


def told(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, section, answer): the ranked rows of each table in words."""
    number = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    with_unit = F.concat_ws(" ", number, F.when(F.col("unit") != "", F.col("unit")))
    listed = rows.groupBy(id_col, "section").agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("rank", "label", with_unit.alias("value")))).alias("_r"))
    others = F.array_join(F.transform(F.slice("_r", 2, 1 << 30), lambda r: F.concat(r["label"], F.lit(" ("), r["value"], F.lit(")"))), ", ")
    first = F.concat(F.lit("Of those listed in \""), F.col("title"), F.lit("\", "), F.col("_r")[0]["label"], F.lit(" comes first with "), F.col("_r")[0]["value"])
    return listed.select(id_col, "section", F.concat(first, F.when(others != "", F.concat(F.lit(", followed by "), others)).otherwise(""), F.lit(".")).alias("answer"))
