"""What is read from questions: a table of questions made from customers and nations, and what each must be read as.

The SQL holds the expected readings by the kind of question, so it shares
nothing with the patterns that read them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ventus.plans import dialogue
from ventus.plans import question as q
from ventus.sources.tables import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Text of each kind ({n}: a number from 2 to 11, {y}: a year, {p}: a nation), places it names, and what it is read as:
#: intent, level, number of years, count, global, benchmark, operator, threshold, about data, leaning on what came before, small talk.
KINDS = (
    ("Top {n} states in {p} in {y} by PM2.5", 1, ("ranking", "state", 1, "n", False, "who", None, None, True, False, None)),
    ("Which countries have pollution above {n} in {y}?", 0, ("threshold", "country", 1, "0", False, "who", "gt", "n", True, False, None)),
    ("PM2.5 of {p} and Bhutan", 2, ("comparison", None, 0, "0", False, "who", None, None, True, False, None)),
    ("Compare {p} from 2001 to {y}", 1, ("trend", None, 2, "0", False, "who", None, None, True, False, None)),
    ("Show trend of life loss in {p} by national standard", 1, ("trend", None, 0, "0", False, "national", None, None, True, True, None)),
    ("What about it in {y}?", 0, ("direct", None, 1, "0", False, "who", None, None, False, True, None)),
    ("Thank you!", 0, ("direct", None, 0, "0", False, "who", None, None, False, False, "gratitude")),
    ("Why is the policy of {p} so strict", 1, ("direct", None, 0, "0", False, "who", None, None, False, False, None)),
    ("Highest polluted districts globally with a target of {n} ug", 0, ("ranking", "district", 0, "0", True, "custom", None, None, True, False, None)),
    ("List of countries with population at most {n} million", 0, ("threshold", "country", 0, "0", False, "who", "lte", "n * 1000000", True, False, None)),
    ("In which year was the highest rise in pollution in {p}?", 1, ("peak_change", None, 0, "0", False, "who", None, None, True, False, None)),
    ("Maximum PM2.5 of {p} since {y}", 1, ("peak_value", None, 1, "0", False, "who", None, None, True, False, None)),
    ("Hello", 0, ("direct", None, 0, "0", False, "who", None, None, False, False, "greeting")),
)


def _combined() -> tuple:
    """Wordings made of parts, where each part alone decides a field."""
    out = []
    for start in ("Compare {p} and Bhutan PM2.5", "{p} versus Bhutan PM2.5", "{p} vs Bhutan PM2.5", "Show the difference between {p} and Bhutan PM2.5"):
        for period, n_years in (("between 2010 and 2020", 2), ("from 2010 through 2020", 2), ("for the last decade", 0), ("over the past ten years", 0), ("during the previous 3 years", 0), ("for the last two decades", 0)):
            out.append((f"{start} {period}", 2, ("comparison", None, n_years, "0", False, "who", None, None, True, False, None)))
    words = {
        "gt": ("more than", "greater than", "higher than", "above", "over", "exceeding", "in excess of", ">"), "gte": ("at least", "no less than", "more than or equal to", "minimum of", ">="),
        "lt": ("less than", "lower than", "below", "under", "<"), "lte": ("at most", "no more than", "less than or equal to", "maximum of", "<="), "eq": ("equal to", "exactly", "="),
    }
    for operator, texts in words.items():
        for text in texts:
            out.append((f"List countries with PM2.5 {text} {{n}} in {{y}}", 0, ("threshold", "country", 1, "0", False, "who", operator, "n", True, False, None)))
            out.append((f"Which districts of {{p}} have a population {text} {{n}} thousand?", 1, ("threshold", "district", 0, "0", False, "who", operator, "n * 1000", True, False, None)))
    for places, level in (("states", "state"), ("districts", "district"), ("provinces", "state")):
        for text in ("Top 5 polluted {} in {{p}} in {{y}}", "Top five most polluted {} in {{p}} for {{y}}", "Show 5 most polluted {} of {{p}} during {{y}}", "List the highest five {} in {{p}} by PM2.5 in {{y}}"):
            out.append((text.format(places), 1, ("ranking", level, 1, "5", False, "who", None, None, True, False, None)))
    for name in ("national standard", "national std", "national limit", "nat std", "nat-standard"):
        out.append((f"Life loss of {{p}} in {{y}} by {name}", 1, ("direct", None, 1, "0", False, "national", None, None, True, False, None)))
    for text in ("Trend of PM2.5 in {p}", "Has pollution of {p} changed?", "Did pollution in {p} increase?", "Pollution over time in {p}"):
        out.append((text, 1, ("trend", None, 0, "0", False, "who", None, None, True, False, None)))
    for text in ("What was the PM2.5 of {p} in {y}?", "PM 2.5 {p} {y}", "How high was pollution in {p} during {y}", "Life expectancy loss of {p} in {y}"):
        out.append((text, 1, ("direct", None, 1, "0", False, "who", None, None, True, False, None)))
    for text, talk in (("Hey", "greeting"), ("Good morning!", "greeting"), ("thanks a lot", "gratitude"), ("Thx", "gratitude"), ("What can you do?", "identity")):
        out.append((text, 0, ("direct", None, 0, "0", False, "who", None, None, False, False, talk)))
    return tuple(out)


KINDS += _combined()
FIELDS = ("intent", "level", "n_years", "asked", "global_", "benchmark", "operator", "threshold", "about_data", "leans", "talk")
SCHEMA = "intent string, level string, n_years int, asked int, global_ boolean, benchmark string, operator string, threshold double, about_data boolean, leans boolean, talk string"


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'"


def _sql() -> str:
    of = {f: [kind[2][k] for kind in KINDS] for k, f in enumerate(FIELDS)}
    types = dict(x.split(" ") for x in SCHEMA.split(", "))
    cases = []
    for f in FIELDS:
        raw = f in ("asked", "threshold")
        whens = " ".join(f"WHEN {k} THEN {('NULL' if v is None else v) if raw else _literal(v)}" for k, v in enumerate(of[f]))
        kind = {"int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}[types[f]]
        cases.append(f"CAST(CASE kind {whens} END AS {kind}) AS {f}")
    return f"SELECT id, {', '.join(cases)} FROM (SELECT c_custkey AS id, c_custkey % {len(KINDS)} AS kind, 2 + c_custkey % 10 AS n FROM customer)"


def _read(table: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for text, places in zip(table["text"], table["places"], strict=True):
        condition = q.condition(text)
        rows.append((q.intent(text, text, places), q.level(text), len(q.years(text)), q.count(text), q.is_global(text), q.benchmark(text).kind, condition.operator if condition else None, condition.threshold if condition else None, dialogue.is_data_question(text), dialogue.is_dependent(text), dialogue.small_talk(text)))
    return pd.DataFrame(rows, columns=list(FIELDS))


def questions_read(spark, sf_dir):
    customer, nation = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")  # nation has 25 rows at every scale
    k = F.col("c_custkey")
    texts, places = F.array(*[F.lit(t) for t, _, _ in KINDS]), F.array(*[F.lit(n) for _, n, _ in KINDS])
    kind = (k % len(KINDS)).cast("int")
    text = F.get(texts, kind)
    for mark, value in (("{n}", (2 + k % 10).cast("string")), ("{y}", (2005 + k % 18).cast("string")), ("{p}", F.initcap("n_name"))):
        text = F.replace(text, F.lit(mark), value)
    asked = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("id"), text.alias("text"), F.get(places, kind).alias("places"))

    # equal questions are read once
    once = asked.groupBy("text", "places").agg(F.count("*").alias("_n")).drop("_n")
    once = once.repartition(spark.sparkContext.defaultParallelism, "text", "places")

    def read_all(batches):
        for batch in batches:
            yield pd.concat([batch[["text", "places"]].reset_index(drop=True), _read(batch)], axis=1)

    return asked.join(once.mapInPandas(read_all, f"text string, places int, {SCHEMA}"), ["text", "places"]).select("id", *FIELDS)


_first = "'What is the PM2.5 level in ' || n || '?'"
_answer = "n || ', 2023: ' || CAST(k % 90 AS VARCHAR) || ' µg.'"
_resolved = f"""CASE k % 6 WHEN 0 THEN {_first} || ' tell me more' WHEN 1 THEN {_first} || ' Previous answer: ' || {_answer} || ' Compare this with 2010' WHEN 2 THEN 'Population of ' || n || ' in 2020'
 WHEN 3 THEN {_first} || ' and in 2012? compared with Nepal' WHEN 4 THEN 'Which state increased most? ' || n ELSE 'Hi' END"""
ORACLE_SQL["follow_ups_resolved"] = f"SELECT k AS id, {_resolved} AS resolved FROM (SELECT s_suppkey AS k, upper(n_name[1]) || lower(n_name[2:]) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE NOT contains(n_name, ' '))"


def follow_ups_resolved(spark, sf_dir):
    nation = read(spark, sf_dir, "nation").where(~F.col("n_name").contains(" "))
    rows = read(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.initcap("n_name").alias("place"))

    def resolved(batches):
        for batch in batches:
            out = []
            for k, n in zip(batch["id"], batch["place"], strict=True):
                first, answer = dialogue.Turn("user", f"What is the PM2.5 level in {n}?"), dialogue.Turn("assistant", f"{n}, 2023: {k % 90} µg.\n\nReference: GADM0 CSV.")
                back = [dialogue.Turn("user", "Which state increased most?"), dialogue.Turn("assistant", "Which country should I use?\n\nReference checked: GADM1 CSV.")]
                said = (("tell me more", [first, answer]), ("Compare this with 2010", [first, answer]), (f"Population of {n} in 2020", [first, answer]), ("compared with Nepal", [first, answer, dialogue.Turn("user", "and in 2012?"), answer]), (n, back), ("Hi", back))
                out.append(dialogue.resolve(*said[k % 6]))
            yield pd.DataFrame({"id": batch["id"], "resolved": out})

    return rows.mapInPandas(resolved, "id long, resolved string")


QUERIES["questions_read"], QUERIES["follow_ups_resolved"] = questions_read, follow_ups_resolved
ORACLE_SQL["questions_read"] = _sql()
