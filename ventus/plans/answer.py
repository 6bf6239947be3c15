"""Answers to metric questions: a request is run as a plan, its few rows are told in words."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ventus.functions.metrics import NATIONAL, WHO, Benchmark, condition, format_integer, format_number, format_signed, life_loss, metric_value
from ventus.functions.places import LEVELS, is_territory, normalize_place
from ventus.operators import summary as sm
from ventus.plans import dialogue
from ventus.plans import question as q

# Replies as they are worded.
NO_DATA = "I don’t have that data in the current CSV."
NO_YEAR = "I don’t have data for that year in the current CSV."
NO_PLACE = "I could not find that location in the current dataset. Please check the spelling or provide the state/country name."
WHICH_PLACE = "Which place should I check? Please provide a country or state/province."
WHICH_LEVEL = "Do you want this at country or state/province level?"
NO_DISTRICTS = "District-level data is not currently available. I can answer this at country or state/province level. Would you like the state/province-level result instead?"
TOTAL_MEANING = "Understood. Total life-years lost means life loss per person multiplied by the location’s population. I’ll use that calculation for total-life-loss questions.\n\nReference: User-provided calculation definition."
PLURALS = {"region": "regions", "country": "countries", "state": "states", "district": "districts"}
DATASET = {"region": "gadm0", "country": "gadm0", "state": "gadm1", "district": "gadm2"}
METRIC_NAMES = {"pm25": "PM2.5", "national_standard": "national PM2.5 standard", "who_standard": "WHO PM2.5 guideline", "llpp_who": "WHO-based life loss", "llpp_national": "national-standard life loss", "population": "population"}
OPERATOR_NAMES = {"lt": "below", "lte": "at or below", "eq": "equal to", "gte": "at or above", "gt": "above"}
UNIT = "µg/m³"


def benchmark_name(b: Benchmark) -> str:
    return {"who": "the WHO guideline", "national": "the national PM2.5 standard"}.get(b.kind) or f"a {format_number(b.target)} {UNIT} target"


def with_unit(value: float, metric: str) -> str:
    if metric == "population":
        return f"{format_integer(value)} people"
    return f"{format_number(value)} " + ("years" if metric.startswith("llpp") else UNIT)


@dataclass
class Asked:
    """A question with what has been read from it."""

    current: str
    resolved: str
    benchmark: Benchmark
    places: list[q.Place]
    intent: str
    level: str | None

    @property
    def years(self) -> list[int]:
        if q.has(r"\blatest(?: available)? year\b", self.current):
            return []
        return q.years(self.current) or q.years(self.resolved)

    def best(self) -> q.Place | None:
        """The place of the level the question speaks of, if it speaks of one."""
        level = q.level(self.resolved)
        return next((p for p in self.places if level is None or p.level == level), None)


class Engines:
    """The engine of the facts that are active now: kept while their sources are the same and it isn't too old."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.signature: int | None = None
        self.until, self.engine = 0.0, None

    def of(self, sources: DataFrame) -> Engine:
        """sources: id, status, updated_at; of the active ones one number comes back."""
        active = sources.where("status = 'active'")
        signature = active.agg(F.bit_xor(F.xxhash64("id", "updated_at")), F.count("*")).first()
        if self.engine is None or signature != self.signature or self.clock() >= self.until:
            if self.engine is not None:
                self.engine.all.unpersist()
            self.engine, self.signature, self.until = Engine(self.load()), signature, self.clock() + self.seconds
        return self.engine


class Engine:
    """Answers from a fact table; its cube is computed once and kept."""

    def __init__(self, facts: DataFrame):
        self.all = sm.cube_by_dataset(facts).cache()
        self.labels = q.labels_of(self.all)
        self.datasets = {r.csv_level for r in self.all.select("csv_level").distinct().collect()}

    # rows

    def cube(self, asked: Asked) -> DataFrame:
        return self.all if asked.level is None or asked.intent == "comparison" else self.all.where(F.col("csv_level") == DATASET[asked.level])

    @staticmethod
    def within(cube: DataFrame, place: q.Place | None) -> DataFrame:
        return cube if place is None else cube.where(normalize_place(place.level) == q.normal_place(place.name))

    @staticmethod
    def whole(cube: DataFrame, level: str) -> DataFrame:
        """The cube as facts of one place: labels that would split it are made one."""
        return sm.summarize(cube.withColumns({x: F.lit(None).cast("string") if x != level and LEVELS.index(x) < LEVELS.index(level) else F.col(x) for x in LEVELS}), level)

    def series(self, cube: DataFrame, place: q.Place, benchmark: Benchmark) -> list[Row]:
        """A place's years in order; a place has as many rows as it has years."""
        rows = self.whole(self.within(cube, place), place.level).where("year is not null")
        return rows.withColumn("loss", life_loss(benchmark)).withColumn("who", life_loss(WHO)).withColumn("national", life_loss(NATIONAL)).orderBy("year").collect()

    # questions

    def read(self, current: str, resolved: str | None = None) -> Asked:
        resolved = resolved or current
        places = q.match_places(self.labels, resolved)
        intent = q.intent(current, resolved, len(places))
        level = q.level(current) or q.level(resolved) or (places[0].level if places else None)
        return Asked(current, resolved, q.benchmark(current if q.names_benchmark(current) else resolved), places, intent, level)

    def reply(self, current: str, history: list[dialogue.Turn] = ()) -> str | None:
        """The answer to a message in its conversation; None if it is not one that facts answer (small talk, definitions, documents)."""
        if dialogue.small_talk(current) or dialogue.begins_anew(current):
            return None
        resolved = dialogue.resolve(current, list(history))
        ours = dialogue.asks_access(current) or dialogue.defines_total(current) or dialogue.is_data_question(resolved)
        if not ours and not (dialogue.may_name_place(current) and q.match_places(self.labels, resolved)):
            return None
        return self.answer(current, resolved)

    def access(self, text: str) -> str:
        """Which datasets are there, and of those asked for which are not."""
        active = ", ".join(f"{level.upper()} CSV" for level in sorted(x for x in self.datasets if x))
        asked = {f"gadm{d}" for d in re.findall(r"\bgadm\s*([012])\b", text, re.I)}
        missing = [f"{level.upper()} CSV" for level in sorted(asked - self.datasets)]
        if missing:
            said = f"{' and '.join(missing)} {'is' if len(missing) == 1 else 'are'} not currently uploaded and active. Available now: {active or 'none'}."
        else:
            said = f"Yes. I currently have access to {active or 'no active GADM CSV files'}."
        return f"{said}\n\nReference checked: active GADM CSV sources."

    def answer(self, current: str, resolved: str | None = None) -> str:
        if not self.datasets:
            return f"{NO_DATA}\n\nReference checked: CSV."
        if dialogue.asks_access(current):
            return self.access(current)
        if dialogue.defines_total(current):
            return TOTAL_MEANING
        asked = self.read(current, resolved)
        if asked.intent in ("ranking", "threshold") and not asked.level:
            return self.told(asked, WHICH_LEVEL)
        if asked.level == "region":
            asked = replace(asked, level="country")
        if asked.level and DATASET[asked.level] not in self.datasets and asked.intent != "comparison":
            return self.told(asked, NO_DISTRICTS if asked.level == "district" else NO_DATA)
        verb = {"threshold": self.threshold, "ranking": self.ranking, "comparison": self.comparison, "trend": self.trend, "peak_change": self.peak_change, "peak_value": self.peak_value, "direct": self.direct}[asked.intent]
        return self.told(asked, verb(asked))

    def told(self, asked: Asked, text: str) -> str:
        if "\nReference" in text:
            return text
        source = f"{DATASET[asked.level].upper()} CSV" if asked.level else "CSV"
        span = asked.years
        when = f", {span[0]}–{span[-1]}" if len(span) > 1 else f", {span[0]}" if span else ""
        checked = " checked" if text.endswith("?") or text in (NO_DATA, NO_YEAR) or "could not find" in text else ""
        return f"{text}\n\nReference{checked}: {source}{when}, {benchmark_name(asked.benchmark)}."

    def suggestion(self, asked: Asked) -> str | None:
        """A next question, from what was asked rather than from the words of the answer."""
        place = asked.best()
        if asked.intent == "direct" and place:
            return f"You could also ask how {place.name} changed over the years."
        if asked.intent in ("trend", "peak_change", "peak_value") and place:
            return f"You could also compare {place.name} with another {place.level}."
        if asked.intent == "ranking" and asked.level:
            return f"You could also ask for the {PLURALS[asked.level]} that improved most."
        if asked.intent == "comparison":
            return "You could also compare them over a period."
        return "You could also name another threshold or year." if asked.intent == "threshold" else None

    # verbs

    def threshold(self, asked: Asked) -> str:
        wanted = q.condition(asked.current) or q.condition(asked.resolved)
        scope = next((p for p in asked.places if LEVELS.index(p.level) < LEVELS.index(asked.level)), None)
        cube = self.within(self.cube(asked), scope)
        year = (q.years(asked.current) or [cube.where(F.col(asked.level).isNotNull()).agg(F.max("year")).first()[0]])[-1]
        if year is None:
            return NO_DATA
        rows = sm.summarize(cube.where(F.col("year") == year), asked.level).withColumn("value", metric_value(wanted.metric)).where(condition(F.col("value"), wanted.operator, wanted.threshold))
        if asked.level == "country":
            rows = rows.where(~is_territory("country"))
        where = f" in {scope.name}" if scope else ""
        what = f"{METRIC_NAMES[wanted.metric]} {OPERATOR_NAMES[wanted.operator]} {with_unit(wanted.threshold, wanted.metric)}"
        total = rows.count()
        if not total:
            return f"No {PLURALS[asked.level]}{where} in the current dataset have {what}."
        if q.has(r"\b(?:how many|number of|count)\b", asked.current):
            return f"{total} {PLURALS[asked.level]}{where} have {what}, {year}."
        order = F.collate(F.col(asked.level), "UNICODE") if wanted.operator == "eq" else F.col("value").asc() if wanted.operator in ("lt", "lte") else F.col("value").desc()
        listed = rows.orderBy(order, "seq").limit(25).collect()
        lines = [f"{k}. {self.name(r, asked.level, not scope and asked.level != 'country')} — {with_unit(r.value, wanted.metric)}" for k, r in enumerate(listed, 1)]
        more = f"\n\nShowing the first {len(listed)} of {total} matches." if total > len(listed) else ""
        note = "\n\nKnown non-country territory entries are excluded." if asked.level == "country" else ""
        return f"{PLURALS[asked.level].capitalize()}{where} with {what}, {year}:\n" + "\n".join(lines) + more + note

    @staticmethod
    def name(row: Row, level: str, parents: bool) -> str:
        parts = [row[level]]
        if level == "district":
            parts += [row.state, row.country if parents else None]
        elif level == "state" and parents:
            parts.append(row.country)
        return ", ".join(p for p in parts if p)

    def ranking(self, asked: Asked) -> str:
        level, text = asked.level, asked.resolved
        scope = next((p for p in asked.places if LEVELS.index(p.level) < LEVELS.index(level)), None)
        k = q.count(text)
        if level == "state" and not scope and not q.is_global(text):
            return f"Sure. Which country should I use for the top {k} states?" if k else "Sure. Which country should I use for the state ranking?"
        cube = self.within(self.cube(asked), scope).where(F.col(level).isNotNull())
        available = sorted(r[0] for r in cube.select("year").where("year is not null").distinct().collect())
        if q.wants_change(text):
            return self.change_ranking(asked, sm.summarize(cube, level), available)
        choice = "average" if q.has(r"^\s*(?:1|option\s*1|first|average|period average)[.!\s]*$", asked.current) else "leader" if q.has(r"^\s*(?:2|option\s*2|second|annual|each year|every year)[.!\s]*$", asked.current) else None
        each = q.wants_each_year(text)
        if each and k > 1 and not choice and not q.has(r"\bthen\s+(?:please\s+)?give", text):
            return f"Do you want (1) the top {k} {PLURALS[level]} averaged across the period, or (2) the single most polluted {level} for each year?"
        years = asked.years
        period = (years[0], years[-1]) if len(years) >= 2 else q.relative_range(text, available) or ((available[0], available[-1]) if (each or choice) and available else None)
        if period and not {*period} <= set(available):
            return NO_YEAR
        summary = sm.summarize(cube, level)
        if period and (choice == "leader" or (each and choice != "average")):
            return self.leaders(asked, summary, period, scope)
        if period:
            return self.listed(asked, sm.period_average(summary, *period), scope, f"{period[0]}–{period[1]} average")
        if years and years[-1] not in available:
            return NO_YEAR
        if not available:
            return NO_DATA
        year = years[-1] if years else available[-1]
        return self.listed(asked, summary.where(F.col("year") == year), scope, str(year))

    def listed(self, asked: Asked, rows: DataFrame, scope: q.Place | None, when: str) -> str:
        level, text, b = asked.level, asked.resolved, asked.benchmark
        people = q.has(r"\b(?:population|populated)\b", text)
        loss = not people and q.has(r"\b(?:life|llpp|years? lost|years? gained)\b", text)
        livable = level == "country" and q.has(r"\b(?:best[\s\S]*live|least polluted|cleanest)\b", text)
        ascending, every = q.has(r"\b(?:lowest|bottom|least)\b", text), q.wants_all(text)
        rows = rows.withColumn("loss", life_loss(b)).withColumn("value", F.col("population" if people else "loss" if loss else "pm25")).where("value is not null")
        if livable:
            rows = rows.where((F.col("pm25") > 0) & (F.col("population") > 0) & ~is_territory("country"))
        single = q.has(r"\b(?:top|highest|lowest|best|worst|most polluted|least polluted)\s+(?:country|state|province|district)\b", text)
        wanted = q.count(text) or (25 if every else 1 if single else 3)
        found = rows.orderBy(F.col("value").asc() if ascending else F.col("value").desc(), "seq").limit(min(wanted, 25 if every else 10)).collect()
        if not found:
            return NO_DATA
        lines = []
        for i, r in enumerate(found, 1):
            parts = {"pm": f"{format_number(r.pm25)} {UNIT} PM2.5" if r.pm25 is not None else None, "loss": f"{format_number(r.loss)} years life loss" if r.loss is not None else None, "people": f"{format_integer(r.population)} people" if r.population is not None else None}
            order = ("people", "pm", "loss") if people else ("loss", "pm") if loss else ("pm", "loss")
            lines.append(f"{i}. {self.name(r, level, q.is_global(text) and not scope)} — " + "; ".join(parts[x] for x in order if parts[x]))
        where, one = f" in {scope.name}" if scope else "", len(found) == 1
        kind = level if one else PLURALS[level]
        if every:
            head = f"Here are all available {PLURALS[level]}{where}"
        elif people:
            head = f"Here {'is the' if one else f'are the {len(found)}'} {'least' if ascending else 'most'} populated {kind}{where}"
        else:
            head = f"Here {'is' if one else 'are'} the {'lowest' if ascending else 'top'} {'' if one else f'{len(found)} '}{kind}{where}"
        notes = ""
        if every and (total := rows.count()) > len(found):
            notes += f"\n\nShowing the first {len(found)} of {total} {PLURALS[level]}."
        if loss:
            notes += f"\n\nThese are the estimated life expectancy losses for the available {PLURALS[level]} in the current dataset." if every else f"\n\nThese {PLURALS[level]} show the {'lowest' if ascending else 'highest'} estimated life expectancy loss from PM2.5 exposure in the current dataset."
        if livable:
            notes += "\n\nThis ranks sovereign-country entries by PM2.5 only, not overall quality of life."
        return f"{head}, {when} ({benchmark_name(b)}):\n" + "\n".join(lines) + notes

    def leaders(self, asked: Asked, summary: DataFrame, period: tuple[int, int], scope: q.Place | None) -> str:
        from ventus.operators.verbs import annual_leaders

        loss = q.has(r"\b(?:life|llpp|years? lost)\b", asked.resolved)
        ascending = q.has(r"\b(?:lowest|bottom|least|cleanest)\b", asked.resolved)
        top = annual_leaders(summary, asked.level, *period, metric="life_loss" if loss else "pm25", ascending=ascending, benchmark=asked.benchmark).orderBy("year").collect()
        if not top:
            return NO_DATA
        lines = [f"{r.year}: {r.label.split(',')[0] if scope else r.label} — {format_number(r.value)} " + ("years life loss" if loss else f"{UNIT} PM2.5") for r in top]
        return f"{'Least' if ascending else 'Most'} polluted {asked.level} for each year, {period[0]}–{period[1]}:\n" + "\n".join(lines)

    def change_ranking(self, asked: Asked, summary: DataFrame, available: list[int]) -> str:
        from ventus.operators.verbs import change_ranking

        text, b, level = asked.current, asked.benchmark, asked.level
        years = asked.years
        span = (years[0], years[1]) if len(years) >= 2 else q.relative_range(asked.resolved, available) or ((available[0], available[-1]) if len(available) > 1 else None)
        if not span:
            return NO_DATA
        if not {*span} <= set(available):
            return NO_YEAR
        both = q.names_who(text) and q.names_national(text)
        loss = both or q.has(r"\b(?:life|llpp|years? lost|years? gained)\b", text)
        improved = q.has(r"\b(?:improved|improvement)", text)
        direction = "improved" if improved else "worsened" if q.has(r"\b(?:worsened|worsening|increase|increased|rise)\b", text) else None
        ascending = q.has(r"\b(?:decrease|decreased|improved|improvement|lowest|least)", text)
        wanted = q.count(text) or (1 if q.has(r"\bwhich\b", text) else 10 if q.has(r"\blist\b", text) else 3)
        rows = change_ranking(summary, level, *span, min(wanted, 10), metric="life_loss" if loss else "pm25", benchmark=b, direction=direction, ascending=ascending, both_benchmarks=both).collect()
        if not rows:
            return NO_DATA
        unit = "years" if loss else UNIT
        lines = [f"{i}. {r.label} — {format_number(r.start_value)} → {format_number(r.end_value)} {unit} ({format_signed(r.change)})" for i, r in enumerate(rows, 1)]
        return f"{PLURALS[level].capitalize()} by {'life loss' if loss else 'PM2.5'} change, {span[0]}–{span[1]} ({benchmark_name(b)}):\n" + "\n".join(lines)

    def comparison(self, asked: Asked) -> str:
        wanted = q.level(asked.resolved)
        two = sorted([p for p in asked.places if wanted is None or p.level == wanted][:2], key=lambda p: p.position)
        if len(two) < 2:
            return f"Which {two[0].level} would you like to compare with {two[0].name}?" if two else "Which two places would you like me to compare?"
        sides = [{r.year: r for r in self.series(self.all, p, asked.benchmark)} for p in two]
        common = sorted(set(sides[0]) & set(sides[1]))
        if not common:
            return NO_DATA
        note = ""
        if two[0].level != two[1].level:
            note = "\nLevel note: " + "; ".join(f"{p.name} uses {DATASET[p.level].upper()} {p.level}-level data" for p in two) + "."
        years = asked.years
        span = (years[0], years[-1]) if len(years) >= 2 else q.relative_range(asked.current, common) or q.relative_range(asked.resolved, common)
        if span:
            return self.compared_over(asked, two, sides, span, note) if {*span} <= set(common) else NO_YEAR
        year = years[-1] if years else common[-1]
        if year not in common:
            return NO_YEAR
        a, b = (s[year] for s in sides)
        lines = [f"- {p.name}: " + ", ".join(x for x in (f"{format_number(r.pm25)} {UNIT}" if r.pm25 is not None else "", f"{format_number(r.loss)} years life loss" if r.loss is not None else "") if x) for p, r in zip(two, (a, b), strict=True)]
        gaps = []
        for field, told in (("pm25", f"{{}} {UNIT} higher PM2.5"), ("loss", "{} more years of life loss")):
            if a[field] is not None and b[field] is not None:
                gaps.append((two[0].name if a[field] >= b[field] else two[1].name, told.format(format_number(abs(a[field] - b[field])))))
        if len(gaps) == 2 and gaps[0][0] == gaps[1][0]:
            gaps = [(gaps[0][0], f"{gaps[0][1]} and {gaps[1][1]}")]
        end = "\nDifference: " + " and ".join(f"{who} has {what}" for who, what in gaps) + "." if gaps else ""
        return f"Using {year} and {benchmark_name(asked.benchmark)}:{note}\n" + "\n".join(lines) + end

    def compared_over(self, asked: Asked, two: list[q.Place], sides: list[dict], span: tuple[int, int], note: str) -> str:
        lines, changes, ends = [], [], []
        for place, side in zip(two, sides, strict=True):
            a, b = side[span[0]], side[span[1]]
            parts = []
            if a.pm25 is not None and b.pm25 is not None:
                parts.append(f"PM2.5 {format_number(a.pm25)} → {format_number(b.pm25)} {UNIT} ({format_signed(b.pm25 - a.pm25)})")
            if a.loss is not None and b.loss is not None:
                parts.append(f"life loss {format_number(a.loss)} → {format_number(b.loss)} years ({format_signed(b.loss - a.loss)})")
            lines.append(f"- {place.name}: " + "; ".join(parts))
            changes.append(None if a.pm25 is None or b.pm25 is None else b.pm25 - a.pm25)
            ends.append(b.pm25)
        text = f"Comparison from {span[0]} to {span[1]} ({benchmark_name(asked.benchmark)}):{note}\n" + "\n".join(lines)
        if None in changes:
            return text
        names, gap = [p.name for p in two], format_number(abs(changes[0] - changes[1]))
        if max(changes) <= 0:
            moved = f"{names[changes.index(min(changes))]} improved {gap} {UNIT} more over the period."
        elif min(changes) >= 0:
            moved = f"{names[changes.index(max(changes))]} worsened {gap} {UNIT} more over the period."
        else:
            moved = f"{names[changes.index(min(changes))]} improved while {names[changes.index(max(changes))]} worsened over the period."
        return f"{text}\n\nBy {span[1]}, {names[0] if ends[0] >= ends[1] else names[1]} had {format_number(abs(ends[0] - ends[1]))} {UNIT} higher PM2.5. {moved}"

    def trend(self, asked: Asked) -> str:
        place = asked.best()
        if not place:
            return "Which place should I show the trend for?"
        rows = {r.year: r for r in self.series(self.cube(asked), place, asked.benchmark)}
        if len(rows) < 2:
            return NO_DATA
        years, found = asked.years, q.relative_range(asked.resolved, list(rows)) or (min(rows), max(rows))
        start, end = years[0] if years else found[0], years[1] if len(years) > 1 else found[1]
        if start not in rows or end not in rows:
            return NO_YEAR if years else NO_DATA
        a, b = rows[start], rows[end]
        lines = []
        if a.pm25 is not None and b.pm25 is not None:
            lines += [f"- PM2.5 changed from {format_number(a.pm25)} to {format_number(b.pm25)} {UNIT}", f"- Change: {format_signed(b.pm25 - a.pm25)} {UNIT}"]
        if a.loss is not None and b.loss is not None:
            lines.append(f"- Life loss changed from {format_number(a.loss)} to {format_number(b.loss)} years")
        if a.pm25 is not None and b.pm25 is not None:
            way = "worsened" if b.pm25 > a.pm25 else "improved" if b.pm25 < a.pm25 else "unchanged"
            lines += [f"- Direction: {way}", f"\nThis suggests long-term exposure {'was unchanged' if way == 'unchanged' else way} over the period."]
        return "\n".join([f"From {start} to {end} for {place.name}:", *lines]) if lines else NO_DATA

    def peak_change(self, asked: Asked) -> str:
        place = asked.best()
        if not place:
            return "Which place should I check for the largest change?"
        rows = [r for r in self.series(self.cube(asked), place, asked.benchmark) if r.pm25 is not None]
        if len(rows) < 2:
            return NO_DATA
        span = q.relative_range(asked.resolved, [r.year for r in rows]) or (rows[0].year, rows[-1].year)
        rows = [r for r in rows if span[0] <= r.year <= span[1]]
        down = q.has(r"\bdecrease\b", asked.resolved)
        steps = list(zip(rows, rows[1:], strict=False))
        if not steps:
            return NO_DATA
        a, b = (min if down else max)(steps, key=lambda s: s[1].pm25 - s[0].pm25)
        loss = f"\n- Life loss change: {format_signed(b.loss - a.loss)} years" if a.loss is not None and b.loss is not None else ""
        return f"Largest annual PM2.5 {'decrease' if down else 'increase'} for {place.name}, {span[0]}–{span[1]}:\n- {a.year} to {b.year}: {format_number(a.pm25)} → {format_number(b.pm25)} {UNIT}\n- Change: {format_signed(b.pm25 - a.pm25)} {UNIT}{loss}"

    def peak_value(self, asked: Asked) -> str:
        place = asked.best()
        if not place:
            return "Which country or state/province should I check?"
        rows = self.series(self.cube(asked), place, asked.benchmark)
        if not rows:
            return NO_DATA
        years = q.years(asked.resolved)
        first, last = q.relative_range(asked.resolved, [r.year for r in rows]) or (years[0] if years else rows[0].year, years[1] if len(years) > 1 else rows[-1].year)
        rows = [r for r in rows if first <= r.year <= last and r.pm25 is not None]
        if not rows:
            return NO_YEAR
        low = q.has(r"\b(?:lowest|minimum|min)\b", asked.resolved)
        best = (min if low else max)(rows, key=lambda r: r.pm25)
        loss = f"\n- Life loss: {format_number(best.loss)} years per person ({benchmark_name(asked.benchmark)})" if best.loss is not None else ""
        return f"{'Lowest' if low else 'Highest'} PM2.5 for {place.name}, {first}–{last}:\n- {best.year}: {format_number(best.pm25)} {UNIT}{loss}"

    def direct(self, asked: Asked) -> str:
        place = asked.best()
        if not place:
            return NO_PLACE if q.names_unknown_place(asked.resolved) else WHICH_PLACE
        cube = self.within(self.cube(asked), place)
        if place.level in ("state", "district"):
            parent = "country" if place.level == "state" else "state"
            parents = cube.where(F.col(parent).isNotNull()).select(parent).distinct().limit(2).count()
            if parents > 1 and not any(p.level == parent for p in asked.places):
                return f"Which {place.name} do you mean? Please include its state or country."
        rows = {r.year: r for r in self.series(self.cube(asked), place, asked.benchmark)}
        if not rows:
            return NO_DATA
        year = asked.years[-1] if asked.years else max(rows)
        if year not in rows:
            return NO_YEAR
        r, total = rows[year], q.wants_total(asked.resolved)
        both = q.names_who(asked.resolved) and q.names_national(asked.resolved)
        if q.has(r"\bpopulation\b", asked.current) and not q.wants_total(asked.current):
            return NO_DATA if r.population is None else f"{place.name}, {year}: population {format_integer(r.population)}."
        if both or total:
            if total and not (r.population or 0) > 0:
                return NO_DATA
            lines = [f"- PM2.5: {format_number(r.pm25)} {UNIT}"] if r.pm25 is not None else []
            lines += [f"- Population: {format_integer(r.population)} people"] if total else []
            named = [("WHO guideline", r.who), ("National standard", r.national)] if both else [("National standard" if asked.benchmark.kind == "national" else "WHO guideline", r.loss)]
            for name, loss in named:
                if loss is not None:
                    lines.append(f"- {name}: {format_number(loss)} years per person; {format_integer(loss * r.population)} total person-years lost" if total else f"- {name}: {format_number(loss)} years life loss per person")
            return "\n".join([f"{place.name}, {year}:", *lines, *(["- Calculation: life loss per person × population"] if total else [])])
        parts = [x for x in (f"{format_number(r.pm25)} {UNIT} PM2.5" if r.pm25 is not None else "", f"{format_number(r.loss)} years of life loss" if r.loss is not None else "") if x]
        note = "\nUsing a simple average because population weights are not available." if r.used_simple_average else ""
        return f"{place.name}, {year} ({benchmark_name(asked.benchmark)}): {', '.join(parts)}.{note}" if parts else NO_DATA
