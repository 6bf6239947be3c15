"""Quality rules: a decision list learned from labelled statistics.

``text_stats`` measures every whole text in one pass over Arrow batches.
``learn_rules`` fits an ordered list of threshold conjunctions by sequential
covering: each rule is grown on two thirds of the rows by FOIL gain, pruned on
the rest, and removed rows are out of the game for the next rule.
``rule_number`` turns the list into one ordered Spark conditional, so applying
it is a projection that stays in generated code.

Defined results: a null or empty text has all counts 0 and fails the base
check; repeated rows are measured each on its own; an empty table gives an
empty result; without labelled rows of both classes the list is empty and only
the base check decides.  Columns other than the id and the text are not read,
so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventus.llm import text as tx

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_lower", "n_marks", "n_pipes", "n_stutters", "n_lines", "n_digits")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, *MORE))

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
#: Words in a window whose repeats count.
WINDOW = 8


def _measure(t: tx.Texts) -> dict[str, np.ndarray]:
    w = tx.words_of(t)
    solid = ~tx._SPACE[t.data]
    owner = w.text_of()
    codes = tx.word_codes(t.data, w)
    # lines
    feed = t.data == 10
    line_start = np.unique(np.concatenate((t.offsets[:-1], np.flatnonzero(feed) + 1)))
    line_start = line_start[line_start < len(t.data)]
    line_end = np.concatenate((line_start[1:], [len(t.data)]))[: len(line_start)]
    line_owner = np.searchsorted(t.offsets, line_start, side="right") - 1
    ends_with_feed = feed[line_end - 1] if len(line_start) else feed
    line_end = line_end - (ends_with_feed & (line_end > line_start))
    solids = np.concatenate(([0], np.cumsum(solid)))
    wordy = solids[line_end] > solids[line_start]
    lines = tx.distinct(tx.line_array(t.data, line_start[wordy], line_end[wordy]))
    dup_line, _ = tx.repeats_of(line_owner[wordy], lines)
    # windows
    windows = tx.window_codes(codes, WINDOW)
    ok = np.flatnonzero(tx.inside(w.first, WINDOW))
    _, twice = tx.repeats_of(owner[ok], windows[ok])
    repeat = tx.covered(ok[twice], WINDOW, len(w))
    stutter = np.zeros(len(w), dtype=bool)
    stutter[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    n = len(t)
    return {
        "n_words": w.per_text,
        "word_chars": tx.per_text(solid & ((t.data & 0xC0) != 0x80), t.offsets),
        "n_symbols": tx.per_text(_SYMBOLS[t.data], t.offsets),
        "n_dup_lines": np.bincount(line_owner[wordy][dup_line], minlength=n),
        "n_repeat_words": tx.per_text(repeat, w.first),
        "n_upper": tx.per_text((t.data >= 65) & (t.data <= 90), t.offsets),
        "n_lower": tx.per_text((t.data >= 97) & (t.data <= 122), t.offsets),
        "n_marks": tx.per_text((t.data == 33) | (t.data == 63), t.offsets),
        "n_pipes": tx.per_text(t.data == 124, t.offsets),
        "n_stutters": tx.per_text(stutter, w.first),
        "n_lines": np.bincount(line_owner[wordy], minlength=n),
        "n_digits": tx.per_text((t.data >= 48) & (t.data <= 57), t.offsets),
    }


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in tx.texts_of(batch.column(1)):
            got = _measure(t)
            ids = batch.column(0).slice(t.first, len(t))
            yield pa.record_batch([ids, *(pa.array(got[c].astype(np.int64)) for c in (*COUNTS, *MORE))], names=["doc_id", *COUNTS, *MORE])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts for each row of docs, over its whole text."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_stats_batches, STATS_SCHEMA)


def features() -> dict[str, Column]:
    """The statistics that rules may test: ratios, so that a long text is judged as a short one."""
    c, per = F.col, lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "n_words": c("n_words").cast("double"),
        "mean_word_chars": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_word_share": per("n_repeat_words", "n_words"),
        "upper_share": c("n_upper") / F.greatest(c("n_upper") + c("n_lower"), F.lit(1)),
        "mark_share": per("n_marks", "n_words"),
        "pipe_share": per("n_pipes", "n_words"),
        "stutter_share": per("n_stutters", "n_words"),
        "digit_share": per("n_digits", "word_chars"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        v = table[self.feature]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > F.lit(self.threshold) if self.above else of[self.feature] <= F.lit(self.threshold)


Rule = tuple[Test, ...]


def covers(rule: Rule, table: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for test in rule:
        out &= test.holds(table)
    return out


def _best_test(table: dict[str, np.ndarray], bad: np.ndarray, at: np.ndarray, bins: int) -> tuple[float, Test | None]:
    """The test with the highest FOIL gain over the rows at."""
    p0, n0 = bad[at].sum(), (~bad[at]).sum()
    base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
    for name in table:
        v = table[name][at]
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        order = np.argsort(v, kind="stable")
        pos = np.concatenate(([0], np.cumsum(bad[at][order])))
        upto = np.searchsorted(v[order], cuts, side="right")
        for above in (True, False):
            p = p0 - pos[upto] if above else pos[upto]
            k = len(v) - upto if above else upto
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / k) - base), 0)
            j = int(np.argmax(gain)) if len(gain) else 0
            if len(gain) and gain[j] > best[0]:
                below, above_it = v[order][upto[j] - 1], v[order][min(upto[j], len(v) - 1)]
                best = (float(gain[j]), Test(name, above, float((below + above_it) / 2)))
    return best


def learn_rules(table: dict[str, np.ndarray], good: np.ndarray, max_rules: int = 12, max_tests: int = 4, min_precision: float = 0.6, bins: int = 200, seed: int = 7, grow: np.ndarray | None = None) -> list[Rule]:
    """Rules that reject, in order; rows that none covers are kept.

    grow: which rows rules are grown on, the others prune them; drawn if not given.
    """
    bad = ~good.astype(bool)
    left, rules = np.ones(len(bad), dtype=bool), []
    if not bad.any() or bad.all():
        return rules
    grow_part = np.random.default_rng(seed).random(len(bad)) < 2 / 3 if grow is None else grow
    while len(rules) < max_rules:
        at, rule = left & grow_part, ()
        if not bad[at].any():
            break
        while len(rule) < max_tests and (~bad[at]).any() and bad[at].any():
            gain, test = _best_test(table, bad, at, bins)
            if test is None:
                break
            rule, at = (*rule, test), at & test.holds(table)
        if not rule:
            break
        held = left & ~grow_part

        def worth(r: Rule, held: np.ndarray = held) -> float:
            c = covers(r, table, len(bad)) & held
            p, n = (bad & c).sum(), (~bad & c).sum()
            return (p - n) / max(p + n, 1)

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = covers(rule, table, len(bad)) & held
        p, n = (bad & c).sum(), (~bad & c).sum()
        if p < 2 or p / max(p + n, 1) < min_precision:
            break
        rules.append(rule)
        left &= ~covers(rule, table, len(bad))
    return rules


def rule_number(rules: list[Rule], of: dict[str, Column] | None = None) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    of, out = of or features(), None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column(of)
        for test in rule[1:]:
            cond = cond & test.column(of)
        out = F.when(cond, F.lit(k)) if out is None else out.when(cond, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def labelled_sample(labels: DataFrame, label_col: str, max_rows: int) -> DataFrame:
    """At most max_rows labelled ids, by hash of the id; of several labels of an id the smallest counts."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **options) -> list[Rule]:
    """Learn from at most max_rows labelled documents (a bound on what reaches the driver)."""
    chosen = F.broadcast(labelled_sample(labels, "quality", max_rows))  # max_rows ids at most
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen.select("doc_id"), "doc_id", "left_semi")
    part = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2  # the id decides, so that neither files nor tasks do
    got = text_stats(rows).join(chosen, "doc_id").select("doc_id", "label", part.alias("grow"), *(v.alias(k) for k, v in features().items())).toPandas()
    got = got.sort_values([c for c in got.columns if c != "grow"], kind="stable")
    return learn_rules({k: got[k].to_numpy(dtype=float) for k in features()}, got["label"].to_numpy() == 1, grow=got["grow"].to_numpy(dtype=bool), **options)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Counts, the base check, the rule that rejects (0: none) and the verdict for each document."""
    return (
        text_stats(docs)
        .withColumn("base_failed", base_failed())
        .withColumn("rule", rule_number(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
        .select("doc_id", *COUNTS, "base_failed", "kept", "rule")
    )
