"""Mixing sources to target weights by soft membership.

A classifier learnt from the labelled table gives each document a posterior
over domains: multinomial naive Bayes over hashed words, endings and beginnings, whose log-likelihoods
are tempered by the factor that makes held-out labelled documents likeliest,
so that posteriors are as soft as the classifier errs.  Then nonnegative
document rates r are fitted so that the expected tokens of each domain, sum
over documents of r * tokens * posterior, match the target shares:

    minimise 1/2 sum over domains of (A r - b)_k^2 / s_k + ridge/2 * sum of share_d * (r_d - 1)^2,  r >= 0

with A[k, d] = share_d * posterior_dk, share_d the document's share of all
tokens, b the target shares and s the shares that the domains have.  Dividing
by s makes rare domains count and the problem well conditioned.  Projected
gradient steps with momentum are taken in the metric of the shares: a step
needs one number a domain from all documents (an aggregation), and the state
(r, y) of each document is written every few steps.  The step is 1 / (largest
eigenvalue + ridge); the loop ends when the gradient stands still, and says so
if it doesn't within max_steps.

All of it is DataFrame functions; the driver holds word weights, whose number
is domains times buckets, and residuals, one a domain and step.

Defined results: a null or empty text has no tokens and the prior as its
posterior; rows are rated each on its own, ties alike; an empty table gives an
empty result; domains without a labelled document are never predicted, and
without any labelled document every posterior is uniform over the targets.  A
domain that no document may belong to cannot reach its target; the others come
as near to theirs as the ridge lets them.  Other columns pass through
``apply_rates``, whatever their names, and are not read elsewhere.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventus.llm.shelf import Shelf

#: Buckets that words are hashed to.
BUCKETS = 2048
#: Steps after which the documents' state is written.
STORED_STEPS = 8
TEMPERATURES = tuple(2.0**-k for k in range(10))


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def n_tokens() -> Column:
    return F.regexp_count(_text(), F.lit("[^ \\t-\\r]+")).cast("double")


def word_buckets(text: Column, buckets: int, table: DataFrame, *others: Column) -> DataFrame:
    """The other columns and (a, b, c) for each word of each text: the buckets of the word, its last three and its first two letters.

    Words are what stands between blanks, in lower case; a null text has one empty word.
    """
    words = table.select(*others, F.explode(F.split(F.lower(F.coalesce(text, F.lit(""))), " ")).alias("_word"))
    w = F.col("_word")
    of = lambda x, part: F.pmod(F.xxhash64(x, F.lit(part)), F.lit(buckets)).cast("int")
    keep = [F.col(f"`{c}`") for c in words.columns if c != "_word"]
    return words.select(*keep, of(w, 0).alias("a"), of(F.right(w, F.lit(3)), 1).alias("b"), of(F.left(w, F.lit(2)), 2).alias("c"))


def _vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


@dataclass
class Classifier:
    """Log prior and log share of each bucket by domain; domains never seen have no entry in weights."""

    domains: list[str]
    priors: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    temperature: float = 1.0
    buckets: int = BUCKETS

    def sums(self, table: DataFrame, text: Column, *keys: Column) -> DataFrame:
        """The keys and the log-likelihoods of each text, a column for each domain that has weights: words are summed where they are read.

        The weights are one literal, which plans hold as an array.
        """
        known = [d for d in self.domains if d in self.weights]
        rows = np.stack([self.weights[d] for d in known], axis=1).round(5).tolist()
        weights = F.from_json(F.lit(json.dumps(rows, separators=(",", ":"))), F.lit("array<array<double>>"))
        words = word_buckets(text, self.buckets, table, *keys)
        names = [c for c in words.columns if c not in ("a", "b", "c")]
        found = words.select(*names, *[F.get(weights, F.col(c)).alias(c) for c in "abc"])
        total = lambda k: F.sum(F.get("a", F.lit(k)) + F.get("b", F.lit(k)) + F.get("c", F.lit(k)))
        return found.groupBy(*names).agg(*[total(k).alias(f"s{self.domains.index(d)}") for k, d in enumerate(known)])

    def posteriors(self, docs: DataFrame) -> DataFrame:
        """(doc_id, key_a, key_b, n_tokens, p) of each row of docs; the keys are hashes of id and text, p has the posterior of each domain."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id").alias("key_b"), n_tokens().alias("n_tokens"), _text().alias("t"))
        if not self.weights:
            return rows.drop("t").withColumn("p", _vector([1 / len(self.domains)] * len(self.domains)))
        keys = ["doc_id", "key_a", "key_b", "n_tokens"]
        scored = self.sums(rows.withColumn("row", F.monotonically_increasing_id()), F.col("t"), "row", *keys)  # repeated rows are rows of their own
        logs = [F.when(F.col("n_tokens") > 0, F.lit(float(x)) + F.lit(self.temperature) * F.col(f"s{k}")).otherwise(F.lit(float(x))) if d in self.weights else F.lit(-1e9) for k, (d, x) in enumerate(zip(self.domains, self.priors, strict=True))]
        scored = scored.select(*keys, F.array(*logs).alias("z"))
        scored = scored.select(*keys, F.transform("z", lambda x: F.exp(x - F.array_max("z"))).alias("e"))
        return scored.select(*keys, F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))


def learn(docs: DataFrame, labelled: DataFrame, domains: list[str], domain_col: str, max_rows: int = 6000, buckets: int = BUCKETS, smooth: float = 64.0) -> Classifier:
    """Learns from the documents that labelled names by doc_id, at most max_rows of them, chosen by hash of the id.

    Two thirds of them give the weights, the others the temperature; smooth is
    how many words the shares of all domains count for.
    """
    ids = labelled.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(domain_col).alias("domain"), _text().alias("t")).where(F.col("domain").isin(domains))
    rows = rows.join(F.broadcast(ids), "doc_id")  # max_rows ids at most
    grown = F.pmod(F.xxhash64("doc_id", F.lit("grown")), F.lit(3)) < 2
    words = word_buckets(F.col("t"), buckets, rows.where(grown), "domain")
    words = words.select("domain", F.explode(F.array("a", "b", "c")).alias("b"))
    counts = np.zeros((len(domains), buckets))
    for r in words.groupBy("domain", "b").count().collect():  # domains times buckets at most
        counts[domains.index(r["domain"]), r["b"]] = r["count"]
    n = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    total = sum(n.values())
    priors = np.log([max(n.get(d, 0), 1e-9) / max(total, 1) for d in domains])
    # shares are smoothed towards those of all domains, so that a domain of few texts isn't taken to use every word less
    pooled = (counts.sum(axis=0) + 1 / buckets) / (counts.sum() + 1)
    found = Classifier(domains, priors, {}, 1.0, buckets)
    for k, d in enumerate(domains):
        if counts[k].sum():
            found.weights[d] = np.log((counts[k] + smooth * pooled) / (counts[k].sum() + smooth))
    if not found.weights:
        return found
    names = {d: f"s{domains.index(d)}" for d in found.weights}
    held = found.sums(rows.where(~grown).where(F.col("domain").isin(list(names))), F.col("t"), "doc_id", "domain").orderBy("doc_id").collect()  # max_rows rows at most, a number a domain
    if held:
        sums = np.array([[r[names[d]] if d in names else -1e9 for d in domains] for r in held])
        truth = np.array([domains.index(r["domain"]) for r in held])
        losses = []
        for t in TEMPERATURES:
            z = priors + np.where(sums > -1e8, t * sums, -1e9)
            z -= z.max(axis=1, keepdims=True)
            losses.append(float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean()))
        found.temperature = TEMPERATURES[int(np.argmin(losses))]
    return found


def _dot(p: Column, g: Column, n: int) -> Column:
    out = p[0] * g[0]
    for k in range(1, n):
        out = out + p[k] * g[k]
    return out


@dataclass
class Fit:
    """The steps taken: of each the scaled residuals and the momentum."""

    n: int
    ridge: float
    step: float = 1.0
    steps: list[tuple[np.ndarray, float]] = field(default_factory=list)
    shares: np.ndarray | None = None  # what the domains end with
    converged: bool = True

    def moved(self, state: Column, first: int = 0) -> Column:
        """Struct (r, y) of a document after the steps from first on: its rate, and the point the next gradient is taken at."""
        if len(self.steps) <= first:
            return state

        def move(at: Column, s: Column) -> Column:
            y = at["y"]
            r = F.greatest(F.lit(0.0), y - F.lit(self.step) * (F.lit(self.ridge) * (y - 1.0) + _dot(F.col("p"), s, self.n)))
            return F.struct(r.alias("r"), (r + s[self.n] * (r - at["r"])).alias("y"))

        return F.aggregate(F.array(*[_vector([*g, beta]) for g, beta in self.steps[first:]]), state, move)

    def rate(self) -> Column:
        """The rate of a row with posterior p."""
        return self.moved(F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y")))["r"]


def fit_rates(table: DataFrame, targets: dict[str, float], shelf: Shelf, ridge: float = 1e-3, max_steps: int = 200, tolerance: float = 1e-6) -> Fit:
    """Fits the rates of the rows of table (n_tokens, p) by projected gradient with momentum."""
    n = len(targets)
    b = np.array([targets[d] for d in sorted(targets)], dtype=float)
    b = b / b.sum()
    w, p = F.col("n_tokens"), F.col("p")
    gram = [F.sum(w * p[i] * p[j]) for i in range(n) for j in range(n)]
    first = table.agg(F.sum(w), *[F.sum(w * p[k]) for k in range(n)], *gram).first()
    found, total = Fit(n, ridge), first[0] or 0.0
    if not total:
        return found
    now = np.array([x or 0.0 for x in first[1 : n + 1]]) / total
    scale = 1 / np.sqrt(np.maximum(now, 1e-12))
    hessian = np.array(first[n + 1 :], dtype=float).reshape(n, n) / total * scale[:, None] * scale[None, :]
    found.step = 1 / (np.linalg.eigvalsh(hessian).max() + ridge)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("y"))
    state, stored, t = table.select("n_tokens", "p", start.alias("at")), 0, 1.0
    while True:
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        found.steps.append(((now - b) * scale * scale, (t - 1) / t_next))
        t = t_next
        here = state.select("n_tokens", "p", found.moved(F.col("at"), stored).alias("at"))
        if len(found.steps) - stored == STORED_STEPS:
            name = f"state-{len(found.steps)}"
            state = here = shelf.put(here, name)
            shelf.drop(f"state-{stored}") if stored else None
            stored = len(found.steps)
        sums = here.agg(*[F.sum(w * F.col("at.y") * p[k]) for k in range(n)], *[F.sum(w * F.col("at.r") * p[k]) for k in range(n)], F.sum(w * F.abs(F.col("at.y") - F.col("at.r")))).first()
        after, found.shares = np.array(sums[:n], dtype=float) / total, np.array(sums[n : 2 * n], dtype=float) / total
        still = np.abs((after - now) * scale).max() < tolerance and (sums[2 * n] or 0.0) / total < tolerance * 10
        now = after
        if still or len(found.steps) >= max_steps:
            found.converged = bool(still)
            break
    if not found.converged:
        warnings.warn(f"rates still moved after {max_steps} steps; shares are {found.shares.round(4).tolist()}, targets {b.round(4).tolist()}", stacklevel=2)
    return found


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain_col: str = "lang", **options) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> for each target, rate) for each row of docs.

    labelled: a table whose doc_id column tells for which documents domain_col
    may be learnt from.  targets: domain to share of all tokens.
    """
    shelf = Shelf(docs.sparkSession)
    domains = sorted(targets)
    model = learn(docs, labelled, domains, domain_col)
    table = shelf.put(model.posteriors(docs), "posteriors")
    found = fit_rates(table, targets, shelf, **options)
    return table.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(domains)], found.rate().alias("rate"))


def apply_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], domain_col: str = "lang", budget: float | None = None, lossless: bool = False, seed: int = 0, **options) -> DataFrame:
    """The rows of docs, each as often as its rate says, so that tokens come to the target shares.

    budget: tokens wanted in all, those of docs if not told; lossless: as many
    as it takes for no document to be left out, which with targets far from the
    shares that there are is many times those of docs.  A rate of 1.3
    stands for one row, and for a second with a chance of 0.3 that a hash of
    id and text draws; one of 0.3 for one row with that chance, else for none.
    Rows without tokens are kept once.
    """
    shelf = Shelf(docs.sparkSession)
    domains = sorted(targets)
    model = learn(docs, labelled, domains, domain_col)
    table = shelf.put(model.posteriors(docs), "posteriors")
    found = fit_rates(table, targets, shelf, **options)
    scale = 1.0
    if budget is not None and found.shares is not None:
        total = table.agg(F.sum("n_tokens")).first()[0] or 0.0
        scale = budget / (total * found.shares.sum()) if total and found.shares.sum() else 1.0
    if lossless:
        least = table.where("n_tokens > 0").agg(F.min(found.rate())).first()[0]
        scale = 1 / least if least else 1.0
    wanted = F.greatest(found.rate() * F.lit(float(scale)), F.lit(1.0 if lossless else 0.0))
    draw = F.pmod(F.xxhash64("key_a", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = F.when(F.col("n_tokens") > 0, F.floor("wanted") + (draw < F.col("wanted") - F.floor("wanted")).cast("int")).otherwise(F.lit(1)).cast("int")
    counted = table.select("key_a", "key_b", "n_tokens", wanted.alias("wanted")).select("key_a", "key_b", copies.alias("copies"))
    counted = shelf.put(counted.groupBy("key_a", "key_b").agg(F.max("copies").alias("copies")), "copies")  # rows of one id and text fare alike
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", "text").alias("key_a"), F.xxhash64("text", "doc_id").alias("key_b"))
    rows = rows.join(counted.where("copies > 0").hint("merge"), ["key_a", "key_b"])
    return rows.select("_row", F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("_copy")).select("_row.*")
