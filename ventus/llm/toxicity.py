"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A feature is a bucket of hashed character n-grams (of UTF-8 bytes, lengths 3
to 6, A-Z lowered, white space folded to one separator).  From labelled texts
come r = log of the ratio of the two classes' smoothed shares of documents
with the feature; a logistic regression is then fitted on the scaled presence
features r * [present], as in Wang and Manning (2012).  A score is the sigmoid
of the sum over the distinct buckets of a whole text.

What is learnt from is bounded by ``max_rows_per_class`` labelled rows of each
class, chosen by hash, and by nothing else.  Their texts are counted where they
are; the driver gets counts, 2**bits at most, and of each chosen text the
distinct buckets that tell the classes apart, 2**bits at most however long it is.  The model broadcast has a fixed size of
2**bits floats.

Defined results: a null or empty text scores as the model's bias says; repeated
rows get equal scores; an empty table gives an empty result; without labelled
rows of both classes every score is the share of class 1 (0.5 without rows).
Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm import text as tx
from ventus.llm.shelf import Shelf

SIZES = (3, 4, 5, 6)
BITS = 20
THRESHOLD = 0.3
#: Bytes of text worked on at a time in the fit.
FIT_SLICE = 256 << 10
#: A longer single text is worked on in blocks of so many bytes.
BLOCK_BYTES = 1 << 20

_fold = tx.lower_ascii(np.arange(256, dtype=np.uint8))
_fold[tx._SPACE] = 0x20
_codes = tx._byte_codes[0][_fold]


def buckets(t: tx.Texts, sizes: tuple[int, ...] = SIZES, bits: int = BITS, of_use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) for each distinct bucket of each text, sorted by text; of_use: only buckets flagged there."""
    if len(t) == 1 and len(t.data) > BLOCK_BYTES:  # one long text: blocks that overlap by a gram, united in a bitmap
        found = np.zeros(1 << bits, dtype=bool)
        for begin in range(0, len(t.data), BLOCK_BYTES):
            found[_keys(t.data[begin : begin + BLOCK_BYTES + max(sizes) - 1], None, sizes, bits, of_use)] = True
        at = np.flatnonzero(found)
        return np.zeros(len(at), dtype=np.int64), at
    both = _keys(t.data, t.offsets, sizes, bits, of_use)
    return both >> bits, both & ((1 << bits) - 1)


def _keys(data: np.ndarray, offsets: np.ndarray | None, sizes: tuple[int, ...], bits: int, of_use: np.ndarray | None) -> np.ndarray:
    """Distinct (text << bits | bucket) of texts that offsets delimit; without offsets all is one text."""
    n = len(data)
    text_end = None if offsets is None else np.repeat(offsets[1:], np.diff(offsets))
    rolled, keys = np.zeros(n, dtype=np.uint64), []
    codes = _codes[data]
    size = 0
    for want in sizes:
        with np.errstate(over="ignore"):
            while size < want and n > size:
                rolled[: n - size] = rolled[: n - size] * np.uint64(tx._BASES[0]) + codes[size:]
                size += 1
            if size < want:
                break
            h = (tx.mix(rolled[: n - size + 1] + np.uint64(want)) >> np.uint64(64 - bits)).astype(np.int64)
        ok = np.ones(len(h), dtype=bool) if text_end is None else np.arange(len(h)) + want <= text_end[: len(h)]
        if of_use is not None:
            ok &= of_use[h]
        at = np.flatnonzero(ok)
        owner = 0 if offsets is None else np.searchsorted(offsets, at, side="right") - 1
        keys.append((owner << bits) | h[at])
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # float32, 2**bits
    sizes: tuple[int, ...] = SIZES
    bits: int = BITS

    def score(self, t: tx.Texts) -> np.ndarray:
        if not hasattr(self, "_used"):
            self._used = self.weights != 0
        owner, bucket = buckets(t, self.sizes, self.bits, self._used)
        z = np.bincount(owner, weights=self.weights[bucket], minlength=len(t)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _counted(sizes: tuple[int, ...], bits: int):
    """(bucket, n_toxic, n_docs) summed over the texts of a task's batches; bucket -1 stands for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, all_ = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        for batch in batches:
            y = np.asarray(batch.column("toxic"))
            for t in tx.texts_of(batch.column("text"), FIT_SLICE):
                owner, bucket = buckets(t, sizes, bits)
                mine = y[t.first : t.first + len(t)]
                pos += np.bincount(bucket + 1, weights=mine[owner], minlength=len(pos))
                all_ += np.bincount(bucket + 1, minlength=len(pos))
                pos[0] += mine.sum()
                all_[0] += len(t)
        at = np.flatnonzero(all_)
        yield pa.record_batch([pa.array(at - 1), pa.array(pos[at].astype(np.int64)), pa.array(all_[at].astype(np.int64))], names=["bucket", "n_toxic", "n_docs"])

    return run


def _present(sizes: tuple[int, ...], bits: int, of_use: np.ndarray):
    """The buckets of use that each text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column("text"), FIT_SLICE):
                owner, bucket = buckets(t, sizes, bits, of_use)
                ends = np.searchsorted(owner, np.arange(len(t) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
                yield pa.record_batch([batch.column("doc_id").slice(t.first, len(t)), batch.column("toxic").slice(t.first, len(t)), lists], names=["doc_id", "toxic", "buckets"])

    return run


def log_count_ratios(pos: np.ndarray, all_: np.ndarray, n_pos: int, n: int, smooth: float = 1.0, min_docs: int = 3, least_z: float = 5.0) -> np.ndarray:
    """Log of the ratio of the two classes' smoothed shares of texts with each bucket.

    Buckets found in fewer than min_docs texts, or whose shares in the two
    classes differ by less than least_z standard errors, get 0: on a long text
    their many small weights would add up to noise.
    """
    ratio = np.log((pos + smooth) / (n_pos + 2 * smooth)) - np.log((all_ - pos + smooth) / (n - n_pos + 2 * smooth))
    with np.errstate(divide="ignore", invalid="ignore"):
        p = all_ / n
        z = (pos / n_pos - (all_ - pos) / (n - n_pos)) / np.sqrt(p * (1 - p) * (1 / n_pos + 1 / (n - n_pos)))
    ratio[~(np.abs(z) >= least_z) | (all_ < min_docs)] = 0
    return ratio


def fit_weights(owner: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, bias: float, ridge: float = 1e-3, max_steps: int = 200, tolerance: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of columns and the bias: Adam on the ridge logistic loss over all rows, until the gradient is within tolerance."""
    n, width = len(y), int(col.max()) + 1 if len(col) else 0
    w, b = np.zeros(width), bias
    m1, m2, c1, c2 = np.zeros(width), np.zeros(width), 0.0, 0.0
    for k in range(1, max_steps + 1):
        err = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights=x * w[col], minlength=n) + b, -50, 50))) - y
        g, gb = np.bincount(col, weights=x * err[owner], minlength=width) / n + ridge * w, err.mean()
        if max(np.abs(g).max(initial=0.0), abs(gb)) < tolerance:
            break
        m1, m2, c1, c2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g, 0.9 * c1 + 0.1 * gb, 0.99 * c2 + 0.01 * gb * gb
        rate = 0.03 / np.sqrt(1 + k / 50)
        w = w - rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.99**k)) + 1e-9)
        b = b - rate * (c1 / (1 - 0.9**k)) / (np.sqrt(c2 / (1 - 0.99**k)) + 1e-9)
    return w, b


def learn(docs: DataFrame, labels: DataFrame, may_learn=None, max_rows_per_class: int = 2000, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Model:
    """Fit on at most max_rows_per_class labelled texts of each class, chosen by hash of the id; whole texts, however long.

    may_learn: a condition on doc_id that rows to learn from must meet.  The
    bias is set back to the shares of the classes among all labels.  Texts stay
    where they are: counts of buckets, 2**bits at most, and the buckets of use
    of each chosen text come to the driver.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    if may_learn is not None:
        labels = labels.where(may_learn)
    labels = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    pick = lambda v: labels.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows_per_class)
    chosen = Shelf(docs.sparkSession).put(pick(0).unionByName(pick(1)), "chosen")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # 2 * max_rows_per_class ids at most
    found = rows.select("toxic", "text").mapInArrow(_counted(sizes, bits), "bucket long, n_toxic long, n_docs long")
    found = found.groupBy("bucket").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_docs").alias("n_docs")).where("bucket < 0 or n_docs > 2").toArrow()  # 2**bits rows at most
    bucket, n_toxic, n_docs = (np.asarray(found.column(c)).astype(np.int64) for c in ("bucket", "n_toxic", "n_docs"))
    n, n_pos = int(n_docs[bucket < 0].sum()), int(n_toxic[bucket < 0].sum())
    share = float(np.clip(n_pos / n, 1e-3, 1 - 1e-3)) if n else 0.5
    flat = Model(float(np.log(share / (1 - share))), np.zeros(1 << bits, dtype=np.float32), sizes, bits)
    if not 0 < n_pos < n:
        return flat
    some = bucket >= 0
    ratio = np.zeros(1 << bits)
    ratio[bucket[some]] = log_count_ratios(n_toxic[some].astype(float), n_docs[some].astype(float), n_pos, n)
    seen = rows.mapInArrow(_present(sizes, bits, ratio != 0), "doc_id long, toxic int, buckets array<int>").orderBy("doc_id", F.xxhash64("buckets")).toArrow()
    lists = seen.column("buckets").combine_chunks()
    y = np.asarray(seen.column("toxic")).astype(np.float64)
    owner = np.repeat(np.arange(len(y), dtype=np.int32), np.asarray(lists.value_lengths()))
    used, col = np.unique(np.asarray(lists.flatten()), return_inverse=True)
    weights, bias = fit_weights(owner, col.astype(np.int32), ratio[used][col], y, flat.bias)
    out = flat.weights.copy()
    out[used] = weights * ratio[used]
    if len(counts) == 2:
        bias += float(np.log(counts[1] / counts[0]) - np.log(n_pos / (n - n_pos)))
    return Model(float(bias), out, sizes, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every whole text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(t.first, len(t)), pa.array(shared.value.score(t))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs and nothing moved.

    A model that has learnt no feature, as without labelled rows, can't tell
    texts apart and rejects none.
    """
    if not model.weights.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column(text_at)):
                yield batch.slice(t.first, len(t)).filter(pa.array(shared.value.score(t) < threshold))

    return docs.mapInArrow(run, docs.schema)
