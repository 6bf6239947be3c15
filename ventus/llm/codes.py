"""Product quantisation with segment-mean lower bounds.

Vectors are cut into ``parts`` equal parts; each part position has a codebook
of ``entries`` entries, and a part's code is its nearest entry.  Distances are
bounded from below before they are computed.  Cut a part x and an entry y into
blocks of b components with means mx and my, and let rx and ry be the lengths
of what remains of them without the means; then

    |x - y|^2  =  sum b (mx - my)^2 + |remainder of x - remainder of y|^2  >=  sum b (mx - my)^2 + (rx - ry)^2.

Coarse to fine, from one block to two and so on: entries whose bound is over
the exact distance to the entry of the least bound are out.  Bounds are lowered
by a rounding margin, so no entry that is nearest or ties is ever out; survivors
get exact integer distances, ties go to the lower index.

A round gives, for each task, a row of (count, sums) for each entry in use;
Spark adds these up, and the driver reads parts x entries rows, whatever the
number of vectors.  Labels are met by their sums: those of over a HOT-th of all
vectors, fewer than HOT labels, are broadcast, so that their vectors are
not exchanged; other labels are joined by an exchange.

Defined results: vectors that are null or hold null or non-finite components
give no row; nor do empty ones, those whose length is no multiple of ``parts``
or isn't that of the vector of smallest id, and those with a component of
magnitude over LIMIT (squared distances need not fit into a long).  Repeated
rows count and come back as often as they occur; null ids come last where
starts are chosen, ties are ordered by components.  With fewer vectors than
entries a codebook has as many entries as there are vectors.  An empty table gives
an empty result.  Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm.centroids import LIMIT, finite, integers
from ventus.llm.shelf import Shelf

#: Vectors worked on at a time; each takes entries x 8 bytes for a part's bounds.
SLICE_ROWS = 4096
#: A label of over a HOT-th of all vectors is hot.
HOT = 1000
_MARGIN = 1e-9


def _levels(width: int) -> list[int]:
    """Numbers of blocks that divide a part, from one; blocks of single components would be the exact distance."""
    return [n for n in range(1, width) if width % n == 0] or [1]


def _summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Means of blocks scaled by the root of their size, and the length of what remains."""
    cut = x.reshape(len(x), blocks, -1)
    mean = cut.mean(axis=2)
    rest = np.sqrt(((cut - mean[:, :, None]) ** 2).sum(axis=(1, 2)))
    return mean * np.sqrt(cut.shape[2]), rest


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(index of the nearest entry of each part, its squared distance, number of exact distances computed). Integers."""
    n, fx, fy = len(x), x.astype(np.float64), book.astype(np.float64)
    slack = _MARGIN * (1 + (fx**2).sum(axis=1).max(initial=0) + (fy**2).sum(axis=1).max())
    row, entry = np.repeat(np.arange(n), len(book)), np.tile(np.arange(len(book)), n)
    best, computed = np.full(n, np.iinfo(np.int64).max), 0
    for blocks in _levels(x.shape[1]):
        (mx, rx), (my, ry) = _summary(fx, blocks), _summary(fy, blocks)
        low = (rx[row] - ry[entry]) ** 2
        for j in range(blocks):
            low += (mx[row, j] - my[entry, j]) ** 2
        hope, _ = _least(row, low, n)
        best = np.minimum(best, ((x - book[entry[hope]]) ** 2).sum(axis=1))
        stays = low <= best[row] + slack  # the nearest ones do, so that no part is left without any
        row, entry, computed = row[stays], entry[stays], computed + n
    first, away = _least(row, exact := ((x[row] - book[entry]) ** 2).sum(axis=1), n)
    return entry[first], away, computed + len(exact)


def _least(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first least value of each row, that value); row ascends and has all of 0 to n - 1."""
    least = np.minimum.reduceat(value, np.searchsorted(row, np.arange(n))) if n else value
    at = np.flatnonzero(value == least[row])
    return at[np.searchsorted(row[at], np.arange(n))], least


def _slices(batches: Iterator[pa.RecordBatch], books: np.ndarray):
    parts, _, width = books.shape
    for batch in batches:
        for begin in range(0, batch.num_rows, SLICE_ROWS):
            own = batch.slice(begin, SLICE_ROWS)
            yield own, np.asarray(own.column("point").flatten()).reshape(-1, parts, width)


def _moved(books: np.ndarray):
    """Counts and sums of what each entry gets in a task."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
        for _, points in _slices(batches, books):
            for p in range(parts):
                to, _, _ = nearest(points[:, p], books[p])
                counts[p] += np.bincount(to, minlength=entries)
                np.add.at(sums[p], to, points[:, p])
        part, entry = np.nonzero(counts)
        flat = sums[part, entry]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.reshape(-1)))
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), lists], names=["part", "entry", "n", "sums"])

    return run


def _coded(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, points in _slices(batches, books):
            error = np.zeros(len(points), dtype=np.int64)
            codes = np.zeros((len(points), len(books)), dtype=np.int32)
            for p in range(len(books)):
                codes[:, p], away, _ = nearest(points[:, p], books[p])
                error += away
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.reshape(-1)))
            yield pa.record_batch([own.column("id"), own.column("label"), flat, pa.array(error)], names=["id", "label", "codes", "error"])

    return run


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list]:
    """((id, label, codes, error) of each kept vector, the codebooks as lists by part, entry and component).

    Components count as floor(scale * x).  Codebooks start as the parts of the
    vectors of smallest id and move rounds times.
    """
    types = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    whole = finite("vector") & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & F.forall("vector", lambda x: F.abs(x) <= LIMIT // scale)
    kept = rows.where(whole).select("id", "label", integers("vector", scale).alias("point"))
    by_id = [F.col("id").asc_nulls_last(), F.col("point")]
    one = kept.orderBy(*by_id).limit(1).collect()
    if not one:
        return vectors.sparkSession.createDataFrame([], f"id {types[id_col]}, label {types[label_col]}, codes array<int>, error long"), []
    width = len(one[0]["point"]) // parts
    kept = kept.where(F.size("point") == width * parts)
    first = kept.orderBy(*by_id).limit(entries).collect()
    books = np.array([r["point"] for r in first], dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(width)]
        moved = kept.mapInArrow(_moved(books), "part int, entry int, n long, sums array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums)
        books = books.copy()
        for row in moved.collect():  # parts x entries rows at most
            books[row["part"], row["entry"]] = [int(row[f"s{j}"]) // row["n"] for j in range(width)]
    coded = kept.mapInArrow(_coded(books), f"id {types[id_col]}, label {types[label_col]}, codes array<int>, error long")
    return coded, books.tolist()


def digest(coded: DataFrame, books: list, shelf: Shelf) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector."""
    coded = shelf.put(coded, "coded")
    sums = shelf.put(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "sums")
    total = sums.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > total / HOT
    often = F.broadcast(sums.where(hot).select(F.col("label").alias("known"), F.col("label_error").alias("hot_error")))
    met = coded.join(often, F.col("label").eqNullSafe(F.col("known")), "left")
    rare = met.where("hot_error is null").drop("known").join(sums.where(~hot).select(F.col("label").alias("known"), "label_error").hint("merge"), F.col("label").eqNullSafe(F.col("known")))
    columns = ["id", "codes", "error", "label_error"]
    every = met.where("hot_error is not null").withColumnRenamed("hot_error", "label_error").select(*columns).unionByName(rare.select(*columns))
    code = F.array_join(F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")), "")
    sha = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return every.select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
