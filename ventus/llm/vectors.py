"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to unit length.  A table's bucket is the tuple of ``hashes``
quantised Gaussian projections floor((a.x + b) / width); vectors that share a
bucket in any of ``tables`` tables (and the label and the dimension) are
compared exactly, in double precision.  Unit vectors of cosine 0.93 are 0.374
apart; with the defaults they share no bucket once in 600 times, vectors of
cosine 0.97 once in 100,000 times.

Equal vectors of a label are one row with a weight from the start.  A bucket
of n vectors is split at random into ceil(n / BLOCK) blocks, and each pair of
blocks is a cell with a task's share of the work, so a large bucket is spread
over tasks and no cell is large.  A cell gives back, for each of its vectors,
the weight of its links, counted only in the first table that brings a pair
together, and one link to the least vector of its component in the cell: pairs
are never emitted.

Defined results: a vector that is null, empty, zero or holds a null or a
non-finite number, and one with a null label or id, links with nothing and
stands alone; rows that share an id never link with each other, equal ones
count once as a partner, and each row has the count of its own vector; an
empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm.components import components
from ventus.llm.shelf import Shelf

TABLES, HASHES, WIDTH = 20, 8, 2.0
#: Vectors of a bucket in a block.
BLOCK = 512


def projections(dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, 1])
    return rng.standard_normal((dim, n)), rng.random(n)


def bucket_codes(unit: np.ndarray, tables: int, hashes: int, width: float) -> np.ndarray:
    """A 64-bit code of the bucket in each table, for each row."""
    a, b = projections(unit.shape[1], tables * hashes)
    q = np.floor(unit @ a / width + b).astype(np.int64).reshape(len(unit), tables, hashes).view(np.uint64)
    code = np.full((len(unit), tables), unit.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(hashes):
            code = (code ^ q[:, :, j]) * np.uint64(0xBF58476D1CE4E5B9)
            code ^= code >> np.uint64(29)
    return code


def _unit(rows: np.ndarray) -> np.ndarray:
    x = rows.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(tables: int, hashes: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(column.value_lengths())
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                part = column.take(pa.array(at))
                flat = np.asarray(part.flatten()).reshape(len(at), dim)
                codes = bucket_codes(_unit(flat), tables, hashes, width)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(at)), _fixed(flat), _fixed(codes), _lists(codes.view(np.int64)), batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at))],
                    names=["head", "vector", "codes", "buckets", "weight", "label"],
                )

    return run


def _fixed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(rows)])


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return np.stack([np.frombuffer(x, dtype=kind) for x in column.to_pylist()])


def _compare(least: float, kind):
    """Cells come as runs of rows sorted by (key, i, j)."""

    def cell(table: pa.Table) -> pa.RecordBatch | None:
        if table.num_rows < 2:
            return None
        ids, weight = np.asarray(table.column("head")), np.asarray(table.column("weight"))
        block, i, j = np.asarray(table.column("block")), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        t = table.column("t")[0].as_py()
        rows = table.column("vector").combine_chunks()
        unit, codes = _unit(_matrix(rows, kind)), _matrix(table.column("codes").combine_chunks(), np.uint64)
        near = unit @ unit.T >= least
        near &= ids[:, None] != ids[None, :]
        if i != j:
            near &= block[:, None] != block[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return None
        first = ~(codes[a, :t] == codes[b, :t]).any(axis=1) if t else np.ones(len(a), dtype=bool)
        links = np.bincount(a[first], weights=weight[b[first]], minlength=len(ids)).astype(np.int64)
        root = ids.copy()
        while True:  # the least id of each component of the cell
            new = root.copy()
            np.minimum.at(new, a, root[b])
            if (new == root).all():
                break
            root = new
        some = np.unique(a)
        return pa.record_batch([pa.array(ids[some]), pa.array(links[some]), pa.array(root[some])], names=["head", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)) for c in ("key", "i", "j")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[:, s].tolist())
                if key != mark and held:
                    if (out := cell(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                mark = key
                held.append(batch.slice(s, e - s))
        if held and (out := cell(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors."""
    shelf = Shelf(vectors.sparkSession)
    kind = np.float64 if vectors.schema[vector_col].dataType.elementType.simpleString() == "double" else np.float32
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", number) & F.exists("v", lambda x: x != 0)
    same = ["label", "same_a", "same_b"]
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("same_a", F.xxhash64("v")).withColumn("same_b", F.xxhash64(F.lit(7), "v"))
    once = rows.where("fit").groupBy(*same, "vec_id").agg(F.first("v").alias("v"))
    heads = once.groupBy(*same).agg(F.min("vec_id").alias("head"), F.first("v").alias("v"), F.count("*").alias("weight"))
    heads = shelf.put(heads, "heads")
    schema = f"head long, vector binary, codes binary, buckets array<long>, weight long, label {rows.schema['label'].dataType.simpleString()}"
    hashed = shelf.put(heads.select("head", "v", "weight", "label").mapInArrow(_hash(tables, hashes, width), schema), "hashed")
    keyed = hashed.select("head", "label", F.posexplode("buckets").alias("t", "bucket")).select("head", "t", F.xxhash64("label", "t", "bucket").alias("key"))
    sizes = shelf.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    full = hashed.select("head", "vector", "codes", "weight", F.posexplode("buckets").alias("t", "bucket"), "label").withColumn("key", F.xxhash64("label", "t", "bucket")).drop("bucket", "label")
    cells = full.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("head", "key"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("n", "blocks", "other")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cells.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(least, kind), "head long, links long, root long")
    found = shelf.put(found, "found")
    counts = found.groupBy("head").agg(F.sum("links").alias("links"))
    part = components(found.select(F.col("head").alias("a"), F.col("root").alias("b")), shelf).withColumnRenamed("node", "head")
    copies = heads.select(*same, "head", "weight").join(counts, "head", "left").join(part, "head", "left")
    copies = shelf.put(copies.select(*same, F.coalesce("component", "head").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.lit(True).alias("fit")), "copies")
    out = rows.drop("v").join(copies, [*same, "fit"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
