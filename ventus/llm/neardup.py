"""Near-duplicate documents: a multi-index Hamming join over MinHash signatures of 32-bit symbols.

A signature has ``CHUNKS * WIDTH`` symbols of 32 bits, each the minimum of one
hash function over the word shingles; the distance of two signatures is the
number of symbols in which they differ.  By the pigeonhole principle two
signatures that differ in fewer than ``CHUNKS * (ERRORS + 1)`` symbols have a
chunk with at most ``ERRORS`` of them, so indexing every chunk under each way
to leave out ERRORS of its symbols finds *all* pairs below that distance.
(Pairs further apart are found too if some chunk agrees: with the defaults a
pair of similarity 0.8 is missed once in 40,000 times, one of 0.85 once in
three million.)  Every pair found is confirmed on the full shingle sets.

Large groups of copies: equal sets are one row from the start.  In a bucket
of the index all members are first compared with its least member, its head,
which is a pre-aggregated minimum and a join, not all pairs; connected
components are formed.  A member outside the component of its head is loose,
and only loose members are compared with the other members of the buckets of
that head, inside cells of two blocks of about ``BLOCK`` sets or
``BLOCK_BYTES``: a cell counts common shingles by matrix products and gives
back a link for each component that it links with a lesser one, so fewer than
it has sets.  So no link is lost, groups never expand into pairs, and a large
group is spread over cells.

Defined results: a document without words (null or empty text) has 0 shingles
and stands alone; a document of fewer words than a shingle has its whole
sequence as one; rows with the same id are one node; rows with a null id are
linked with nothing, have a null component and are kept; an empty table gives
an empty result.  Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm import text as tx
from ventus.llm.components import components
from ventus.llm.shelf import Shelf

CHUNKS, WIDTH, ERRORS = 10, 6, 1
#: Sets on each side of a cell, and bytes of them, about.
BLOCK, BLOCK_BYTES = 256, 16 << 20

def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2014)
    return rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(t: tx.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): the distinct shingle codes of each text, sorted within it."""
    data = tx.lower_ascii(t.data)
    w = tx.words_of(t)
    codes = tx.word_codes(data, w)
    at = np.flatnonzero(tx.inside(w.first, size))
    owner = w.text_of()
    shingles = tx.window_codes(codes, size)[at] if len(at) else np.zeros(0, dtype=np.uint64)
    owners = owner[at]
    short = np.flatnonzero((w.per_text > 0) & (w.per_text < size))
    if len(short):
        whole = w.per_text[short].astype(np.uint64)
        for j in range(size - 1):  # fewer words than a shingle
            more = w.first[short] + j < w.first[short + 1]
            whole[more] = tx.joined(whole[more], codes[w.first[short[more]] + j], 1)
        shingles, owners = np.concatenate((shingles, whole)), np.concatenate((owners, short))
    order = np.lexsort((shingles, owners))
    shingles, owners = shingles[order], owners[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owners[1:] != owners[:-1])
    shingles, owners = shingles[new], owners[new]
    return shingles, np.searchsorted(owners, np.arange(len(t) + 1))


def signatures(codes: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """One row of n 32-bit symbols for each text; texts without shingles have zeros."""
    some = np.flatnonzero(np.diff(first))
    out = np.zeros((len(first) - 1, n), dtype=np.uint32)
    if len(some):
        shift, times = _functions(n)
        with np.errstate(over="ignore"):
            for k in range(n):
                out[some, k] = np.minimum.reduceat((codes ^ shift[k]) * times[k], first[some]) >> np.uint64(32)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _sign(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column(1)):
                codes, first = shingle_sets(t, size)
                owner = np.repeat(np.arange(len(t)), np.diff(first))
                with np.errstate(over="ignore"):
                    sums = np.zeros((2, len(t)), dtype=np.uint64)
                    np.add.at(sums[0], owner, codes)
                    np.add.at(sums[1], owner, tx.mix(codes ^ np.uint64(0x5851F42D4C957F2D)))
                yield pa.record_batch(
                    [batch.column(0).slice(t.first, len(t)), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), _binary(signatures(codes, first, n))],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return run


def _index(chunks: int, width: int, errors: int):
    """The keys under which a signature is indexed: each chunk without each choice of errors symbols."""
    kept = [np.array(c) for c in combinations(range(width), width - errors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                n = batch.num_rows
                column = batch.column(1)
                at = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
                symbols = np.frombuffer(column.buffers()[2], dtype=np.uint32, offset=at, count=n * chunks * width).reshape(n, chunks, width).astype(np.uint64)
                keys = np.empty((n, chunks, len(kept)), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j, keep in enumerate(kept):
                        code = np.full((n, chunks), j + 1, dtype=np.uint64) + np.arange(chunks, dtype=np.uint64) * np.uint64(len(kept))
                        for p in keep:
                            code = tx.mix(code * np.uint64(tx._BASES[0]) + symbols[:, :, p])
                        keys[:, :, j] = code
                ids = np.repeat(np.asarray(batch.column(0)), chunks * len(kept))
                yield pa.record_batch([pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], names=["key", "doc_id"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in tx.texts_of(batch.column(1)):
                codes, first = shingle_sets(t, size)
                offsets = (first * 8).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(t), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(codes))])
                yield pa.record_batch([batch.column(0).slice(t.first, len(t)), sets], names=["doc_id", "members"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    continue
                short, long = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(long, short)
                at[at == len(long)] = 0
                both = int((long[at] == short).sum())
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many codes each set of left has in common with each of right."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x])) for x in (left, right)]
    both = np.intersect1d(flat[0][0], flat[1][0])
    places = []
    for codes, owner in flat:
        at = np.searchsorted(both, codes)
        ok = at < len(both)
        ok[ok] = both[at[ok]] == codes[ok]
        order = np.argsort(at[ok], kind="stable")
        places.append((at[ok][order], owner[ok][order]))
    for start in range(0, len(both), columns):
        width = min(columns, len(both) - start)
        parts = []
        for (at, owner), n in zip(places, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(at, (start, start + width))
            m = np.zeros((n, width), dtype=np.float32)
            m[owner[i:j], at[i:j] - start] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _cells(percent: int):
    """Rows come sorted by cell; gives one link for each component that a cell links with a lesser one."""

    def cell(table: pa.Table) -> pa.RecordBatch:
        doc, own, loose = (np.asarray(table.column(c)) for c in ("doc", "own", "loose"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("members").to_pylist()]
        left, right = np.flatnonzero(loose), np.flatnonzero(~loose)
        a = b = np.zeros(0, dtype=np.int64)
        if len(left) and len(right):
            common = _common([sets[k] for k in left], [sets[k] for k in right])
            sizes = np.array([len(x) for x in sets], dtype=np.float64)
            near = 100 * common.astype(np.float64) >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
            near &= own[left][:, None] != own[right][None, :]
            i, j = np.nonzero(near)
            nodes, place = np.unique(np.concatenate((own[left[i]], own[right[j]])), return_inverse=True)
            x, y = place[: len(i)], place[len(i) :]
            root = np.arange(len(nodes))
            while True:  # the least component that each is linked with in the cell
                new = root.copy()
                np.minimum.at(new, x, root[y])
                np.minimum.at(new, y, root[x])
                if (new == root).all():
                    break
                root = new
            some = root != np.arange(len(nodes))
            a, b = nodes[some], nodes[root[some]]
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        mark = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("head", "i", "j")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                key = tuple(keys[:, s].tolist())
                if key != mark and held:
                    yield cell(pa.Table.from_batches(held))
                    held = []
                mark = key
                held.append(batch.slice(s, e - s))
        if held:
            yield cell(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, chunks: int = CHUNKS, width: int = WIDTH, errors: int = ERRORS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    spark = docs.sparkSession
    shelf = Shelf(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = shelf.put(rows.mapInArrow(_sign(shingle_words, chunks * width), "doc_id long, n_shingles long, set_a long, set_b long, signature binary"), "signed")
    same = ["set_a", "set_b", "n_shingles"]
    some = signed.where("doc_id is not null and n_shingles > 0")
    heads = shelf.put(some.groupBy(*same).agg(F.min("doc_id").alias("head"), F.first("signature").alias("signature")), "heads")

    keys = heads.select(F.col("head").alias("doc_id"), "signature").mapInArrow(_index(chunks, width, errors), "key long, doc_id long")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = shelf.put(buckets, "buckets")  # read anew, so that the join below may split large buckets
    pairs = shelf.put(keys.join(buckets, "key").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # the same join at every size: which ids there are grows with the documents
    sets = shelf.put(rows.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "doc_id long, members binary"), "sets")

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("of_a")), sets.select(F.col("doc_id").alias("b"), F.col("members").alias("of_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "of_a", "of_b")
    links = shelf.put(both.mapInArrow(_confirm(percent), "a long, b long"), "links")
    part = components(links, shelf, "first")
    of = lambda c, to: part.select(F.col("node").alias(c), F.col("component").alias(to))
    placed = pairs.join(of("b", "own"), "b", "left").join(of("a", "of_head"), "a", "left")
    placed = placed.select(F.col("a").alias("head"), F.col("b").alias("doc"), F.coalesce("own", "b").alias("own"), (F.coalesce("own", "b") != F.coalesce("of_head", "a")).alias("loose"))
    placed = shelf.put(placed.join(sets.select(F.col("doc_id").alias("doc"), F.octet_length("members").alias("bytes")), "doc"), "placed")
    much = lambda n, bytes_: F.greatest(F.ceil(n / block), F.ceil(bytes_ / BLOCK_BYTES), F.lit(1)).cast("int")
    sizes = placed.groupBy("head").agg(F.count("*").alias("n"), F.count_if("loose").alias("n_loose"), F.sum("bytes").alias("bytes"), F.sum(F.when(F.col("loose"), F.col("bytes"))).alias("bytes_loose")).where("n > 1 and n_loose > 0")
    sizes = shelf.put(sizes.select("head", much(F.col("n_loose"), F.col("bytes_loose")).alias("of_i"), much(F.col("n"), F.col("bytes")).alias("of_j")), "sizes")
    open_ = placed.drop("bytes").join(sizes, "head").join(sets.withColumnRenamed("doc_id", "doc"), "doc")
    spread = lambda of: F.pmod(F.xxhash64("doc", "head"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    one = open_.where("loose").withColumn("i", spread("of_i")).withColumn("j", every("of_j"))
    other = open_.withColumn("loose", F.lit(False)).withColumn("i", every("of_i")).withColumn("j", spread("of_j"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = one.unionByName(other).select("head", "i", "j", "doc", "own", "loose", "members").repartition(n, "head", "i", "j").sortWithinPartitions("head", "i", "j")
    more = shelf.put(cells.mapInArrow(_cells(percent), "a long, b long"), "more")
    final = components(links.unionByName(more), shelf, "final").select(F.col("node").alias("head"), "component")

    of_set = heads.select(*same, "head").join(final, "head", "left").select(*same, F.coalesce("component", "head").alias("component"))
    of_set = of_set.withColumnRenamed("n_shingles", "n_of_set").withColumn("with_id", F.lit(True))
    known = (signed.set_a == of_set.set_a) & (signed.set_b == of_set.set_b) & (F.col("n_shingles") == F.col("n_of_set")) & (signed.doc_id.isNotNull() == F.col("with_id"))
    found = signed.select("doc_id", *same).join(of_set, known, "left").select(signed.doc_id, "n_shingles", F.coalesce("component", signed.doc_id).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs but those of documents that are near-duplicates of one of smaller id; columns as they are."""
    found = near_duplicates(docs, **options)
    name = "_copy"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    copies = Shelf(docs.sparkSession).put(found.where("not kept").select(F.col("doc_id").alias(name)).distinct(), "copies")
    return docs.join(copies, F.col("doc_id").cast("long") == F.col(name), "left_anti")
