"""Centroid clustering with ball-tree filtering.

Vectors become integers, and each record batch of a partition is built into
metric trees of at most TREE_ROWS vectors, written once.  A node of a tree
stands for a ball and stores radius, count and integer sum (its centre is
sum / count).  In each round a task walks its trees with the centroids: by the
triangle inequality a centroid that is farther from a ball's centre than the
nearest one by over two radii is nearest to nothing in the ball.  A ball that
only one centroid is left for is assigned whole, by its sum and count; otherwise its
children are looked at, and in leaves integer distances decide, with ties to
the smaller number.  Bounds are widened by a rounding margin, so filtering never
decides what exact distances would not.

A round gives one row of (count, sums) for each task and centroid; Spark adds
these up, and the driver reads k rows.  Nothing else leaves the tasks until
the last assignment, which gives each vector its centroid and distance.

Defined results: a vector is kept if it has exactly ``dim`` components, none
null or non-finite, and none of magnitude over LIMIT (squared distances of
larger ones need not fit into a long); others give no row.  Repeated rows and
equal vectors count and come back as often as they occur.  A null id comes
after all hashes where starts are chosen; rows of one hash are ordered by their
components.  With fewer than k vectors there are as many centroids as vectors;
an empty table gives an empty result.  Columns other than id and vector are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ventus.llm.shelf import Shelf

#: Vectors of a tree, and of a leaf.
TREE_ROWS, LEAF_ROWS = 4096, 8
#: Components after scaling: 64 * (2 * LIMIT) ** 2 fits into a long.
LIMIT = 1 << 27
#: Up to this magnitude products of 64 components are exact in double precision.
_SMALL = 1 << 22
_MARGIN = 1e-9

_NODES = {"begin": np.int64, "end": np.int64, "left": np.int64, "radius": np.float64}


def finite(vector: str) -> Column:
    """Whether a vector column is not null and holds neither nulls nor non-finite numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & F.forall(vector, number), F.lit(False))


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(F.col(vector), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def squares(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points from all centroids, exactly."""
    if not len(points):
        return np.zeros((0, len(centroids)), dtype=np.int64)
    small = max(np.abs(points).max(), np.abs(centroids).max()) <= _SMALL
    if small:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def build(points: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """A ball tree: an order of the points, and of each node its range in that order, left child (right is the next one; 0 in leaves), radius, and sum."""
    order = np.arange(len(points))
    begin, end, left, radius, sums = [0], [len(points)], [], [], []
    k = 0
    while k < len(begin):
        own = order[begin[k] : end[k]]
        p = points[own].astype(np.float64)
        total = points[own].sum(axis=0)
        away = np.sqrt(((p - total / len(own)) ** 2).sum(1))
        radius.append(away.max() * (1 + _MARGIN))
        sums.append(total)
        if len(own) <= LEAF_ROWS or (points[own] == points[own[0]]).all():
            left.append(0)
        else:  # along the line between a point far out and the one farthest from it, by the median
            a = p[away.argmax()]
            b = p[((p - a) ** 2).sum(1).argmax()]
            side = np.argsort(p @ (b - a), kind="stable")
            order[begin[k] : end[k]] = own[side]
            left.append(len(begin))
            half = begin[k] + len(own) // 2
            begin += [begin[k], half]
            end += [half, end[k]]
        k += 1
    nodes = {"begin": begin, "end": end, "left": left, "radius": radius}
    return order, {name: np.array(nodes[name], dtype=kind) for name, kind in _NODES.items()}, np.stack(sums)


def walk(nodes: dict[str, np.ndarray], sums: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whole balls, the centroid of each, leaves that are left to exact distances)."""
    count = nodes["end"] - nodes["begin"]
    balls, owners, leaves = [], [], []
    front = np.zeros(1, dtype=np.int64)
    while len(front):
        centre = sums[front] / count[front, None]
        away = np.sqrt(((centre[:, None, :] - centroids[None]) ** 2).sum(2))
        nearest = away.argmin(axis=1)
        reach = (away.min(axis=1) + 2 * nodes["radius"][front]) * (1 + _MARGIN) + _MARGIN
        alone = (away <= reach[:, None]).sum(axis=1) == 1
        leaf = nodes["left"][front] == 0
        balls.append(front[alone])
        owners.append(nearest[alone])
        leaves.append(front[leaf & ~alone])
        inner = nodes["left"][front[~leaf & ~alone]]
        front = np.concatenate((inner, inner + 1))
    return np.concatenate(balls), np.concatenate(owners), np.concatenate(leaves)


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    length = end - begin
    return np.repeat(begin - np.cumsum(length) + length, length) + np.arange(length.sum())


def _flat(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _plant(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TREE_ROWS):
                part = batch.slice(begin, TREE_ROWS)
                points = _matrix(part.column("point"), dim)
                order, nodes, sums = build(points)
                ids = pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), part.column("id").take(pa.array(order)))
                columns = [ids, _flat(points[order].astype(np.int32)), *(_flat(nodes[n]) for n in _NODES), _flat(sums)]
                yield pa.record_batch(columns, names=["ids", "points", *_NODES, "sums"])

    return run


def _trees(batches: Iterator[pa.RecordBatch], dim: int):
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda name, kind, k=k, batch=batch: np.frombuffer(batch.column(name)[k].as_buffer(), dtype=kind)
            yield (lambda k=k, batch=batch: batch.column("ids").slice(k, 1).flatten()), get("points", np.int32).reshape(-1, dim), {n: get(n, kind) for n, kind in _NODES.items()}, get("sums", np.int64).reshape(-1, dim)


def _moved(centroids: np.ndarray):
    """Counts and sums of what each centroid gets in a task."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for _, points, nodes, sums in _trees(batches, dim):
            balls, owners, leaves = walk(nodes, sums, centroids)
            np.add.at(counts, owners, (nodes["end"] - nodes["begin"])[balls])
            np.add.at(totals, owners, sums[balls])
            if len(leaves):
                own = points[_ranges(nodes["begin"][leaves], nodes["end"][leaves])].astype(np.int64)
                to = squares(own, centroids).argmin(axis=1)  # the first of equal ones
                counts += np.bincount(to, minlength=k)
                np.add.at(totals, to, own)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32) * dim), pa.array(totals.reshape(-1)))
        yield pa.record_batch([pa.array(np.arange(k, dtype=np.int32)), pa.array(counts), lists], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, points, nodes, sums in _trees(batches, dim):
            balls, owners, leaves = walk(nodes, sums, centroids)
            to = np.full(len(points), -1, dtype=np.int64)
            begin, end = nodes["begin"][balls], nodes["end"][balls]
            to[_ranges(begin, end)] = np.repeat(owners, end - begin)
            rest = _ranges(nodes["begin"][leaves], nodes["end"][leaves])
            to[rest] = squares(points[rest].astype(np.int64), centroids).argmin(axis=1)
            distance = ((points.astype(np.int64) - centroids[to]) ** 2).sum(axis=1)
            yield pa.record_batch([ids(), pa.array(to.astype(np.int32)), pa.array(distance)], names=["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int, rounds: int, seed: int, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of each kept vector, the final centroids).

    Components count as floor(scale * x).  Centroids start as the k vectors of
    least sha256 of "seed:id" and move rounds times.
    """
    shelf = Shelf(vectors.sparkSession)
    id_type = vectors.schema[id_col].dataType.simpleString()
    kept = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(finite("vector") & (F.size("vector") == dim) & F.forall("vector", lambda x: F.abs(x) <= LIMIT // scale))
    kept = kept.select("id", integers("vector", scale).alias("point"))
    schema = f"ids array<{id_type}>, points binary, begin binary, end binary, left binary, radius binary, sums binary"
    trees = shelf.put(kept.mapInArrow(_plant(dim), schema), "trees")
    name = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), F.lit("g"))  # g: after all hex digits
    first = kept.orderBy(name, "point").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], f"id {id_type}, cluster int, distance long"), []
    centroids = np.array([r["point"] for r in first], dtype=np.int64)
    sums = [F.sum(F.col("sums")[j].cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]
    for _ in range(rounds):
        moved = trees.select("points", *_NODES, "sums").mapInArrow(_moved(centroids), "cluster int, n long, sums array<long>")
        centroids = centroids.copy()
        for row in moved.groupBy("cluster").agg(F.sum("n").alias("n"), *sums).where("n > 0").collect():  # k rows
            centroids[row["cluster"]] = [int(row[f"s{j}"]) // row["n"] for j in range(dim)]
    return trees.mapInArrow(_assigned(centroids), f"id {id_type}, cluster int, distance long"), centroids.tolist()


def digest(assigned: DataFrame, centroids: list[list[int]], shelf: Shelf) -> DataFrame:
    """Each vector with the inertia of its cluster and of all, and a hash of its centroid."""
    assigned = shelf.put(assigned, "assigned")
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    hashes = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    told = own.join(assigned.sparkSession.createDataFrame(hashes, "cluster int, centroid_sha256 string"), "cluster")
    told = told.crossJoin(own.agg(F.sum("cluster_inertia").alias("inertia")))  # k rows and one row
    return assigned.withColumnRenamed("id", "vec_id").join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
