"""Connected components of a graph that is given as a table of links.

Alternating large-star and small-star steps (Kiveris and others, 2014): each
is one pre-aggregated minimum and one join, links never gather in one task,
and nothing but two numbers a round reaches the driver.  Rounds are written to
the shared folder, and earlier ones are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ventus.llm.shelf import Shelf


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node")
    moved = links.join(least, F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct()


def components(links: DataFrame, shelf: Shelf, name: str = "components") -> DataFrame:
    """(node, component) for each node that has a link; component is the least node reachable.

    links: columns a and b (long); direction, repeats, loops and nulls don't
    matter.  An empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen, k = shelf.put(links, f"{name}-0"), None, 0
    while True:
        k += 1
        now = shelf.put(_small_star(_large_star(now)), f"{name}-{k}")
        shelf.drop(f"{name}-{k - 1}")
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
