"""Tables that change: differences of snapshots as a feed of events, and changed partitions merged by copy and rename.

A feed keeps snapshots and events by version.  A version's snapshot is written
first and its events last; it counts once the events are complete.  A run
that is lost before is done again from the last version that counts, over the same folders,
so events are neither lost nor doubled, and a stream reads each once.

Rows are told apart by their keys (null is a key like others) and compared by a digest of their
other columns, so that of the older snapshot only keys and digests are
exchanged.  Of rows of one key the one of the least digest counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INSERT, UPDATE, DELETE = "insert", "update", "delete"


def _matches(keys: Sequence[str], other: str) -> Column:
    """Keys equal to those of another table's columns, of which other is the beginning; nulls are equal."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys])


def _single(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _digest, _row): one row a key."""
    others = [c for c in table.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("_"))
    rows = table.select(*keys, F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256).alias("_digest"), row.alias("_row"))
    return rows.groupBy(*keys).agg(F.min_by(F.struct("_digest", "_row"), "_digest").alias("_s")).select(*keys, "_s.*")


def differences(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(op, keys, other columns): what turns one table into another; other columns are null in rows that are deleted."""
    old = _single(before.select(*after.columns), keys).select(*(F.col(k).alias(f"_old_{k}") for k in keys), F.col("_digest").alias("_old"))
    new = _single(after, keys)
    both = new.join(old, _matches(keys, "_old_"), "full_outer").where("_old is null or _digest is null or _old <> _digest")
    op = F.when(F.col("_old").isNull(), INSERT).when(F.col("_digest").isNull(), DELETE).otherwise(UPDATE)
    named = [F.when(F.col("_digest").isNull(), F.col(f"_old_{k}")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.select(op.alias("op"), *named, *(F.col(f"_row.`{c}`").alias(c) for c in after.columns if c not in keys))


def applied(table: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A table after the events of one version."""
    touched = events.select(*(F.col(k).alias(f"_k_{k}") for k in keys))
    return table.join(touched, _matches(keys, "_k_"), "left_anti").unionByName(events.where(F.col("op") != DELETE).select(*table.columns))


class _Files:
    def __init__(self, spark: SparkSession, folder: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [x.getPath().getName() for x in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.path(path))

    def move(self, a: str, b: str) -> bool:
        self.fs.mkdirs(self.path(b).getParent())
        return self.fs.rename(self.path(a), self.path(b))

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


class Feed:
    """Events of a table's changes under a folder, a version for each snapshot that differs from the last."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str]):
        self.spark, self.folder, self.keys, self._files = spark, folder.rstrip("/"), list(keys), _Files(spark, folder)

    def last(self) -> int:
        """The last version whose events are complete; -1 for none."""
        found = [int(n.partition("=")[2]) for n in self._files.names(f"{self.folder}/events") if n.startswith("version=")]
        return max((k for k in found if self._files.exists(f"{self.folder}/events/version={k}/_SUCCESS")), default=-1)

    def publish(self, table: DataFrame) -> int:
        """Writes what has changed since the last version; gives the version of the table."""
        k = self.last()
        at = lambda n: f"{self.folder}/snapshots/version={n}"
        table.write.mode("overwrite").parquet(at(k + 1))
        now = self.spark.read.schema(table.schema).parquet(at(k + 1))
        before = self.spark.read.schema(table.schema).parquet(at(k)) if k >= 0 else now.limit(0)
        events = differences(before, now, self.keys)
        if k >= 0 and events.isEmpty():
            return k
        events.write.mode("overwrite").parquet(f"{self.folder}/events/version={k + 1}")
        self._files.delete(at(k - 1))
        return k + 1

    def stream(self, schema) -> DataFrame:
        """The events as a stream, with their version; schema is that of the table."""
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        return self.spark.readStream.schema(f"op string, {fields}, version int").parquet(f"{self.folder}/events")


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert(path: str, rows: DataFrame, keys: Sequence[str], buckets: int = 64) -> int:
    """Merges rows into the table at path by their keys; gives the number of buckets rewritten.

    The table lies in buckets of keys.  Only buckets with new rows are read and
    written anew, in a staging folder; then each takes its place by two renames,
    and one that a lost run has set aside is put back first.  The same rows
    merged again change nothing.  Of rows of one key any one counts; other
    columns than the table's are refused.
    """
    spark = rows.sparkSession
    path, files = path.rstrip("/"), _Files(spark, path)
    place, aside, staging = (lambda k, x=x: f"{path}{x}/bucket={k}" for x in ("", "/_aside", "/_staging"))
    for name in files.names(f"{path}/_aside"):
        k = name.partition("=")[2]
        if not files.exists(place(k)):
            files.move(aside(k), place(k))
        files.delete(aside(k))
    rows = rows.dropDuplicates(list(keys)).withColumn("bucket", bucket_of(keys, buckets))
    rows.write.mode("overwrite").parquet(f"{path}/_new")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/_new")
    changed = sorted(r[0] for r in rows.select("bucket").distinct().collect())  # as many as there are buckets at most
    there = [k for k in changed if files.exists(place(k))]
    merged = rows
    if there:
        old = spark.read.option("basePath", path).parquet(*[place(k) for k in there])
        if set(old.columns) != set(rows.columns):
            raise ValueError("the rows have other columns than the table")
        touched = rows.select(*(F.col(k).alias(f"_k_{k}") for k in keys))
        merged = old.join(touched, _matches(keys, "_k_"), "left_anti").unionByName(rows)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/_staging")
    for k in changed:
        if files.exists(place(k)) and not files.move(place(k), aside(k)):
            raise OSError(f"bucket {k} can't be set aside")
        if not files.move(staging(k), place(k)):
            files.move(aside(k), place(k))
            raise OSError(f"bucket {k} can't be put in place")
        files.delete(aside(k))
    files.delete(f"{path}/_staging")
    files.delete(f"{path}/_new")
    return len(changed)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """The table that upsert keeps."""
    return spark.read.parquet(path.rstrip("/")).drop("bucket")
