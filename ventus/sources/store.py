"""The store's tables: appends, updates and their rules, as projections over snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("processing", "active", "inactive", "error")
MODES = ("agent", "human")
ROLES = ("user", "assistant", "human", "system")


def valid(column: str, allowed: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*allowed), F.lit(False))


def merged_metadata(base: Column, later: Column) -> Column:
    """Two maps as one; later keys win."""
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(later), k))
    return F.coalesce(F.map_concat(kept, later), base, later)


def with_status(sources: DataFrame, source_id: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"no such status: {status}")
    hit = F.col("id") == source_id
    return sources.withColumn("status", F.when(hit, status).otherwise(F.col("status"))).withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")))


def with_names(conversations: DataFrame, contacts: DataFrame) -> DataFrame:
    """Names filled in where there is none yet."""
    known = contacts.where("name is not null").groupBy("phone").agg(F.min("name").alias("_name"))
    return conversations.join(known, "phone", "left").withColumn("name", F.coalesce("name", "_name")).drop("_name")


def read_by_person(conversations: DataFrame, conv_id: str) -> DataFrame:
    return conversations.withColumn("unread_count", F.when(F.col("id") == conv_id, 0).otherwise(F.col("unread_count")))


def manual_reply(messages: DataFrame, conv_id: str, text: str) -> DataFrame:
    """Messages with a person's reply appended; blank replies are refused."""
    if not text.strip():
        raise ValueError("a reply needs text")
    row = messages.sparkSession.createDataFrame([(conv_id, "human", text.strip(), "dashboard")], "conversation_id string, role string, content string, source string")
    return messages.unionByName(row.withColumn("created_at", F.current_timestamp()), allowMissingColumns=True)


def replied(conversations: DataFrame, replies: DataFrame) -> DataFrame:
    """The rows of conversations (id, last_message, updated_at, ...) that persons' replies (id, text, at) change, as they are afterwards.

    Blank replies change nothing, nor do replies to no conversation; of several
    to one the latest is its last message.  The rows are for ``changes.upsert``.
    """
    said = replies.where(F.trim("text") != "").groupBy("id").agg(F.max(F.struct("at", F.trim("text").alias("text"))).alias("_said"))
    rows = conversations.join(said, "id").withColumns({"last_message": F.col("_said.text"), "updated_at": F.greatest("updated_at", F.col("_said.at"))})
    return rows.select(*conversations.columns)


def promote(chunks: DataFrame, source_id: str, path: str) -> bool:
    """Writes a source's chunks all or not at all.

    They go to a staging folder; once complete, the source's own is set aside,
    the new one takes its place, and only then the old one is removed.  If the
    place can't be taken the old folder is put back.
    """
    spark = chunks.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    staging, aside, final = (hadoop.Path(f"{path}/{x}") for x in (f"_staging/{source_id}", f"_aside/{source_id}", f"source_id={source_id}"))
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(final):  # an earlier run was lost between its two renames
        fs.rename(aside, final)
    try:
        chunks.drop("source_id").write.mode("overwrite").parquet(staging.toString())
        if spark.read.parquet(staging.toString()).isEmpty():
            return False
        fs.delete(aside, True)
        fs.mkdirs(aside.getParent())
        fs.mkdirs(final.getParent())
        if fs.exists(final) and not fs.rename(final, aside):
            return False
        if not fs.rename(staging, final):
            fs.rename(aside, final)
            return False
        fs.delete(aside, True)
        return True
    finally:
        fs.delete(staging, True)


def reprocessed(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_id, status): active if all chunks of a source have what they should, and there is one; else error."""
    done = chunks.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("structured") | F.col("embedding").isNotNull()).alias("ok"))
    return expected.select("source_id").join(done, "source_id", "left").select("source_id", F.when((F.coalesce("n", F.lit(0)) > 0) & (F.col("n") == F.col("ok")), "active").otherwise("error").alias("status"))
