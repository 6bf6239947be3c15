"""Fact tables derived from the star schema that the driver provides."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has made; results may still read them until they are written elsewhere.
_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares (spark.checkpoint.dir); where that is unset, one machine takes a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    _made.append(folder := f"{base.rstrip('/')}/ventus-own-{uuid.uuid4().hex}")
    return folder


def clear(spark: SparkSession) -> None:
    """Removes all folders that shared_folder has given; for when results have been written."""
    fs = spark._jvm.org.apache.hadoop.fs
    while _made:
        path = fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes a core should have before work on rows is worth more tasks.
SPREAD_BYTES = 16 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table that is too small for a task a core by its bytes, dealt over all cores; for costly work on each row. Others stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * SPREAD_BYTES else table


def geo_facts(spark: SparkSession, sf_dir: str, mixed: bool = False) -> DataFrame:
    """Orders as facts: region, nation, segment and a district number; balance stands for population.

    mixed: every seventh order is a row of its country, every eleventh one of
    its state, so that places have rows of their own level beside deeper ones.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")  # 25 and 5 rows at every scale
    places = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    state, district = F.col("c_mktsegment"), F.concat(F.lit("D"), (F.col("c_custkey") % 10).cast("string"))
    if mixed:
        country_row, state_row = F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 11 == 0
        state, district = F.when(~country_row, state), F.when(~country_row & ~state_row, district)
    null = F.lit(None).cast("double")
    return rows.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("country"), state.alias("state"), district.alias("district"), F.year("o_orderdate").alias("year"),
        (F.col("o_totalprice") / 9973).alias("pm25"), null.alias("llpp"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") / 99991).alias("llpp_who"), null.alias("llpp_national"),
        F.col("c_acctbal").alias("population"), F.lit(5.0).alias("who_standard"), F.when(F.col("r_regionkey") > 0, 10.0 + 5 * F.col("r_regionkey")).alias("national_standard"),
        F.lit("gadm2").alias("csv_level"), F.lit("orders").alias("source_file"), F.col("o_orderkey").alias("seq"),
    )


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by supplier nation, with the always positive quantity as population."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    places = F.broadcast(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    rows = items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    null, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    return rows.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("country"), text.alias("state"), text.alias("district"), F.year("l_shipdate").alias("year"),
        (F.col("l_extendedprice") / 997).alias("pm25"), null.alias("llpp"), null.alias("llpp_who"), null.alias("llpp_national"), F.col("l_quantity").alias("population"),
        F.lit(5.0).alias("who_standard"), F.lit(35.0).alias("national_standard"), F.lit("gadm0").alias("csv_level"), F.lit("lineitem").alias("source_file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
