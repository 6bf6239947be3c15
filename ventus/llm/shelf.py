"""Intermediate tables in the folder that the cluster shares.

The folder is spark.checkpoint.dir of the session.  Where that is unset a
session on one machine (as in tests) takes a temporary folder, and any other
is refused.  A table written there survives lost executors and cuts the
lineage of what follows.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Shelf:
    #: Folders that this process has made; results may still read them until they are written elsewhere.
    made: list[str] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            base = os.path.join(tempfile.gettempdir(), "checkpoints")  # one machine: its folder is shared
        self.root = f"{base.rstrip('/')}/ventus-{uuid.uuid4().hex}"
        Shelf.made.append(self.root)

    def put(self, df: DataFrame, name: str, large: bool = False) -> DataFrame:
        """Writes df and returns what was written; large: exchanges made on the way are given back at once."""
        df.write.mode("overwrite").parquet(path := f"{self.root}/{name}")
        if large:  # Spark removes the files of exchanges that no plan refers to any more, once it learns of it
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Removes all that was put on shelves; for when results have been written."""
    fs = spark._jvm.org.apache.hadoop.fs
    while Shelf.made:
        path = fs.Path(Shelf.made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
