"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where the master is local."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir names no folder, and executors share no temporary one")
    return f"file://{tempfile.gettempdir()}/tables"


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Tables:
    """Tables written below the shared folder and read again: their lineage is cut, and a lost executor
    costs none of them. `clear` deletes what has served its turn."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[int, str] = {}
        self.held: dict[int, DataFrame] = {}
        self.counts: dict[int, int] = {}

    def store(self, df: DataFrame, tasks: int | None = None) -> DataFrame:
        """`df`, written by at most so many tasks: few rows in many partitions cost more to start than to write."""
        df = df.coalesce(tasks) if tasks else df
        path = f"{shared_folder(self.spark)}/{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        self.paths[id(out)], self.held[id(out)] = path, out
        return out

    def count(self, df: DataFrame) -> int:
        """The rows of one of these tables, counted once."""
        if id(df) not in self.paths:
            return df.count()
        if id(df) not in self.counts:
            self.counts[id(df)] = df.count()
        return self.counts[id(df)]

    def clear(self, *keep: DataFrame) -> None:
        """Deletes all of these tables but `keep`; only where no lazy result reads them."""
        for k in [k for k in self.paths if all(k != id(df) for df in keep)]:
            dropped(self.spark, self.paths.pop(k))
            self.counts.pop(k, None)
            del self.held[k]
