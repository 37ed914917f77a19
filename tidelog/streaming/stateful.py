"""A custom stateful operator: changes and last position of each key, kept across micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.streaming.folders import Folder
from tidelog.streaming.runner import in_files


def counted(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's new rows folded into its (changes, last position)."""
    changes, last = state.get if state.exists else (0, -1)
    for p in parts:
        changes += len(p)
        last = max(last, int(p["seq"].max()))
    state.update((changes, last))
    yield pd.DataFrame({"key": [key[0]], "changes": [changes], "last_seq": [last]})


def run_counts(spark: SparkSession, rows: DataFrame, key: str, files: int) -> DataFrame:
    """(key, changes, last_seq) after all rows, streamed from files."""
    folder = Folder.fresh(spark, "counts")
    in_files(rows, folder.at("source"), files)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder.at("source"))
    kept = stream.groupBy(key).applyInPandasWithState(counted, "key long, changes long, last_seq long", "changes long, last_seq long", "update", GroupStateTimeout.NoTimeout)
    write = lambda d, n: d.write.mode("overwrite").parquet(folder.at(f"out/{n:09d}"))
    kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", folder.at("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.parquet(*(folder.at(f"out/{n}") for n in folder.names("out")))
    return every.groupBy(F.col("key").alias(key)).agg(F.max("changes").alias("changes"), F.max("last_seq").alias("last_seq"))
