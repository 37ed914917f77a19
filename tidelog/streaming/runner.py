"""Structured Streaming over a changelog: what a batch run gives, micro-batch by micro-batch.

Each micro-batch is reduced to its share of the state, one row per key or group, and written under
its batch id; writing it again after a failure replaces it, so a replayed batch changes nothing. A share
costs what its batch holds, not what the state holds. Shares are merged in levels: `compact_every` of a
level become one of the next, so a row is written again once a level, and not at each compaction.
Shares carry the log's order, so neither file order nor batch boundaries matter.

Rows that break the log's contract go to `dead_letters`, with the reason; nothing is skipped silently.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.incremental import merged, partial, shown
from tidelog.operators.state import keyed, latest
from tidelog.plans.table_plan import TablePlan
from tidelog.streaming.folders import Folder


@dataclass(frozen=True)
class Fold:
    """How a batch becomes a share, how shares become one, and how the result is read."""

    share: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    view: Callable[[DataFrame], DataFrame]


def fold_of(plan: TablePlan) -> Fold:
    if plan.mode == "on_dup":
        return Fold(lambda d: partial(plan, plan.changes(d)), lambda d: merged(plan, d), lambda d: shown(plan, d))
    if plan.mode == "ignore":
        first = lambda d: d.groupBy("_key").agg(F.min("_at").alias("_at"), F.min_by("_row", "_at").alias("_row"))
        entries = lambda d: keyed(plan.changes(d).filter(F.col("after").isNotNull()).withColumn("before", F.lit(None).cast(plan.changes(d).schema["before"].dataType)), plan.key)
        return Fold(lambda d: first(entries(d)), first, lambda d: d.select("_row.*"))
    return Fold(lambda d: latest(keyed(plan.changes(d), plan.key)), latest, lambda d: d.filter(F.col("_row").isNotNull()).select("_row.*"))


def fault(plan: TablePlan) -> F.Column:
    """Why a row event cannot be applied; null if it can.

    Rows of a table with a key need all the columns that the key is made from; a null group is a group."""
    needed = plan.key_references if plan.mode == "normal" and plan.declared else ()
    out = F.when(F.col("seq").isNull(), "no position in the log").when(F.col("before").isNull() & F.col("after").isNull(), "partial row image")
    for image in ("before", "after"):
        for c in needed:
            out = out.when(F.col(image).isNotNull() & F.col(f"`{image}`.`{c}`").isNull(), "no key")
    return out


class Runner:
    """A plan's fold over a stream of changelog files, with its shares, checkpoint and dead letters in a folder."""

    def __init__(self, spark: SparkSession, folder: Folder, plan: TablePlan, compact_every: int = 16) -> None:
        self.spark, self.folder, self.plan, self.fold, self.compact_every = spark, folder, plan, fold_of(plan), compact_every

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        marked = self.plan.mine(batch).withColumn("fault", fault(self.plan)).persist()
        try:
            self._write(self.fold.share(marked.filter("fault is null").drop("fault")), 0, batch_id)
            bad = marked.filter("fault is not null")
            if not bad.isEmpty():
                bad.write.mode("overwrite").parquet(self.folder.at(f"dead_letters/{batch_id:09d}"))
        finally:
            marked.unpersist()
        self.compact(batch_id)

    def _write(self, rows: DataFrame, level: int, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(self.folder.at(f"shares/{level:02d}/{batch_id:09d}"))

    def _live(self) -> list[tuple[int, int]]:
        """(level, last batch) of the finished shares that no finished share of a higher level holds."""
        out: list[tuple[int, int]] = []
        for level in reversed(self.folder.names("shares")):
            for name in self.folder.names(f"shares/{level}"):
                if self.folder.exists(f"shares/{level}/{name}/_SUCCESS") and not any(b - self.compact_every**k < int(name) <= b for k, b in out if k > int(level)):
                    out.append((int(level), int(name)))
        return out

    def _paths(self, shares: list[tuple[int, int]]) -> list[str]:
        return [f"shares/{level:02d}/{batch:09d}" for level, batch in shares]

    def compact(self, batch_id: int) -> None:
        """Makes one share of every `compact_every` of a level, as far up as a batch completes them."""
        n, level = self.compact_every, 0
        while (batch_id + 1) % n ** (level + 1) == 0:
            parts = [(k, b) for k, b in self._live() if k <= level and batch_id - n ** (level + 1) < b <= batch_id]
            level += 1
            if parts:
                self._write(self.fold.merge(self.spark.read.parquet(*map(self.folder.at, self._paths(parts)))), level, batch_id)
                for path in self._paths(parts):
                    self.folder.delete(path)

    def state(self) -> DataFrame:
        live = self._live()
        if not live:
            raise ValueError("no batch has been applied yet")
        return self.fold.view(self.fold.merge(self.spark.read.parquet(*map(self.folder.at, self._paths(live)))))

    def dead_letters(self) -> DataFrame | None:
        names = self.folder.names("dead_letters")
        return self.spark.read.parquet(*(self.folder.at(f"dead_letters/{n}") for n in names)) if names else None

    def run(self, source: str, schema, files_per_batch: int = 1, stop: int | None = None) -> None:
        """All files that are there, in batches; ends when they are done. The transaction that holds the
        position `stop` is the last one taken, as a whole."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
        if stop is not None:
            rows = self.spark.read.schema(schema).parquet(source)
            last = rows.filter(F.col("seq") <= stop).agg(F.max_by("txn_id", "seq").alias("t")).first()["t"]
            end = rows.filter(F.col("txn_id") == F.lit(last)).agg(F.max("seq").alias("s")).first()["s"]
            stream = stream.filter(F.col("seq") <= (stop if end is None else end))
        written = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", self.folder.at("checkpoint"))
        written.trigger(availableNow=True).start().awaitTermination()


def in_files(rows: DataFrame, path: str, files: int, order: str = "seq") -> None:
    """`rows` as `files` Parquet files, by ranges of the order: a source to stream from.

    Streams take files by age, so the files get ages in the order's order, whichever was written first."""
    rows.repartitionByRange(files, order).write.mode("append").parquet(path)
    Folder(rows.sparkSession, path).aged()


def run_to_state(spark: SparkSession, log: DataFrame, plan: TablePlan, files: int) -> DataFrame:
    """A changelog streamed from files, and the state it leaves."""
    folder = Folder.fresh(spark, "stream")
    in_files(log, folder.at("source"), files)
    runner = Runner(spark, folder, plan, compact_every=3)
    runner.run(folder.at("source"), log.schema)
    return runner.state()


def run_windows(spark: SparkSession, events: DataFrame, time: str, by: list[str], width: str, files: int) -> DataFrame:
    """(by, began, events): counts in tumbling windows over a stream of event files.

    Naive times are cast, for watermarks need an instant. A batch writes only the windows that it
    changed, and those behind the watermark leave the state; a window's last count is the result.
    """
    folder = Folder.fresh(spark, "windows")
    in_files(events, folder.at("source"), files, time)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder.at("source"))
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", "1 hour")
    counted = timed.groupBy(*by, F.window("_t", width).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(*by, F.unix_timestamp("w.start").alias("began"), "events")
    keep = lambda d, n: d.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(folder.at(f"out/{n:09d}"))
    counted.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", folder.at("checkpoint")).trigger(availableNow=True).start().awaitTermination()
    written = spark.read.parquet(*(folder.at(f"out/{n}") for n in folder.names("out")))
    return written.groupBy(*by, "began").agg(F.max_by("events", "_batch").alias("events"))
