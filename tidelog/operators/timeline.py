"""Operators along the log's order: grouping, barriers, lag, gaps, admission, rates, history.

`by` splits the log into independent streams (a task, a source id); windows run inside one stream.
Where a running sum over one long stream is needed, it is made in two levels: sums of fixed ranges of
the order first, then within each range, so that no task gets the whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, value: Column, order: str | list[str], name: str, width: int, inclusive: bool = True) -> DataFrame:
    """`rows` with the sum of `value` over all rows up to each one, by `order`, whose first column is a long.

    Ranges of `width` of that column are summed up first; their sums, few, are run over once.
    """
    order = [order] if isinstance(order, str) else order
    ranged = rows.withColumn("_range", F.floor(F.col(order[0]) / width)).withColumn("_value", value)
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    over_ranges = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", F.coalesce(F.sum("_total").over(over_ranges), F.lit(0)).alias("_sum_before"))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranged.join(before, "_range").withColumn(name, F.col("_sum_before") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return out.drop("_range", "_value", "_sum_before")


def transaction_groups(log: DataFrame, width: int = 1 << 16, order: str = "seq") -> DataFrame:
    """`log` with `txn_group`: commits between two barriers (DDL, other events) are one group."""
    barrier = F.col("kind").isin("ddl", "other").cast("long")
    return running(log, barrier, order, "txn_group", width)


def schema_versions(log: DataFrame, width: int = 1 << 16, order: str = "seq") -> DataFrame:
    """`log` with `schema_version`: the number of DDL events before each event."""
    return running(log, (F.col("kind") == "ddl").cast("long"), order, "schema_version", width, inclusive=False)


def until(log: DataFrame, stop: int, order: str = "seq") -> DataFrame:
    """The whole transactions that begin at or before a stop position."""
    begun = log.filter(F.col(order) <= stop).select("txn_id").distinct()
    return log.join(begun, "txn_id", "left_semi")


def without_empty(log: DataFrame) -> DataFrame:
    """`log` without transactions that have no row event."""
    return log.join(log.filter("kind = 'row'").select("txn_id").distinct(), "txn_id", "left_semi")


def lag_by(log: DataFrame, by: list[str], event_time: str, seen_time: Column) -> DataFrame:
    """Largest and mean seconds between events and when they were seen, by group."""
    seconds = F.unix_timestamp(seen_time) - F.unix_timestamp(F.col(event_time).cast("timestamp"))
    return log.groupBy(*by).agg(F.max(seconds).alias("max_lag"), F.min(seconds).alias("min_lag"), F.count(F.lit(1)).alias("events"))


def numbered(rows: DataFrame, by: list[str], order: str, name: str, width: int) -> DataFrame:
    """`rows` with their number, from 1, within `by` by the long column `order`; in two levels."""
    ranged = rows.withColumn("_range", F.floor(F.col(order) / width))
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select(*by, "_range", F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(order))
    return _beside(ranged, before, by).withColumn(name, F.col("_before") + own).drop("_range", "_before")


def _beside(rows: DataFrame, of_ranges: DataFrame, by: list[str]) -> DataFrame:
    """`rows` with what `of_ranges` says of their range; a null group is a group."""
    renamed = of_ranges.withColumnsRenamed({c: f"_r_{c}" for c in (*by, "_range")})
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by]
    on = F.col("_range") == F.col("_r__range")
    for c in same:
        on = on & c
    return rows.join(renamed, on).drop(*(f"_r_{c}" for c in (*by, "_range")))


def heartbeats(log: DataFrame, by: list[str], event_time: str, order: str, every_us: int, width_us: int = 3_600_000_000) -> DataFrame:
    """(by, order, gap_us, beats): silences longer than a beat, and how many beats they had.

    Events are compared within ranges of time; a range's first one with the last of the range before."""
    at = F.unix_micros(F.col(event_time).cast("timestamp"))
    ranged = log.select(*by, order, at.alias("_at")).withColumn("_range", F.floor(F.col("_at") / width_us))
    lasts = ranged.groupBy(*by, "_range").agg(F.max("_at").alias("_last"))
    carried = lasts.select(*by, "_range", F.lag("_last").over(Window.partitionBy(*by).orderBy("_range")).alias("_carried"))
    within = F.lag("_at").over(Window.partitionBy(*by, "_range").orderBy("_at", order))
    gap = F.col("_at") - F.coalesce(within, "_carried")
    out = _beside(ranged, carried, by).select(*by, order, gap.alias("gap_us")).filter(F.col("gap_us") > every_us)
    return out.withColumn("beats", F.floor(F.col("gap_us") / every_us))


def admitted(log: DataFrame, by: list[str], order: str, rate: int, burst: int, arrival_us: str | None = None, width: int = 1 << 16) -> DataFrame:
    """`log` with `admit_second`, or with `arrival_us` `admit_us`: when a bucket of `burst` tokens,
    refilled `rate` a second, lets each event in. Without arrivals all wait from the start.

    Event n is let in when it is there and n + 1 - burst tokens came since any earlier event arrived
    that found the bucket full: the greatest of these is a running maximum, found in two levels."""
    placed = numbered(log, by, order, "_n", width)
    if arrival_us is None:
        return placed.withColumn("admit_second", F.greatest(F.lit(0), F.ceil((F.col("_n") - burst) / rate)).cast("long")).drop("_n")
    # In millionths of a token: what the bucket had over when this event came.
    ranged = placed.withColumn("_over", F.col(arrival_us) * rate - F.col("_n") * 1_000_000).withColumn("_range", F.floor(F.col(order) / width))
    most = ranged.groupBy(*by, "_range").agg(F.max("_over").alias("_most"))
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = most.select(*by, "_range", F.max("_most").over(along).alias("_before"))
    within = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    due = F.greatest(F.max("_over").over(within), "_before") + (F.col("_n") + 1 - burst) * 1_000_000
    out = _beside(ranged, before, by).withColumn("admit_us", F.greatest(F.col(arrival_us), F.ceil(due / rate)).cast("long"))
    return out.drop("_n", "_over", "_range", "_before")


def rates(samples: DataFrame, by: list[str], order: str, value: str, depth: int, width: int = 1 << 16) -> DataFrame:
    """`samples` with `rate`: change of a counter per step over a ring of the last `depth` samples.

    Samples are numbered in two levels and dealt into blocks; each block also gets the `depth` before it."""
    width = max(width, depth)
    placed = numbered(samples, by, order, "_n", width).withColumn("_block", F.floor(F.col("_n") / width))
    blocks = F.array_distinct(F.array("_block", F.floor((F.col("_n") + depth) / width)))
    copies = placed.withColumn("_in", F.explode(blocks))
    w = Window.partitionBy(*by, "_in").orderBy("_n")
    steps = F.least(F.col("_n") - 1, F.lit(depth))
    oldest = F.first(value).over(w.rowsBetween(-depth, 0))
    rated = copies.withColumn("rate", F.when(steps > 0, (F.col(value) - oldest).cast("double") / steps))
    return rated.filter(F.col("_in") == F.col("_block")).drop("_n", "_block", "_in")


def history(records: DataFrame, by: list[str], order: str, value: str, depth: int = 3) -> DataFrame:
    """The last `depth` records of each group, newest first as `age` 1, 2, ...; equal neighbours count once."""
    w = Window.partitionBy(*by).orderBy(order)
    changed = records.withColumn("_same", F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1)).filter("not _same").drop("_same")
    newest = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return changed.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= depth)
