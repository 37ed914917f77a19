"""Counters, gauges and histograms over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of the timing buckets, in nanoseconds; fixed values.
CUTOFFS = (500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000, 100_000_000, 500_000_000, 1_000_000_000, 5_000_000_000, 10_000_000_000)


def bucket(value: Column, cutoffs: tuple[int, ...] = CUTOFFS) -> Column:
    """The first bound that is not below the value, as text; `inf` beyond the last."""
    out = F.lit("inf")
    for c in reversed(cutoffs):
        out = F.when(value <= c, str(c)).otherwise(out)
    return out


def histogram(events: DataFrame, by: list[str], value: Column, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(by, bucket, events, total): how many values lie in each bucket, and their sum."""
    return events.groupBy(*by, bucket(value, cutoffs).alias("bucket")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    """(labels, count): a counter of several labels, with the totals of its first label and of all."""
    grouped = events.rollup(*labels).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("level"))
    return grouped.select(*labels, "count", "level")


def gauge(events: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The last value of each group."""
    return events.groupBy(*by).agg(F.max_by(value, order).alias(value))


def counter_rates(events: DataFrame, by: list[str], second: Column, width: int) -> DataFrame:
    """(by, slot, events, per_second): events in slots of `width` seconds."""
    return events.groupBy(*by, F.floor(second / width).alias("slot")).agg(F.count(F.lit(1)).alias("events")).withColumn("per_second", F.col("events") / F.lit(float(width)))
