"""Replication positions as tables of intervals: (set_id, sid, start, end), ends inclusive.

A position is a partially ordered set of transactions, not a number. Unions are gaps and islands over
sorted intervals; containment and difference are interval arithmetic, never lists of single
transactions. Windows run per (set, source id), whose intervals are as many as the gaps in it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def valid(intervals: DataFrame) -> DataFrame:
    """Without reversed intervals, which mean nothing."""
    return intervals.filter(F.col("end") >= F.col("start"))


def coalesced(intervals: DataFrame) -> DataFrame:
    """Adjacent and overlapping intervals made one."""
    by_sid = Window.partitionBy("set_id", "sid").orderBy("start", "end")
    reach = F.max("end").over(by_sid.rowsBetween(Window.unboundedPreceding, -1))
    opened = valid(intervals).withColumn("opens", (reach.isNull() | (F.col("start") > reach + 1)).cast("int"))
    island = opened.withColumn("island", F.sum("opens").over(by_sid.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy("set_id", "sid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def union(left: DataFrame, right: DataFrame, set_id: str = "union") -> DataFrame:
    return coalesced(left.unionByName(right).withColumn("set_id", F.lit(set_id)))


def intersection(left: DataFrame, right: DataFrame, set_id: str = "intersection") -> DataFrame:
    a, b = coalesced(left).alias("a"), coalesced(right).alias("b")
    both = a.join(b, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end")))
    return both.select(
        F.lit(set_id).alias("set_id"), F.col("a.sid").alias("sid"), F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end")
    )


def difference(left: DataFrame, right: DataFrame, set_id: str = "difference") -> DataFrame:
    """What of `left` is not in `right`: the gaps between the parts that both have."""
    a = coalesced(left).select("sid", F.col("start").alias("lo"), F.col("end").alias("hi"))
    common = intersection(left, right).select("sid", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    inside = a.join(common, "sid", "left").filter(F.col("c_start").isNull() | ((F.col("c_start") >= F.col("lo")) & (F.col("c_end") <= F.col("hi"))))
    # An interval of `left` none of which is common is kept by the left join below.
    cut = a.join(inside.filter("c_start is not null"), ["sid", "lo", "hi"], "left")
    within = Window.partitionBy("sid", "lo", "hi").orderBy("c_start")
    begin = F.coalesce(F.lag("c_end").over(within) + 1, F.col("lo"))
    gaps = cut.select("sid", begin.alias("start"), F.coalesce(F.col("c_start") - 1, F.col("hi")).alias("end"))
    tails = cut.groupBy("sid", "lo", "hi").agg(F.max("c_end").alias("c_end")).filter("c_end is not null").select("sid", (F.col("c_end") + 1).alias("start"), F.col("hi").alias("end"))
    return valid(gaps.unionByName(tails)).select(F.lit(set_id).alias("set_id"), "sid", "start", "end")


def contains(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """One row (contains): whether every transaction of `inner` is in `outer`."""
    a, b = coalesced(outer).alias("a"), coalesced(inner).alias("b")
    outside = b.join(a, (F.col("a.sid") == F.col("b.sid")) & (F.col("a.start") <= F.col("b.start")) & (F.col("b.end") <= F.col("a.end")), "left_anti")
    return outside.agg((F.count(F.lit(1)) == 0).alias("contains"))


def equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (equal): whether two sets have the same transactions."""
    return contains(left, right).crossJoin(contains(right, left).withColumnRenamed("contains", "other")).select((F.col("contains") & F.col("other")).alias("equal"))


def executed(log: DataFrame, width: int = 1 << 16) -> DataFrame:
    """The set that a changelog's transactions add up to: (sid, start, end).

    A source's transactions become intervals within ranges of their numbers first; only those, one or
    a few a range, meet in one window."""
    points = log.filter("commit").select(F.col("gtid_sid").alias("sid"), F.col("gtid_seq").alias("n")).distinct()
    along = Window.partitionBy("sid", F.floor(F.col("n") / width)).orderBy("n")
    islands = points.withColumn("_island", F.col("n") - F.row_number().over(along)).groupBy("sid", F.floor(F.col("n") / width), "_island")
    parts = islands.agg(F.min("n").alias("start"), F.max("n").alias("end")).select(F.lit("log").alias("set_id"), "sid", "start", "end")
    return coalesced(parts)


def parse(spark: SparkSession, set_id: str, text: str) -> DataFrame:
    """`sid:1-5:7,sid:...` as intervals."""
    rows = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        sid, *ranges = part.split(":")
        if not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", sid):
            raise ValueError(f"invalid source id {sid!r}")
        for r in ranges:
            m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", r)
            if not m or int(m[1]) < 1:
                raise ValueError(f"invalid interval {r!r}")
            rows.append((set_id, sid.lower(), int(m[1]), int(m[2] or m[1])))
    return spark.createDataFrame(rows, "set_id string, sid string, start long, end long")


def text(intervals: DataFrame) -> DataFrame:
    """(set_id, gtid_set): sets in their text form, source ids and intervals in order."""
    one = F.when(F.col("start") == F.col("end"), F.col("start").cast("string")).otherwise(F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")))
    by_sid = coalesced(intervals).groupBy("set_id", "sid").agg(F.array_sort(F.collect_list(F.struct("start", one.alias("r")))).alias("r"))
    whole = by_sid.select("set_id", F.concat_ws(":", "sid", "r.r").alias("s")).groupBy("set_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return whole.select("set_id", F.concat_ws(",", "s").alias("gtid_set"))


def domain_set(points: DataFrame) -> DataFrame:
    """(domain, server, sequence) points -> the latest point of each domain."""
    return points.groupBy("domain").agg(F.max("sequence").alias("sequence"), F.max_by("server", F.struct("sequence", "server")).alias("server"))


def domain_contains(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """One row (contains): whether `outer` is at least as far in every domain of `inner`."""
    a, b = domain_set(outer).alias("a"), domain_set(inner).alias("b")
    behind = b.join(a, (F.col("a.domain") == F.col("b.domain")) & (F.col("a.sequence") >= F.col("b.sequence")), "left_anti")
    return behind.agg((F.count(F.lit(1)) == 0).alias("contains"))


def file_position_reached(points: DataFrame, file: str, pos: int) -> DataFrame:
    """Points (file, pos) that are at or before a place: an earlier file, or the same one up to it."""
    return points.filter(F.struct("file", "pos") <= F.struct(F.lit(file).alias("file"), F.lit(pos).cast("long").alias("pos")))


def lost(purged: DataFrame, position: DataFrame) -> DataFrame:
    """The gap records of a start from `position` on a server that has purged some transactions: what
    was purged and not yet read, and so can never be read."""
    return difference(purged, position, "lost")
