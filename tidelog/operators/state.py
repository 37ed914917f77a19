"""Keyed state: the table that a changelog leaves behind.

A change whose key columns differ between its images is a delete of the one and an insert of the
other. The state of a key is its latest image by `seq`; a key whose latest image is a delete is gone.
One aggregation by key, combined before the shuffle, whatever the number of changes per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.table_plan import TablePlan


def key_of(image: str, key: tuple[str, ...] | list[str]) -> Column:
    return F.struct(*(F.col(f"`{image}`.`{k}`").alias(k) for k in key))


def key_moved(key: tuple[str, ...] | list[str]) -> Column:
    """Whether an update moves the row to another key; two nulls are equal."""
    return F.col("before").isNotNull() & F.col("after").isNotNull() & ~key_of("before", key).eqNullSafe(key_of("after", key))


def keyed(changes: DataFrame, key: tuple[str, ...] | list[str], order: str = "seq") -> DataFrame:
    """(_key, _at, _row): every key that a change sets (_row) or leaves behind (null)."""
    # `_at` orders a moved row's insert behind deletes of the same change.
    images = F.array(
        F.when(F.col("before").isNotNull() & (F.col("after").isNull() | key_moved(key)), F.struct(key_of("before", key).alias("k"), F.lit(0).alias("n"), F.lit(False).alias("here"))),
        F.when(F.col("after").isNotNull(), F.struct(key_of("after", key).alias("k"), F.lit(1).alias("n"), F.lit(True).alias("here"))),
    )
    out = changes.select("*", F.explode(F.filter(images, lambda x: x.isNotNull())).alias("_i"))
    return out.select(
        F.col("_i.k").alias("_key"), F.struct(F.col(order).alias("seq"), F.col("_i.n").alias("n")).alias("_at"),
        F.when(F.col("_i.here"), F.col("after")).alias("_row"),
    )


def latest(entries: DataFrame) -> DataFrame:
    """(_key, _at, _row) with the last entry of each key; deletes stay, with a null row."""
    return entries.groupBy("_key").agg(F.max("_at").alias("_at"), F.max_by("_row", "_at").alias("_row"))


def state(changes: DataFrame, key: tuple[str, ...] | list[str], order: str = "seq") -> DataFrame:
    """The rows that remain after all of `changes`."""
    return latest(keyed(changes, key, order)).filter(F.col("_row").isNotNull()).select("_row.*")


def first_rows(changes: DataFrame, key: tuple[str, ...] | list[str], order: str = "seq") -> DataFrame:
    """The first image of each key ever seen; deletes and later images change nothing."""
    seen = changes.filter(F.col("after").isNotNull())
    out = seen.groupBy(key_of("after", key).alias("_key")).agg(F.min_by("after", order).alias("_row"))
    return out.select("_row.*")


def applied(plan: TablePlan, log: DataFrame) -> DataFrame:
    """What a plan's target holds after a changelog, in whichever mode the plan is."""
    from tidelog.operators.incremental import aggregate

    changes = plan.changes(log)
    if plan.mode == "normal":
        return state(changes, plan.key)
    return first_rows(changes, plan.key) if plan.mode == "ignore" else aggregate(plan, changes)
