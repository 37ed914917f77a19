"""Snapshot and changelog made one table, at any cut, and copying that is half done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.state import keyed, latest


def at_or_before(key: list[str] | tuple[str, ...], lastpk: dict, image: str | None = None) -> Column:
    """Whether a row's key is in the part that has been copied: (k1, k2, ...) <= the last key."""
    own = F.struct(*(F.col(f"`{image}`.`{k}`" if image else f"`{k}`").alias(k) for k in key))
    return own <= F.struct(*(F.lit(lastpk[k]).alias(k) for k in key))


def after_key(key: list[str] | tuple[str, ...], lastpk: dict) -> Column:
    """The rows still to be copied. The first column's bound alone lets the scan skip row groups."""
    own = F.struct(*(F.col(f"`{k}`").alias(k) for k in key))
    return (F.col(f"`{key[0]}`") >= F.lit(lastpk[key[0]])) & (own > F.struct(*(F.lit(lastpk[k]).alias(k) for k in key)))


def copied_part(changes: DataFrame, key: list[str] | tuple[str, ...], lastpk: dict | None) -> DataFrame:
    """Changes cut to the copied part of their table: an image beyond it is not there yet."""
    if lastpk is None:
        return changes.limit(0)
    cut = {i: F.when(F.col(i).isNotNull() & at_or_before(key, lastpk, i), F.col(i)) for i in ("before", "after")}
    return changes.withColumns(cut).filter(F.col("before").isNotNull() | F.col("after").isNotNull())


def copied_by_table(log: DataFrame, copy_state: DataFrame, key: str) -> DataFrame:
    """The same for many tables at once: (tbl, lastpk) joined to the log; copied tables have no row there.

    A table whose lastpk is null has not begun, and nothing of it applies.
    """
    state = copy_state.select("tbl", "lastpk", F.lit(True).alias("copying"))
    joined = log.join(state, "tbl", "left")
    inside = lambda i: F.col("copying").isNull() | (F.col(f"{i}.{key}") <= F.col("lastpk"))
    cut = {i: F.when(F.col(i).isNotNull() & inside(i), F.col(i)) for i in ("before", "after")}
    return joined.withColumns(cut).filter(F.col("before").isNotNull() | F.col("after").isNotNull()).drop("lastpk", "copying")


def fast_forward(log: DataFrame, upto: int, order: str = "seq") -> DataFrame:
    """The changes up to a snapshot's position."""
    return log.filter(F.col(order) <= upto)


def stitched(snapshot: DataFrame, cut: int, changes: DataFrame, key: list[str] | tuple[str, ...], order: str = "seq") -> DataFrame:
    """The final state from a snapshot at `cut` and the changes behind it.

    Snapshot rows are entries at the cut; one aggregation by key folds them with the changes.
    """
    rows = F.struct(*(F.col(f"`{c}`") for c in snapshot.columns))
    begun = snapshot.select(
        F.struct(*(F.col(f"`{k}`").alias(k) for k in key)).alias("_key"), F.struct(F.lit(cut).cast("long").alias("seq"), F.lit(1).alias("n")).alias("_at"), rows.alias("_row")
    )
    behind = keyed(changes.filter(F.col(order) > cut), key, order)
    return latest(begun.unionByName(behind)).filter(F.col("_row").isNotNull()).select("_row.*")


def not_applied_twice(position: DataFrame, log: DataFrame) -> DataFrame:
    """The changes of `log` whose transactions a position (sid, start, end) does not have yet."""
    done = position.select(F.col("sid").alias("gtid_sid"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    inside = (log["gtid_sid"] == done["gtid_sid"]) & log["gtid_seq"].between(done["_start"], done["_end"])
    return log.join(done, inside, "left_anti")
