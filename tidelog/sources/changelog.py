"""The canonical changelog, and one derived from the orders table.

Columns: seq, txn_id, gtid_sid, gtid_seq, db, tbl, ts, commit, kind, before, after, sql. `seq` is the
order of all events; `before` and `after` are structs of one table's columns; `kind` is row, ddl,
other or heartbeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER_ROW = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
    T.StructField("o_orderstatus", T.StringType()), T.StructField("cents", T.LongType()),
])
SIDS = ("3e11fa47-71ca-11e1-9e33-c80aa9429562", "4e11fa47-71ca-11e1-9e33-c80aa9429562")
MOVED = 10_000_000


def order_rows(orders: DataFrame) -> DataFrame:
    """The followed table: orders with their price in cents."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", cents.alias("cents"), "o_orderdate")


def order_changes(orders: DataFrame) -> DataFrame:
    """Each order K is inserted; K%3=0 is updated, K%13=5 moved to another key, K%21=0 deleted."""
    k = F.col("o_orderkey")
    row = lambda key, status, cents: F.struct(key.alias("o_orderkey"), F.col("o_custkey"), status.alias("o_orderstatus"), cents.alias("cents"))
    first = row(k, F.col("o_orderstatus"), F.col("cents"))
    changed = k % 3 == 0
    status = F.when(changed, F.when(k % 2 == 0, "F").otherwise("O")).otherwise(F.col("o_orderstatus"))
    cents = F.when(changed, F.col("cents") + 100).otherwise(F.col("cents"))
    now, gone = row(k, status, cents), k % 21 == 0
    none = F.lit(None).cast(ORDER_ROW)
    change = lambda n, before, after: F.struct((8 * k + n).alias("seq"), before.cast(ORDER_ROW).alias("before"), after.cast(ORDER_ROW).alias("after"))
    events = F.array(
        change(1, none, first), F.when(changed, change(2, first, now)),
        F.when((k % 13 == 5) & ~gone, change(3, now, row(k + MOVED, status, cents))), F.when(gone, change(4, now, none)),
    )
    out = order_rows(orders).select("o_orderkey", F.col("o_orderdate").alias("ts"), F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e"))
    return out.select(
        "e.seq", k.alias("txn_id"), F.when(k % 2 == 0, SIDS[0]).otherwise(SIDS[1]).alias("gtid_sid"), (F.floor(k / 2) + 1).alias("gtid_seq"),
        F.lit("shop").alias("db"), F.lit("orders").alias("tbl"), "ts", F.lit(True).alias("commit"), F.lit("row").alias("kind"),
        "e.before", "e.after", F.lit("").alias("sql"),
    )


def full_images(log: DataFrame, columns: list[str]) -> DataFrame:
    """Fails, at the row, on an image that misses some of `columns`: partial images cannot be followed."""
    missing = [c for c in columns if c not in log.schema["after"].dataType.names]
    if missing:
        raise ValueError(f"partial row image: no {', '.join(missing)}")
    neither = F.col("before").isNull() & F.col("after").isNull() & (F.col("kind") == "row")
    return log.withColumn("kind", F.when(neither, F.raise_error(F.lit("partial row image"))).otherwise(F.col("kind")))
