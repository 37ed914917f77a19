"""Snapshot scans: in key order, from a key on, with the last key of each batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.stitch import after_key


def scan(rows: DataFrame, position: str | None = None) -> DataFrame:
    """A frozen table, carrying the position that it was frozen at."""
    return rows if position is None else rows.withColumn("snapshot_gtid", F.lit(position))


def resumed(rows: DataFrame, key: list[str], lastpk: dict | None, ordered: bool = True) -> DataFrame:
    """The rows behind the last key, in key order. The bound on the first column is pushed down."""
    left = rows if lastpk is None else rows.filter(after_key(key, lastpk))
    return left.orderBy(*key) if ordered else left


def last_keys(rows: DataFrame, key: list[str], batch: Column) -> DataFrame:
    """(batch, key columns, rows): the last key of each batch, what a copy saves after it."""
    top = F.max(F.struct(*key)).alias("k")
    return rows.groupBy(batch.alias("batch")).agg(top, F.count(F.lit(1)).alias("rows")).select("batch", "k.*", "rows")


def byte_size(rows: DataFrame) -> Column:
    """The length of a row's values as text; nulls have none."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in rows.columns]
    out = sizes[0]
    for s in sizes[1:]:
        out = out + s
    return out


def byte_batches(rows: DataFrame, key: list[str], limit: int = 250_000, range_bytes: int = 16 << 20) -> DataFrame:
    """`rows` with `batch`: rows in key order cut whenever `limit` more bytes have passed.

    Rows are dealt into ranges of the key's first column, a long, of about `range_bytes` on average;
    ranges' sizes are summed up first, then rows within each range, by the whole key.
    """
    from tidelog.operators.timeline import running

    sized = rows.withColumn("_size", byte_size(rows).cast("long"))
    span = sized.agg(F.min(key[0]).alias("a"), F.max(key[0]).alias("b"), F.sum("_size").alias("bytes")).first()
    ranges = max(64, (span["bytes"] or 0) // range_bytes)
    width = max(1, ((span["b"] or 0) - (span["a"] or 0)) // ranges + 1)
    before = running(sized, F.col("_size"), key, "_before", width, inclusive=False)
    return before.withColumn("batch", F.floor(F.col("_before") / limit)).drop("_size", "_before")
