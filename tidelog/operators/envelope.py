"""Change envelopes for a message bus: (topic, key, value) rows, values in JSON.

Three forms: `default` has both images as one-element arrays of text maps, `maxwell` has native values
and only the columns that changed, `flat` has the after image's columns at top level. Snapshots have
an array form and a flat form. Everything is one projection: it runs inside the scan's stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOPIC_BY_DB, TOPIC_BY_TABLE = "db", "table"
BY_COLUMN, BY_TABLE, BY_KEY = "column", "table", "primary_key"
_JSON = {"ignoreNullFields": "false"}


@dataclass(frozen=True)
class Sink:
    """How a task's changes are put on the bus."""

    form: str = "default"
    topic_mode: str = TOPIC_BY_TABLE
    partition_mode: str = BY_KEY
    partition_columns: tuple[str, ...] = ()
    fallback: str = BY_TABLE
    exclude: tuple[str, ...] = ()
    with_gtid: bool = False

    def __post_init__(self) -> None:
        for name, value, known in (
            ("form", self.form, ("default", "maxwell", "flat")), ("topic mode", self.topic_mode, (TOPIC_BY_DB, TOPIC_BY_TABLE)),
            ("partition mode", self.partition_mode, (BY_COLUMN, BY_TABLE, BY_KEY)), ("fallback", self.fallback, (BY_TABLE, BY_KEY)),
        ):
            if value not in known:
                raise ValueError(f"unknown {name} {value}")


def topic(sink: Sink) -> Column:
    return F.col("db") if sink.topic_mode == TOPIC_BY_DB else F.concat_ws("_", "db", "tbl")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def partition_key(sink: Sink, key: tuple[str, ...] | list[str], columns: list[str]) -> Column:
    """Values run together without a separator; the primary key's are empty for a delete."""
    by_table = F.col("tbl")
    by_key = F.when(F.col("after").isNull(), "").otherwise(F.concat(*(_text(F.col(f"after.`{k}`")) for k in key)))
    if sink.partition_mode == BY_TABLE:
        return by_table
    if sink.partition_mode == BY_COLUMN:
        if sink.partition_columns and all(c in columns for c in sink.partition_columns):
            of = lambda image: F.concat(*(_text(F.col(f"{image}.`{c}`")) for c in sink.partition_columns))
            return F.when(F.col("after").isNull(), of("before")).otherwise(of("after"))
        return by_table if sink.fallback == BY_TABLE or sink.form == "flat" and not key else by_key
    return by_key


def _kept(changes: DataFrame, sink: Sink) -> list[str]:
    return [c for c in sorted(changes.schema["after"].dataType.names) if c not in sink.exclude]


def _texts(image: str, columns: list[str]) -> Column:
    return F.struct(*(_text(F.col(f"{image}.`{c}`")).alias(c) for c in columns))


def _gtid(sink: Sink) -> list[Column]:
    return [F.concat_ws(":", "gtid_sid", F.col("gtid_seq").cast("string")).alias("gtid")] if sink.with_gtid else []


def default_value(changes: DataFrame, sink: Sink, key: tuple[str, ...], now: int) -> Column:
    """Images as text; an insert has an empty old image, a delete has its image as data and old."""
    columns = _kept(changes, sink)
    image = lambda i: F.to_json(F.array(_texts(i, columns)))
    data = F.when(F.col("after").isNull(), image("before")).otherwise(image("after"))
    old = F.when(F.col("before").isNull(), "[{}]").otherwise(image("before"))
    head = F.to_json(F.struct(
        F.col("tbl").alias("table"), F.col("db").alias("database"), *_gtid(sink), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("es"), F.lit(now).cast("long").alias("ts"),
        F.array(*map(F.lit, key)).alias("pkNames"), F.lit("").alias("sql"), F.lit(False).alias("isDdl"), F.col("op").alias("type"),
    ), _JSON)
    return F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"data":'), data, F.lit(',"old":'), old, F.lit("}"))


def changed_columns(columns: list[str]) -> Column:
    """JSON of the before image's columns that an update changed."""
    parts = [
        F.when(~F.col(f"before.`{c}`").eqNullSafe(F.col(f"after.`{c}`")), F.expr(f"substring(to_json(struct(before.`{c}` AS `{c}`), map('ignoreNullFields', 'false')), 2)"))
        for c in columns
    ]
    # Each part is `"name":value}`: its closing bracket goes.
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.regexp_replace(p, r"\}$", "") for p in parts)), F.lit("}"))


def maxwell_value(changes: DataFrame, sink: Sink, now: int) -> Column:
    """Native values; `old` only for updates, with what changed."""
    columns = _kept(changes, sink)
    image = lambda i: F.to_json(F.struct(*(F.col(f"{i}.`{c}`").alias(c) for c in columns)), _JSON)
    head = F.to_json(F.struct(F.col("tbl").alias("table"), F.col("db").alias("database"), *_gtid(sink), F.lit(now).cast("long").alias("ts"), F.lower("op").alias("type")), _JSON)
    data = F.when(F.col("after").isNull(), image("before")).otherwise(image("after"))
    changed = changed_columns(columns)
    old = F.when((F.col("op") == "UPDATE") & (changed != "{}"), F.concat(F.lit(',"old":'), changed)).otherwise("")
    return F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"data":'), data, old, F.lit("}"))


def flat_value(changes: DataFrame, sink: Sink, key: tuple[str, ...], now: int) -> Column:
    """The after image's columns beside the metadata; a delete has the metadata only."""
    columns = _kept(changes, sink)
    meta = [
        F.col("db").alias("database"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("es"), *_gtid(sink), F.lit(False).alias("isDdl"),
        F.array(*map(F.lit, key)).alias("pkNames"), F.lit("").alias("sql"), F.col("tbl").alias("table"), F.lit(now).cast("long").alias("ts"), F.col("op").alias("type"),
    ]
    head = F.to_json(F.struct(*meta), _JSON)
    row = F.to_json(F.struct(*(F.col(f"after.`{c}`").alias(c) for c in columns)), _JSON)
    return F.when(F.col("after").isNull(), head).otherwise(F.concat(F.substring(row, 1, F.length(row) - 1), F.lit(","), F.substring(head, 2, 1 << 30)))


def messages(changes: DataFrame, key: tuple[str, ...] | list[str], sink: Sink, now: int) -> DataFrame:
    """(seq, topic, key, value) for each change; `now` is the sending time in seconds."""
    value = {
        "default": lambda: default_value(changes, sink, tuple(key), now), "maxwell": lambda: maxwell_value(changes, sink, now),
        "flat": lambda: flat_value(changes, sink, tuple(key), now),
    }[sink.form]()
    keyed = partition_key(sink, key, changes.schema["after"].dataType.names)
    return changes.select("seq", topic(sink).alias("topic"), keyed.alias("key"), value.alias("value"))


def snapshot_batches(rows: DataFrame, bucket: Column, db: str, tbl: str, key: tuple[str, ...], order: list[str], now_ms: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, value): one array envelope for each bucket of a snapshot; a bucket is one message."""
    columns = [c for c in sorted(rows.columns) if c not in exclude]
    packed = F.struct(F.struct(*(F.col(c).alias(f"_o{n}") for n, c in enumerate(order))).alias("at"), F.struct(*(_text(F.col(f"`{c}`")).alias(c) for c in columns)).alias("row"))
    out = rows.withColumn("bucket", bucket).groupBy("bucket").agg(F.array_sort(F.collect_list(packed)).alias("rows"))
    head = F.struct(
        F.lit(tbl).alias("table"), F.lit(db).alias("database"), F.lit(now_ms).cast("long").alias("es"), F.lit(now_ms).cast("long").alias("ts"),
        F.array(*map(F.lit, key)).alias("pkNames"), F.lit("").alias("sql"), F.lit(False).alias("isDdl"), F.lit("INSERT").alias("type"), F.col("rows.row").alias("data"),
    )
    return out.select("bucket", F.to_json(head, _JSON).alias("value"))


def snapshot_flat(rows: DataFrame, db: str, tbl: str, key: tuple[str, ...], now: int, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(value): one flat INSERT envelope for each row of a snapshot."""
    columns = [F.col(f"`{c}`").alias(c) for c in sorted(rows.columns) if c not in exclude]
    meta = [
        F.lit(db).alias("database"), F.lit(now).cast("long").alias("es"), F.lit(False).alias("isDdl"), F.array(*map(F.lit, key)).alias("pkNames"),
        F.lit("").alias("sql"), F.lit(tbl).alias("table"), F.lit(now).cast("long").alias("ts"), F.lit("INSERT").alias("type"),
    ]
    return rows.select(F.to_json(F.struct(*columns, *meta), _JSON).alias("value"))
