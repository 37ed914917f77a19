"""Bind variables: substitution in statement templates, and lists pivoted to rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Scalar = str | int | float | bool | None


def encoded(value: Scalar | list[Scalar]) -> str:
    """A value as a SQL literal; a list as a bracketed tuple."""
    if isinstance(value, (list, tuple)):
        if not value:
            raise ValueError("an empty list has no SQL form")
        return "(" + ", ".join(encoded(v) for v in value) + ")"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (int, float)):
        return repr(value)
    escapes = {"\0": "\\0", "'": "\\'", '"': '\\"', "\b": "\\b", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\x1a": "\\Z", "\\": "\\\\"}
    return "'" + "".join(escapes.get(c, c) for c in value) + "'"


def bound(template: str, values: dict[str, Scalar | list[Scalar]]) -> str:
    """`:name` and `::list` replaced by their values; a missing one is an error."""

    def one(m: re.Match) -> str:
        name = m[2]
        if name not in values:
            raise KeyError(f"missing bind var {name}")
        if (m[1] == "::") != isinstance(values[name], (list, tuple)):
            raise ValueError(f"unexpected list or scalar for {name}")
        return encoded(values[name])

    return re.sub(r"(::?)([A-Za-z_]\w*)", one, template)


def pivoted(spark: SparkSession, plan: dict[str, Scalar | list[Scalar]], schema: str) -> DataFrame:
    """Lists side by side as rows, scalars repeated on each; lists must be of one length."""
    lengths = {len(v) for v in plan.values() if isinstance(v, (list, tuple))}
    if len(lengths) > 1:
        raise ValueError("mismatch in number of column values")
    n = lengths.pop() if lengths else 1
    rows = [tuple(v[k] if isinstance(v, (list, tuple)) else v for v in plan.values()) for k in range(n)]
    return spark.createDataFrame(rows, schema)


def exploded(rows: DataFrame, lists: list[str]) -> DataFrame:
    """The same on columns: array columns become rows side by side, the others repeat."""
    zipped = rows.withColumn("_z", F.explode(F.arrays_zip(*lists)))
    return zipped.select(*(F.col(f"_z.`{c}`").alias(c) if c in lists else F.col(c) for c in rows.columns))
