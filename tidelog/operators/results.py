"""Whole results: put together, compared, cut, read by name with defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appended(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both; their columns must have the same names and types."""
    if {(c.lower(), t) for c, t in first.dtypes} != {(c.lower(), t) for c, t in second.dtypes}:
        raise ValueError("results have different columns")
    return first.unionByName(second)


def differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows that only one result has, or has more often: `side` says which."""
    return first.exceptAll(second).withColumn("side", F.lit("first")).unionByName(second.exceptAll(first).withColumn("side", F.lit("second")))


def equal(first: DataFrame, second: DataFrame) -> bool:
    """Whether two results have the same rows as often as each other, in any order."""
    return sorted(first.dtypes) == sorted(second.dtypes) and differences(first, second).isEmpty()


def first_columns(rows: DataFrame, width: int) -> DataFrame:
    """The first columns of a result."""
    return rows.select(rows.columns[:width])


def named(name: str, kind: str, default: object = None) -> Column:
    """A column by name as a kind; what is null or does not fit is the default."""
    return F.coalesce(F.col(f"`{name}`").try_cast(kind), F.lit(default).cast(kind))
