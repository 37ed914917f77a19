"""Schemas of tables, which tables a list selects, and how streamed types fit a schema."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """A table as it was announced: its columns, key, and version within the log."""

    db: str
    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    version: int = 0

    @property
    def key_columns(self) -> tuple[str, ...]:
        """The primary key; all columns where there is none."""
        return self.key or tuple(self.schema.names)


def _matcher(names: list[str]):
    exact = {n.lower() for n in names if not (len(n) > 1 and n[0] == "/" == n[-1])}
    patterns = [re.compile(n[1:-1]) for n in names if len(n) > 1 and n[0] == "/" == n[-1]]
    return lambda table: table.lower() in exact or any(p.search(table) for p in patterns)


def included(tables: list[str], include: list[str] = (), exclude: list[str] = ()) -> list[str]:
    """Tables by lists of names, in any case, and /regular expressions/; no list includes all."""
    wanted, unwanted = _matcher(list(include)), _matcher(list(exclude))
    return sorted(t for t in tables if (not include or wanted(t)) and not unwanted(t))


def catalog_tables(spark: SparkSession, db: str, include: list[str] = (), exclude: list[str] = ()) -> list[TableSpec]:
    names = included([t.name for t in spark.catalog.listTables(db)], include, exclude)
    return [TableSpec(db, n, spark.table(f"`{db}`.`{n}`").limit(0).schema) for n in names]


#: MySQL type name -> Spark type; unsigned types take the next wider one. Fixed values.
TYPES = {
    "tinyint": T.ByteType(), "tinyint unsigned": T.ShortType(), "smallint": T.ShortType(), "smallint unsigned": T.IntegerType(),
    "mediumint": T.IntegerType(), "mediumint unsigned": T.IntegerType(), "int": T.IntegerType(), "int unsigned": T.LongType(),
    "bigint": T.LongType(), "bigint unsigned": T.DecimalType(20, 0), "float": T.FloatType(), "double": T.DoubleType(), "year": T.ShortType(),
    "date": T.DateType(), "time": T.DayTimeIntervalType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(),
    "char": T.StringType(), "varchar": T.StringType(), "text": T.StringType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "blob": T.BinaryType(),
    "bit": T.BinaryType(), "enum": T.StringType(), "set": T.StringType(), "geometry": T.BinaryType(), "json": T.StringType(),
}


def spark_field(name: str, column_type: str) -> T.StructField:
    """A MySQL column as a Spark field; its type's text and labels stay as metadata."""
    m = re.match(r"\s*(\w+)\s*(?:\((.*)\))?\s*(unsigned)?", column_type, re.I | re.S)
    if not m:
        raise ValueError(f"unknown column type {column_type!r}")
    base, args, unsigned = m[1].lower(), m[2], bool(m[3])
    base = {"integer": "int", "tinytext": "text", "mediumtext": "text", "longtext": "text", "tinyblob": "blob", "mediumblob": "blob", "longblob": "blob", "numeric": "decimal", "real": "double"}.get(base, base)
    meta: dict = {"column_type": column_type, "unsigned": unsigned}
    if base == "decimal":
        p, s = ([int(x) for x in args.split(",")] + [0])[:2] if args else (10, 0)
        # Spark ends at 38 digits; wider numbers stay exact as text.
        kind: T.DataType = T.DecimalType(p, s) if p <= 38 else T.StringType()
    else:
        name_of = f"{base} unsigned" if unsigned and f"{base} unsigned" in TYPES else base
        if name_of not in TYPES:
            raise ValueError(f"unknown column type {column_type!r}")
        kind = TYPES[name_of]
    if base in ("enum", "set"):
        meta["labels"] = [x.replace("''", "'") for x in re.findall(r"'((?:[^']|'')*)'", args or "")]
    return T.StructField(name, kind, True, meta)


_FAMILIES = (
    ("tinyint",), ("smallint",), ("mediumint",), ("int",), ("bigint",), ("float",), ("double",), ("decimal",), ("year",), ("date",), ("time",), ("datetime",), ("timestamp",),
    ("char", "binary", "enum", "set"), ("varchar", "varbinary"), ("text", "blob", "json", "geometry"), ("bit",),
)


def equivalent(streamed: str, declared: str) -> bool:
    """Whether a streamed type may be a declared one: signs, and text against bytes, are not streamed."""
    strip = lambda t: t.lower().replace(" unsigned", "").strip()
    a, b = strip(streamed), strip(declared)
    return a == b or any(a in f and b in f for f in _FAMILIES)


def reconciled(streamed: list[str], table: T.StructType) -> list[str]:
    """Names of streamed columns: the table's if it has as many and their types fit, else @1, @2, ..."""
    declared = [re.match(r"\s*(\w+)", f.metadata.get("column_type", f.dataType.simpleString()))[1] for f in table][: len(streamed)]
    fits = len(declared) == len(streamed) and all(equivalent(a, b) for a, b in zip(streamed, declared, strict=True))
    return list(table.names[: len(streamed)]) if fits else [f"@{k}" for k in range(1, len(streamed) + 1)]


def label_of(number: int | None, labels: list[str], is_set: bool = False) -> str | None:
    """An ENUM's label by its ordinal (0 is ''), or a SET's labels by its bit mask."""
    if number is None:
        return None
    if is_set:
        return ",".join(x for k, x in enumerate(labels) if number >> k & 1)
    return labels[number - 1] if 0 < number <= len(labels) else ""
