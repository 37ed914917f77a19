"""From a rule's select and a table's schema to functions over DataFrames.

One plan serves batch, snapshot and stream. `snapshot` filters and projects rows. `changes` does it
with both images of a change, each for itself: a row that leaves the filter becomes a DELETE, one
that enters it an INSERT; a change with neither image inside is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.plans.errors import PlanError
from tidelog.plans.select_text import Comparison, Item, Select, Token, parse

OPS = ("INSERT", "UPDATE", "DELETE")
#: Digits that any value of an integer type may have.
_DIGITS = {T.ByteType: 2, T.ShortType: 4, T.IntegerType: 9, T.LongType: 18}


def _lookup(schema: T.StructType, column: str) -> T.StructField:
    for f in schema:
        if f.name.lower() == column.lower():
            return f
    raise PlanError(f"unknown column {column}")


def literal_of(literal: object, field: T.StructField) -> tuple[Column, bool]:
    """A filter's literal for a column, and whether it is of the column's type: if that holds it exactly,
    else wide enough to compare by value. Text that is no number is refused beside a numeric column."""
    kind = field.dataType
    if not isinstance(kind, T.NumericType) or literal is None:
        return F.lit(literal).cast(kind), True
    try:
        number = Decimal(str(literal))
    except InvalidOperation as e:
        raise PlanError(f"{field.name} is a number, {literal!r} is not") from e
    if isinstance(kind, (T.FloatType, T.DoubleType)) or not number.is_finite():
        return F.lit(float(number)).cast(T.DoubleType()), True
    whole, scale = (kind.precision - kind.scale, kind.scale) if isinstance(kind, T.DecimalType) else (_DIGITS[type(kind)], 0)
    exponent = int(number.normalize().as_tuple().exponent)
    if -exponent <= scale and number.adjusted() < whole:
        return F.lit(int(number) if scale == 0 else number).cast(kind), True
    # No value of the column equals it; comparing by value still orders right.
    return F.lit(number) if number.adjusted() < 30 and -exponent <= 7 else F.lit(float(number)), False


def condition(where: tuple[Comparison, ...], schema: T.StructType, image: str | None = None) -> Column:
    """The conjunction, literals cast to the columns' types here and not for each row.

    A null comparison keeps nothing, as false does; left as it is, it reaches the scan.
    """
    out = F.lit(True)
    for c in where:
        field = _lookup(schema, c.column)
        value, exact = literal_of(c.literal, field)
        col = F.col(f"`{image}`.`{field.name}`" if image else f"`{field.name}`")
        one = {
            "=": lambda a, b: a == b, "<=>": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
            "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
        }[c.op](col, value)
        # Beside a literal out of the column's range Spark 4.1 takes a null for a match; it is none.
        out = out & (one if exact else col.isNotNull() & one)
    return out


@dataclass(frozen=True)
class TablePlan:
    select: Select
    schema: T.StructType
    key: tuple[str, ...]
    #: The database whose table is meant; None for whichever the log tells of.
    db: str | None = None
    #: Whether the table has a key of its own, whose columns are never null.
    declared: bool = True

    @staticmethod
    def of(text: str, schema: T.StructType, key: list[str] | tuple[str, ...] = (), extended: bool = False, db: str | None = None) -> TablePlan:
        """A checked plan. Without a key, all columns together are the key."""
        select = parse(text, extended)
        if select.star:
            items = tuple(Item(f.name, "column", (Token("name", f"`{f.name}`", 0),)) for f in schema)
            select = Select(select.table, True, items, select.where, ())
        for item in select.items:
            for c in item.columns:
                _lookup(schema, c)
        for c in select.where:
            _lookup(schema, c.column)
        names = {i.alias.lower(): i for i in select.items}
        keys = tuple(key) or tuple(i.alias for i in select.items if i.kind not in ("count", "sum"))
        for k in keys:
            if k.lower() not in names:
                raise PlanError(f"primary key column {k} not found in select list")
            if names[k.lower()].kind in ("count", "sum"):
                raise PlanError(f"primary key column {k} is not allowed to reference an aggregate expression")
        return TablePlan(select, schema, keys, db, bool(key))

    @property
    def mode(self) -> str:
        """normal: rows by key; on_dup: keyed aggregates or last values; ignore: the first row stays."""
        if not self.select.group_by:
            return "normal"
        return "ignore" if len(self.select.group_by) == len(self.select.items) else "on_dup"

    @property
    def referenced(self) -> tuple[str, ...]:
        """The source columns that the plan reads."""
        out = dict.fromkeys(c for i in self.select.items for c in i.columns)
        return tuple(out | dict.fromkeys(c.column for c in self.select.where))

    @property
    def key_references(self) -> tuple[str, ...]:
        """The source columns that the key depends on."""
        return tuple(sorted({c for i in self.select.items if i.alias in self.key for c in i.columns}))

    def actions(self) -> dict[str, str]:
        """What insert, update and delete come down to, by mode."""
        if self.mode == "ignore":
            return {"insert": "ignore", "update": "ignore", "delete": "none"}
        if self.mode == "on_dup":
            return {"insert": "upsert", "update": "update", "delete": "update"}
        return {"insert": "insert", "update": "update", "delete": "delete"}

    def _plain(self) -> list[Item]:
        return list(self.select.items)

    def _projected(self, image: str | None = None) -> list[Column]:
        out = []
        for i in self._plain():
            text = "1" if i.kind == "count" else i.sql(image)
            out.append((F.expr(text).cast("long") if i.kind == "count" else F.expr(text)).alias(i.alias))
        return out

    def snapshot(self, rows: DataFrame) -> DataFrame:
        """The table's rows that the filter keeps, projected; the filter reaches the scan."""
        return rows.filter(condition(self.select.where, self.schema)).select(*self._projected())

    def mine(self, log: DataFrame) -> DataFrame:
        """The row events of this plan's table, as far as the log tells kinds, tables and databases."""
        wanted = {"kind": "row", "tbl": self.select.table, "db": self.db}
        for column, value in wanted.items():
            if value is not None and column in log.columns:
                log = log.filter(F.col(column) == value)
        return log

    def changes(self, log: DataFrame) -> DataFrame:
        """Row changes of the table with `before` and `after` filtered, projected, and `op` derived.

        A log may hold other tables' events: they are left out."""
        log = self.mine(log)
        inside = {i: F.col(i).isNotNull() & condition(self.select.where, self.schema, i) for i in ("before", "after")}
        images = {i: F.when(inside[i], F.struct(*self._projected(i))) for i in ("before", "after")}
        kept = log.withColumns(images).filter(F.col("before").isNotNull() | F.col("after").isNotNull())
        return kept.withColumn("op", operation(F.col("before"), F.col("after")))


def operation(before: Column, after: Column) -> Column:
    """INSERT, DELETE or UPDATE, by which images there are."""
    return F.when(before.isNull(), "INSERT").when(after.isNull(), "DELETE").otherwise("UPDATE")
