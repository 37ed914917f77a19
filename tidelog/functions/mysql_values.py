"""MySQL-compatible value arithmetic, comparison and casts as columns.

Kinds are `int64`, `uint64` (decimal(20, 0) here), `float64` and `text`. A mixed pair takes the higher
of float > unsigned > signed. What MySQL refuses raises by default; with `tolerant` it is null. The
signed minimum and the unsigned maximum are the bounds, as 64-bit values have them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("int64", "uint64", "float64", "text")
SIGNED = (-(1 << 63), (1 << 63) - 1)
UNSIGNED = (0, (1 << 64) - 1)
_WIDE = "decimal(38,0)"


def number(value: Column) -> tuple[Column, Column]:
    """Text as a number: (whole, real), one of them null; text that is no number is 0.

    Blanks around a number make it none, where a cast would trim them.
    """
    whole = F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))
    real = F.when(whole.isNull() & value.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), value.try_cast("double"))
    return F.when(value.isNotNull(), F.when(real.isNull(), F.coalesce(whole, F.lit(0).cast("bigint")))), real


def text_to_number(value: Column) -> Column:
    """Text as a double: an integer, else a real number, else 0."""
    whole, real = number(value)
    return F.coalesce(whole.cast("double"), real)


def result_kind(left: str, right: str) -> str:
    """The kind that a mixed pair is calculated in."""
    pair = {"float64" if k == "text" else k for k in (left, right)}
    return next(k for k in ("float64", "uint64", "int64") if k in pair)


def _fail(message: Column | str, tolerant: bool) -> Column:
    return F.lit(None) if tolerant else F.raise_error(F.lit(message) if isinstance(message, str) else message)


def _whole(op: str, a: Column, b: Column, kind: str, tolerant: bool) -> Column:
    """Exact integer arithmetic in 38 digits, checked against the kind's range."""
    wide_a, wide_b = a.cast(_WIDE), b.cast(_WIDE)
    out = {"+": wide_a + wide_b, "-": wide_a - wide_b, "*": F.try_multiply(wide_a, wide_b)}[op].try_cast(_WIDE)
    low, high = UNSIGNED if kind == "uint64" else SIGNED
    name = "BIGINT UNSIGNED" if kind == "uint64" else "BIGINT"
    inside = out.between(F.lit(str(low)).cast(_WIDE), F.lit(str(high)).cast(_WIDE))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(inside, out).otherwise(_fail(f"{name} value is out of range in '{op}'", tolerant)).cast("bigint" if kind == "int64" else "decimal(20,0)")


def arithmetic(op: str, a: Column, b: Column, left: str = "int64", right: str = "int64", tolerant: bool = False) -> Column:
    """a op b for + - * and /. Division is always real, and null by zero."""
    if op == "/":
        return F.try_divide(_real(a, left), _real(b, right))
    kind = result_kind(left, right)
    if kind == "float64":
        x, y = _real(a, left), _real(b, right)
        return {"+": x + y, "-": x - y, "*": x * y}[op]
    return _whole(op, a, b, kind, tolerant)


def _real(value: Column, kind: str) -> Column:
    return text_to_number(value) if kind == "text" else value.cast("double")


def nullsafe_add(a: Column, b: Column) -> Column:
    """a + b with null as 0, so null + null is 0; a sum out of the signed range goes through a double."""
    x, y = F.coalesce(a.cast("bigint"), F.lit(0)), F.coalesce(b.cast("bigint"), F.lit(0))
    return F.coalesce(F.try_add(x, y), (x.cast("double") + y.cast("double")).try_cast("bigint"))


def nullsafe_compare(a: Column, b: Column, left: str = "int64", right: str = "int64") -> Column:
    """-1, 0 or 1; null is lowest and equal to itself. Two texts compare as bytes, mixed pairs as numbers."""
    if left == right == "text":
        x, y = a.cast("binary"), b.cast("binary")
    elif "float64" in (left, right) or "text" in (left, right):
        x, y = _real(a, left), _real(b, right)
    else:
        x, y = a.cast(_WIDE), b.cast(_WIDE)
    return F.when(x.eqNullSafe(y), 0).when(x.isNull(), -1).when(y.isNull(), 1).when(x < y, -1).otherwise(1)


def smaller(a: Column, b: Column) -> Column:
    """The smaller of two, ignoring nulls."""
    return F.least(a, b)


def larger(a: Column, b: Column) -> Column:
    """The larger of two, ignoring nulls."""
    return F.greatest(a, b)


def hash_code(value: Column) -> Column:
    """Equal numbers of any kind have equal codes; null has one of its own."""
    d = value.cast("double")
    # -0.0 and 0.0 are equal.
    return F.when(d.isNull(), F.lit(SIGNED[1])).otherwise(F.xxhash64(d + F.lit(0.0)))


def cast(value: Column, kind: str, tolerant: bool = False) -> Column:
    """Text or a number as a kind; what does not fit is an error, or null."""
    target = {"int64": "bigint", "uint64": "decimal(20,0)", "float64": "double", "text": "string"}[kind]
    text = value.cast("string")
    pattern = {"int64": r"^[+-]?[0-9]+$", "uint64": r"^[+]?[0-9]+$", "float64": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "text": r"(?s)^.*$"}[kind]
    out = text.try_cast(target)
    good = text.rlike(pattern) & out.isNotNull()
    if kind == "uint64":
        good = good & (out <= F.lit(str(UNSIGNED[1])).cast("decimal(20,0)"))
    return F.when(value.isNull(), F.lit(None)).when(good, out).otherwise(_fail(F.concat(F.lit(f"cannot be {kind}: "), text), tolerant)).cast(target)


def to_bool(value: Column, tolerant: bool = False) -> Column:
    """0 and 1 as booleans; other values are an error, or null."""
    return F.when(value.isNull(), F.lit(None)).when(value == 0, False).when(value == 1, True).otherwise(_fail("not a boolean", tolerant)).cast("boolean")


def decimal_text(value: Column) -> Column:
    """A decimal without the zero before its point, as the log's text form has it."""
    return F.regexp_replace(value.cast("string"), r"^(-?)0\.", "$1.")


def year_text(value: Column) -> Column:
    """A year byte: 0 is 0000, others count from 1900."""
    return F.when(value == 0, "0000").otherwise((value + 1900).cast("string"))


def padded_binary(value: Column, width: int) -> Column:
    """A BINARY(width) value as it is compared: padded with zero bytes."""
    return F.rpad(value.cast("binary"), F.lit(width), F.lit(b"\0"))


def date_or_null(value: Column) -> Column:
    """A date's text as a date; zero dates, which no calendar has, are null."""
    return F.when(value.rlike(r"^0000-|-00"), F.lit(None)).otherwise(value.try_cast("date"))


def time_interval(value: Column) -> Column:
    """`[-]hhh:mm:ss[.ffffff]` as an interval of seconds, within 838:59:59."""
    part = lambda k: F.regexp_extract(value, r"^(-?)(\d{1,3}):(\d{2}):(\d{2}(?:\.\d{1,6})?)$", k)
    seconds = part(2).try_cast("int") * 3600 + part(3).try_cast("int") * 60 + part(4).try_cast("decimal(8,6)")
    signed = F.when(part(1) == "-", -seconds).otherwise(seconds)
    return F.when(F.abs(signed) <= 838 * 3600 + 59 * 60 + 59, F.make_dt_interval(secs=signed.cast("decimal(18,6)")))
