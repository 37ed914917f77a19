"""Text functions about SQL statements, names and literals, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First word of a statement -> its kind; fixed values.
_FIRST_WORD = {
    "SELECT": ("select",), "STREAM": ("stream",), "VSTREAM": ("vstream",), "INSERT": ("insert",), "REPLACE": ("replace",), "UPDATE": ("update",), "DELETE": ("delete",),
    "SAVEPOINT": ("savepoint",), "LOCK_TABLES": ("lock",), "UNLOCK_TABLES": ("unlock",),
}
_WHOLE = {"BEGIN": ("begin", "start transaction"), "COMMIT": ("commit",), "ROLLBACK": ("rollback",)}
_LATER = {
    "DDL": ("create", "alter", "rename", "drop", "truncate"), "FLUSH": ("flush",), "SET": ("set",), "SHOW": ("show",), "USE": ("use",), "EXPLAIN": ("describe", "desc", "explain"),
    "OTHER": ("analyze", "repair", "optimize"), "PRIV": ("grant", "revoke"), "RELEASE": ("release",), "SAVEPOINT_ROLLBACK": ("rollback",),
}
_LEADING = r"^(\s|/\*[^!](?s:.*?)\*/|--[^\n]*(\n|$))*"
_TRAILING = r"(\s|/\*(?s:.*?)\*/)*$"


def statement_kind(sql: Column) -> Column:
    """What kind of statement a text begins, by its first word; comments around it do not count."""
    body = F.regexp_replace(sql, _LEADING, "")
    word = F.lower(F.regexp_extract(body, r"^[^\p{L}]*(\p{L}[^\s]*)", 1))
    whole = F.lower(F.regexp_replace(body, _TRAILING, ""))
    out = F.lit("UNKNOWN")
    for source, table in ((word, _LATER), (whole, _WHOLE), (word, _FIRST_WORD)):
        for kind, words in reversed(list(table.items())):
            out = F.when(source.isin(*words), kind).otherwise(out)
    return F.when(body.startswith("/*!"), "COMMENT").otherwise(out)


def truncated(text: Column, most: int = 950) -> Column:
    """A message cut to its first `most` characters, with dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def quoted_name(name: Column) -> Column:
    """An identifier in back-ticks, those within doubled."""
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def quoted_text(text: Column) -> Column:
    """A string literal with its special characters escaped; null is the word."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, e in (("\0", "\\0"), ("'", "\\'"), ('"', '\\"'), ("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x1a", "\\Z")):
        out = F.replace(out, F.lit(c), F.lit(e))
    return F.coalesce(F.concat(F.lit("'"), out, F.lit("'")), F.lit("null"))


def bit_literal(value: Column) -> Column:
    """Bytes as a bit literal, eight digits each."""
    digits = F.transform(F.split(F.regexp_replace(F.hex(value), "(..)(?=.)", "$1,"), ","), lambda h: F.lpad(F.conv(h, 16, 2), 8, "0"))
    return F.concat(F.lit("b'"), F.array_join(digits, ""), F.lit("'"))


def snake_name(name: Column) -> Column:
    """CamelCase and dotted names in snake case."""
    out = F.regexp_replace(name, r"([a-z])([A-Z])", "$1_$2")
    out = F.regexp_replace(out, r"([A-Z])([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(out, r"[.-]", "_"))


def kebab_name(name: Column) -> Column:
    """CamelCase and dotted names in kebab case."""
    out = F.regexp_replace(name, r"([a-z])([A-Z])", "$1-$2")
    out = F.regexp_replace(out, r"([A-Z])([A-Z][a-z])", "$1-$2")
    return F.lower(F.regexp_replace(out, r"[._]", "-"))


def like(text: Column, pattern: str) -> Column:
    """SQL LIKE with \\ as the escape; an empty pattern matches everything."""
    return F.lit(True) if not pattern else text.like(pattern)


def redacted(sql: Column) -> Column:
    """A statement with its string and number literals replaced."""
    out = F.regexp_replace(sql, r"'(?:[^'\\]|\\.|'')*'", ":v")
    return F.regexp_replace(out, r"(?<![\w`])\d+(\.\d+)?(?![\w`])", ":v")


def earliest_token(a: Column, b: Column) -> Column:
    """The smaller of two event times; null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))
