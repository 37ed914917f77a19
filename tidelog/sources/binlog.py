"""Row events of MySQL's binary log, decoded in parallel.

Input is a table of raw events: (file, pos, event). A rows event needs the table map announced before
it under its table id; a window by (file, table id) brings the two together, and cells are decoded in
batches from there. Output rows are (file, pos, row, db, tbl, kind, before, after, sql), the images as
JSON objects of column name -> value; `typed` makes them structs of a table's schema.
"""

from __future__ import annotations

import datetime as dt
import json
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Event types of the log; fixed values.
QUERY, FORMAT, XID, TABLE_MAP, GTID = 2, 15, 16, 19, 33
ROWS = {23: "INSERT", 24: "UPDATE", 25: "DELETE", 30: "INSERT", 31: "UPDATE", 32: "DELETE"}
# Column types of the log; fixed values.
TINY, SHORT, LONG, FLOAT, DOUBLE, NULL, TIMESTAMP, LONGLONG, INT24, DATE, TIME, DATETIME, YEAR, NEWDATE, VARCHAR, BIT = range(1, 17)
TIMESTAMP2, DATETIME2, TIME2, JSON, DECIMAL, ENUM, SET = 17, 18, 19, 245, 246, 247, 248
TINY_BLOB, MEDIUM_BLOB, LONG_BLOB, BLOB, VAR_STRING, STRING, GEOMETRY = range(249, 256)

_META_BYTES = {
    **dict.fromkeys((FLOAT, DOUBLE, TIMESTAMP2, DATETIME2, TIME2, JSON, TINY_BLOB, MEDIUM_BLOB, LONG_BLOB, BLOB, GEOMETRY), 1),
    **dict.fromkeys((VARCHAR, BIT, VAR_STRING, DECIMAL, ENUM, SET, STRING), 2),
}
_HEADER = 19


@dataclass(frozen=True)
class TableMap:
    table_id: int
    db: str
    name: str
    kinds: bytes
    meta: tuple[int, ...]
    nullable: bytes


def length_at(data: bytes, at: int) -> tuple[int, int]:
    """A length-encoded integer and where it ends."""
    first = data[at]
    if first < 251:
        return first, at + 1
    width = {252: 2, 253: 3, 254: 8}[first]
    return int.from_bytes(data[at + 1 : at + 1 + width], "little"), at + 1 + width


def table_map(body: bytes) -> TableMap:
    table_id = int.from_bytes(body[:6], "little")
    at = 8
    names = []
    for _ in range(2):
        n = body[at]
        names.append(body[at + 1 : at + 1 + n].decode())
        at += n + 2
    count, at = length_at(body, at)
    kinds = body[at : at + count]
    size, at = length_at(body, at + count)
    end, meta = at + size, []
    for k in kinds:
        n = _META_BYTES.get(k, 0)
        # String-like types and decimals have their two bytes the other way round.
        order = "big" if k in (DECIMAL, ENUM, SET, STRING) else "little"
        meta.append(int.from_bytes(body[at : at + n], order))
        at += n
    if at != end:
        raise ValueError("table map: metadata does not fit its length")
    return TableMap(table_id, names[0], names[1], kinds, tuple(meta), body[at : at + (count + 7) // 8])


_DIGIT_BYTES = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)


def decimal_at(data: bytes, at: int, precision: int, scale: int) -> tuple[str, int]:
    """A packed decimal: groups of nine digits in four bytes, the first bit the sign's complement."""
    whole = precision - scale
    widths = [_DIGIT_BYTES[whole % 9]] * (whole % 9 > 0) + [4] * (whole // 9 + scale // 9) + [_DIGIT_BYTES[scale % 9]] * (scale % 9 > 0)
    digits = [whole % 9] * (whole % 9 > 0) + [9] * (whole // 9 + scale // 9) + [scale % 9] * (scale % 9 > 0)
    size = sum(widths)
    raw = bytearray(data[at : at + size])
    negative = not raw[0] & 0x80
    raw[0] ^= 0x80
    if negative:
        raw = bytearray(b ^ 0xFF for b in raw)
    text, p = "", 0
    for w, d in zip(widths, digits, strict=True):
        text += str(int.from_bytes(raw[p : p + w], "big")).zfill(d)
        p += w
    left, right = text[:whole].lstrip("0") or "0", text[whole:]
    return ("-" if negative and text.strip("0") else "") + left + ("." + right if scale else ""), at + size


def _fraction(value: int, digits: int) -> str:
    """Sub-seconds stored in pairs of digits, as text of `digits`."""
    pairs = (digits + 1) // 2
    return f".{value:0{2 * pairs}d}"[: digits + 1] if digits else ""


def _timestamp2(data: bytes, at: int, digits: int):
    n = (digits + 1) // 2
    seconds, part = int.from_bytes(data[at : at + 4], "big"), int.from_bytes(data[at + 4 : at + 4 + n], "big")
    shown = dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S") if seconds else "0000-00-00 00:00:00"
    return shown + _fraction(part, digits), at + 4 + n


def _datetime2(data: bytes, at: int, digits: int):
    n = (digits + 1) // 2
    packed, part = int.from_bytes(data[at : at + 5], "big") - (1 << 39), int.from_bytes(data[at + 5 : at + 5 + n], "big")
    month, day, clock = packed >> 22, packed >> 17 & 31, packed & 0x1FFFF
    return f"{month // 13:04d}-{month % 13:02d}-{day:02d} {clock >> 12:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}" + _fraction(part, digits), at + 5 + n


def _time2(data: bytes, at: int, digits: int):
    n = (digits + 1) // 2
    # Whole and fraction are one number around a bias, so its absolute value has both.
    packed = int.from_bytes(data[at : at + 3 + n], "big") - (1 << (23 + 8 * n))
    clock, part = abs(packed) >> (8 * n), abs(packed) & ((1 << (8 * n)) - 1)
    return f"{'-' if packed < 0 else ''}{clock >> 12 & 0x3FF:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}" + _fraction(part, digits), at + 3 + n


def _old_date(data: bytes, at: int, _: int):
    v = int.from_bytes(data[at : at + 3], "little")
    return f"{v >> 9:04d}-{v >> 5 & 15:02d}-{v & 31:02d}", at + 3


def _old_time(data: bytes, at: int, _: int):
    v = int.from_bytes(data[at : at + 3], "little", signed=True)
    return f"{'-' if v < 0 else ''}{abs(v) // 10000:02d}:{abs(v) // 100 % 100:02d}:{abs(v) % 100:02d}", at + 3


def _old_datetime(data: bytes, at: int, _: int):
    t = f"{int.from_bytes(data[at : at + 8], 'little'):014d}"
    return f"{t[:4]}-{t[4:6]}-{t[6:8]} {t[8:10]}:{t[10:12]}:{t[12:]}", at + 8


def _text(data: bytes, at: int, width: int, binary: bool = False):
    n = int.from_bytes(data[at : at + width], "little")
    raw = data[at + width : at + width + n]
    return (raw.hex() if binary else raw.decode("utf-8", "surrogateescape")), at + width + n


def _string(data: bytes, at: int, meta: int, unsigned: bool, binary: bool):
    kind, most = meta >> 8, meta & 0xFF
    if kind in (ENUM, SET):
        return int.from_bytes(data[at : at + most], "little"), at + most
    # Lengths above 255 have two bits of theirs in the type.
    most |= ((kind & 0x30) ^ 0x30) << 4
    return _text(data, at, 2 if most > 255 else 1, binary)


def _json(data: bytes, at: int, width: int):
    from tidelog.sources.binary_json import decode

    n = int.from_bytes(data[at : at + width], "little")
    return decode(data[at + width : at + width + n]), at + width + n


def _integer(width: int) -> Callable:
    return lambda data, at, meta, unsigned, binary: (int.from_bytes(data[at : at + width], "little", signed=not unsigned), at + width)


def _plain(read: Callable) -> Callable:
    return lambda data, at, meta, unsigned, binary: read(data, at, meta)


_CELLS: dict[int, Callable] = {
    TINY: _integer(1), SHORT: _integer(2), INT24: _integer(3), LONG: _integer(4), LONGLONG: _integer(8),
    FLOAT: _plain(lambda d, at, m: (struct.unpack_from("<f", d, at)[0], at + 4)), DOUBLE: _plain(lambda d, at, m: (struct.unpack_from("<d", d, at)[0], at + 8)),
    YEAR: _plain(lambda d, at, m: (d[at] + 1900 if d[at] else 0, at + 1)), NULL: _plain(lambda d, at, m: (None, at)),
    TIMESTAMP: _plain(lambda d, at, m: _timestamp2(d[at : at + 4][::-1], 0, 0)[:1] + (at + 4,)), DATE: _plain(_old_date), NEWDATE: _plain(_old_date), TIME: _plain(_old_time), DATETIME: _plain(_old_datetime),
    TIMESTAMP2: _plain(_timestamp2), DATETIME2: _plain(_datetime2), TIME2: _plain(_time2), DECIMAL: _plain(lambda d, at, m: decimal_at(d, at, m >> 8, m & 0xFF)),
    VARCHAR: lambda d, at, m, u, b: _text(d, at, 2 if m > 255 else 1, b), VAR_STRING: lambda d, at, m, u, b: _text(d, at, 2 if m > 255 else 1, b), STRING: _string,
    ENUM: _plain(lambda d, at, m: (int.from_bytes(d[at : at + (m & 0xFF)], "little"), at + (m & 0xFF))), SET: _plain(lambda d, at, m: (int.from_bytes(d[at : at + (m & 0xFF)], "little"), at + (m & 0xFF))),
    BIT: _plain(lambda d, at, m: (int.from_bytes(d[at : at + (m >> 8) + ((m & 0xFF) > 0)], "big"), at + (m >> 8) + ((m & 0xFF) > 0))),
    JSON: _plain(_json), **dict.fromkeys((TINY_BLOB, MEDIUM_BLOB, LONG_BLOB, BLOB), lambda d, at, m, u, b: _text(d, at, m, b)), GEOMETRY: lambda d, at, m, u, b: _text(d, at, m, True),
}


def _image(data: bytes, at: int, table: TableMap, present: list[int], unsigned: frozenset[int], binary: frozenset[int]) -> tuple[list, int]:
    """One row image: its null bits, then the values that are not null."""
    nulls = data[at : at + (len(present) + 7) // 8]
    at += len(nulls)
    out = []
    for k, c in enumerate(present):
        if nulls[k >> 3] >> (k & 7) & 1:
            out.append(None)
            continue
        kind = table.kinds[c]
        if kind not in _CELLS:
            raise ValueError(f"unknown column type {kind}")
        value, at = _CELLS[kind](data, at, table.meta[c], c in unsigned, c in binary)
        out.append(value)
    return out, at


def rows_of(kind: int, body: bytes, table: TableMap, unsigned: frozenset[int] = frozenset(), binary: frozenset[int] = frozenset()) -> Iterator[tuple[list | None, list | None]]:
    """(before, after) of each change in a rows event. Partial images are refused."""
    at = 8
    if kind >= 30:
        at += int.from_bytes(body[8:10], "little")
    count, at = length_at(body, at)
    if count != len(table.kinds):
        raise ValueError("rows event does not fit its table map")
    bits = (count + 7) // 8
    maps = 2 if ROWS[kind] == "UPDATE" else 1
    for k in range(maps):
        if any(not body[at + k * bits + (c >> 3)] >> (c & 7) & 1 for c in range(count)):
            raise ValueError("partial row image")
    at += maps * bits
    every = list(range(count))
    while at < len(body):
        first, at = _image(body, at, table, every, unsigned, binary)
        if ROWS[kind] == "UPDATE":
            second, at = _image(body, at, table, every, unsigned, binary)
            yield first, second
        else:
            yield (None, first) if ROWS[kind] == "INSERT" else (first, None)


def query_of(body: bytes) -> tuple[str, str]:
    """(database, statement) of a query event."""
    db, status = body[8], int.from_bytes(body[11:13], "little")
    at = 13 + status
    return body[at : at + db].decode(), body[at + db + 1 :].decode("utf-8", "replace")


def _default(v):
    return str(v) if isinstance(v, Decimal) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def _shape(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for f, p, e, checksum in zip(pdf["file"], pdf["pos"], pdf["event"], pdf["checksum"], strict=True):
            kind, body = e[4], bytes(e[_HEADER : len(e) - 4 if checksum else len(e)])
            has_table = kind == TABLE_MAP or kind in ROWS
            rows.append((f, p, kind, int.from_bytes(body[:6], "little") if has_table else -1, body, int.from_bytes(e[:4], "little")))
        yield pd.DataFrame(rows, columns=["file", "pos", "kind", "table_id", "body", "at"])


def _checked(events: DataFrame, checksum: bool | None) -> DataFrame:
    """`events` with whether a checksum ends each; if it isn't given, each file's FORMAT event tells.

    That event ends with the number of the checksum's kind (0 for none) and four bytes of its own."""
    if checksum is not None:
        return events.withColumn("checksum", F.lit(checksum))
    last = F.hex(F.expr("substring(event, length(event) - 4, 1)"))
    formats = events.filter(F.hex(F.expr("substring(event, 5, 1)")) == f"{FORMAT:02X}").groupBy("file").agg(F.max(last == "01").alias("checksum"))
    return events.join(formats, "file", "left").withColumn("checksum", F.coalesce("checksum", F.lit(False)))


def gtid_of(body: bytes) -> tuple[str, int]:
    """(server id, number) of a GTID event."""
    return str(uuid.UUID(bytes=bytes(body[1:17]))), int.from_bytes(body[17:25], "little")


def _decoded(names: dict[tuple[str, str], list[str]], unsigned: dict[tuple[str, str], frozenset[int]], binary: dict[tuple[str, str], frozenset[int]]):
    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                head = (r.file, r.pos)
                if r.kind == QUERY:
                    db, sql = query_of(bytes(r.body))
                    out.append((*head, 0, r.at, db, "", "ddl", None, None, sql))
                elif r.kind == XID:
                    out.append((*head, 0, r.at, "", "", "commit", None, None, ""))
                elif r.kind == GTID:
                    sid, number = gtid_of(r.body)
                    out.append((*head, 0, r.at, "", "", "gtid", None, None, f"{sid}:{number}"))
                elif r.kind in ROWS:
                    if r.map is None:
                        raise ValueError(f"no table map before the rows event at {r.file}:{r.pos}")
                    table = table_map(bytes(r.map))
                    key = (table.db, table.name)
                    known = names.get(key, [])
                    columns = [known[c] if c < len(known) else f"@{c + 1}" for c in range(len(table.kinds))]
                    shown = lambda image, columns=columns: None if image is None else json.dumps(dict(zip(columns, image, strict=True)), default=_default, ensure_ascii=False)
                    for k, (before, after) in enumerate(rows_of(r.kind, bytes(r.body), table, unsigned.get(key, frozenset()), binary.get(key, frozenset()))):
                        out.append((*head, k, r.at, *key, "row", shown(before), shown(after), ""))
            yield pd.DataFrame(out, columns=["file", "pos", "row", "at", "db", "tbl", "kind", "before", "after", "sql"])

    return of


def decode(events: DataFrame, names: dict[tuple[str, str], list[str]] | None = None, unsigned: dict | None = None, binary: dict | None = None, checksum: bool | None = None) -> DataFrame:
    """(file, pos, row, at, db, tbl, kind, before, after, sql) of raw events (file, pos, event).

    `names` has tables' column names, `unsigned` and `binary` the numbers of such columns: the log
    tells neither. Columns without a name are @1, @2, ... A GTID event's text is in `sql`.
    """
    shaped = _checked(events, checksum).mapInPandas(_shape, "file string, pos long, kind int, table_id long, body binary, at long")
    needed = shaped.filter(F.col("kind").isin(QUERY, XID, GTID, TABLE_MAP, *ROWS))
    last = Window.partitionBy("file", "table_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # Events without a table need none; they are not dealt by table id.
    with_table = needed.filter("table_id >= 0").withColumn("map", F.last(F.when(F.col("kind") == TABLE_MAP, F.col("body")), ignorenulls=True).over(last))
    others = needed.filter("table_id < 0").withColumn("map", F.lit(None).cast("binary"))
    schema = "file string, pos long, row int, at long, db string, tbl string, kind string, before string, after string, sql string"
    rows = with_table.filter(F.col("kind") != TABLE_MAP).unionByName(others)
    return rows.mapInPandas(_decoded(names or {}, unsigned or {}, binary or {}), schema)


def changelog(decoded: DataFrame) -> DataFrame:
    """The canonical changelog (see `changelog.py`) of decoded events; images stay JSON texts.

    `seq` is the file's number and the place in it; each row of an event has a place of its own, for no
    row takes less than a byte. An event belongs to the GTID event before it in its file, and `commit`
    marks the last event before the transaction's end. Both are looked up within a file, whose size the
    server bounds; nothing runs over the whole log. A statement that commits by itself ends its transaction.
    """
    number = F.coalesce(F.regexp_extract("file", r"(\d+)$", 1).try_cast("long"), F.lit(0))
    along = Window.partitionBy("file").orderBy("seq")
    placed = decoded.withColumn("seq", number * (1 << 40) + F.col("pos") + F.col("row"))
    gtid = F.last(F.when(F.col("kind") == "gtid", F.struct(F.col("sql").alias("text"), F.col("seq").alias("began"))), ignorenulls=True).over(along)
    ends = F.lead("kind").over(along)
    told = placed.withColumns({"_g": gtid, "commit": F.coalesce(ends.isin("commit", "gtid"), F.lit(True))})
    events = told.filter(F.col("kind").isin("row", "ddl"))
    text = F.col("_g.text")
    return events.select(
        "seq", F.col("_g.began").alias("txn_id"), F.substring_index(text, ":", 1).alias("gtid_sid"), F.substring_index(text, ":", -1).cast("long").alias("gtid_seq"),
        "db", "tbl", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), "commit", "kind", "before", "after", "sql",
    )


def typed(decoded: DataFrame, db: str, tbl: str, schema: T.StructType) -> DataFrame:
    """One table's changes with typed images."""
    mine = decoded.filter((F.col("kind") == "row") & (F.col("db") == db) & (F.col("tbl") == tbl))
    return mine.withColumns({i: F.from_json(i, schema) for i in ("before", "after")})
