"""Decoders on hand-made events."""

import json
import struct

import pytest
from pyspark.sql import types as T

from tidelog.sources import binlog as bl
from tidelog.sources.binary_json import decode as decode_json

KINDS = bytes([bl.LONG, bl.VARCHAR, bl.DECIMAL, bl.DATETIME2, bl.TIME2, bl.LONGLONG, bl.JSON])
META = struct.pack("<H", 40) + bytes([5, 2]) + bytes([3]) + bytes([2]) + bytes([4])


def event(kind, body):
    return struct.pack("<IBIIIH", 1_600_000_000, kind, 1, 19 + len(body), 0, 0) + body


def table(name=b"t"):
    body = (7).to_bytes(6, "little") + b"\0\0" + bytes([2]) + b"db\0" + bytes([len(name)]) + name + b"\0"
    return event(bl.TABLE_MAP, body + bytes([len(KINDS)]) + KINDS + bytes([len(META)]) + META + b"\x7f")


def packed_decimal(text):
    """decimal(5, 2): three digits in two bytes, two in one."""
    whole, part = text.lstrip("-").split(".")
    raw = bytearray(int(whole).to_bytes(2, "big") + int(part).to_bytes(1, "big"))
    if text[0] == "-":
        raw = bytearray(b ^ 0xFF for b in raw)
    raw[0] ^= 0x80
    return bytes(raw)


def datetime2(y, mo, d, h, mi, s, fraction, digits):
    packed = ((y * 13 + mo) << 22 | d << 17 | h << 12 | mi << 6 | s) + (1 << 39)
    return packed.to_bytes(5, "big") + fraction.to_bytes((digits + 1) // 2, "big")


def time2(negative, h, m, s, fraction, digits):
    n = (digits + 1) // 2
    v = (h << 12 | m << 6 | s) << (8 * n) | fraction
    return ((-v if negative else v) + (1 << (23 + 8 * n))).to_bytes(3 + n, "big")


def small_json(pairs):
    """A small object of int16 values."""
    n = len(pairs)
    keys_at = 4 + n * 4 + n * 3
    keys = b"".join(k.encode() for k in pairs)
    head, at = b"", keys_at
    for k in pairs:
        head += struct.pack("<HH", at, len(k))
        at += len(k)
    for v in pairs.values():
        head += bytes([5]) + struct.pack("<h", v)
    return b"\0" + struct.pack("<HH", n, at) + head + keys


def image(i, text, dec, big, js, null_text=False):
    nulls = bytes([2 if null_text else 0])
    out = nulls + struct.pack("<i", i)
    if not null_text:
        out += bytes([len(text)]) + text
    return out + packed_decimal(dec) + datetime2(2021, 3, 4, 5, 6, 7, 1230, 3) + time2(True, 1, 2, 3, 50, 2) + struct.pack("<Q", big) + struct.pack("<I", len(js)) + js


def rows(kind, *images):
    maps = 2 if kind == 31 else 1
    return event(kind, (7).to_bytes(6, "little") + b"\0\0" + struct.pack("<H", 2) + bytes([7]) + b"\x7f" * maps + b"".join(images))


def test_cells_and_events(spark):
    a = image(-5, "häß".encode(), "-12.05", (1 << 64) - 1, small_json({"k": -3}))
    b = image(6, b"", "0.50", 1 << 60, small_json({"k": 4}), null_text=True)
    query = struct.pack("<IIBHH", 1, 0, 2, 0, 0) + b"db\0alter table t add c int"
    log = [table(), rows(30, a, b), rows(31, a, b), event(bl.XID, b"\0" * 8), event(bl.QUERY, query), rows(32, b)]
    raw = spark.createDataFrame([("f1", k, bytearray(e)) for k, e in enumerate(log)], "file string, pos long, event binary")
    names = {("db", "t"): ["id", "name", "price", "at", "took", "big"]}
    out = sorted(bl.decode(raw, names, unsigned={("db", "t"): frozenset([5])}).collect(), key=lambda r: (r.pos, r.row))
    assert [(r.pos, r.row, r.kind) for r in out] == [(1, 0, "row"), (1, 1, "row"), (2, 0, "row"), (3, 0, "commit"), (4, 0, "ddl"), (5, 0, "row")]
    first = json.loads(out[0].after)
    assert first == {"id": -5, "name": "häß", "price": "-12.05", "at": "2021-03-04 05:06:07.123", "took": "-01:02:03.50", "big": (1 << 64) - 1, "@7": {"k": -3}}
    second = json.loads(out[1].after)
    assert second["name"] is None and second["price"] == "0.50" and second["big"] == 1 << 60
    assert (json.loads(out[2].before), json.loads(out[2].after)) == (first, second)
    assert (out[4].db, out[4].sql) == ("db", "alter table t add c int") and out[5].after is None
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("price", T.DecimalType(5, 2))])
    got = bl.typed(bl.decode(raw, names), "db", "t", schema).filter("pos = 1 and row = 0").first()
    assert got.after.id == -5 and str(got.after.price) == "-12.05"


def test_a_rows_event_needs_a_full_image_and_a_map(spark):
    t = bl.table_map(table()[19:])
    body = (7).to_bytes(6, "little") + b"\0\0" + struct.pack("<H", 2) + bytes([7]) + b"\x3f"
    with pytest.raises(ValueError, match="partial row image"):
        list(bl.rows_of(30, body, t))
    lone = spark.createDataFrame([("f", 1, bytearray(rows(32, image(1, b"x", "1.00", 1, small_json({"k": 1})))))], "file string, pos long, event binary")
    with pytest.raises(Exception, match="no table map"):
        bl.decode(lone).collect()


def test_old_formats():
    assert bl._old_date((2020 << 9 | 2 << 5 | 29).to_bytes(3, "little"), 0, 0)[0] == "2020-02-29"
    assert bl._old_time((-1234567).to_bytes(3, "little", signed=True), 0, 0)[0] == "-123:45:67"
    assert bl._old_datetime((20200229123456).to_bytes(8, "little"), 0, 0)[0] == "2020-02-29 12:34:56"
    assert bl._timestamp2((0).to_bytes(4, "big"), 0, 0)[0] == "0000-00-00 00:00:00"
    assert bl._CELLS[bl.TIMESTAMP]((86400).to_bytes(4, "little"), 0, 0, False, False) == ("1970-01-02 00:00:00", 4)
    assert bl.length_at(b"\xfc\x01\x02", 0) == (513, 3)
    assert bl._string(bytes([2]), 0, bl.ENUM << 8 | 1, False, False) == (2, 1)


def test_json_values():
    assert decode_json(b"") is None and decode_json(b"\x04\x01") is True
    # An array of a literal, an inline number and a string behind it.
    body = struct.pack("<HH", 3, 16) + bytes([4, 0, 0]) + bytes([5]) + struct.pack("<h", -7) + bytes([12]) + struct.pack("<H", 13) + b"\x02ab"
    assert decode_json(b"\x02" + body) == [None, -7, "ab"]
    assert decode_json(b"\x09" + struct.pack("<q", (1 << 53) + 1)) == (1 << 53) + 1
    assert str(decode_json(b"\x0f\xf6\x05\x05\x02" + packed_decimal("-12.05"))) == "-12.05"
