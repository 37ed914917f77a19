"""MySQL's binary JSON as Python values, numbers exact."""

from __future__ import annotations

import struct
from decimal import Decimal

_SCALARS = {5: ("<h", 2), 6: ("<H", 2), 7: ("<i", 4), 8: ("<I", 4), 9: ("<q", 8), 10: ("<Q", 8), 11: ("<d", 8)}
_LITERALS = {0: None, 1: True, 2: False}


def decode(data: bytes):
    """The value of a document; an empty one is null."""
    return _value(data[0], data, 1) if data else None


def _value(kind: int, data: bytes, at: int):
    if kind <= 3:
        return _container(data, at, is_object=kind < 2, wide=bool(kind & 1))
    if kind == 4:
        return _LITERALS[data[at]]
    if kind in _SCALARS:
        form, _ = _SCALARS[kind]
        return struct.unpack_from(form, data, at)[0]
    if kind == 12:
        size, at = _size(data, at)
        return data[at : at + size].decode()
    if kind == 15:
        return _opaque(data, at)
    raise ValueError(f"unknown JSON type {kind}")


def _size(data: bytes, at: int) -> tuple[int, int]:
    """A length of seven bits a byte, the lowest first."""
    out = shift = 0
    while True:
        out |= (data[at] & 0x7F) << shift
        shift += 7
        at += 1
        if not data[at - 1] & 0x80:
            return out, at


def _container(data: bytes, at: int, is_object: bool, wide: bool):
    form, step = ("<I", 4) if wide else ("<H", 2)
    number = lambda p: struct.unpack_from(form, data, p)[0]
    count, keys_at = number(at), at + 2 * step
    values_at = keys_at + (count * (step + 2) if is_object else 0)
    inline = {4, 5, 6, 7, 8} if wide else {4, 5, 6}
    out = []
    for k in range(count):
        entry = values_at + k * (1 + step)
        kind = data[entry]
        out.append(_value(kind, data, entry + 1 if kind in inline else at + number(entry + 1)))
    if not is_object:
        return out
    names = []
    for k in range(count):
        entry = keys_at + k * (step + 2)
        begin = at + number(entry)
        names.append(data[begin : begin + struct.unpack_from("<H", data, entry + step)[0]].decode())
    return dict(zip(names, out, strict=True))


def _opaque(data: bytes, at: int):
    """Values of column types that JSON lacks: decimals, dates and times as text."""
    from tidelog.sources.binlog import DATE, DATETIME, DECIMAL, TIME, TIMESTAMP, decimal_at

    kind = data[at]
    size, at = _size(data, at + 1)
    body = data[at : at + size]
    if kind == DECIMAL:
        return Decimal(decimal_at(body, 2, body[0], body[1])[0])
    if kind in (DATE, DATETIME, TIMESTAMP, TIME):
        packed = struct.unpack("<q", body)[0]
        sign, packed = ("-", -packed) if packed < 0 else ("", packed)
        micros, whole = packed & 0xFFFFFF, packed >> 24
        if kind == TIME:
            return f"{sign}{whole >> 12 & 0x3FF:02d}:{whole >> 6 & 63:02d}:{whole & 63:02d}.{micros:06d}"
        day, clock = whole >> 17, whole & 0x1FFFF
        date = f"{(day >> 5) // 13:04d}-{(day >> 5) % 13:02d}-{day & 31:02d}"
        return date if kind == DATE else f"{date} {clock >> 12:02d}:{clock >> 6 & 63:02d}:{clock & 63:02d}.{micros:06d}"
    return body.decode("utf-8", "replace")
