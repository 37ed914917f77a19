"""Texts as baseline JPEG images, without loss, and DC-only thumbnails decoded from them.

A payload (the text's UTF-8 bytes, zeros up to a positive multiple of 64) is a grey image of flat
8 x 8 blocks, one byte a block and 64 blocks a row. With a DC quantiser of 8 a flat block of value v
has the quantised coefficient v - 128, exactly; all AC coefficients are 0. Each row of blocks is a
restart interval. Payloads beyond `ROWS` rows are stored as several images, one behind the other.

The decoder parses the markers, takes quantiser, Huffman tables, dimensions and restart interval
from them, and decodes the scan's DC coefficients; the block means it reconstructs are the image's
thumbnail, one luminance sample for each block. All restart intervals of a batch of images are
decoded together, a symbol of each at a time, in numpy. AC symbols are decoded and skipped. Files of
other encoders may have several components with sampling factors, in one scan or one scan each: the
first component, the luminance, is kept. `thumbnails` reads a column of such files.

Defined results: a null or empty text is one row of 64 zeros; equal texts have equal bytes; longer
texts have more rows, whatever their length; other columns are not carried. A file that is no baseline
JPEG of 8 bits, or is cut off, has a null thumbnail and says why; a null file has nulls alone.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import column, sliced

COLUMNS = 64
#: Block rows that an image of 16-bit height holds.
ROWS = 65_535 // 8
#: Payload bytes encoded or decoded at once.
SLICE = 1 << 20

# Huffman code lengths: a DC category's from 2 to 7 bits, by how often text steps so far; the only AC
# symbols are end of block, and the run of 16 zeros that no image here has.
_DC_LENGTHS = {0: 5, 1: 5, 2: 4, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 8: 5}
_AC_LENGTHS = {0x00: 1, 0xF0: 2}
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_SHAPE = "doc_id long, n_bytes long, width int, height int, media binary, thumbnail binary, feature string"


def _codes(lengths: dict[int, int]) -> tuple[list[int], list[int], dict[int, tuple[int, int]]]:
    """(counts by length 1-16, symbols in order, symbol -> (code, length)): canonical codes."""
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, before = [0] * 16, {}, 0, 0
    for s in symbols:
        code <<= lengths[s] - before
        before = lengths[s]
        codes[s] = (code, before)
        counts[before - 1] += 1
        code += 1
    return counts, symbols, codes


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    tables = b""
    for kind, lengths in ((0x00, _DC_LENGTHS), (0x10, _AC_LENGTHS)):
        counts, symbols, _ = _codes(lengths)
        tables += _segment(0xC4, bytes([kind, *counts, *symbols]))
    size = (8 * rows).to_bytes(2, "big") + (8 * COLUMNS).to_bytes(2, "big")
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        _segment(0xDB, bytes([0, 8, *[1] * 63])),
        _segment(0xC0, b"\x08" + size + b"\x01\x01\x11\0"),
        tables,
        _segment(0xDD, COLUMNS.to_bytes(2, "big")),
        _segment(0xDA, b"\x01\x01\0\0\x3f\0"),
    ))


def _block_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and bit count of a whole block, by its DC difference + 255: category, amplitude, end."""
    dc, (end, end_bits) = _codes(_DC_LENGTHS)[2], _codes(_AC_LENGTHS)[2][0]
    bits, count = np.zeros(511, np.int64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        code, n = dc[category]
        amplitude = d if d >= 0 else d + (1 << category) - 1
        bits[d + 255] = (((code << category) | amplitude) << end_bits) | end
        count[d + 255] = n + category + end_bits
    return bits, count


_BITS, _COUNT = _block_codes()


def _scans(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with stuffing, bytes per row) of the restart intervals of block rows, markers left out."""
    level = samples.reshape(-1, COLUMNS).astype(np.int64) - 128
    step = np.diff(level, axis=1, prepend=0) + 255
    bits, count = _BITS[step], _COUNT[step]
    ends = np.cumsum(count, axis=1)
    length = (ends[:, -1] + 7) // 8
    origin = np.cumsum(length) - length
    at = (ends - count) + 8 * origin[:, None]
    total = int(length.sum())
    # A code has at most 16 bits, so it touches three bytes.
    shifted = (bits << (24 - count - (at & 7))).ravel()
    first = (at >> 3).ravel()
    out = np.zeros(total + 3)
    for k in range(3):
        out[: total + 3] += np.bincount(first + k, (shifted >> (16 - 8 * k)) & 255, total + 3)
    out = out[:total].astype(np.uint8)
    # The last byte of an interval is filled with ones.
    out[origin + length - 1] |= ((1 << (8 * length - ends[:, -1])) - 1).astype(np.uint8)
    stuffed = out == 0xFF
    if stuffed.any():
        row = np.repeat(np.arange(len(length)), length)
        length = length + np.bincount(row[stuffed], minlength=len(length))
        out = np.insert(out, np.flatnonzero(stuffed) + 1, 0)
    return out, length


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 64 bytes, as one JPEG file or several in a row."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    body, length = _scans(joined)
    # Each interval is followed by its restart marker, or by the end of the image.
    rows = np.array([len(p) // COLUMNS for p in payloads])
    number = np.arange(len(length)) - np.repeat(np.cumsum(rows) - rows, rows)
    within = number % ROWS
    marked = np.insert(body, np.repeat(np.cumsum(length), 2), np.stack((np.full(len(length), 0xFF), 0xD0 + within % 8), 1).ravel().astype(np.uint8))
    ends = np.cumsum(length + 2).tolist()
    raw, out, row = marked.tobytes(), [], 0
    for n in rows.tolist():
        parts = []
        for a in range(0, n, ROWS):
            b = min(a + ROWS, n)
            begin, end = ends[row + a - 1] if row + a else 0, ends[row + b - 1]
            parts += (_header(b - a), raw[begin : end - 2], b"\xff\xd9")
        row += n
        out.append(b"".join(parts))
    return out


def _parsed(media: bytes) -> Iterator[dict]:
    """The images in a byte string: tables, dimensions, restart interval, place of the scan."""
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        image: dict = {"quantisers": {}, "tables": {}, "restart": 0}
        while True:
            if media[at] != 0xFF:
                raise ValueError("no marker")
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            body = media[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    image["quantisers"][body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    image["tables"][body[0]] = body[1 : 17 + n]
                    body = body[17 + n :]
            elif marker in (0xC0, 0xC1):
                image["height"], image["width"] = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                if body[0] != 8 or not image["height"] or not image["width"]:
                    raise ValueError("only samples of 8 bits and known dimensions are decoded")
                image["parts"] = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)}
            elif marker == 0xDD:
                image["restart"] = int.from_bytes(body, "big")
            elif marker == 0xDA:
                scan = {body[k]: (image["tables"][body[k + 1] >> 4], image["tables"][0x10 | body[k + 1] & 15]) for k in range(1, 1 + 2 * body[0], 2)}
                if next(iter(image["parts"])) in scan:
                    _shape_of(image, scan)
                    break
                at = _marker_after(media, at)
            elif marker == 0xD9:
                raise ValueError("no scan of the luminance")
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline images are decoded")
        image["begin"], image["end"] = at, _marker_after(media, at)
        end = media.find(b"\xff\xd9", image["end"])
        if end < 0:
            raise ValueError("no end of image")
        at = end + 2
        yield image


def _marker_after(media: bytes, at: int) -> int:
    """Where a scan's data end: at the next marker but restarts."""
    m = _MARKER.search(media, at)
    if not m:
        raise ValueError("no end of scan")
    return m.start()


def _shape_of(image: dict, scan: dict) -> None:
    """The blocks of a scan: tables by block within a unit, units, and how the luminance lies in them."""
    luminance = next(iter(image["parts"]))
    across, down, image["quantiser"] = image["parts"][luminance]
    widest, highest = (max(p[k] for p in image["parts"].values()) for k in (0, 1))
    samples = -(-image["width"] * across // widest), -(-image["height"] * down // highest)
    image["columns"], image["rows"] = -(-samples[0] // 8), -(-samples[1] // 8)
    if len(scan) == 1:
        across = down = 1
        image["pattern"], units = ((*scan[luminance], True, luminance),), (image["columns"], image["rows"])
    else:
        image["pattern"] = tuple((*tables, part == luminance, part) for part, tables in scan.items() for _ in range(image["parts"][part][0] * image["parts"][part][1]))
        units = -(-image["width"] // (8 * widest)), -(-image["height"] // (8 * highest))
    image["unit"], image["units"] = (across, down), units


def _lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, code length) by the next 16 bits of the scan."""
    symbol, bits = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    code, at, k = 0, 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            symbol[at : at + (1 << (16 - n))], bits[at : at + (1 << (16 - n))] = table[k], n
            at += 1 << (16 - n)
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, bits


def decode(media: list[bytes]) -> list[tuple[int, int, bytes]]:
    """(width, height, DC thumbnail) of each byte string; images in a row are stacked."""
    found = [list(_parsed(m)) for m in media]
    groups: dict[tuple, list[tuple[int, int, dict]]] = {}
    for m, images in enumerate(found):
        for k, image in enumerate(images):
            total = image["units"][0] * image["units"][1]
            key = (image["pattern"], image["quantisers"][image["quantiser"]], image["restart"] or total)
            groups.setdefault(key, []).append((m, k, image))
    thumbnails: dict[tuple[int, int], bytes] = {}
    for (pattern, quantiser, restart), members in groups.items():
        scans = [np.frombuffer(media[m], np.uint8)[i["begin"] : i["end"]] for m, _, i in members]
        samples = _dc_samples(scans, [i["units"][0] * i["units"][1] for _, _, i in members], pattern, quantiser, restart)
        for (m, k, image), s in zip(members, samples, strict=True):
            thumbnails[m, k] = _raster(s, image)
    return [
        (images[0]["width"], sum(i["height"] for i in images), b"".join(thumbnails[m, k] for k in range(len(images))))
        for m, images in enumerate(found)
    ]


def _raster(samples: np.ndarray, image: dict) -> bytes:
    """Luminance samples in the order of the scan, by rows, without what lies beyond the image."""
    (across, down), (units, rows) = image["unit"], image["units"]
    if (across, down) == (1, 1):
        return samples.reshape(rows, units)[: image["rows"], : image["columns"]].tobytes()
    blocks = samples.reshape(rows, units, down, across).swapaxes(1, 2).reshape(rows * down, units * across)
    return np.ascontiguousarray(blocks[: image["rows"], : image["columns"]]).tobytes()


def _dc_samples(scans: list[np.ndarray], units: list[int], pattern: tuple, quantiser: int, restart: int) -> list[np.ndarray]:
    """The luminance's block means of each scan, in the scan's order.

    `pattern` has the tables of each block of a unit and whether it is luminance; `restart` is in units."""
    blocks, restart = [n * len(pattern) for n in units], restart * len(pattern)
    data = np.concatenate([*scans, np.zeros(8, np.uint8)])
    # Stuffed zeros and restart markers go; where an interval begins is kept.
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xFF
    mark = after & (data >= 0xD0) & (data <= 0xD7)
    drop = (after & (data == 0)) | mark
    drop[:-1] |= mark[1:]
    kept_before = np.cumsum(~drop) - ~drop
    first = np.cumsum([0, *(len(s) for s in scans)])[:-1]
    begins = np.sort(np.concatenate((first, np.flatnonzero(mark) + 1)))
    starts = kept_before[begins]
    data = data[~drop]
    per_image = [-(-n // restart) for n in blocks]
    if sum(per_image) != len(starts):
        raise ValueError("restart markers don't fit the restart interval")
    lanes = np.concatenate([np.minimum(restart, n - restart * np.arange(k)) for n, k in zip(blocks, per_image, strict=True)])
    # The next 32 bits at any byte, so that a symbol and its amplitude are one look away.
    d = data.astype(np.uint32)
    word = (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]
    word = np.append(word, np.zeros(8, np.uint32))
    tables = {t: _lookup(t) for part in pattern for t in part[:2]}
    predictor = _predictors(pattern)
    bit, levels = starts * 8, {p: np.zeros(len(starts), np.int64) for p in predictor}
    width = int(lanes.max())
    kept = np.flatnonzero([pattern[k % len(pattern)][2] for k in range(width)])
    place = {int(k): n for n, k in enumerate(kept)}
    out = np.zeros((len(starts), len(kept)), np.int64)
    every = int(lanes.min())
    live = np.arange(len(starts))
    for k in range(width):
        dc, ac = pattern[k % len(pattern)][:2]
        (dc_symbol, dc_bits), (ac_symbol, ac_bits) = tables[dc], tables[ac]
        level = levels[predictor[k % len(pattern)]]
        if k >= every:
            live = np.flatnonzero(lanes > k)
        at = bit[live] if k >= every else bit
        look = _look(word, at)
        category = dc_symbol[look]
        at = at + dc_bits[look]
        amplitude = (_look(word, at) >> (16 - category)).astype(np.int64)
        at = at + category
        half = (1 << category) >> 1
        step = np.where(amplitude < half, amplitude - (1 << category) + 1, amplitude)
        level[live] += step
        if k in place:
            out[live, place[k]] = level[live]
        # AC symbols up to the end of the block.
        coefficient, busy = np.ones(len(at), np.int64), np.arange(len(at))
        while len(busy):
            look = _look(word, at[busy])
            symbol = ac_symbol[look]
            at[busy] += ac_bits[look] + (symbol & 15)
            coefficient[busy] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
            busy = busy[coefficient[busy] < 64]
        bit[live] = at
    # A block's mean: DC x quantiser / 8, around 128.
    value = np.clip(np.rint(out * quantiser / 8) + 128, 0, 255).astype(np.uint8)
    flat = value.ravel() if every == width else value[kept[None, :] < lanes[:, None]]
    own = sum(p[2] for p in pattern)
    ends = np.cumsum([n * own for n in units])
    return [flat[e - n * own : e] for e, n in zip(ends.tolist(), units, strict=True)]


def _predictors(pattern: tuple) -> list[int]:
    """Whose DC each block of a unit goes on from: blocks of one component stand together."""
    out = [0]
    for k in range(1, len(pattern)):
        out.append(out[-1] + (pattern[k][3] != pattern[k - 1][3]))
    return out


def _look(word: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """The 16 bits at a bit place."""
    return (word[bit >> 3] >> (16 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)


def difference_hash(thumbnail: bytes, columns: int = COLUMNS) -> str:
    """64 bits: in an 8 x 9 shrink of the thumbnail, whether each cell is darker than the next."""
    t = np.frombuffer(thumbnail, np.uint8).reshape(-1, columns)
    if columns < 9:
        t, columns = np.repeat(t, -(-9 // columns), axis=1), columns * -(-9 // columns)
    rows = np.arange(8) * len(t) // 8
    strips = np.add.reduceat(t, np.unique(rows), axis=0, dtype=np.int64)[np.searchsorted(np.unique(rows), rows)]
    heights = np.diff(np.append(np.unique(rows), len(t)))[np.searchsorted(np.unique(rows), rows)]
    cols = np.arange(9) * columns // 9
    cells = np.add.reduceat(strips, cols, axis=1) / (np.diff(np.append(cols, columns)) * heights[:, None])
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % COLUMNS if raw else COLUMNS)


def _slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, held = [], 0
    for t in texts:
        n = len(t or "")
        if part and held + n > SLICE:
            yield part
            part, held = [], 0
        part.append(t)
        held += n
    if part:
        yield part


def _stored(texts: list[str | None]) -> Iterator[tuple[bytes, int, tuple[int, int, bytes]]]:
    for part in _slices(texts):
        payloads = [payload_of(t) for t in part]
        media = encode(payloads)
        for t, m, read in zip(part, media, decode(media), strict=True):
            yield m, len((t or "").encode()), read


def _media(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [(n, w, h, m, t, f"{w}x{h}:{difference_hash(t)}") for m, n, (w, h, t) in _stored(pdf["text"].tolist())]
        out = pd.DataFrame(rows, columns=["n_bytes", "width", "height", "media", "thumbnail", "feature"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        yield out


def _digests(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [
            (n, len(t), hashlib.sha256(t).hexdigest(), zlib.crc32(t[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{w}x{h}:{difference_hash(t)}")
            for m, n, (w, h, t) in _stored(pdf["text"].tolist())
        ]
        out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        yield out


def _read(docs: DataFrame) -> DataFrame:
    # An id travels as text, for pandas turns integers beside nulls into floats.
    return docs.select(column(docs, "doc_id", "string").alias("doc_id"), column(docs, "text", "string").alias("text"))


def _with_ids(out: DataFrame) -> DataFrame:
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, width, height, media, thumbnail, feature) for each row of `docs`."""
    return _with_ids(_read(docs).mapInPandas(_media, _SHAPE.replace("doc_id long", "doc_id string")))


def read(media: bytes | None) -> tuple[int | None, int | None, bytes | None, str | None, str | None]:
    """(width, height, thumbnail, its hash, error) of a file of any encoder; images in a row are stacked."""
    if media is None:
        return None, None, None, None, None
    try:
        width, height, thumbnail = decode([bytes(media)])[0]
        return width, height, thumbnail, difference_hash(thumbnail, -(-width // 8)), None
    except (ValueError, IndexError, KeyError, StopIteration) as e:
        return None, None, None, None, f"not decoded: {e}"


def thumbnails(files: DataFrame, media: str = "media") -> DataFrame:
    """`files` with width, height, thumbnail, thumbnail_hash and error of the JPEG files in a binary
    column; its own columns of these names give way."""
    names = ("width", "height", "thumbnail", "thumbnail_hash", "error")
    kept = [c for c in files.columns if c.lower() not in names]
    schema = T.StructType([*(f for f in files.schema if f.name in kept), *(T.StructField(n, t) for n, t in zip(names, (T.IntegerType(), T.IntegerType(), T.BinaryType(), T.StringType(), T.StringType()), strict=True))])
    at = kept.index(media)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [read(m) for m in b.column(at).to_pylist()]
            added = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], [*kept, *names])

    return files.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(of, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The same, with digests in place of the stored and the read bytes."""
    shape = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _with_ids(_read(docs).mapInPandas(_digests, shape))
