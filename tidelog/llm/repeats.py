"""Finding repeated windows in a corpus: routing of candidate segments to bounded shards.

Both exact-substring operators share these steps; they differ in the unit (words or bytes) and in
the index that a shard builds.

1. Rows are dealt into batches of bounded size by a hash of (doc_id, text). Each batch sends its
   distinct window anchors, five or six bytes each, to buckets by hash. A bucket tells each batch which of
   its anchors other batches (or other occurrences) have too. Only those can lead to a repeat, for
   equal windows have equal anchors.
2. Each batch sends the distinct segments around such anchors to shards by anchor. A shard holds all
   segments of its anchors, so equal windows meet there, whatever document they come from. The
   shard's index decides for every window.
3. The verdicts return to the batches, by segment hash, and each text is cut.

An anchor that very many batches share (`hot_batches`) is not one shard's: its windows go out
one by one, by their own hash. A batch sends equal segments once, with their count and least id, so
what one shard gets of a frequent passage is bounded by the number of batches below that limit.
Rows between the steps are (batch, bucket, packed arrays); there are at most as many as anchors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.common import column

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
HOT_BATCHES = 512
_ROUTE = "_batch long, kind int, bucket long, payload binary"
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Unit:
    """What windows are made of: how to hash a text's units, and where they lie in its bytes."""

    words: bool
    window: int
    gram: int


@dataclass
class Segments:
    """Distinct segments of one batch or shard. `least`: smallest doc_id; `times`: occurrences;
    `hot`: whether it is one window of an anchor that very many batches have."""

    anchor: np.ndarray
    segment: np.ndarray
    hot: np.ndarray
    offset: np.ndarray
    count: np.ndarray
    least: np.ndarray
    times: np.ndarray
    size: np.ndarray
    text: bytes

    def pack(self) -> bytes:
        """Without the two hashes, which follow from the rest."""
        head = np.array([len(self.size)], np.int64).tobytes()
        fixed = b"".join(getattr(self, name).astype(kind).tobytes() for name, kind in _PACKED)
        return zlib.compress(head + fixed + self.text, 4)

    @staticmethod
    def unpack(packed: bytes, unit: Unit) -> Segments:
        raw = zlib.decompress(packed)
        n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
        for _, kind in _PACKED:
            out.append(np.frombuffer(raw, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        text = raw[at:]
        hot, offset, count, _, _, size = out
        return Segments(*_hashes(text, size, hot, offset, count, unit), *out, text)


_PACKED = (("hot", "<u1"), ("offset", "<u2"), ("count", "<u2"), ("least", "<i8"), ("times", "<i8"), ("size", "<i8"))


def _hashes(text: bytes, size: np.ndarray, hot: np.ndarray, offset: np.ndarray, count: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, segment) hashes of packed segments."""
    ends = np.cumsum(size).tolist()
    anchor, segment = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    for numbers in hashing.groups(size.tolist(), hashing.CHUNK):
        a, b = numbers[0], numbers[-1] + 1
        buffer = np.frombuffer(b"\n".join(text[ends[k] - int(size[k]) : ends[k]] for k in numbers), np.uint8)
        start = np.cumsum(size[a:b] + 1) - size[a:b] - 1
        if unit.words:
            values, words, _ = hashing.word_hashes(buffer)
            start = np.searchsorted(words, start)
        else:
            values = hashing.byte_values(buffer)
        sums = hashing.prefix(values)
        segment[a:b] = hashing.segment_hash(sums, start, count[a:b], offset[a:b], unit.window)
        own = hashing.ranges(sums, start + offset[a:b], start + offset[a:b] + unit.gram)
        anchor[a:b] = np.where(hot[a:b] == 1, hashing.mixed(own ^ segment[a:b]), own)
    return anchor, segment


@dataclass
class Verdicts:
    """For windows [first, last) of a segment: the smallest doc_id among all that have them, and
    their occurrences."""

    anchor: np.ndarray
    segment: np.ndarray
    first: np.ndarray
    last: np.ndarray
    least: np.ndarray
    times: np.ndarray

    def pack(self) -> bytes:
        return np.array([len(self.anchor)], np.int64).tobytes() + b"".join(x.astype("<u8").tobytes() if k < 2 else x.astype("<i8").tobytes() for k, x in enumerate((self.anchor, self.segment, self.first, self.last, self.least, self.times)))

    @staticmethod
    def unpack(packed: bytes) -> Verdicts:
        n = int(np.frombuffer(packed, np.int64, 1)[0])
        return Verdicts(*(np.frombuffer(packed, np.uint64 if k < 2 else np.int64, n, 8 + 8 * n * k) for k in range(6)))

    @staticmethod
    def joined(parts: list[Verdicts]) -> Verdicts:
        none = [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 4
        columns = ("anchor", "segment", "first", "last", "least", "times")
        return Verdicts(*(np.concatenate([getattr(p, c) for p in parts] or [none[k]]) for k, c in enumerate(columns)))


def _units(texts: list[bytes], unit: Unit) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Pieces of a batch: (values, first, last, from, byte start, byte end, text number)."""
    if unit.words:
        hashed = [hashing.word_hashes(np.frombuffer(t, np.uint8)) for t in texts]
        values = [h[0] for h in hashed]
        begins, ends = [h[1] for h in hashed], [h[2] for h in hashed]
    else:
        values = [np.frombuffer(t, np.uint8) for t in texts]
    for part in hashing.pieces(np.array([len(v) for v in values], np.int64), unit.window):
        v = np.concatenate([values[k][a:b] for k, a, b in part])
        last = np.cumsum([b - a for _, a, b in part])
        first = last - np.array([b - a for _, a, b in part])
        origin = np.array([a for _, a, _ in part], np.int64)
        if unit.words:
            bs = np.concatenate([begins[k][a:b] for k, a, b in part])
            be = np.concatenate([ends[k][a:b] for k, a, b in part])
        else:
            v, bs, be = hashing.byte_values(v), origin, origin
        yield v, first, last, origin, bs, be, [k for k, _, _ in part]


def _runs(texts: list[bytes], unit: Unit, wanted: np.ndarray | None = None, hot: np.ndarray | None = None):
    """Per piece: the runs with a wanted anchor, their text, their first unit in it, and byte bounds."""
    for values, first, last, origin, bs, be, number in _units(texts, unit):
        r = hashing.runs(values, first, last, unit.window, unit.gram)
        if wanted is not None:
            r = r.take(_among(r.anchor >> np.uint64(16), wanted))
        if not len(r):
            continue
        if hot is not None and len(hot) and (burning := _among(r.anchor >> np.uint64(16), hot)).any():
            r = _single(values, r, burning, unit.window)
        piece = np.searchsorted(last, r.start, side="right")
        at = r.start - first[piece] + origin[piece]
        end = r.start + r.count - 1 + unit.window
        bounds = (bs[r.start], be[end - 1]) if unit.words else (at, at + end - r.start)
        yield r, np.array(number)[piece], at, bounds


def _single(values: np.ndarray, r: hashing.Runs, burning: np.ndarray, window: int) -> hashing.Runs:
    """The runs with burning ones cut into their windows, whose anchor is then their own hash."""
    cold, hot = r.take(~burning), r.take(burning)
    within = np.arange(hot.count.sum()) - np.repeat(np.cumsum(hot.count) - hot.count, hot.count)
    start = np.repeat(hot.start, hot.count) + within
    one = np.ones(len(start), np.int64)
    offset = np.repeat(hot.offset, hot.count) - within
    own = hashing.segment_hash(hashing.prefix(values), start, one, offset, window)
    anchor = hashing.mixed(np.repeat(hot.anchor, hot.count) ^ own)
    return hashing.Runs(*(np.concatenate(x) for x in ((cold.start, start), (cold.count, one), (cold.offset, offset), (cold.anchor, anchor), (cold.segment, own), (cold.hot, one))))


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _six(x: np.ndarray) -> bytes:
    """Sorted 48-bit values, as the gaps between them: five bytes each if all gaps fit, else six."""
    gaps = np.diff(x, prepend=np.uint64(0))
    width = 5 if len(gaps) and gaps.max() >> np.uint64(40) == 0 else 6
    return bytes([width]) + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_six(packed: bytes) -> np.ndarray:
    width = packed[0]
    wide = np.zeros(((len(packed) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _texts(pdf: pd.DataFrame) -> list[bytes]:
    return [t.encode() for t in pdf["text"]]


def _by_bucket(keys: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return [(int(bucket[x[0]]), x) for x in np.split(order, at[1:])] if len(order) else []


def _anchors(unit: Unit, buckets: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        seen, often = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for r, _, _, _ in _runs(_texts(pdf), unit):
            h, n = np.unique(r.anchor >> np.uint64(16), return_counts=True)
            seen.append(h)
            often.append(n)
        h, back = np.unique(np.concatenate(seen), return_inverse=True)
        twice = np.bincount(back, np.concatenate(often), len(h)) > 1
        rows = []
        for bucket, which in _by_bucket(h, buckets):
            # Those that this batch alone has twice or more come last.
            once, more = h[which[~twice[which]]], h[which[twice[which]]]
            packed = _six(once)
            rows.append((pdf["_batch"].iloc[0], 0, bucket, np.array([len(packed)], np.int64).tobytes() + packed + _six(more)))
        return pd.DataFrame(rows, columns=["_batch", "kind", "bucket", "payload"])

    return of


def _shared(hot_batches: int):
    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(p[8 : 8 + int(np.frombuffer(p[:8], np.int64)[0])], p[8 + int(np.frombuffer(p[:8], np.int64)[0]) :]) for p in pdf["payload"]]
        pairs = [(_from_six(once), _from_six(more)) for once, more in parts]
        held = [np.concatenate(p) for p in pairs]
        if not held:
            return pd.DataFrame(columns=["_batch", "kind", "bucket", "payload"])
        weight = np.concatenate([np.repeat((1, 2), (len(once), len(more))) for once, more in pairs])
        values, back, batches = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        repeated, hot = np.bincount(back, weight, len(values)) > 1, batches > hot_batches
        rows, at = [], 0
        for b, k, h in zip(pdf["_batch"], pdf["bucket"], held, strict=True):
            mine = back[at : at + len(h)]
            at += len(h)
            for kind, flag in ((1, repeated), (2, hot)):
                if (keep := h[flag[mine]]).size:
                    rows.append((b, kind, k, _six(np.sort(keep))))
        return pd.DataFrame(rows, columns=["_batch", "kind", "bucket", "payload"])

    return of


def _told(told: pd.DataFrame, kind: int) -> np.ndarray:
    parts = [_from_six(p) for p in told["payload"][told["kind"] == kind]]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _send(unit: Unit, buckets: int):
    def of(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        wanted, hot = _told(told, 1), _told(told, 2)
        empty = pd.DataFrame(columns=["_batch", "kind", "bucket", "payload"])
        if not len(pdf) or not len(wanted):
            return empty
        texts, ids = _texts(pdf), pdf["doc_id"].to_numpy(np.int64)
        got: list[list[np.ndarray]] = [[] for _ in range(10)]
        for r, text, _, bounds in _runs(texts, unit, wanted, hot):
            order = np.lexsort((ids[text], r.segment, r.anchor))
            a, s = r.anchor[order], r.segment[order]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1]))))
            f = order[new]
            times = np.diff(np.append(new, len(order)))
            for x, y in zip(got, (r.anchor[f], r.segment[f], r.hot[f], r.offset[f], r.count[f], ids[text[f]], times, text[f], bounds[0][f], bounds[1][f]), strict=True):
                x.append(y)
        if not got[0]:
            return empty
        a, s, burning, offset, count, least, times, text, b0, b1 = (np.concatenate(x) for x in got)
        order = np.lexsort((least, s, a))
        new = np.flatnonzero(np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (s[order][1:] != s[order][:-1]))))
        times = np.add.reduceat(times[order], new)
        f = order[new]
        rows = []
        for bucket, which in _by_bucket(a[f] >> np.uint64(16), buckets):
            w = f[which]
            cut = [texts[t][x:y] for t, x, y in zip(text[w].tolist(), b0[w].tolist(), b1[w].tolist(), strict=True)]
            part = Segments(a[w], s[w], burning[w], offset[w], count[w], least[w], times[which], np.array([len(c) for c in cut], np.int64), b"".join(cut))
            rows.append((pdf["_batch"].iloc[0], 3, bucket, part.pack()))
        return pd.DataFrame(rows, columns=["_batch", "kind", "bucket", "payload"])

    return of


def _judge(unit: Unit, index: Callable[[Segments, np.ndarray], Verdicts]):
    """index(segments by anchor, group starts) gives the verdicts of groups of two or more."""

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["_batch", "kind", "bucket", "payload"])
        if not len(pdf):
            return empty
        parts = [Segments.unpack(p, unit) for p in pdf["payload"]]
        names = ("anchor", "segment", "hot", "offset", "count", "least", "times", "size")
        anchor, segment, hot, offset, count, least, times, size = (np.concatenate([getattr(p, x) for p in parts]) for x in names)
        text = b"".join(p.text for p in parts)
        at = np.cumsum(size) - size
        order = np.lexsort((least, segment, anchor))
        a, s = anchor[order], segment[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
        f = order[np.flatnonzero(new)]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        total = np.bincount(number, times, len(f)).astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], anchor[f][1:] != anchor[f][:-1])))
        sizes = np.diff(np.append(begins, len(f)))
        alone = np.repeat(sizes == 1, sizes)
        verdict = [Verdicts(anchor[f][alone], segment[f][alone], np.zeros(alone.sum(), np.int64), count[f][alone], least[f][alone], total[alone])]
        if (~alone).any():
            m = f[~alone]
            cut = [text[x : x + n] for x, n in zip(at[m].tolist(), size[m].tolist(), strict=True)]
            many = Segments(anchor[m], segment[m], hot[m], offset[m], count[m], least[m], total[~alone], size[m], b"".join(cut))
            groups = sizes[sizes > 1]
            verdict.append(index(many, np.cumsum(groups) - groups))
        v = Verdicts.joined(verdict)
        # The verdicts by distinct segment, to hand each batch those of its own.
        order = np.lexsort((v.segment, v.anchor))
        v = Verdicts(*(getattr(v, c)[order] for c in ("anchor", "segment", "first", "last", "least", "times")))
        change = np.concatenate(([True], (v.anchor[1:] != v.anchor[:-1]) | (v.segment[1:] != v.segment[:-1])))[: len(v.anchor)]
        start = np.flatnonzero(change)
        length = np.diff(np.append(start, len(v.anchor)))
        rows, seen = [], 0
        for b, k, p in zip(pdf["_batch"], pdf["bucket"], parts, strict=True):
            mine = number[seen : seen + len(p.anchor)]
            seen += len(p.anchor)
            n = length[mine]
            which = np.repeat(start[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
            rows.append((b, 4, k, Verdicts(*(getattr(v, c)[which] for c in ("anchor", "segment", "first", "last", "least", "times"))).pack()))
        return pd.DataFrame(rows, columns=["_batch", "kind", "bucket", "payload"])

    return of


def _cut(unit: Unit, remove, finish):
    """remove(verdicts, own id of each) -> which to remove; finish(text, units removed) -> a row."""

    def of(pdf: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        texts = _texts(pdf)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        packed = told["payload"][told["kind"] == 4]
        if len(packed) and len(texts):
            ids = pdf["doc_id"].to_numpy(np.int64)
            v = Verdicts.joined([Verdicts.unpack(p) for p in packed])
            key = hashing.mixed(v.anchor) ^ v.segment
            order = np.argsort(key, kind="stable")
            key = key[order]
            for r, text, at, _ in _runs(texts, unit, _told(told, 1), _told(told, 2)):
                own = hashing.mixed(r.anchor) ^ r.segment
                lo, hi = np.searchsorted(key, own), np.searchsorted(key, own, side="right")
                n = hi - lo
                run = np.repeat(np.arange(len(r)), n)
                which = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                gone = remove(v, which, ids[text[run]])
                run, which = run[gone], which[gone]
                for t, a, b in zip(text[run].tolist(), (at[run] + v.first[which]).tolist(), (at[run] + v.last[which] - 1 + unit.window).tolist(), strict=True):
                    spans[t].append((a, b))
        rows = [finish(t, _merged(s)) for t, s in zip(texts, spans, strict=True)]
        out = pd.DataFrame(rows, columns=finish.columns)
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        return out

    return of


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _unused(rows: DataFrame) -> int:
    """A number that no row has as its id: there are more numbers than rows."""
    random = np.random.default_rng(20_250_101)
    while True:
        some = random.integers(-(1 << 62), 1 << 62, 64).tolist()
        taken = {r.doc_id for r in rows.filter(F.col("doc_id").isin(some)).select("doc_id").distinct().collect()}
        if free := [x for x in some if x not in taken]:
            return free[0]


def removed(docs: DataFrame, unit: Unit, index, remove, finish, schema: str, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES, hot_batches: int = HOT_BATCHES) -> DataFrame:
    """One row (doc_id, *schema) for each row of `docs`, with what `finish` makes of its spans.

    A null id comes after all others: within, it is the greatest number. If a row has that number as
    its id, the ids above some unused number move down by one until the end."""
    rows = docs.select(column(docs, "doc_id", "long").alias("doc_id"), F.coalesce(column(docs, "text", "string"), F.lit("")).alias("text"))
    seen = rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long") + 1), F.lit(1)).alias("n"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    batches, buckets = 1 + seen["n"] // batch_bytes, 1 + seen["n"] // bucket_bytes
    gap = _unused(rows) if seen["nulls"] and seen["last"] == _NO_ID else _NO_ID
    inner = F.when(F.col("doc_id") > gap, F.col("doc_id") - 1).otherwise(F.coalesce("doc_id", F.lit(_NO_ID)))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)).alias("_batch"), inner.alias("doc_id"), "text")
    by_batch = dealt.groupBy("_batch")
    anchors = by_batch.applyInPandas(_anchors(unit, buckets), _ROUTE)
    shared = anchors.groupBy("bucket").applyInPandas(_shared(hot_batches), _ROUTE)
    sent = by_batch.cogroup(shared.groupBy("_batch")).applyInPandas(_send(unit, buckets), _ROUTE)
    judged = sent.groupBy("bucket").applyInPandas(_judge(unit, index), _ROUTE)
    told = shared.unionByName(judged)
    cut = by_batch.cogroup(told.groupBy("_batch")).applyInPandas(_cut(unit, remove, finish), f"doc_id long, {schema}")
    if not seen["nulls"]:
        return cut
    outer = F.nullif("doc_id", F.lit(_NO_ID))
    return cut.withColumn("doc_id", F.when(outer >= gap, outer + 1).otherwise(outer))
