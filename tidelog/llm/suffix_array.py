"""Suffix-array dedup: of a repeated byte string, only the document with the least id keeps it.

A window is `WINDOW` consecutive bytes of one document. A byte is removed if a window that covers it
also starts in a document with a smaller doc_id. `repeats` routes the segments that can hold such
windows to shards; a shard sorts the suffixes of its segments and takes the least id of each range
of suffixes that share a window.

The suffix array is built by linear grouping. Suffixes are grouped by their Lyndon prefix: from the
highest group down, each suffix points to the nearest suffix before it in a lower group, and the
suffixes pointed at move to new groups just above their own, by how many pointers they got. The
array then fills from the left: the suffixes of a group come in the order of their next smaller
suffixes, which all stand before them. No prefix is renamed or sorted recursively. Highest groups that
do not point at each other, and at no suffix twice, are taken in one step of arrays: of what they point
at in one group, the suffixes that the higher ones point at come higher. Groups also emit together.

A shard's segments with one anchor are laid over each other at it. To the right of the windows'
starts, columns in which they all agree need only one symbol, so the sorted string is short. Symbols
rise with the column first, so that groups of one column are taken together.

Defined results: a null or empty text is empty; null ids come last, and rows with one id never
remove each other's bytes, as neither id is smaller; other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
from numpy.typing import ArrayLike
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.repeats import Segments, Unit, Verdicts, removed

WINDOW = 50
GRAM = 20
#: Segments whose suffixes are sorted at once, where no group has more.
SEGMENTS = 8_000
#: How many steps of arrays may be small before the rest is taken group by group, and what is small.
STEPS, LEAST = 8, 256


def suffix_array(symbols: np.ndarray) -> list[int]:
    """The suffixes of a string of small non-negative integers in order, a prefix before its longer."""
    n = len(symbols)
    if not n:
        return []
    # A group is an interval of `places`, and is known by where the interval begins.
    places = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[places]
    begins = np.flatnonzero(np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1])))
    widths = np.diff(np.append(begins, n))
    groups = np.empty(n, np.int64)
    groups[places] = np.repeat(begins, widths)
    wheres = np.empty(n, np.int64)
    wheres[places] = np.arange(n)
    width = np.zeros(n, np.int64)
    width[begins] = widths
    lower = np.full(n, -1)
    end = _together(places, wheres, groups, width, lower)
    # What is left goes group by group, numbered in the string's order without the suffixes done.
    left = np.sort(places[:end])
    number = np.full(n + 1, -1)
    number[left] = np.arange(end)
    before = number[_pointed(left, end, groups, lower)].tolist()
    place, where, group = number[places[:end]].tolist(), wheres[left].tolist(), groups[left].tolist()
    width, smaller = width[:end].tolist(), [-1] * end
    while end:
        low = group[place[end - 1]]
        if end - low == 1:
            i = place[low]
            j = before[i]
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                g = group[j]
                w = width[g] - 1
                if w:
                    _raise(j, g + w, place, where, group)
                    width[g], width[g + w] = w, 1
            end = low
            continue
        pointed: dict[int, int] = {}
        for i in sorted(place[low:end]):
            j = before[i]
            while j >= 0 and group[j] >= low:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        end = low
        by_count: dict[int, list[int]] = {}
        for j, count in pointed.items():
            by_count.setdefault(count, []).append(j)
        for count in sorted(by_count, reverse=True):
            together: dict[int, list[int]] = {}
            for j in by_count[count]:
                together.setdefault(group[j], []).append(j)
            for g, members in together.items():
                top = g + width[g]
                rest = width[g] - len(members)
                if not rest:
                    continue
                for k, j in enumerate(members):
                    _raise(j, top - 1 - k, place, where, group)
                for j in members:
                    group[j] = g + rest
                width[g], width[g + rest] = rest, len(members)
    places[: len(left)] = left[place]
    groups[left] = group
    return _emitted(places, groups).tolist()


def _pointed(i: np.ndarray, end: int, group: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """For each suffix in i: the nearest before it, by the pointers of those done, that isn't done; -1: none."""
    j = i - 1
    over = np.flatnonzero((j >= 0) & (group[j] >= end))
    while len(over):
        j[over] = smaller[j[over]]
        over = over[(j[over] >= 0) & (group[j[over]] >= end)]
    return j


def _emitted(place: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The suffixes in order: those of a group by the order of their next smaller suffixes.

    Groups in a row whose next smaller suffixes all come before the first of them are taken at once."""
    n = len(place)
    # The next smaller suffix of j begins behind j's Lyndon prefix: the next that is in no higher group.
    smaller = np.arange(1, n + 1)
    lower = np.append(group, -1)
    live = np.flatnonzero(lower[smaller] > group)
    while len(live):
        smaller[live] = smaller[smaller[live]]
        live = live[lower[smaller[live]] > group[live]]
    begins = np.flatnonzero(group[place] == np.arange(n))
    needs = np.maximum.reduceat(lower[smaller[place]], begins)
    borders = np.append(begins, n)
    out, rank = np.empty(n, np.int64), np.full(n + 1, -1)
    c = 0
    while c < len(begins):
        begin, d, reach = begins[c], c, 64
        while d < len(begins):
            late = np.flatnonzero(needs[d : d + reach] >= begin)
            if len(late):
                d += int(late[0])
                break
            d, reach = min(d + reach, len(begins)), 4 * reach
        alone = d == c
        d += alone
        j = place[begin : borders[d]]
        if alone:
            # Suffixes whose next smaller one is in their own group come after it, in its order.
            within = lower[smaller[j]] == begin
            after = dict(zip(smaller[j[within]].tolist(), j[within].tolist(), strict=True))
            outer = j[~within]
            layer = outer[np.argsort(rank[smaller[outer]])].tolist()
            j = []
            while layer:
                j += layer
                layer = [after[i] for i in layer if i in after]
        else:
            j = j[np.lexsort((rank[smaller[j]], group[j]))]
        out[begin : borders[d]] = j
        rank[j] = np.arange(begin, borders[d])
        c = d
    return out


def _together(place: np.ndarray, where: np.ndarray, group: np.ndarray, width: np.ndarray, smaller: np.ndarray) -> int:
    """Takes highest groups in steps of many while that pays; all from the returned place on are done."""
    n = end = len(place)
    small, reach = 0, 1 << 10
    marked, latest = np.zeros(n, bool), np.empty(n, np.int64)
    while end and small < STEPS:
        begin = group[place[max(0, end - reach)]]
        i = place[begin:end]
        j = _pointed(i, end, group, smaller)
        at = np.where(j >= 0, group[j], -1)
        highest = np.maximum.accumulate(at[::-1])[::-1]
        k = np.arange(begin, end)
        low = k[(group[i] == k) & (highest < k)]
        if not len(low):
            break
        low = int(low[0])
        if low == begin and begin and len(i) < n // 2:
            reach *= 4
            continue
        reach = max(1 << 10, 2 * (end - low))
        i, j = i[low - begin :], j[low - begin :]
        by = group[i[j >= 0]]
        pointed = j[j >= 0]
        marked[pointed] = True
        number = np.arange(len(pointed))
        latest[pointed] = number
        if (latest[pointed] != number).any():
            break
        if len(pointed):
            _raise_all(pointed, by, place, where, group, width, marked)
        marked[pointed] = False
        smaller[i] = j
        small += end - low < LEAST
        end = low
    return end


def _raise_all(j: np.ndarray, by: np.ndarray, place: np.ndarray, where: np.ndarray, group: np.ndarray, width: np.ndarray, marked: np.ndarray) -> None:
    """Moves the suffixes j to the tops of their groups, in groups of their own by what points at them."""
    order = np.lexsort((by, group[j]))
    j, by = j[order], by[order]
    g = group[j]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(j)))
    rest = width[g[first]] - many
    floor = g + np.repeat(rest, many)
    to = floor + np.arange(len(j)) - np.repeat(first, many)
    # As many others leave a group's top as places fall free below it.
    others = place[to]
    others = others[~marked[others]]
    free = where[j]
    free = free[free < floor]
    place[free], where[others] = others, free
    place[to], where[j] = j, to
    part = np.flatnonzero(new | np.concatenate(([True], by[1:] != by[:-1])))
    sizes = np.diff(np.append(part, len(j)))
    group[j] = np.repeat(to[part], sizes)
    width[g[first]] = rest
    width[to[part]] = sizes


def _raise(j: int, to: int, place: list[int], where: list[int], group: list[int]) -> None:
    """Swaps suffix j into the place `to` and makes it a group of its own there."""
    at, other = where[j], place[to]
    place[at], where[other] = other, at
    place[to], where[j] = j, to
    group[j] = to


def common_prefixes(symbols: ArrayLike, order: ArrayLike) -> np.ndarray:
    """For each suffix in order: the length it shares with the one before it.

    Where a suffix and the one before it follow equal symbols, they share one less than what those
    begin; only the others are compared."""
    symbols, order = np.asarray(symbols, np.int64), np.asarray(order, np.int64)
    n = len(order)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    # The end differs from every symbol.
    padded = np.append(symbols, -1)
    at = np.arange(n)
    compared = (at == 0) | (before <= 0)
    compared |= padded[at - 1] != padded[before - 1]
    first = np.flatnonzero(compared)
    shared = np.zeros(len(first), np.int64)
    live = np.flatnonzero(before[first] >= 0)
    h = 0
    while len(live):
        i = first[live]
        live = live[padded[i + h] == padded[before[i] + h]]
        h += 1
        shared[live] = h
    lengths = np.diff(np.append(first, n))
    by_place = np.repeat(shared + first, lengths) - at
    return by_place[order]


def _laid_over(s: Segments, starts: np.ndarray, window: int, gram: int):
    """The shard's string: dense symbols, their byte weights, each one's segment and window.

    A segment's symbols end in 0. `window` is the window that starts there, -1 if none does.
    """
    reach = window - gram
    columns = 2 * window - gram
    text = np.frombuffer(s.text, np.uint8)
    begin = np.cumsum(s.size) - s.size
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(s.size))))
    col = np.arange(columns)
    within = col[None, :] - (reach - s.offset)[:, None]
    there = (within >= 0) & (within < s.size[:, None])
    cells = np.where(there, text[np.minimum(begin[:, None] + np.maximum(within, 0), len(text) - 1)], 256).astype(np.int64)
    alike = np.logical_and.reduceat(cells == cells[starts][group], starts, axis=0)
    joins = np.zeros_like(alike)
    joins[:, reach + 2 :] = alike[:, reach + 2 :] & alike[:, reach + 1 : -1]
    head = there & ~joins[group]
    row, c = np.nonzero(head)
    # One symbol for each (column, group, byte): windows of one anchor can only match in place.
    key = (c * len(starts) + group[row]) * 257 + np.where(alike[group[row], c], 256, cells[row, c])
    _, dense = np.unique(key, return_inverse=True)
    here = within[row, c]
    following = np.append(here[1:], 0)
    final = np.append(row[1:] != row[:-1], True)
    weight = np.where(final, s.size[row] - here, following - here)
    starting = np.where(here < s.count[row], here, -1)
    # A 0 behind each segment.
    at = np.arange(len(row)) + row
    n = len(row) + len(s.size)
    symbols, weights = np.zeros(n, np.int64), np.zeros(n, np.int64)
    owner, windows = np.full(n, -1), np.full(n, -1)
    symbols[at], weights[at], owner[at], windows[at] = dense + 1, weight, row, starting
    return symbols, weights, owner, windows


def _index(window: int, gram: int):
    def of(segments: Segments, starts: np.ndarray) -> Verdicts:
        # Groups are independent of each other: some at a time bound the memory.
        ends = np.append(starts[1:], len(segments.size))
        at = np.concatenate(([0], np.cumsum(segments.size)))
        parts, g = [], 0
        while g < len(starts):
            h = max(g + 1, int(np.searchsorted(ends, starts[g] + SEGMENTS, side="right")))
            a, b = int(starts[g]), int(ends[h - 1])
            some = (x[a:b] for x in (segments.anchor, segments.segment, segments.hot, segments.offset, segments.count, segments.least, segments.times, segments.size))
            parts.append(sorted_groups(Segments(*some, segments.text[at[a] : at[b]]), starts[g:h] - a))
            g = h
        return Verdicts.joined(parts)

    def sorted_groups(segments: Segments, starts: np.ndarray) -> Verdicts:
        symbols, weights, owner, windows = _laid_over(segments, starts, window, gram)
        order = np.array(suffix_array(symbols), np.int64)
        shared = common_prefixes(symbols, order)
        bytes_before = np.concatenate(([0], np.cumsum(weights)))
        # What is common ends with the segment, at the 0 behind it, whose weight is 0.
        stop = np.flatnonzero(symbols == 0)
        end = stop[np.searchsorted(stop, order)]
        common = bytes_before[np.minimum(order + shared, end)] - bytes_before[order]
        breaks = common < window
        breaks[0] = True
        least = np.full(len(order), np.iinfo(np.int64).max)
        is_window = windows[order] >= 0
        least[is_window] = segments.least[owner[order[is_window]]]
        at = np.flatnonzero(breaks)
        least = np.repeat(np.minimum.reduceat(least, at), np.diff(np.append(at, len(order))))
        by_place = np.empty(len(order), np.int64)
        by_place[order] = least
        k = np.flatnonzero(windows >= 0)
        seg, win, low = owner[k], windows[k], by_place[k]
        first = np.flatnonzero(np.concatenate(([True], (seg[1:] != seg[:-1]) | (low[1:] != low[:-1]))))
        last = np.append(first[1:], len(k)) - 1
        s = seg[first]
        return Verdicts(segments.anchor[s], segments.segment[s], win[first], win[last] + 1, low[first], segments.times[s])

    return of


def _earlier(v: Verdicts, which: np.ndarray, own: np.ndarray) -> np.ndarray:
    return v.least[which] < own


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last:a])
        last = b
    kept.append(text[last:])
    left = b"".join(kept)
    return len(text), len(text) - len(left), [{"start": a, "end": b} for a, b in spans], left


_kept.columns = ["n_bytes", "n_removed", "spans", "kept"]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, maximal removed spans, kept bytes) for each row of `docs`."""
    gram = min(gram, window - 1)
    schema = "n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, kept binary"
    return removed(docs, Unit(False, window, gram), _index(window, gram), _earlier, _kept, schema, **limits)


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """What `digest` returns without the ids, from a table of every window; for tests."""
    texts = [(k, (t or "").encode()) for k, t in rows]
    least: dict[bytes, int] = {}
    for k, t in texts:
        for i in range(len(t) - window + 1):
            w = t[i : i + window]
            least[w] = min(k, least.get(w, k))
    out = []
    for k, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if least[t[i : i + window]] < k:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        n_spans = sum(1 for x, y in zip(b"\0" + bytes(gone), bytes(gone), strict=False) if y and not x)
        out.append((len(t), sum(gone), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


ORACLE = None
