"""Benchmark decontamination: documents that hold a test item within an edit budget.

Texts are compared as words, lower-cased and stripped to letters, their combining marks and digits;
where a script has no spaces between words, each letter is a word. An item of m words has a budget of floor(m / 5) word edits, a similarity of 0.8. It is split into budget + 1 pieces: within
the budget at least one piece stands in the document unchanged. Pieces are found by hashes of the
document's grams of the pieces' lengths; each hit is verified by Myers' bit-parallel distance of the
whole item against the stretch of the document around the hit, whose end may lie anywhere in it.

The items are the stated query set. They go to the executors in blocks of at most `BLOCK_BYTES`, one
pass over the documents for each block, so their number is not bounded by a broadcast.

Items shorter than `SHORTEST` words have no room for an edit; they must stand in the document as they
are. Defined results: items and documents without words match nothing; equal items count each; null
item ids and doc_ids stay null; rows with one id are judged each for itself; of ties the first stretch
counts; texts of any length are read whole; an empty table of documents gives an empty one, an empty
benchmark finds nothing; other columns pass through `decontaminate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.common import column, filtered, sliced

EDITS_PER_WORD = 5
SHORTEST = 5
BLOCK_BYTES = 8 << 20
_OTHER = r"[^\p{L}\p{M}\p{N}]+"
#: Scripts that are written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{323AF}]"
_FOUND = "item_id long, distance int, budget int, first int, last int"


def normal(text):
    """Lower-case words of letters, marks and digits, joined by one space."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _OTHER, " ")
    apart = F.regexp_replace(F.regexp_replace(words, rf"((?!\p{{M}}){_UNSPACED}\p{{M}}*)", " $1 "), " +", " ")
    # One look at the text as it is tells whether there are any.
    return F.trim(F.when(F.coalesce(text.rlike(_UNSPACED), F.lit(False)), apart).otherwise(words))


def budget_of(words: int) -> int:
    return words // EDITS_PER_WORD


def split(words: list[str]) -> list[tuple[int, int]]:
    """The pieces of an item, as (from, to): budget + 1 of them, of like lengths."""
    n, parts = len(words), budget_of(len(words)) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def myers(pattern: list, text: list, most: int) -> tuple[int, int]:
    """(least distance of the whole pattern to a stretch of `text`, where that stretch ends).

    A distance above `most` is returned as most + 1. Hyyro's form of Myers' recurrence: one bit for
    each unit of the pattern, whatever its length, in Python's integers.
    """
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    where: dict = {}
    for k, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << k
    up, down, score, best, end = full, 0, m, most + 1, -1
    for k, x in enumerate(text):
        eq = where.get(x, 0)
        across = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(across | up) & full), up & across
        score += bool(plus & high) - bool(minus & high)
        if score < best:
            best, end = score, k + 1
        plus = (plus << 1) & full
        minus = (minus << 1) & full
        vertical = eq | down
        up = minus | (~(vertical | plus) & full)
        down = plus & vertical
    return best, end


class Pieces:
    """Hashed pieces of a block of items, to look a document's grams up in."""

    def __init__(self, items: list[tuple[int | None, list[str]]]) -> None:
        self.items = items
        by_length: dict[int, list[tuple[np.uint64, int, int]]] = {}
        for k, (_, words) in enumerate(items):
            raw = " ".join(words).encode()
            values = hashing.word_hashes(np.frombuffer(raw, np.uint8))[0]
            pieces = split(words) if len(words) >= SHORTEST else [(0, len(words))]
            for a, b in pieces:
                by_length.setdefault(b - a, []).append((hashing.grams(values[a:b], b - a)[0], k, a))
        self.tables = {}
        for length, found in by_length.items():
            h, item, at = (np.array(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << 16, bool)
            some[h & np.uint64(0xFFFF)] = True
            self.tables[length] = (h[order], item[order], at[order], some)

    def hits(self, values: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item number, where it would begin, from, to) for each exact piece among word hashes."""
        for length, (h, item, at, some) in self.tables.items():
            g = hashing.grams(values, length)
            maybe = np.flatnonzero(some[g & np.uint64(0xFFFF)])
            lo = np.searchsorted(h, g[maybe])
            here = h[np.minimum(lo, len(h) - 1)] == g[maybe]
            for i, k in zip(maybe[here].tolist(), lo[here].tolist(), strict=True):
                while k < len(h) and h[k] == g[i]:
                    yield int(item[k]), i - int(at[k]), i, i + length
                    k += 1

    def verified(self, words: list[str], hits: dict[int, set[int]]) -> Iterator[tuple[int | None, int, int, int, int]]:
        """(item id, distance, budget, first and last word looked at) of items within their budget."""
        for k, begins in sorted(hits.items()):
            item, pattern = self.items[k]
            most = budget_of(len(pattern)) if len(pattern) >= SHORTEST else 0
            best = None
            last = -1
            for a in sorted(begins):
                # Stretches around hits that are close together are the same stretch.
                lo, hi = max(0, a - most), min(len(words), a + len(pattern) + most)
                if hi <= last:
                    continue
                last = hi
                distance, _ = myers(pattern, words[lo:hi], most)
                if distance <= most and (best is None or distance < best[1]):
                    best = (item, distance, most, lo, hi)
                    if not distance:
                        break
            if best:
                yield best


    def search(self, texts: list[str]) -> Iterator[tuple]:
        """(text number, *what `verified` yields) for normal texts."""
        raw = [t.encode() for t in texts]
        for numbers in hashing.groups([len(t) for t in raw]):
            joined = b"\n".join(raw[k] for k in numbers)
            values, starts, _ = hashing.word_hashes(np.frombuffer(joined, np.uint8))
            bound = np.searchsorted(starts, np.cumsum([len(raw[k]) + 1 for k in numbers]))
            found: dict[int, dict[int, set[int]]] = {}
            for item, begin, a, b in self.hits(values):
                d = int(np.searchsorted(bound, a, side="right"))
                if b <= bound[d]:
                    found.setdefault(d, {}).setdefault(item, set()).add(begin - int(bound[d - 1] if d else 0))
            for d, hits in found.items():
                for x in self.verified(texts[numbers[d]].split(" "), hits):
                    yield numbers[d], *x


def _search(block: list[tuple[int | None, str]]):
    pieces = Pieces([(k, t.split()) for k, t in block])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ids = b.column(0).to_pylist()
            rows = [(ids[k], *x) for k, *x in pieces.search(b.column(1).to_pylist())]
            kinds = (pa.int64(), pa.int64(), *[pa.int32()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "distance", "budget", "first", "last"])

    return of


def _clean(block: list[tuple[int | None, str]]):
    pieces = Pieces([(k, t.split()) for k, t in block])

    def of(texts: list[str]) -> list[bool]:
        bad = {x[0] for x in pieces.search(texts)}
        return [k not in bad for k in range(len(texts))]

    return of


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    items = benchmark.select(column(benchmark, "item_id", "long").alias("item_id"), normal(column(benchmark, "text", "string")).alias("t"))
    block, held = [], 0
    for r in items.filter(F.length("t") > 0).toLocalIterator():
        if block and held + len(r.t) > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.item_id, r.t))
        held += len(r.t)
    if block:
        yield block


def found(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance, budget, first, last): each item in each document, with the words
    of the normal text between which its closest stretch lies."""
    read = docs.select(column(docs, "doc_id", "long").alias("doc_id"), normal(column(docs, "text", "string")).alias("words"))
    schema = f"doc_id long, {_FOUND}"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, block_bytes):
        out = out.unionByName(read.mapInArrow(_search(block), schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that hold no item."""
    for block in _blocks(benchmark, block_bytes):
        docs = filtered(docs, normal(column(docs, "text", "string")), _clean(block))
    return docs


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each pair of a document and an item in it, with the least word distance."""
    return found(docs, benchmark).select("doc_id", "item_id", "distance", "budget")


def brute(docs: list[tuple[int | None, str]], items: list[tuple[int, str]]) -> set[tuple]:
    """What `digest` returns, by full dynamic programming on normal texts; for tests."""
    out = set()
    for d, text in docs:
        words = text.split()
        for i, item in items:
            pattern = item.split()
            if not pattern:
                continue
            row = [0] * (len(words) + 1)
            for k, p in enumerate(pattern):
                new = [k + 1]
                for j, w in enumerate(words):
                    new.append(min(row[j] + (p != w), row[j + 1] + 1, new[j] + 1))
                row = new
            most = budget_of(len(pattern)) if len(pattern) >= SHORTEST else 0
            if min(row) <= most:
                out.add((d, i, min(row), most))
    return out
