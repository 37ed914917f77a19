"""Substring dedup by suffix automata: every occurrence of a repeated run of words goes.

A window is `WINDOW` consecutive words of one document. A word is removed if a window that covers
it stands anywhere else too, in another document or the same one. `repeats` routes the segments that
can hold such windows to shards; each shard builds suffix automata over its reference segments, then
streams the segments through them: the matching statistic at each word gives the state that holds
the last `WINDOW` words, and that state's number of end positions tells whether they repeat.

The reference is the corpus itself, which has no size bound; so its shards are not broadcast but
meet the documents' segments by anchor.

Defined results: a null or empty text has no words and keeps the empty text; a text shorter than the
window keeps all its words; equal rows repeat each other, so their windows go; other columns are not
carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.repeats import Segments, Unit, Verdicts, removed

WINDOW = 35
GRAM = 8


class Automaton:
    """Suffix automaton of several token lists, with how often each state's strings occur."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [0]

    def add(self, tokens: list[bytes], times: int) -> None:
        """One more reference text, as if it stood `times` times."""
        edges, link, length, ends = self.next, self.link, self.length, self.ends
        last = 0
        for token in tokens:
            held = edges[last].get(token)
            if held is not None and length[held] == length[last] + 1:
                last = held
                ends[last] += times
                continue
            if held is None:
                new = len(edges)
                edges.append({})
                length.append(length[last] + 1)
                link.append(0)
                ends.append(times)
                p = last
                while p >= 0 and token not in edges[p]:
                    edges[p][token] = new
                    p = link[p]
                last = new
                if p < 0:
                    continue
                q = edges[p][token]
                if length[q] == length[p] + 1:
                    link[new] = q
                    continue
                link[new] = self._split(p, q, token)
            else:
                last = self._split(last, held, token)
                ends[last] += times

    def _split(self, p: int, q: int, token: bytes) -> int:
        edges, link = self.next, self.link
        clone = len(edges)
        edges.append(edges[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        self.ends.append(0)
        link[q] = clone
        while p >= 0 and edges[p].get(token) == q:
            edges[p][token] = clone
            p = link[p]
        return clone

    def close(self) -> None:
        """Hands the counts of end positions up the suffix links; after the last `add`."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[s]] += self.ends[s]

    def matches(self, tokens: list[bytes], window: int) -> list[int]:
        """For each window of `tokens`: how often it stands in the reference."""
        edges, link, length, ends = self.next, self.link, self.length, self.ends
        state = held = 0
        out = []
        for k, token in enumerate(tokens):
            while state and token not in edges[state]:
                state = link[state]
                held = length[state]
            if token in edges[state]:
                state, held = edges[state][token], held + 1
            # Longer matches are of no use: the state of the last `window` words is enough.
            while held >= window and length[link[state]] >= window:
                state = link[state]
                held = length[state]
            if k + 1 >= window:
                out.append(ends[state] if held >= window else 0)
        return out


def _index(window: int):
    def of(segments: Segments, starts: np.ndarray) -> Verdicts:
        at = np.cumsum(segments.size) - segments.size
        tokens = [segments.text[a : a + n].split() for a, n in zip(at.tolist(), segments.size.tolist(), strict=True)]
        rows: list[tuple[int, int, int, int]] = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(tokens)], strict=True):
            automaton = Automaton()
            for k in range(a, b):
                automaton.add(tokens[k], int(segments.times[k]))
            automaton.close()
            for k in range(a, b):
                seen = automaton.matches(tokens[k], window)
                first = 0
                for j in range(1, len(seen) + 1):
                    if j == len(seen) or seen[j] != seen[first]:
                        rows.append((k, first, j, seen[first]))
                        first = j
        k, first, last, times = np.array(rows, np.int64).T
        return Verdicts(segments.anchor[k], segments.segment[k], first, last, segments.least[k], times)

    return of


def _again(v: Verdicts, which: np.ndarray, _: np.ndarray) -> np.ndarray:
    return v.times[which] > 1


def _kept(text: bytes, spans: list[tuple[int, int]]) -> tuple:
    words = text.split()
    kept, last = [], 0
    for a, b in spans:
        kept += words[last:a]
        last = b
    kept += words[last:]
    return len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in spans], b" ".join(kept).decode()


_kept.columns = ["n_words", "n_removed", "spans", "kept"]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """(doc_id, n_words, n_removed, spans of removed words, kept text) for each row of `docs`."""
    schema = "n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string"
    return removed(docs, Unit(True, window, min(gram, window)), _index(window), _again, _kept, schema, **limits)


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(texts: list[str | None], window: int = WINDOW) -> list[tuple[int, int, str]]:
    """What `digest` returns, from a table of every window; for tests."""
    words = [hashing_words(t) for t in texts]
    seen: dict[tuple[str, ...], int] = {}
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def hashing_words(text: str | None) -> list[str]:
    raw = (text or "").encode()
    starts, ends = hashing.word_spans(np.frombuffer(raw, np.uint8))
    return [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
h AS (SELECT r, i, md5(win) AS k FROM n),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM h) WHERE n > 1),
g AS (SELECT r, list(DISTINCT j) AS gone FROM (SELECT r, unnest(range(i, i + 35)) AS j FROM c) GROUP BY r),
x AS (SELECT d.r, d.doc_id, d.w, u.j FROM d, (SELECT r, unnest(range(1, len(w) + 1)) AS j FROM d) u WHERE d.r = u.r),
k AS (SELECT x.r, string_agg(x.w[x.j], ' ' ORDER BY x.j) AS kept, count(*) AS n
      FROM x LEFT JOIN (SELECT r, unnest(gone) AS j FROM g) y ON x.r = y.r AND x.j = y.j WHERE y.j IS NULL GROUP BY x.r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
