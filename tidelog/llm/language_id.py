"""Language identification: nearest of several centroids per language, over TF-IDF n-gram vectors.

A text's n-grams are those of one to three bytes of its lower-cased UTF-8, digits, ASCII punctuation
and white space all being one blank; they are hashed into `WIDTH` dimensions. A vector has
(1 + log count) x idf in each, normalised. The idf counts all rows to learn from. Every language that
is not null is learned: its centroids come from spherical k-means over its first rows by hash, an equal
share of `SAMPLE` for each language but `LEAST_PER_LANGUAGE` at least, on the executors. The driver and
each task hold `CENTROIDS` x `WIDTH` numbers (64 KB) a language, whatever the number of rows.

A text gets the language of the centroid with the largest cosine. Its score is the soft maximum of
the languages' best cosines. If the best cosine is below what all but one in a thousand of the
sampled rows have with their own language, the text is `rejected`: its language is but a guess.

Defined results: a null text, or one without any letter, is `und` with score 0; so is every text if
no row is there to learn from. A null language is not learned from; languages are taken as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.common import column, held_out

WIDTH = 4096
CENTROIDS = 4
SAMPLE = 6_000
LEAST_PER_LANGUAGE = 40
SHARPNESS = 40.0
UNKNOWN = "und"
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
_MULTIPLY = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def counts(texts: list[str]) -> np.ndarray:
    """The hashed n-gram counts of each text, `WIDTH` a row."""
    raw = [b" " + t.lower().encode() + b" " for t in texts]
    out = np.zeros((len(raw), WIDTH), np.float32)
    for numbers in hashing.groups([len(r) for r in raw]):
        b = _BLANK[np.frombuffer(b"".join(raw[k] for k in numbers), np.uint8)].astype(np.uint32)
        end = np.cumsum([len(raw[k]) for k in numbers])
        row = np.repeat(np.arange(len(numbers)) * WIDTH, np.diff(end, prepend=0))
        flat = np.zeros(len(numbers) * WIDTH, np.int64)
        gram = np.zeros(len(b), np.uint32)
        for n in range(1, 4):
            # Grams end at their place; those at a text's start have its neighbour's last bytes in
            # them, which are its blank and the one before.
            gram = (np.concatenate((gram[:1], gram[:-1])) << np.uint32(8)) | b if n > 1 else b
            slot = ((gram + np.uint32(n)) * _MULTIPLY[n - 1]) >> np.uint32(20)
            usable = np.ones(len(b), bool)
            for k in range(n - 1):
                first = np.concatenate(([0], end[:-1])) + k
                usable[first[first < len(b)]] = False
            flat += np.bincount((row + slot)[usable], minlength=len(flat))
        out[numbers] = flat.reshape(len(numbers), WIDTH)
    return out


def vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def clustered(v: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Centroids of spherical k-means, started far from each other."""
    random = np.random.default_rng(seed)
    centres = [v[random.integers(len(v))]]
    for _ in range(min(k, len(v)) - 1):
        centres.append(v[np.argmin(np.max(v @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(15):
        own = np.argmax(v @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = v[own == j].sum(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


class Model:
    def __init__(self, idf: np.ndarray, languages: list[str], centres: list[np.ndarray], reject_below: list[float]) -> None:
        self.idf, self.languages, self.reject_below = idf, languages, reject_below
        self.centroids = np.concatenate(centres) if centres else np.zeros((0, WIDTH), np.float32)
        #: Where each language's centroids begin.
        self.first = np.cumsum([0, *(len(c) for c in centres)])[:-1]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float, bool]]:
        """(language, score, cosine, rejected) of each text."""
        out: list[tuple[str, float, float, bool]] = [(UNKNOWN, 0.0, 0.0, True)] * len(texts)
        told = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.languages else []
        for a in range(0, len(told), 512):
            part = told[a : a + 512]
            cosine = vectors(counts([texts[k] for k in part]), self.idf) @ self.centroids.T
            best = np.maximum.reduceat(cosine, self.first, axis=1).astype(float)
            e = np.exp(SHARPNESS * (best - best.max(axis=1, keepdims=True)))
            for k, j, b, p in zip(part, best.argmax(axis=1).tolist(), best, (e / e.sum(axis=1, keepdims=True)).max(axis=1).tolist(), strict=True):
                out[k] = (self.languages[j], p, float(b[j]), bool(b[j] < self.reject_below[j]))
        return out


def _frequencies(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total, rows = np.zeros(WIDTH, np.int64), 0
    for pdf in parts:
        texts = pdf["text"].tolist()
        for a in range(0, len(texts), 512):
            total += (counts(texts[a : a + 512]) > 0).sum(axis=0)
        rows += len(texts)
    yield pd.DataFrame({"rows": [rows], "total": [total.tolist()]})


def _sampled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        for a in range(0, len(pdf), 512):
            part = pdf[a : a + 512]
            yield pd.DataFrame({"lang": part["lang"].to_numpy(), "counts": [np.minimum(c, 65_535).astype(np.uint16).tobytes() for c in counts(part["text"].tolist())]})


def _learned(idf: np.ndarray, pdf: pd.DataFrame) -> pd.DataFrame:
    """The centroids of one language's sampled rows, and the cosine to reject below."""
    # In an order that no partitioning changes.
    rows = sorted(pdf["counts"])
    v = np.concatenate([vectors(np.array([np.frombuffer(r, np.uint16) for r in rows[a : a + 512]]), idf) for a in range(0, len(rows), 512)])
    c = clustered(v, CENTROIDS)
    return pd.DataFrame({"lang": pdf["lang"][:1], "centroids": [c.tobytes()], "reject_below": [float(np.quantile(np.max(v @ c.T, axis=1), 0.001))]})


def fit(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from (doc_id, text, lang); a language's centroids are fitted on at most its share of `sample`."""
    known = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    per_task = known.select("text").mapInPandas(_frequencies, "rows long, total array<long>")
    # One row of WIDTH counts a task; summed up by dimension before they reach the driver.
    document = dict(per_task.select(F.posexplode("total").alias("k", "n")).groupBy("k").agg(F.sum("n")).collect())
    total, many = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    df = np.array([document.get(k, 0) for k in range(WIDTH)], float)
    idf = np.log((1 + total) / (1 + df)) + 1
    if not many:
        return Model(idf, [], [], [])
    each = max(LEAST_PER_LANGUAGE, sample // many)
    # The rows of a language up to its hash number `each`; tasks pass on no more of each language.
    hashed = known.withColumn("draw", F.xxhash64("doc_id", "text"))
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("draw"))
    last = hashed.select("lang", "draw").withColumn("place", place).filter(F.col("place") <= each).groupBy("lang").agg(F.max("draw").alias("last"))
    # One number a language, where the model has 64 KB of it: a small side whatever Spark's estimate.
    drawn = hashed.join(F.broadcast(last), "lang").filter("draw <= last").groupBy("lang", "draw").agg(F.first("text").alias("text"))
    grouped = drawn.select("lang", "text").mapInPandas(_sampled, "lang string, counts binary").groupBy("lang")
    learned = sorted(grouped.applyInPandas(lambda pdf: _learned(idf, pdf), "lang string, centroids binary, reject_below double").collect())
    return Model(idf, [r.lang for r in learned], [np.frombuffer(r.centroids, np.float32).reshape(-1, WIDTH) for r in learned], [r.reject_below for r in learned])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, cosine, rejected) for each row of `docs`."""

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = pd.DataFrame(model.predict(pdf["text"].tolist()), columns=["lang_pred", "score", "cosine", "rejected"])
            out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield out

    read = docs.select(column(docs, "doc_id", "string").alias("doc_id"), column(docs, "text", "string").alias("text"))
    out = read.mapInPandas(of, "doc_id string, lang_pred string, score double, cosine double, rejected boolean")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def digest(docs: DataFrame) -> DataFrame:
    rows = docs.select(*(column(docs, c, t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"))))
    model = fit(rows.filter(~held_out(3, 1, F.col("doc_id"))))
    return identify(rows, model).withColumn("held_out", held_out(3, 1, F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "cosine", "rejected")
