"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated probabilities.

Words are runs of letters and digits, and runs of marks, as they stand: capitals and marks tell. A
word's index vector has one +1 and one -1 among `WIDTH` places, from its own hash. Its context vector
is the sum of the index vectors of the words at most two places away, over all occurrences in all
documents. Sums are kept in `WORDS` rows, and every word adds to two of them; a word reads the one of
its two rows that fewer occurrences share, as a count-min sketch does, which also tells how rare it is.
Rows are centred and normalised. A document is the mean of its words' vectors weighted by rarity, the
plain mean, and the log of its length; nothing else of the text is looked at. A network of one
hidden layer, trained on a bounded sample of labelled rows, gives a logit; a temperature, fitted on a
part of the sample that the network has not seen, makes it a probability.

Defined results: a null or empty text is scored as a text without words; with no labelled rows every
score is 0.5, and with labels of one kind the share of label 1, smoothed. Null labels are not learned
from. Repeated ids in the labels count as often as they stand there. Equal texts have equal scores;
texts of any length are read whole, in groups of bounded size; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.common import column, held_out, sliced
from tidelog.llm.labelled import sample_of

WORDS = 16_384
WIDTH = 64
FEATURES = 2 * WIDTH + 1
HIDDEN = 32
#: Bound of the labelled rows that the network is trained on.
SAMPLE = 8_000
PREDICT_ABOVE = 0.3
#: Rows of one block of sums that one task adds up.
FAN_IN = 256
BLOCK = 256
# Kinds of bytes: white space, letters and digits (and all beyond ASCII), marks.
_KIND = np.full(256, 2, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def _hashed(texts: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, the text of each) of some texts."""
    buffer = np.frombuffer(b"\n".join(texts[k] for k in numbers) + b"\n", np.uint8)
    kind = _KIND[buffer]
    edge = np.flatnonzero(np.diff(kind, prepend=0))
    starts = edge[kind[edge] > 0]
    ends = np.append(edge, len(buffer))[np.searchsorted(edge, starts, side="right")]
    values = hashing.ranges(hashing.prefix(hashing.byte_values(buffer)), starts, ends)
    return values, np.searchsorted(np.cumsum([len(texts[k]) + 1 for k in numbers]), starts, side="right")


def _rows(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two rows of each word."""
    return (values >> np.uint64(40)).astype(np.int64) % WORDS, (values >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype(np.int64) % WORDS


def contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the neighbours' index vectors, occurrences) of each row."""
    sums, often = np.zeros(WORDS * WIDTH, np.int64), np.zeros(WORDS, np.int64)
    for numbers in hashing.groups([len(t) for t in texts]):
        values, owner = _hashed(texts, numbers)
        own = (hashing.mixed(values) >> np.uint64(1)).astype(np.int64)
        plus = own % WIDTH
        minus = (plus + 1 + (own >> 20) % (WIDTH - 1)) % WIDTH
        to, by = [], []
        at = np.arange(len(values))
        for gap in (1, 2):
            near = owner[gap:] == owner[:-gap]
            to += (at[:-gap][near], at[gap:][near])
            by += (at[gap:][near], at[:-gap][near])
        to, by = np.concatenate(to), np.concatenate(by)
        for row in _rows(values):
            base = row[to] * WIDTH
            sums += np.bincount(base + plus[by], minlength=len(sums))
            sums -= np.bincount(base + minus[by], minlength=len(sums))
            often += np.bincount(row, minlength=WORDS)
    return sums.reshape(WORDS, WIDTH), often


def features(texts: list[bytes], table: np.ndarray, often: np.ndarray, total: int) -> np.ndarray:
    """The pooled word vectors of each text, and the log of its length."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for numbers in hashing.groups([len(t) for t in texts]):
        values, owner = _hashed(texts, numbers)
        n = len(numbers)
        one, two = _rows(values)
        row = np.where(often[one] <= often[two], one, two)
        words = np.bincount(owner, minlength=n)
        # Pooling over distinct (text, row) pairs: a sparse product with the table.
        pair, count = np.unique(owner * WORDS + row, return_counts=True)
        text, at = pair // WORDS, pair % WORDS
        if len(pair):
            first = np.flatnonzero(np.diff(text, prepend=-1))
            for k, weight in enumerate((count * 1e-3 / (1e-3 + often[at] / max(total, 1)), count)):
                pooled = np.zeros((n, WIDTH))
                pooled[text[first]] = np.add.reduceat(table[at] * weight[:, None], first, axis=0)
                out[numbers, k * WIDTH : (k + 1) * WIDTH] = pooled / np.maximum(np.bincount(text, weight, n), 1e-9)[:, None]
        out[numbers, -1] = np.log1p(words)
    return out


class Network:
    """Two layers, trained by Adam; the last step fits the temperature on rows set apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60) -> None:
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float((y.sum() + 1) / (len(y) + 2))
            return
        random = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        order = random.permutation(len(z))
        aside, used = order[: len(order) // 5], order[len(order) // 5 :]
        if len(np.unique(y[used])) < 2:
            used = order
        w = [random.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        first, second = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        step = 0
        for _ in range(epochs):
            random.shuffle(used)
            for a in range(0, len(used), 128):
                k = used[a : a + 128]
                h = np.maximum(z[k] @ w[0] + w[1], 0)
                error = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - y[k]) / len(k)
                back = np.outer(error, w[2]) * (h > 0)
                step += 1
                for j, g in enumerate((z[k].T @ back + 1e-3 * w[0] / len(k), back.sum(axis=0), h.T @ error, error.sum(keepdims=True))):
                    first[j] = 0.9 * first[j] + 0.1 * g
                    second[j] = 0.999 * second[j] + 0.001 * g * g
                    w[j] = w[j] - 0.003 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        logit = self._logit(z[aside] if len(aside) else z)
        truth = y[aside] if len(aside) else y
        losses = {t: np.logaddexp(0, np.where(truth == 1, -1, 1) * logit / t).mean() for t in np.geomspace(0.25, 8, 41)}
        self.temperature = min(losses, key=losses.get)

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self._logit(z) / self.temperature, -30, 30)))


class Model:
    def __init__(self, sums: np.ndarray, often: np.ndarray) -> None:
        mean = sums.sum(axis=0) / max(often.sum(), 1)
        centred = sums / np.maximum(often, 1)[:, None] - mean
        self.table = (centred / np.maximum(np.linalg.norm(centred, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        # Every occurrence is in two rows.
        self.often, self.total = often, int(often.sum()) // 2
        self.network = Network(np.zeros((0, FEATURES)), np.zeros(0))

    def features(self, texts: list[str | None]) -> np.ndarray:
        return features([(t or "").encode() for t in texts], self.table, self.often, self.total)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return self.network(self.features(texts).astype(float)) if texts else np.zeros(0)


_SUMS = "block int, task long, sums binary, often binary"


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums, often = np.zeros((WORDS, WIDTH), np.int64), np.zeros(WORDS, np.int64)
    for b in sliced(batches):
        s, o = contexts([(t or "").encode() for t in b.column(0).to_pylist()])
        sums += s
        often += o
    task = TaskContext.get().partitionId()
    for a in range(0, WORDS, BLOCK):
        if often[a : a + BLOCK].any():
            parts = [pa.array([a], pa.int32()), pa.array([task], pa.int64()), pa.array([sums[a : a + BLOCK].tobytes()]), pa.array([often[a : a + BLOCK].tobytes()])]
            yield pa.RecordBatch.from_arrays(parts, ["block", "task", "sums", "often"])


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    add = lambda c: sum(np.frombuffer(b, np.int64) for b in pdf[c]).tobytes()
    return pd.DataFrame({"block": pdf["block"][:1], "task": pdf["task"][:1] // FAN_IN, "sums": [add("sums")], "often": [add("often")]})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Word vectors from all of `docs`; the network from at most about `sample` rows of `labels`.

    `labels` has doc_id and label. What tasks send is `WORDS` x `WIDTH` sums each, in blocks; they are
    added up in three levels, so that a task gets a block of at most `FAN_IN` others (and the last one
    of as many as there are 65536 input tasks).
    """
    parts = docs.select(column(docs, "text", "string").alias("text")).mapInArrow(_partial, _SUMS)
    for _ in range(2):
        parts = parts.groupBy("block", F.floor(F.col("task") / FAN_IN).alias("_group")).applyInPandas(_summed, _SUMS)
    blocks = parts.groupBy("block").applyInPandas(_summed, _SUMS).collect()
    sums, often = np.zeros((WORDS, WIDTH), np.int64), np.zeros(WORDS, np.int64)
    for r in blocks:
        sums[r.block : r.block + BLOCK] = np.frombuffer(r.sums, np.int64).reshape(-1, WIDTH)
        often[r.block : r.block + BLOCK] = np.frombuffer(r.often, np.int64)
    model = Model(sums, often)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = model.features(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([v.tobytes() for v in x], pa.binary())], ["label", "x"])

    rows = sorted((r.label, bytes(r.x)) for r in sample_of(docs, labels, sample).mapInArrow(of, "label int, x binary").limit(2 * sample).collect())
    if rows:
        model.network = Network(np.array([np.frombuffer(x, np.float32) for _, x in rows], float), np.array([y for y, _ in rows], float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of `docs`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    read = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return read.mapInArrow(of, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "quality", "int").alias("label"))
    model = fit(docs, known.filter(~held_out(5, 0, F.col("doc_id"))))
    out = score(docs, model)
    return out.select("doc_id", held_out(5, 0, F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_ABOVE).cast("int").alias("predicted"))
