"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

A voter looks for one word of `LEXICON` (which has a list for each of four languages), for a pattern
of the text, or for a word or a beginning of words that the corpus itself insults with; it says toxic,
clean or nothing, and reads no label. Which beginnings get a voter is found in the labelled rows: those
that stand so often in toxic texts and so seldom in others that chance is no reason, each picked for the
texts that none before it tells (see `_picked`). The label model is a mixture of two
classes; within a class each voter's say depends on one other voter's, so voters that repeat one
another count once. It estimates the voters' accuracies (their rates by class), the tree of the
strongest correlations within the classes and the rates along it by EM, from the votes alone,
beginning with what the lexicon's voters say. Labels give the
share of class 1 to begin with. The posteriors are the targets
of a logistic regression over the votes and the text's shape, whose slope and offset are calibrated on
labels at the end; it scores every document without any label.

Rows of the sample that are copies of one another (same least 3-word shingle) weigh one row together.
Executors count beginnings and turn the sample's texts, which are written once, into votes; the driver
gets some hundred bytes a row.

Defined results: a null or empty text gets the score of a text without words; with fewer than `LEAST`
labelled rows only the lexicon speaks, at fixed rates. Null labels are not learned from, and equal
texts have equal scores, whatever their columns. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import hashing
from tidelog.llm.common import column, filtered, held_out, sliced
from tidelog.llm.labelled import sample_of
from tidelog.llm.storage import Tables

#: Words that insult, by language; fixed values.
LEXICON = {
    "en": ("idiot", "stupid", "moron", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown"),
    "de": ("idiot", "dumm", "trottel", "versager", "abschaum", "erbärmlich", "wertlos", "widerlich", "depp", "dreckskerl"),
    "fr": ("idiot", "stupide", "crétin", "minable", "ordure", "pathétique", "débile", "dégueulasse", "abruti", "imbécile"),
    "es": ("idiota", "estúpido", "imbécil", "perdedor", "escoria", "basura", "patético", "inútil", "asqueroso", "payaso"),
}
#: Bound of the labelled rows that label model and classifier are fitted on, and the least to fit on.
SAMPLE = 10_000
LEAST = 40
#: Rows that the rate of a voter alone counts as, beside what its parent says.
SHRINK = 30
PATTERNS = ("several words", "word on word", "shouting", "exclaiming", "calm", "no word")
FIGURES = 5
#: Bytes of the beginnings that may get a voter; words longer than all of them may as a whole.
STEMS = (4, 5, 6, 7, 8)
#: Half the G statistic that a beginning needs (chance gives 15 once in 20 million), the least share of toxic
#: texts, and the bounds of those that are looked at and of those that get a voter.
TELLS, PRECISION = 15.0, 0.7
LOOKED_AT, PICKED = 1024, 64
_SPLIT = np.arange(256, dtype=np.uint8)
_SPLIT[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def _spelt(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text numbers, sums of the bytes, word starts, word ends, bounds of each text's words), by groups of texts."""
    raw = [(t or "").lower().encode() for t in texts]
    for numbers in hashing.groups([len(r) for r in raw]):
        buffer = _SPLIT[np.frombuffer(b"\n".join(raw[k] for k in numbers) + b"\n", np.uint8)]
        starts, ends = hashing.word_spans(buffer)
        yield numbers, hashing.prefix(hashing.byte_values(buffer)), starts, ends, np.searchsorted(starts, np.cumsum([len(raw[k]) + 1 for k in numbers]))


def _words(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(text numbers, word hashes, bounds of each text's words), by groups of texts."""
    for numbers, sums, starts, ends, bound in _spelt(texts):
        yield numbers, hashing.ranges(sums, starts, ends), bound


def _keys(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, keys): the first `size` bytes of each word that has as many; for 0, all of those longer than any stem."""
    of = np.flatnonzero(ends - starts >= size if size else ends - starts > STEMS[-1])
    keys = hashing.ranges(sums, starts[of], starts[of] + size if size else ends[of])
    return of, hashing.mixed(keys + np.uint64(size))


def word_hash(word: str) -> np.uint64:
    return hashing.word_hashes(np.frombuffer(word.encode(), np.uint8))[0][0]


def shape(texts: list[str | None]) -> np.ndarray:
    """(share of capitals, exclamation marks per word, log words) of each text."""
    out = []
    for t in texts:
        raw = (t or "").encode()
        b = np.frombuffer(raw, np.uint8)
        letters = np.count_nonzero((b | 32) - np.uint8(97) < 26) if len(b) else 0
        upper = np.count_nonzero(b - np.uint8(65) < 26) if len(b) else 0
        words = raw.count(b" ") + raw.count(b"\n") + bool(raw)
        out.append((upper / max(letters, 1), min(raw.count(b"!") / max(words, 1), 2.0), np.log1p(words)))
    return np.array(out, float).reshape(len(texts), 3)


class Voters:
    def __init__(self, words: np.ndarray, stems: list[tuple[int, int]] | None = None) -> None:
        """Whole words by their hashes; (size, key) of beginnings, as `_keys` gives them."""
        self.words = np.unique(words)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.words & np.uint64(0xFFFF)] = True
        self.stems = {}
        for size in sorted({k for k, _ in stems or []}):
            keys = np.unique(np.array([key for k, key in stems if k == size], np.uint64))
            maybe = np.zeros(1 << 16, bool)
            maybe[keys & np.uint64(0xFFFF)] = True
            self.stems[size] = (keys, maybe)
        #: Voters that a word calls up; patterns come after them.
        self.lexical = len(self.words) + sum(len(keys) for keys, _ in self.stems.values())

    def __len__(self) -> int:
        return self.lexical + len(PATTERNS)

    def found(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place of the word, voter) of all words that call up a voter, by groups of texts."""
        for numbers, sums, starts, ends, bound in _spelt(texts):
            held, first = [], 0
            for size, (keys, maybe) in [(-1, (self.words, self.maybe)), *self.stems.items()]:
                of, values = (np.arange(len(starts)), hashing.ranges(sums, starts, ends)) if size < 0 else _keys(sums, starts, ends, size)
                few = np.flatnonzero(maybe[values & np.uint64(0xFFFF)])
                if len(few) and len(keys):
                    at = np.minimum(np.searchsorted(keys, values[few]), len(keys) - 1)
                    here = keys[at] == values[few]
                    held.append((of[few[here]], first + at[here]))
                first += len(keys)
            if held:
                place = np.concatenate([p for p, _ in held])
                yield np.array(numbers)[np.searchsorted(bound, place, side="right")], place, np.concatenate([v for _, v in held])

    def votes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(votes 1, 0 or -1; features) by text: the features are the votes, hits and shape."""
        s = shape(texts)
        out = np.zeros((len(texts), len(self)), np.int8)
        hits, close, several = np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for text, place, voter in self.found(texts):
            out[text, voter] = 1
            # A word that calls up several voters is one hit.
            place, one = np.unique(place, return_index=True)
            text, voter = text[one], voter[one]
            hits += np.bincount(text, minlength=len(texts))
            near = (np.diff(place) <= 20) & (text[1:] == text[:-1])
            close[text[1:][near]] = True
            called = np.unique(np.stack((text, voter)), axis=1)[0]
            several |= np.bincount(called, minlength=len(texts)) > 1
        w = self.lexical
        out[:, w] = several
        out[:, w + 1] = close
        out[:, w + 2] = (s[:, 0] > 0.5) & (s[:, 2] > 1)
        out[:, w + 3] = s[:, 1] > 0.3
        out[:, w + 4] = -((s[:, 0] < 0.2) & (s[:, 1] < 0.05)).astype(np.int8)
        out[:, w + 5] = -(hits == 0).astype(np.int8)
        return out, np.column_stack((out, np.log1p(hits), hits / np.expm1(np.maximum(s[:, 2], np.log(2))) * 20, s))


def _tree(dependence: np.ndarray) -> list[tuple[int, int]]:
    """(voter, parent or -1) along the tree of the strongest dependences, parents first."""
    m = len(dependence)
    best, parent, left = np.full(m, -1.0), np.full(m, -1), set(range(m))
    out = []
    while left:
        j = max(left, key=lambda k: (best[k], -k))
        left.remove(j)
        out.append((j, int(parent[j])))
        closer = dependence[j] > best
        best[closer], parent[closer] = dependence[j][closer], j
    return out


class LabelModel:
    """P(class) and P(vote | class, the parent's vote), by EM from the votes alone."""

    #: What a voter says before anything is known: clean, nothing, toxic.
    BEFORE = np.array([0.1, 0.8, 0.1])

    def __init__(self, votes: np.ndarray, words: int, weight: np.ndarray, prior: float, rounds: int = 20) -> None:
        n, m = votes.shape
        said = (votes[:, :, None] == np.array([-1, 0, 1])).astype(np.float32).reshape(n, 3 * m)
        posterior = np.where((votes[:, :words] == 1).any(axis=1), 0.9, 0.1)
        self.prior, known = prior, weight.sum()
        for _ in range(rounds):
            # The share of class 1 given at first counts as much as all the votes.
            self.prior = (weight @ posterior + known * prior) / (2 * known)
            both = []
            for mass in (weight * (1 - posterior), weight * posterior):
                both.append(((said * mass[:, None].astype(np.float32)).T @ said).astype(float).reshape(m, 3, m, 3))
            self.tree = _tree(self._dependence(both))
            logit = np.full(n, np.log(self.prior / (1 - self.prior)))
            self.evidence = {}
            for j, p in self.tree:
                rates = []
                for count in both:
                    alone = np.diagonal(count[j, :, j, :]) + 10 * self.BEFORE
                    alone = alone / alone.sum()
                    # Beside a parent, shrunk towards the rate of the voter alone.
                    given = count[j, :, p, :].T + SHRINK * alone if p >= 0 else np.tile(alone, (3, 1))
                    rates.append(given / given.sum(axis=1, keepdims=True))
                self.evidence[j] = np.log(rates[1]) - np.log(rates[0])
                if j < words:
                    # Whatever another voter says, a word found does not speak for clean.
                    self.evidence[j][:, 2] = np.maximum(self.evidence[j][:, 2], 0)
                logit += self.evidence[j][votes[:, p] + 1 if p >= 0 else np.zeros(n, int), votes[:, j] + 1]
            posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        self.posterior = posterior

    @staticmethod
    def _dependence(both: list[np.ndarray]) -> np.ndarray:
        """The voters' mutual information within the classes, weighted by the classes' shares."""
        total, m = np.zeros(both[0].shape[::2]), len(both[0])
        mass = [np.trace(c[0, :, 0, :]) for c in both]
        for count, share in zip(both, mass, strict=True):
            p = count / max(share, 1e-9)
            one = np.stack([np.diagonal(p[j, :, j, :]) for j in range(m)])
            apart = one[:, :, None, None] * one[None, None, :, :]
            ratio = np.log(np.maximum(p, 1e-12) / np.maximum(apart, 1e-12))
            total += share / max(sum(mass), 1e-9) * np.where(p > 1e-12, p * ratio, 0).sum(axis=(1, 3))
        return np.maximum(total, 0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last one is the bias) by Newton's method on soft targets."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _calibrated(logit: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by which the logits fit the labels, near 1 and 0 if these say little."""
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * logit + offset, -30, 30)))
        g = np.array([weight @ ((p - labels) * logit) + (slope - 1), weight @ (p - labels) + offset])
        v = weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[v @ logit**2 + 1, v @ logit], [v @ logit, v.sum() + 1]])
        step = np.linalg.solve(h, g)
        step /= max(1.0, np.abs(step).max())
        slope, offset = max(slope - step[0], 0.05), offset - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return slope, offset


class Model:
    def __init__(self, voters: Voters, votes: np.ndarray, x: np.ndarray, labels: np.ndarray, copies: np.ndarray) -> None:
        """Votes, features, labels and copy groups of a sample, as `voters` gave them."""
        self.voters = voters
        if len(labels) < LEAST:
            # Fixed rates: a word is strong evidence, its absence is weak.
            self.weights = np.zeros(len(voters) + FIGURES + 1)
            self.weights[: voters.lexical] = 5.0
            self.weights[-1] = -3.0
            return
        _, group, size = np.unique(copies, return_inverse=True, return_counts=True)
        weight = 1 / size[group]
        prior = (weight @ labels + 1) / (weight.sum() + 2)
        self.label_model = LabelModel(votes, voters.lexical, weight, prior)
        self.weights = _logistic(x, self.label_model.posterior, weight)
        slope, offset = _calibrated(x @ self.weights[:-1] + self.weights[-1], labels, weight)
        self.weights *= slope
        self.weights[-1] += offset

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = self.voters.votes(texts)[1] if texts else np.zeros((0, len(self.weights) - 1))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fixed_voters() -> Voters:
    return Voters(np.array([word_hash(w) for words in LEXICON.values() for w in words], np.uint64))


def _least(texts: list[str | None]) -> list[int]:
    """A number for each text that its copies share: its least shingle of three words."""
    out = [0] * len(texts)
    for numbers, values, bound in _words(texts):
        grams = hashing.grams(values, 3)
        for k, a, b in zip(numbers, [0, *bound.tolist()], bound.tolist(), strict=False):
            out[k] = int(grams[a : b - 2].min() if b - a > 2 else values[a:b].sum(dtype=np.uint64)) >> 1
    return out


def _signal(toxic: np.ndarray, clean: np.ndarray, share: float) -> np.ndarray:
    """Half the G statistic of beginnings in so many toxic and clean texts, 0 below `PRECISION`; `share` of all texts are toxic."""
    both = np.maximum(toxic + clean, 1e-9)
    g = toxic * np.log(np.maximum(toxic, 1e-9) / (both * share)) + clean * np.log(np.maximum(clean, 1e-9) / (both * (1 - share)))
    return np.where(toxic >= max(PRECISION, share) * both, g, 0.0)


def _picked(row: np.ndarray, stem: np.ndarray, told: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> list[int]:
    """The stems that get a voter, of those that stand in rows (`row`, `stem` side by side): again and again the one
    that tells most of the rows which none has `told` yet."""
    told, out = told.copy(), []
    share = float(weight @ labels / weight.sum())
    toxic, clean = weight * labels, weight * (1 - labels)
    while len(out) < PICKED and len(row):
        left = ~told[row]
        at, of = row[left], stem[left]
        size = int(stem.max()) + 1
        signal = _signal(np.bincount(of, toxic[at], size), np.bincount(of, clean[at], size), share)
        best = int(signal.argmax())
        if signal[best] < TELLS:
            break
        out.append(best)
        told[row[stem == best]] = True
    return out


def _stems(drawn: DataFrame, voters: Voters, bound: int) -> list[tuple[int, int]]:
    """(size, key) of the beginnings of words that get a voter, from `drawn` (text, label, least)."""
    rows = drawn.select("least", "label").limit(bound).collect()
    labels = np.array([r.label for r in rows], float)
    groups, at, size = np.unique(np.array([r.least for r in rows], np.int64), return_inverse=True, return_counts=True)
    if len(rows) < LEAST or not 0 < labels.mean() < 1:
        return []
    weight = 1 / size
    share = float(weight[at] @ labels / len(groups))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            label, least = np.asarray(b.column(1), float), np.asarray(b.column(2), np.int64)
            k = np.minimum(np.searchsorted(groups, least), len(groups) - 1)
            heavy = np.where(groups[k] == least, weight[k], 0.0)
            for numbers, sums, starts, ends, bound in _spelt(b.column(0).to_pylist()):
                text = np.array(numbers)[np.searchsorted(bound, np.arange(len(starts)), side="right")]
                for bytes_ in (0, *STEMS):
                    of, keys = _keys(sums, starts, ends, bytes_)
                    order = np.lexsort((text[of], keys))
                    keys, t = keys[order], text[of][order]
                    new = np.ones(len(keys), bool)
                    new[1:] = (keys[1:] != keys[:-1]) | (t[1:] != t[:-1])
                    one, inverse = np.unique(keys[new], return_inverse=True)
                    mass, said = heavy[t[new]], label[t[new]]
                    toxic, clean = (np.bincount(inverse, mass * y, len(one)) for y in (said, 1 - said))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), bytes_, np.int32)), pa.array(one.view(np.int64)), pa.array(toxic), pa.array(clean)], ["size", "key", "toxic", "clean"])

    # Sums of shares come in any order; rounded, they are the same in each run.
    sums = [F.round(F.sum(c), 6).alias(c) for c in ("toxic", "clean")]
    counts = drawn.select("text", "label", "least").mapInArrow(counted, "size int, key long, toxic double, clean double").groupBy("size", "key").agg(*sums)
    both = F.col("toxic") + F.col("clean")
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * s))).otherwise(0.0)
    told = counts.filter(F.col("toxic") >= max(PRECISION, share) * both).withColumn("signal", F.round(part("toxic", share) + part("clean", 1 - share), 6)).filter(F.col("signal") >= TELLS)
    looked_at = [(r.size_, r.key & 0xFFFF_FFFF_FFFF_FFFF) for r in told.orderBy(F.col("signal").desc(), "size", "key").limit(LOOKED_AT).select(F.col("size").alias("size_"), "key").collect()]
    if not looked_at:
        return []
    seen = Voters(voters.words, looked_at)
    # Voters have an order of their own.
    named = [(k, int(key)) for k, (keys, _) in seen.stems.items() for key in keys]
    fixed = len(seen.words)

    def standing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = b.column(0).to_pylist()
            where: list[list[np.ndarray]] = [[] for _ in texts]
            for text, _, voter in seen.found(texts):
                for t in np.unique(text):
                    where[t].append(np.unique(voter[text == t]))
            packed = [np.concatenate(v).astype("<i4").tobytes() if v else b"" for v in where]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(packed, pa.binary())], ["label", "least", "packed"])

    rows = sorted((r.least, r.label, bytes(r.packed)) for r in drawn.select("text", "label", "least").mapInArrow(standing, "label int, least long, packed binary").limit(bound).collect())
    held = [np.frombuffer(p, "<i4") for _, _, p in rows]
    row, voter = np.repeat(np.arange(len(rows)), [len(h) for h in held]), np.concatenate(held)
    told_ = np.zeros(len(rows), bool)
    told_[row[voter < fixed]] = True
    _, at, size = np.unique(np.array([g for g, _, _ in rows], np.int64), return_inverse=True, return_counts=True)
    stems = voter >= fixed
    return [named[k] for k in _picked(row[stems], voter[stems] - fixed, told_, np.array([y for _, y, _ in rows], float), 1 / size[at])]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about `sample` rows of `labels` (doc_id, label) and their texts."""
    tables = Tables(docs.sparkSession)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_least(b.column(0).to_pylist()), pa.int64())], ["text", "label", "least"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            votes, x = voters.votes(b.column(0).to_pylist())
            packed = [v.tobytes() + f.astype("<f4").tobytes() for v, f in zip(votes, x[:, len(voters) :], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(packed, pa.binary())], ["label", "least", "packed"])

    drawn = tables.store(sample_of(docs, labels, sample).select("text", "label").mapInArrow(copied, "text string, label int, least long"))
    voters = fixed_voters()
    voters = Voters(voters.words, _stems(drawn, voters, 2 * sample))
    rows = sorted((r.least, r.label, bytes(r.packed)) for r in drawn.mapInArrow(of, "label int, least long, packed binary").limit(2 * sample).collect())
    tables.clear()
    m = len(voters)
    votes = np.array([np.frombuffer(p, np.int8, m) for _, _, p in rows], np.int8).reshape(-1, m)
    figures = np.array([np.frombuffer(p, "<f4", offset=m) for _, _, p in rows], float).reshape(-1, FIGURES)
    return Model(voters, votes, np.column_stack((votes, figures)), np.array([y for _, y, _ in rows], np.int64), np.array([g for g, _, _ in rows], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of `docs`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    read = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return read.mapInArrow(of, "doc_id long, score double")


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that are not toxic."""
    return filtered(docs, column(docs, "text", "string"), lambda texts: (model.scores(texts) < 0.5).tolist())


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels that the registered query may learn from."""
    known = labels.select(column(labels, "doc_id", "long").alias("doc_id"), column(labels, "toxic", "int").alias("label"))
    return known.filter(~held_out(5, 0, F.col("doc_id")))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, training_labels(labels)))
    return out.select("doc_id", held_out(5, 0, F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
