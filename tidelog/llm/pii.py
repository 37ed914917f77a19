"""Personal data by base patterns and a skip-chain conditional random field.

Base spans are the patterns' matches, leftmost and non-overlapping for each kind; a match that fails
its test (IP parts, Luhn's digit, digit counts) is dropped without another try. They stay whatever
the field says.

The field decides about candidates that the patterns miss: address-like words around an `@` or
`(at)`, numbers in groups, dotted numbers, and long tokens of letters and digits, which may be secrets,
a fifth kind that only the field adds. Each candidate of a document is a node with a label, one of the
kinds or none. Its own potential is a log-linear model of how it looks and what words stand before it.
Neighbours in the text share a chain potential. Distant nodes are joined by skip edges if they have
equal contents (the same address in other letters, the same digits but for separators) or similar ones
(the same end): an edge's potential favours one label, so that a repeated token is labelled in all
places as where it is clearest. Sum-product messages go around the loopy graph until they settle;
labels with a belief of `BELIEF` become spans, if no base span of the same kind overlaps them.

Equal contents are one star of edges around their first node, and similar contents are joined through
their common key, so a token repeated n times has n edges, not n x n. Node weights and the strengths of
the three sorts of edges are trained together, by pseudo-likelihood: each node's label given its looks
and its neighbours' labels. Labels are the base spans and, for secrets, what stands behind `SECRET`'s
words; in half of the cases the looks by which the labels were given are hidden from the model, so that
the rest and the neighbours must tell. The sample is the first `SAMPLE` distinct texts by hash, and of
each at most `CANDIDATES` candidates by hash from all over the text.

Defined results: a null text is empty and has no spans; equal texts have equal spans, whatever their
ids and other columns; an empty table gives an empty one; texts of any length are read whole; offsets
are in code points, ends exclusive. With nothing to learn from, only exact looks speak.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import column, replaced_text, sliced

#: The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "secret")
SURE, NONE = 4, len(KINDS)
CHAIN, SAME, ALIKE = range(3)
BELIEF = 0.9
ROUNDS = 8
#: Bound of the distinct texts that the field's weights are fitted on, and of the candidates of each.
SAMPLE = 2_000
CANDIDATES = 64

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9][0-9().\x20-]{6,28}[0-9]")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\])[A-Za-z0-9-]{1,63}){1,8}")
_AT = re.compile(r"@|\(at\)|\[at\]")
_BEFORE = (
    re.compile(r"mail|contact|write", re.I), re.compile(r"\bip\b|host|server|address", re.I),
    re.compile(r"card|visa|credit|iban", re.I), re.compile(r"phone|tel|call|fax|mobile", re.I), re.compile(r"key|token|secret|passw|pwd|auth", re.I),
)
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,200}(?![A-Za-z0-9+/_-])")
SECRET = re.compile(r"""(?:key|token|secret|passw\w*|pwd)["']?\s*[=:]\s*["']?$""", re.I)

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # From each @ backwards and forwards: words without one are not scanned again and again.
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            yield begin, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    # Of a chain of dotted numbers each four in a row are a match, and linear to find.
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".") if m.end() - m.start() >= 7 else ()
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def base(text: str) -> list[Span]:
    """(start, end, kind) of the base spans, by start, then kind."""
    out: list[Span] = [(a, b, 0) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [(a, b, 1) for a, b in _ips(text)]
        for m in _CARD.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((*m.span(), 2))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                    out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _candidates(text: str, spans: list[Span]) -> list[Span]:
    """The nodes: base spans with their kind, other candidates with `NONE`; by start."""
    found = list(spans)
    taken = {(a, b) for a, b, _ in spans}
    if _AT.search(text):
        found += [(*m.span(), NONE) for m in _ADDRESS.finditer(text) if m.span() not in taken]
    if _DIGIT.search(text):
        found += [(*m.span(), NONE) for m in _NUMBER.finditer(text) if m.span() not in taken]
        found += [(*m.span(), NONE) for m in _LONG.finditer(text) if m.span() not in taken]
    return sorted(set(found))


def _content(text: str) -> str:
    """What is alike in tokens that differ in letters' case and separators."""
    if any(c.isalpha() for c in text):
        plain = re.sub(r"\(at\)|\[at\]", "@", text.lower())
        return re.sub(r"\(dot\)|\[dot\]", ".", plain).replace(" ", "")
    return re.sub(r"[^0-9]", "", text)


def _features(text: str, a: int, b: int, plain: bool) -> np.ndarray:
    """How a candidate looks. `plain`: without what only the base patterns see."""
    token = text[a:b]
    digits = sum(c.isdigit() for c in token)
    letters = sum(c.isalpha() for c in token)
    content = _content(token)
    parts = token.split(".")
    before = text[max(0, a - 24) : a]
    octets = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    exact = (
        bool(_EMAIL.fullmatch(token)), octets, 14 <= digits <= 19 and not letters and _luhn(re.sub(r"[^0-9]", "", token)), token[0] == "+" and 10 <= digits <= 15,
        len(token) >= 20 and letters > 0 and bool(SECRET.search(text[max(0, a - 24) : a])),
    )
    long = len(token) >= 20 and letters > 0 and digits > 0 and content.find("@") < 0
    x = [
        1.0, letters > 0, "@" in content and letters > 0, "." in token and letters > 0, digits / 20, 10 <= digits <= 15, 14 <= digits <= 19, digits < 10, digits > 19,
        len(parts) == 4 and not letters, token.count("-") / 4, token.count(" ") / 4, "(" in token, long, long and bool(_HEX.fullmatch(token)), long and digits / len(token),
        *(bool(w.search(before)) for w in _BEFORE),
    ]
    return np.array([*x, *((0,) * len(KINDS) if plain else exact)], float)


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_N_FEATURES = len(_features("0", 0, 1, True))


@dataclass(frozen=True)
class Field:
    """Weights (feature, label) of the nodes, and the strength of each sort of edge."""

    nodes: np.ndarray
    edges: np.ndarray


def fitted(x: np.ndarray, y: np.ndarray, near: np.ndarray) -> Field:
    """The field, by gradient steps with momentum on the pseudo-likelihood.

    `near` (node, sort of edge, label) counts each node's neighbours by their labels."""
    w, strength = np.zeros((_N_FEATURES, NONE + 1)), np.zeros(3)
    if not len(y):
        # Nothing to learn from: only exact looks speak, and repeated tokens go together.
        w[0, NONE] = 3.0
        for k in range(NONE):
            w[_N_FEATURES - NONE + k, k] = 6.0
        return Field(w, np.array([0.0, 7.0, 0.0]))
    target = np.eye(NONE + 1)[y]
    # Kinds are far from equally frequent: each weighs the same in half of the loss.
    share = np.bincount(y, minlength=NONE + 1)
    weight = (0.5 + 0.5 * len(y) / np.maximum(share[y], 1) / max((share > 0).sum(), 1))[:, None] / len(y)
    speed, speed_e = np.zeros_like(w), np.zeros(3)
    for _ in range(400):
        z = x @ w + np.einsum("nsl,s->nl", near, strength)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = weight * (p - target)
        speed = 0.9 * speed - 0.5 * (x.T @ error + 1e-3 * w)
        speed_e = 0.9 * speed_e - 0.5 * (np.einsum("nl,nsl->s", error, near) + 1e-3 * strength)
        w, strength = w + speed, strength + speed_e
    return Field(w, strength)


def _edges(text: str, nodes: list[Span]) -> list[tuple[int, int, int]]:
    """(node, node, sort): chain edges between neighbours, skip edges between like tokens."""
    out = [(k, k + 1, CHAIN) for k in range(len(nodes) - 1)]
    first: dict[str, int] = {}
    for k, (a, b, _) in enumerate(nodes):
        content = _content(text[a:b])
        if not content:
            continue
        # The same content; for long contents, the same end of it.
        for key, sort in (("c" + content, SAME), *((("e" + content[-8:], ALIKE),) if len(content) > 9 else ())):
            if key in first:
                out.append((first[key], k, sort))
                break
            first[key] = k
    return out


def beliefs(own: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Marginals by loopy sum-product: log potentials `own` (node, label), edges that favour one label."""
    n, labels = own.shape
    if not edges:
        z = own - own.max(axis=1, keepdims=True)
        return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    u, v, s = (np.array(x) for x in zip(*edges, strict=True))
    source, target = np.concatenate((u, v)), np.concatenate((v, u))
    back = np.concatenate((np.arange(len(u)) + len(u), np.arange(len(u))))
    favour = np.exp(np.concatenate((s, s)))[:, None]
    message = np.full((len(source), labels), -np.log(labels))
    for _ in range(ROUNDS):
        total = own.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        p = np.exp(out - out.max(axis=1, keepdims=True))
        # Potts potential: e^strength for the same label, 1 for another.
        m = p.sum(axis=1, keepdims=True) + (favour - 1) * p
        m = np.log(m / m.sum(axis=1, keepdims=True))
        moved = np.abs(m - message).max()
        message = 0.5 * (message + m) if moved > 1e-3 else m
        if moved < 1e-4:
            break
    total = own.copy()
    np.add.at(total, target, message)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def spans_of(text: str, weights: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    sure = base(text)
    nodes = _candidates(text, sure)
    if len(nodes) == len(sure):
        return sure, sure
    own = np.array([_features(text, a, b, False) for a, b, _ in nodes]) @ weights.nodes
    for k, (_, _, kind) in enumerate(nodes):
        if kind != NONE:
            own[k] = -20.0
            own[k, kind] = 0.0
    p = beliefs(own, [(u, v, float(weights.edges[sort])) for u, v, sort in _edges(text, nodes)])
    added = []
    for (a, b, kind), q in zip(nodes, p, strict=True):
        label = int(q.argmax())
        if kind == NONE and label != NONE and q[label] >= BELIEF and not any(label == j and x < b and a < y for x, y, j in sure):
            added.append((a, b, label))
    # Candidates may overlap: of one kind the longer one stays.
    added = [x for x in added if not any(y != x and y[2] == x[2] and x[0] < y[1] and y[0] < x[1] and (y[1] - y[0], -y[0]) > (x[1] - x[0], -x[0]) for y in _around(added, x))]
    return sure, sorted(sure + added, key=lambda s: (s[0], s[2], s[1]))


def _around(spans: list[Span], one: Span) -> list[Span]:
    """The spans, in order, that may overlap one of them: no candidate has more than 800 characters."""
    return spans[bisect_left(spans, (one[0] - 800, 0, 0)) : bisect_left(spans, (one[1], 0, 0))]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def _examples(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        kinds, xs, nears = [], [], []
        for text in batch.column(0).to_pylist():
            nodes = [(a, b, SURE if k == NONE and b - a >= 20 and SECRET.search(text[max(0, a - 24) : a]) else k) for a, b, k in _candidates(text, base(text))]
            near = np.zeros((len(nodes), 3, NONE + 1), np.float32)
            for u, v, sort in _edges(text, nodes):
                near[u, sort, nodes[v][2]] += 1
                near[v, sort, nodes[u][2]] += 1
            # As in a message, many neighbours say little more than a few.
            near = np.minimum(near, 3)
            chosen = range(len(nodes))
            if len(nodes) > most:
                chosen = sorted(sorted(chosen, key=lambda k: (zlib.crc32(f"{nodes[k][0]} {text[nodes[k][0] : nodes[k][1]]}".encode()), k))[:most])
            for k in chosen:
                a, b, kind = nodes[k]
                kinds.append(kind)
                xs.append(_features(text, a, b, k % 2 == 0).tobytes())
                nears.append(near[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(xs, pa.binary()), pa.array(nears, pa.binary())], ["kind", "x", "near"])


def fit(docs: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES) -> Field:
    """The field, from `sample` distinct texts with a digit or an @, at most `candidates` of each."""
    texts = docs.select(column(docs, "text", "string").alias("text")).filter(F.col("text").rlike("[0-9@]"))
    hashed = texts.withColumn("draw", F.xxhash64("text"))
    # Copies count once; the hashes alone tell where the sample ends.
    last = hashed.select("draw").distinct().orderBy("draw").limit(sample).agg(F.max("draw")).first()[0]
    rows = []
    if last is not None:
        drawn = hashed.filter(F.col("draw") <= last).groupBy("draw").agg(F.first("text").alias("text")).select("text")
        found = drawn.mapInArrow(lambda batches: _examples(batches, candidates), "kind int, x binary, near binary").collect()
        rows = sorted((r.kind, bytes(r.x), bytes(r.near)) for r in found)
    x = np.array([np.frombuffer(v) for _, v, _ in rows]).reshape(-1, _N_FEATURES)
    near = np.array([np.frombuffer(n, np.float32) for _, _, n in rows], float).reshape(-1, 3, NONE + 1)
    return fitted(x, np.array([k for k, _, _ in rows], int), near)


def find(docs: DataFrame, weights: Field) -> DataFrame:
    """(doc_id, counts of base spans by kind, base, spans, counts of all spans and of secrets) for each row of `docs`."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans", "n_spans", "n_secret"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                sure, every = spans_of(text or "", weights)
                kinds = [k for _, _, k in sure]
                rows.append((*(kinds.count(k) for k in range(SURE)), joined(sure), joined(every), len(every), sum(k == SURE for _, _, k in every)))
            kinds = (*[pa.int64()] * SURE, pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    read = docs.select(column(docs, "doc_id", "long").alias("doc_id"), column(docs, "text", "string").alias("text"))
    return read.mapInArrow(of, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_spans long, n_secret long")


def masked(text: str | None, weights: Field) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping ones by the first."""
    if text is None:
        return None
    out, last = [], 0
    for a, b, kind in spans_of(text, weights)[1]:
        if a >= last:
            out += (text[last:a], f"<{KINDS[kind]}>")
        last = max(last, b)
    out.append(text[last:])
    return "".join(out)


def redact(docs: DataFrame, weights: Field) -> DataFrame:
    """`docs` with the personal data in its texts masked; all rows and columns stay."""
    return replaced_text(docs, lambda texts: [masked(t, weights) for t in texts])


def digest(docs: DataFrame) -> DataFrame:
    out = find(docs, fit(docs))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans", "n_secret")


def brute(text: str | None) -> tuple[int, int, int, int, str]:
    """Counts and digest of the base spans, by the patterns as they stand; for tests."""
    text = text or ""
    out = [(*m.span(), 0) for m in _EMAIL.finditer(text)]
    out += [(*m.span(), 1) for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for pattern, kind, least, most in ((_CARD, 2, 14, 19), (_PHONE, 3, 10, 15)):
        for m in pattern.finditer(text):
            digits = [c for c in m[0] if c in "0123456789"]
            if least <= len(digits) <= most and (kind == 3 or _luhn("".join(digits))):
                out.append((*m.span(), kind))
    out.sort(key=lambda s: (s[0], s[2]))
    kinds = [k for _, _, k in out]
    return (*(kinds.count(k) for k in range(4)), hashlib.sha256(joined(out).encode()).hexdigest())
