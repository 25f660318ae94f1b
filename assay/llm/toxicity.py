"""Toxic spans by a linear-chain conditional random field.

Labels are given for whole documents. Words and word beginnings that stand in toxic documents
far more often than chance allows become evidence features; a token of a toxic training
document that has one is labelled toxic, every token of other documents is not. On windows of
these labelled tokens a two-state chain with feature weights and transitions is trained. A
document's marginals come from forward-backward over its whole token sequence: stretches
without evidence all have one transition matrix, whose power is taken at once, so the result
is that of the plain recursion. The marginals give the offending offsets; their largest value
and their sum give the score, calibrated on the training documents.

Rows with crc32(doc_id) mod ``FOLDS`` = 0 are never learned from. At most ``TRAINING_ROWS``
labelled documents are learned from, those with the smallest hash of doc_id; scoring covers
every text to its end. Only the text enters a score.

Results for unusual input: null and empty texts get the score of a text without evidence; a
null doc_id is not held out; labels without a document, or null, are not used; without any
toxic label all scores are the share of toxic training documents; rows that repeat are scored
alike; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import text_rows

FOLDS = 5
TRAINING_ROWS = 12_000
#: Evidence: least toxic documents, share of toxic ones among a feature's documents, and G-squared.
LEAST_DOCUMENTS = 5
LEAST_SHARE = 0.8
LEAST_G2 = 30.0
FEATURES = 5000
BEGINNINGS = range(4, 9)
REACH = 8
WINDOWS_PER_DOCUMENT = 6
STEPS = 150
REMEMBERED_WORDS = 300_000
_EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_"


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: Column, rows: int) -> list:
    """(text, label) of at most ``rows`` labelled documents outside the held-out fold."""
    picked = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
              .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = text_rows(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label"))
    return sorted(((r.doc_id, r.text, r.label) for r in found.collect()), key=lambda r: r[0])


def features_of(token: str) -> list[str]:
    """The word itself and its beginnings; ``token`` is in lower case."""
    word = token.strip(_EDGES)
    return [f"={word}"] + [word[:k] for k in BEGINNINGS if k < len(word)] if word else []


@dataclass
class Model:
    """Log-weights: ``weight`` by feature, ``rest`` of a token without evidence, transitions."""

    weight: dict[str, float] = field(default_factory=dict)
    rest: float = -6.0
    start: tuple[float, float] = (0.0, 0.0)
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def evidence(self, token: str) -> float | None:
        """Log-weight of the toxic state at a token, None if it has no evidence feature."""
        found = [self.weight[f] for f in features_of(token) if f in self.weight]
        return self.rest + sum(found) if found else None

    def marginals(self, places: list[int], weights: list[float], n: int) -> list[float]:
        """Probability of the toxic state at the evidence tokens of a text of n tokens."""
        step = np.exp(self.move)
        rest = step * np.array([1.0, math.exp(self.rest)])
        values, vectors = np.linalg.eig(rest)
        order = np.argsort(-values.real)
        first, second = values.real[order]
        inverse = np.linalg.inv(vectors.real[:, order])
        main = np.outer(vectors.real[:, order[0]], inverse[0])
        other = np.outer(vectors.real[:, order[1]], inverse[1])
        power = lambda k: main + (second / first) ** k * other if k else np.eye(2)
        forward, here, at = [], np.exp(self.start), 0
        for i, (place, w) in enumerate(zip(places, weights)):
            emit = np.array([1.0, math.exp(min(w, 500.0))])
            if i == 0 and place == 0:
                here = here * emit
            else:
                if i == 0:
                    here = here * np.array([1.0, math.exp(self.rest)])
                    at = 1
                here = (here @ power(place - at) @ step) * emit
            here = here / here.sum()
            forward.append(here)
            at = place + 1
        out, back, at = [0.0] * len(places), np.ones(2), n
        for i in range(len(places) - 1, -1, -1):
            back = power(at - places[i] - 1) @ back
            back = back / back.sum()
            both = forward[i] * back
            out[i] = float(both[1] / both.sum())
            back = step @ (np.array([1.0, math.exp(min(weights[i], 500.0))]) * back)
            at = places[i]
        return out

    def score(self, marginals: list[float]) -> float:
        a, b, c = self.calibration
        z = a + b * max(marginals, default=0.0) + c * math.log1p(sum(marginals))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _g2(a: int, b: int, toxic: int, clean: int) -> float:
    out, share = 0.0, (a + b) / (toxic + clean)
    for k, n in ((a, toxic), (b, clean)):
        for seen, want in ((k, n * share), (n - k, n * (1 - share))):
            if seen:
                out += 2 * seen * math.log(seen / want)
    return out


def evidence_features(rows: list) -> list[str]:
    """Features that stand in toxic documents far more often than in others."""
    count = {0: Counter(), 1: Counter()}
    for _, text, label in rows:
        count[int(label)].update({f for token in set((text or "").lower().split()) for f in features_of(token)})
    toxic = sum(1 for r in rows if r[2])
    clean = len(rows) - toxic
    good = []
    for name, a in count[1].items():
        b = count[0][name]
        if a >= LEAST_DOCUMENTS and a >= LEAST_SHARE * (a + b) and (g := _g2(a, b, toxic, clean)) >= LEAST_G2:
            good.append((-g, name))
    return [name for _, name in sorted(good)[:FEATURES]]


def _chains(rows: list, names: dict[str, int]):
    """Feature ids, labels and mask of token windows around evidence and at text starts."""
    feats, labels, mask = [], [], []
    width, most = 2 * REACH + 1, len(BEGINNINGS) + 1
    for _, text, label in rows:
        tokens = (text or "").lower().split()
        ids = {}
        for token in set(tokens):
            if found := [names[f] for f in features_of(token) if f in names]:
                ids[token] = found
        centres = [i for i, t in enumerate(tokens) if t in ids][:WINDOWS_PER_DOCUMENT] or ([REACH] if tokens else [])
        for centre in centres:
            f, y, m = np.zeros((width, most), np.int64), np.zeros(width, np.int64), np.zeros(width, bool)
            for j, token in enumerate(tokens[max(0, centre - REACH):centre + REACH + 1]):
                m[j] = True
                for k, x in enumerate(ids.get(token, ())):
                    f[j, k] = x
                y[j] = bool(label) and token in ids
            feats.append(f)
            labels.append(y)
            mask.append(m)
    return np.array(feats), np.array(labels), np.array(mask)


def _train(feats: np.ndarray, labels: np.ndarray, mask: np.ndarray, n_features: int, steps: int = STEPS):
    """Penalised maximum likelihood of the chains by Adam; weight 0 is that of every token."""
    size = n_features + 1
    theta = np.zeros(size + 6)  # weights, start (2), transitions (4)
    theta[0] = -3.0
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    n, width, _ = feats.shape
    real = feats > 0
    flat = feats[real]
    rows = np.nonzero(real)
    for step in range(1, steps + 1):
        w, start, move = theta[:size], theta[size:size + 2], theta[size + 2:].reshape(2, 2)
        emit = np.zeros((n, width, 2))
        emit[:, :, 1] = w[0]
        np.add.at(emit, (rows[0], rows[1], 1), w[flat])
        emit = np.exp(np.clip(emit, -30, 30))
        t = np.exp(move)
        alpha, beta = np.zeros((n, width, 2)), np.ones((n, width, 2))
        alpha[:, 0] = np.exp(start) * emit[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for j in range(1, width):
            a = (alpha[:, j - 1] @ t) * emit[:, j]
            a = np.where(mask[:, j, None], a, alpha[:, j - 1])
            alpha[:, j] = a / a.sum(1, keepdims=True)
        for j in range(width - 2, -1, -1):
            b = (emit[:, j + 1] * beta[:, j + 1]) @ t.T
            b = np.where(mask[:, j + 1, None], b, beta[:, j + 1])
            beta[:, j] = b / b.sum(1, keepdims=True)
        p = alpha * beta
        p /= p.sum(2, keepdims=True)
        gap = (p[:, :, 1] - labels) * mask
        grad = np.zeros_like(theta)
        grad[0] = gap.sum()
        grad[1:size] = np.bincount(flat, gap[rows[0], rows[1]], size)[1:]
        first = np.stack((1 - labels[:, 0], labels[:, 0]), 1)
        grad[size:size + 2] = (p[:, 0] - first).sum(0)
        pair = alpha[:, :-1, :, None] * t * (emit[:, 1:] * beta[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        seen = np.zeros_like(pair)
        i, j = np.nonzero(mask[:, 1:])
        seen[i, j, labels[i, j], labels[i, j + 1]] = 1
        grad[size + 2:] = ((pair - seen) * mask[:, 1:, None, None]).sum((0, 1)).ravel()
        grad = grad / n + 0.001 * theta
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta -= 0.2 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return theta[:size], theta[size:size + 2], theta[size + 2:].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    return w


class Tagger:
    """Evidence places of texts; remembers the evidence of each distinct token."""

    def __init__(self, model: Model):
        self.model, self.known, self.marked = model, set(), {}

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        """Places of the evidence tokens and their marginals."""
        tokens = text.lower().split()
        distinct = set(tokens)
        for token in distinct - self.known:
            w = self.model.evidence(token)
            if w is not None:
                self.marked[token] = w
        if len(self.known) > REMEMBERED_WORDS:
            self.known = set()
        self.known |= distinct
        if self.marked.keys().isdisjoint(distinct):
            return [], []
        places = [i for i, t in enumerate(tokens) if t in self.marked]
        return places, self.model.marginals(places, [self.marked[tokens[i]] for i in places], len(tokens))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Learn features, chain and calibration from a bounded sample of labelled documents."""
    sample = training_rows(docs, labels, F.col("toxic").cast("int"), rows)
    share = (sum(bool(r[2]) for r in sample) + 0.5) / (len(sample) + 1) if sample else 0.0
    model = Model(calibration=(math.log(share / (1 - share)) if sample else -30.0, 0.0, 0.0))
    names = {name: i + 1 for i, name in enumerate(evidence_features(sample))}
    if not names:
        return model
    weights, start, move = _train(*_chains(sample, names), len(names))
    model.weight = {name: float(weights[i]) for name, i in names.items()}
    model.rest, model.start, model.move = float(weights[0]), tuple(start.tolist()), move
    tag = Tagger(model)
    found = [tag(text or "")[1] for _, text, _ in sample]
    x = np.array([(1.0, max(m, default=0.0), math.log1p(sum(m))) for m in found])
    model.calibration = tuple(_logistic(x, np.array([float(bool(r[2])) for r in sample])).tolist())
    return model


def _score(model: Model):
    def run(batches):
        tag = Tagger(model)
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                places, marginals = tag(text)
                scores.append(model.score(marginals))
                own = []
                if places and max(marginals) >= 0.5:
                    bounds = [m.span() for m in re.finditer(r"\S+", text)]
                    for place, p in zip(places, marginals):
                        if p >= 0.5:
                            own.append({"start": bounds[place][0], "end": bounds[place][1], "probability": p})
                spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, kind)],
                ["doc_id", "score", "spans"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, and the character spans of toxic tokens."""
    scored = text_rows(docs).mapInArrow(
        _score(model), "doc_id long, score double, spans array<struct<start: long, end: long, probability: double>>")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
