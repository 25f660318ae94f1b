"""Quality grades by ordinal cumulative-link regression.

Ratings have ordered grades 0 .. K. One weight vector over hashed text features is shared by
all grades; K ordered thresholds cut its score: P(grade <= k) = logistic(threshold_k - score).
The features of a text are the shares of its hashed words and word shapes, and a few hashed
bins that describe the whole text. The fit uses at most ``TRAINING_ROWS`` rated documents
outside the held-out fold, those with the smallest hash of doc_id; every text is scored to its
end. Results are the expected grade and the tail probability P(grade >= ``tail``), by which
documents are selected.

Results for unusual input: null and empty texts are scored by their bins alone; null ratings
are not used; without ratings every grade is equally likely; rows that repeat are scored
alike; no rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import text_rows
from assay.llm.toxicity import held_out, training_rows

BITS = 18
TRAINING_ROWS = 10_000
STEPS = 150
#: A text's shares are scaled so that weights stay near one.
SCALE = 20.0
REMEMBERED_WORDS = 400_000
_SHAPE = ((re.compile(r"[^\W\d_]*[a-zà-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_a]+"), "A"), (re.compile(r"\d+"), "0"),
          (re.compile(r"([^\w])\1+"), r"\1\1"))


def slot(name: str, bits: int) -> int:
    return zlib.crc32(name.encode()) & ((1 << bits) - 1)


def shape(word: str) -> str:
    """Letters as a or A, digits as 0, repeated marks as two."""
    for pattern, mark in _SHAPE:
        word = pattern.sub(mark, word)
    return word


def slots_of(word: str, bits: int) -> tuple[int, int]:
    return slot(f"w{word.lower()}", bits), slot(f"s{shape(word)}", bits)


def bins_of(text: str, words: list[str], distinct: int, bits: int) -> list[int]:
    """Hashed bins for length, variety, word length and repeated lines."""
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    names = [f"n{int(math.log2(n + 1))}", f"d{int(10 * distinct / n) if n else -1}",
             f"l{min(20, len(text) // n) if n else -1}",
             f"r{int(10 * len(set(lines)) / len(lines)) if lines else -1}"]
    return [slot(x, bits) for x in names]


@dataclass
class Model:
    weight: np.ndarray
    thresholds: np.ndarray
    bits: int = BITS

    def probabilities(self, z: np.ndarray) -> np.ndarray:
        """P(grade = k) for each score."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - z[:, None], -500, 500)))
        return np.diff(np.concatenate((np.zeros((len(z), 1)), below, np.ones((len(z), 1))), axis=1), axis=1)


def _design(texts: list[str], bits: int):
    """Sparse features: text, slot and value; a slot stands once for each text."""
    rows, cols, values = [], [], []
    for i, text in enumerate(texts):
        words = text.split()
        counts = Counter(words)
        share: dict[int, float] = {}
        for w, c in counts.items():
            for s in slots_of(w, bits):
                share[s] = share.get(s, 0.0) + SCALE * c / len(words)
        for s in bins_of(text, words, len(counts), bits):
            share[s] = share.get(s, 0.0) + 1.0
        rows.append(np.full(len(share), i, np.int32))
        cols.append(np.fromiter(share.keys(), np.int32, len(share)))
        values.append(np.fromiter(share.values(), np.float32, len(share)))
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(values)


def _likelihood_gradients(z: np.ndarray, grade: np.ndarray, thresholds: np.ndarray):
    """Gradient of the negative log-likelihood by score and by threshold."""
    cut = np.concatenate(([-np.inf], thresholds, [np.inf]))
    up, low = cut[grade + 1] - z, cut[grade] - z
    s_up, s_low = 1 / (1 + np.exp(-np.clip(up, -30, 30))), 1 / (1 + np.exp(-np.clip(low, -30, 30)))
    s_up[np.isposinf(up)], s_low[np.isneginf(low)] = 1.0, 0.0
    p = np.maximum(s_up - s_low, 1e-9)
    d_up, d_low = s_up * (1 - s_up) / p, s_low * (1 - s_low) / p
    by_threshold = np.array([d_low[grade == k + 1].sum() - d_up[grade == k].sum() for k in range(len(thresholds))])
    return d_up - d_low, by_threshold


def fit_rows(texts: list[str], grades: list[int], n_grades: int, bits: int = BITS, steps: int = STEPS) -> Model:
    """Penalised maximum likelihood by Adam; thresholds are a first value and positive gaps."""
    grade = np.array(grades, np.int64)
    row, col, value = _design(texts, bits)
    size, k = 1 << bits, n_grades - 1
    if not len(texts):
        return Model(np.zeros(size), np.log(np.arange(1, n_grades) / (n_grades - np.arange(1, n_grades))), bits)
    share = np.clip(np.array([(grade <= j).mean() for j in range(k)]), 0.01, 0.99)
    start = np.log(share / (1 - share))
    theta = np.concatenate((np.zeros(size), [start[0]], np.log(np.maximum(np.diff(start), 0.05))))
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        thresholds = theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1:]))))
        z = np.bincount(row, theta[:size][col] * value, len(texts))
        by_z, by_t = _likelihood_gradients(z, grade, thresholds)
        grad = np.zeros_like(theta)
        grad[:size] = np.bincount(col, by_z[row] * value, size)
        grad[size] = by_t.sum()
        grad[size + 1:] = np.cumsum(by_t[::-1])[::-1][1:] * np.exp(theta[size + 1:])
        grad = grad / len(texts)
        grad[:size] += 1e-4 * theta[:size]
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad * grad
        theta -= 0.05 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-8)
    thresholds = theta[size] + np.concatenate(([0.0], np.cumsum(np.exp(theta[size + 1:]))))
    return Model(theta[:size], thresholds, bits)


def fit(docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, rows: int = TRAINING_ROWS,
        bits: int = BITS) -> Model:
    sample = training_rows(docs, ratings, grade, rows)
    return fit_rows([r[1] for r in sample], [r[2] for r in sample], n_grades, bits)


def _score(model: Model, tail: int):
    def run(batches):
        known: dict[str, float] = {}
        w, bits = model.weight, model.bits
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                words = text.split()
                distinct = set(words)
                new = distinct.difference(known)
                if len(known) > REMEMBERED_WORDS:
                    known, new = {}, distinct
                for x in new:
                    a, b = slots_of(x, bits)
                    known[x] = float(w[a] + w[b])
                if words:
                    z[i] = SCALE * sum(map(known.__getitem__, words)) / len(words)
                z[i] += w[bins_of(text, words, len(distinct), bits)].sum()
            p = model.probabilities(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1])), pa.array(p[:, tail:].sum(axis=1))],
                ["doc_id", "expected_grade", "tail_probability"])
    return run


def score(docs: DataFrame, model: Model, tail: int = 1, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability, kept."""
    scored = text_rows(docs).mapInArrow(_score(model, tail), "doc_id long, expected_grade double, tail_probability double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability",
                         (F.col("tail_probability") >= least).alias("kept"))
