"""Hard-negative mining with bounds from segment summaries.

Each vector is cut into 1, 2, 4 and 8 segments, and each segment's mean and deviation is stored
with it on shared files. For two vectors a segment of length l adds l * mean * mean' to their
product, give or take l * deviation * deviation' (Cauchy-Schwarz on what is left of the means).
A pair is bounded by one segment first; where the bounds leave it open it is refined to the next
finer segments, and only what eight segments leave open is multiplied out. Bounds are floating
point with a margin for rounding; scores are exact integers.

Anchors against rows is a grid: anchors are dealt to blocks of about ``ANCHORS``, rows to blocks
of about ``ROWS``, both by hash, and a task holds one block of each. Every cell gives each of its
anchors the few rows that can still be among the first ones; windows merge the cells. Pass one
finds an anchor's positives, pass two the negatives between two shares of each positive's score.
Equal vectors, hot labels and hot anchors are spread by the hash of the row.

Results for unusual input: rows with a null vec_id, label or vector, or with a null or non-finite
component, take no part; vectors of different length are compared as if the shorter one ended
with zeros, an empty one with zeros alone; scaled components beyond ``LARGEST`` count as that, so
scores stay within 64 bits; rows that repeat are rows of their own; an anchor without positives,
and a positive without negatives, has no rows; no rows give no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.llm.common import cut_lineage, shuffle_parts, with_rows

LEVELS = (1, 2, 4, 8)
SCALE = 256
LARGEST = 1 << 22
ANCHORS, ROWS = 4096, 32768
POSITIVES, NEGATIVES = 5, 3
#: Negatives have between 50 and 95 percent of the positive's score.
LEAST_PERCENT, MOST_PERCENT = 50, 95
_STORED = "vec_id long, label long, here long, body binary, means binary, deviations binary, norm double"


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of all levels, one row a vector."""
    means, deviations = [], []
    for n in LEVELS:
        part = x.reshape(len(x), n, -1).astype(np.float64)
        means.append(part.mean(axis=2))
        deviations.append(part.std(axis=2))
    return np.concatenate(means, axis=1), np.concatenate(deviations, axis=1)


def _summarised(length: int):
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("vector")
        sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
        x = np.zeros((len(sizes), length), np.int32)
        x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        means, deviations = summaries(x)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("here"),
             *[pa.array([r.tobytes() for r in a], pa.binary()) for a in (x, means, deviations)], pa.array(norm)],
            ["vec_id", "label", "here", "body", "means", "deviations", "norm"])
    return with_rows(rows)


def stored(vectors: DataFrame, label: Column) -> DataFrame:
    """The rows that take part, with their summaries, on shared files."""
    x = F.col("embedding")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x).filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    scaled = good.select("vec_id", "label", F.monotonically_increasing_id().alias("here"), F.transform(x, lambda v: F.least(
        F.greatest(F.floor(SCALE * v.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")).alias("vector"))
    longest = good.agg(F.max(F.size("embedding"))).first()[0] or 1
    length = -(-longest // LEVELS[-1]) * LEVELS[-1]
    return cut_lineage(scaled.mapInArrow(_summarised(length), _STORED))


class Block:
    """Vectors of one side of a cell."""

    def __init__(self, table: pa.Table):
        def matrix(name, kind):
            return np.frombuffer(b"".join(table.column(name).to_pylist()), kind).reshape(table.num_rows, -1)

        self.here, self.vec_id, self.label, self.norm = (
            table.column(c).to_numpy() for c in ("here", "vec_id", "label", "norm"))
        self.x = matrix("body", np.int32).astype(np.int64)
        self.means, self.deviations = matrix("means", np.float64), matrix("deviations", np.float64)
        self.length = self.x.shape[1]


def bounds(anchors: Block, a: int, rows: Block, of: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the anchor's scores with the rows ``of``, at one level."""
    at = slice(sum(LEVELS[:level]), sum(LEVELS[:level + 1]))
    width = rows.length / LEVELS[level]
    middle = width * (rows.means[of, at] @ anchors.means[a, at])
    room = width * (rows.deviations[of, at] @ anchors.deviations[a, at])
    room += 1e-12 * anchors.norm[a] * rows.norm[of] + 1e-6
    return middle - room, middle + room


def nth_best(values: np.ndarray, n: int) -> float:
    return np.partition(values, len(values) - n)[len(values) - n] if len(values) >= n else -np.inf


def _first(score: np.ndarray, ids: np.ndarray, here: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((here, ids, -score))[:n]


def best_rows(anchors: Block, a: int, rows: Block, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n of the rows ``of`` for one anchor, and their scores."""
    for level in range(len(LEVELS)):
        if len(of) <= n:
            break
        low, high = bounds(anchors, a, rows, of, level)
        of = of[high >= nth_best(low, n)]
    score = rows.x[of] @ anchors.x[a]
    first = _first(score, rows.vec_id[of], rows.here[of], n)
    return of[first], score[first]


def rows_between(anchors: Block, a: int, rows: Block, of: np.ndarray, targets: list[int], n: int):
    """For each target score the first n of the rows ``of`` within the shares of it."""
    targets = [t for t in targets if t >= 0]  # below zero the shares exclude each other
    least, most = (np.array([t * p / 100 for t in targets]) for p in (LEAST_PERCENT, MOST_PERCENT))
    for level in range(len(LEVELS)):
        if not len(of) or not targets:
            break
        low, high = bounds(anchors, a, rows, of, level)
        use = np.zeros(len(of), bool)
        for lo, hi in zip(least, most):
            sure = (low >= lo) & (high <= hi)
            use |= (high >= max(lo, nth_best(low[sure], n))) & (low <= hi)
        of = of[use]
    score = rows.x[of] @ anchors.x[a] if targets else np.zeros(0, np.int64)
    for target in dict.fromkeys(targets):
        inside = np.flatnonzero((LEAST_PERCENT * target <= 100 * score) & (100 * score <= MOST_PERCENT * target))
        first = inside[_first(score[inside], rows.vec_id[of[inside]], rows.here[of[inside]], n)]
        yield target, of[first], score[first]


def _table(out: list[tuple], names: list[str]) -> pa.Table:
    cols = list(zip(*out)) or [[]] * len(names)
    return pa.table([pa.array(c, pa.int64()) for c in cols], names)


_POSITIVE = ["anchor", "anchor_id", "positive", "positive_id", "score"]
_NEGATIVE = ["anchor", "positive_score", "negative", "negative_id", "score"]


def _positives(n: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            anchors, rows = Block(left), Block(right)
            same = {v: np.flatnonzero(rows.label == v) for v in np.unique(anchors.label)}
            for a in range(len(anchors.here)):
                of = same[anchors.label[a]]
                of, score = best_rows(anchors, a, rows, of[rows.here[of] != anchors.here[a]], n)
                out += [(int(anchors.here[a]), int(anchors.vec_id[a]), *map(int, x))
                        for x in zip(rows.here[of], rows.vec_id[of], score)]
        return _table(out, _POSITIVE)
    return cell


def _negatives(n: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            anchors, rows = Block(left), Block(right)
            targets = left.column("targets").to_pylist()
            other = {v: np.flatnonzero(rows.label != v) for v in np.unique(anchors.label)}
            for a in range(len(anchors.here)):
                for target, of, score in rows_between(anchors, a, rows, other[anchors.label[a]], targets[a], n):
                    out += [(int(anchors.here[a]), int(target), *map(int, x))
                            for x in zip(rows.here[of], rows.vec_id[of], score)]
        return _table(out, _NEGATIVE)
    return cell


def _grid(anchors: DataFrame, rows: DataFrame, shape: tuple[int, int], cell, names: list[str]) -> DataFrame:
    """``cell`` of each block of anchors with each block of rows."""
    n_anchors, n_rows = shape

    def dealt(df, own, n_own, other, n_other):
        return df.withColumn(own, F.pmod(F.xxhash64("here"), F.lit(n_own)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # columns apart from those of ``rows``
    left = dealt(anchors, "i", n_anchors, "j", n_rows).groupBy("i", "j")
    right = dealt(rows, "j", n_rows, "i", n_anchors).groupBy("i", "j")
    return left.cogroup(right).applyInArrow(cell, ", ".join(f"{c} long" for c in names))


def _leading(df: DataFrame, by: list[str], other: str, n: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc(f"{other}_id"), F.asc(other))
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         block: tuple[int, int] = (ANCHORS, ROWS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``label`` and ``is_anchor`` are expressions on the columns vec_id, label and embedding.
    """
    rows = stored(vectors, label)
    anchors = rows.filter(is_anchor)
    shape = (max(1, -(-anchors.count() // block[0])), max(shuffle_parts(rows), -(-rows.count() // block[1])))
    found = _grid(anchors, rows, shape, _positives(positives), _POSITIVE)
    first = cut_lineage(_leading(found, ["anchor"], "positive", positives))
    targets = first.groupBy("anchor").agg(F.collect_set("score").alias("targets"))  # ``positives`` values at most
    asked = anchors.join(targets.withColumnRenamed("anchor", "here"), "here")
    found = _grid(asked, rows, shape, _negatives(negatives), _NEGATIVE)
    best = _leading(found, ["anchor", "positive_score"], "negative", negatives).withColumnRenamed("score", "negative_score")
    pairs = first.select("anchor", "anchor_id", "positive_id", F.col("score").alias("positive_score"))
    return pairs.join(best, ["anchor", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
