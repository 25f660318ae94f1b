"""Exact ranks and quantiles without gathering a group in one task.

Everything rests on ``value_positions``: rows are first counted per distinct
value (partial aggregation shrinks ties before the shuffle), then a running sum
over the distinct values gives each value its position. On a large input the
value axis is cut into pieces of about equal row counts. A piece holds at most a
fixed number of rows of the whole table, so no key, however hot, gives one task
more than that. The cut points are found once, on the driver, as a short list of
numbers, so a recomputed task always cuts at the same places.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import present, quoted
from assay.session import cut_lineage

ROWS_PER_PIECE = 4_000_000
MAX_PIECES = 8192


def cut_points(df: DataFrame, value: str, rows_per_piece: int = ROWS_PER_PIECE) -> list[float]:
    """Ascending values that cut the column into pieces; empty when one piece will do."""
    v = quoted(value).cast("double")
    rows = df.agg(F.count(v)).first()[0]
    pieces = min(MAX_PIECES, -(-rows // rows_per_piece))
    if pieces <= 1:
        return []
    probs = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(v, probs, max(10_000, 4 * pieces))).first()[0]
    return sorted(set(found or []))


def with_piece(df: DataFrame, value: str, cuts: Sequence[float], piece: str = "__piece") -> DataFrame:
    """Add the number of the piece of ``value`` (binary search over the cut points)."""
    splits = [-float("inf"), *cuts, float("inf")]
    number = df.withColumn("__cut_on", quoted(value).cast("double"))
    return Bucketizer(splits=splits, inputCol="__cut_on", outputCol=piece).transform(number).drop(
        "__cut_on")


def value_positions(df: DataFrame, keys: Sequence[str], value: str, *,
                    rows_per_piece: int | None = ROWS_PER_PIECE, weight: str | None = None) -> DataFrame:
    """One row per (keys, value) with ``n``, ``before`` and ``total``.

    ``n`` counts rows holding the value, ``before`` rows of the key with a smaller
    value and ``total`` all rows of the key. NULL keys, NULL and NaN values are left
    out. ``rows_per_piece=None`` skips the size check; use it only for inputs that
    are small by construction. A row counts as many as its ``weight`` says.
    """
    keys = list(keys)
    rows = df.filter(present(df, value))
    for k in keys:
        rows = rows.filter(quoted(k).isNotNull())
    by = [quoted(k) for k in keys]
    rows = rows.select(*by, quoted(value), (quoted(weight) if weight else F.lit(1)).alias("__weight"))
    cuts = [] if rows_per_piece is None else cut_points(rows, value, rows_per_piece)
    counts = rows.groupBy(*by, quoted(value)).agg(
        (F.sum("__weight") if weight else F.count(F.lit(1))).alias("n"))
    earlier = (Window.unboundedPreceding, -1)
    if not cuts:
        whole = Window.partitionBy(*by)
        return counts.select(
            *by, quoted(value), "n",
            F.coalesce(F.sum("n").over(whole.orderBy(quoted(value)).rowsBetween(*earlier)),
                       F.lit(0)).alias("before"),
            F.sum("n").over(whole).alias("total"))
    placed = with_piece(counts, value, cuts)
    pieces = placed.groupBy(*by, "__piece").agg(F.sum("n").alias("__piece_n"))
    # At most MAX_PIECES rows per key from here on.
    across = Window.partitionBy(*by)
    offsets = pieces.select(
        *by, "__piece",
        F.coalesce(F.sum("__piece_n").over(across.orderBy("__piece").rowsBetween(*earlier)),
                   F.lit(0)).alias("__offset"),
        F.sum("__piece_n").over(across).alias("total"))
    inside = Window.partitionBy(*by, "__piece").orderBy(quoted(value)).rowsBetween(*earlier)
    local = placed.withColumn("__local", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return local.join(offsets, [*keys, "__piece"]).select(
        *by, quoted(value), "n", (F.col("__local") + F.col("__offset")).alias("before"), "total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float], **split: int | None) -> DataFrame:
    """Linearly interpolated quantiles per key, one output column per entry of ``probs``."""
    by = [quoted(k) for k in keys]
    pos = value_positions(df, keys, value, **split)

    def rank(p: float) -> Column:
        return (F.col("total") - 1).cast("double") * F.lit(float(p))

    def holds(k: Column) -> Column:
        return (F.col("before") <= k) & (k < F.col("before") + F.col("n"))

    wanted = F.lit(False)
    for p in probs.values():
        wanted = wanted | holds(F.floor(rank(p))) | holds(F.ceil(rank(p)))
    v = quoted(value).cast("double")
    aggs = [F.max("total").alias("total")]
    for i, p in enumerate(probs.values()):
        aggs.append(F.max(F.when(holds(F.floor(rank(p))), v)).alias(f"__lo{i}"))
        aggs.append(F.max(F.when(holds(F.ceil(rank(p))), v)).alias(f"__hi{i}"))
    found = pos.filter(wanted).groupBy(*by).agg(*aggs)
    cols = []
    for i, (name, p) in enumerate(probs.items()):
        frac = rank(p) - F.floor(rank(p))
        cols.append((F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * frac).alias(name))
    return found.select(*by, *cols)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank",
                  **split: int | str | None) -> DataFrame:
    """Add the average-tie rank of ``value`` within ``keys``; NULL values get no rank."""
    pos = value_positions(df, keys, value, **split).select(
        *[quoted(k) for k in keys], quoted(value),
        (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias(rank))
    return df.join(pos, [*keys, value], "left")


def numbered_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], number: str, total: str | None = None
                  ) -> DataFrame:
    """Number the rows of each key from 1 in the given order; ``total`` names a column with their count.

    Rows are dealt to tasks by sampled ranges of (keys, order) and sorted there, so neither a key
    nor a value with very many rows meets in one task, as long as ``order`` goes on beyond the value.
    What one task holds of a key is numbered from the sum of the tasks before it: a window over as
    many rows a key as there are tasks. The dealt rows are written first, so that a recomputed
    task finds the same ranges. Rows with a NULL key are left out.
    """
    by = [quoted(k) for k in keys]
    rows = df.dropna(subset=[k for k in keys]) if keys else df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(rows.repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).withColumn(
        "__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    sizes = placed.groupBy(*by, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    across = Window.partitionBy(*(by or [F.lit(1)]))
    before = F.sum("__n").over(across.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*by, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first") + 1).alias("__shift"),
                           F.sum("__n").over(across).alias("__total"))
    out = placed.join(offsets, [*keys, "__part"]).withColumn(number, F.col("__at") + F.col("__shift"))
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.select(*[quoted(c) for c in df.columns], quoted(number), *([quoted(total)] if total else []))
