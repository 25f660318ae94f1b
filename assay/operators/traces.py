"""Ordered traces such as chromatograms: baseline, smoothing, peaks and their quality.

A trace is a group of points ordered by a numeric axis. All work is done in
windows per trace. A long trace is cut into segments that share a few rows at
their ends (the halo), so that one trace may hold any share of the table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import clean, present, quoted
from assay.functions.order_stats import ROWS_PER_PIECE, cut_points, exact_quantiles, value_positions
from assay.session import cut_lineage

# Fixed values of the signal rules.
BASELINE_WINDOW = 50
BASELINE_QUANTILE = 0.05
SMOOTH_WINDOW, SMOOTH_ORDER = 11, 3
MIN_POINTS = 25
MIN_SMOOTH_POINTS = 50
ASYMMETRY_LEVEL = 0.10
TAILING_LEVEL = 0.05
RESOLVED, PARTIAL = 1.5, 1.0
MIN_PLATES = 2000.0
MAX_ASYMMETRY = 2.0
PURE_RATIO, CONTAMINATED_RATIO = 1.5, 1.0
AGGREGATE_SHARE = 5.0

SEGMENT, CORE = "__segment", "__core"


def segmented(df: DataFrame, trace: Sequence[str], x: str, halo: int, tie: Sequence[str] = (), *,
              rows_per_segment: int = ROWS_PER_PIECE, small: bool | None = None, keep: bool = False) -> DataFrame:
    """Add ``__segment`` and ``__core``; each core row sees ``halo`` neighbours on both sides.

    Small tables keep one segment per trace. Larger ones get an exact row number
    per trace from value positions, and rows near a segment end are copied into
    the neighbouring segment as non-core rows. ``small`` passes on a size check
    already made. A row without an axis value or trace key has no place on any
    trace, whatever the size of the table: with ``keep`` it stays, alone in a
    segment of its own, else it is left out.
    """
    placed = present(df, x)
    for t in trace:
        placed = placed & quoted(t).isNotNull()
    alone = (df.filter(~placed).withColumn(SEGMENT, -1 - F.monotonically_increasing_id())
             .withColumn(CORE, F.lit(True))) if keep else None
    df = df.filter(placed)
    rows = _cut(df, trace, x, halo, tie, rows_per_segment, small)
    return rows.unionByName(alone) if keep else rows


def _cut(df: DataFrame, trace: Sequence[str], x: str, halo: int, tie: Sequence[str],
         rows_per_segment: int, small: bool | None) -> DataFrame:
    if small is None:
        small = not cut_points(df, x, rows_per_segment)
    if small:
        return df.withColumn(SEGMENT, F.lit(0).cast("bigint")).withColumn(CORE, F.lit(True))
    keys = [quoted(t) for t in trace]
    pos = value_positions(df, trace, x, rows_per_piece=rows_per_segment).select(
        *keys, quoted(x), "before")
    # Without a tie key the rest of the row decides, so that retried tasks agree.
    among = Window.partitionBy(*keys, quoted(x)).orderBy(
        *[quoted(t) for t in tie] or [F.xxhash64(*[quoted(c) for c in df.columns])])
    row = df.join(pos, [*trace, x]).withColumn(
        "__row", F.col("before") + F.row_number().over(among) - 1).drop("before")
    home = F.floor(F.col("__row") / rows_per_segment)
    low = F.floor(F.greatest(F.col("__row") - halo, F.lit(0)) / rows_per_segment)
    high = F.floor((F.col("__row") + halo) / rows_per_segment)
    return row.withColumn("__home", home).withColumn(
        SEGMENT, F.explode(F.sequence(low, high))).withColumn(
        CORE, F.col(SEGMENT) == F.col("__home")).drop("__row", "__home")


def _window(trace: Sequence[str], x: str, tie: Sequence[str] = ()):
    return Window.partitionBy(*[quoted(t) for t in trace], SEGMENT).orderBy(
        quoted(x), *[quoted(t) for t in tie])


def _core(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORE)).drop(SEGMENT, CORE)


def rolling_baseline(df: DataFrame, trace: Sequence[str], x: str, y: str, tie: Sequence[str] = (),
                     window: int = BASELINE_WINDOW, **kw) -> DataFrame:
    """Rolling minimum around each point and the signal above it."""
    half = window // 2
    rows = segmented(df, trace, x, window, tie, keep=True, **kw)
    w = _window(trace, x, tie).rowsBetween(-half, window - half - 1)
    return _core(rows.withColumn("baseline", F.min(clean(df, y)).over(w)).withColumn(
        "corrected", quoted(y) - F.col("baseline")))


def quantile_baseline(df: DataFrame, trace: Sequence[str], y: str,
                      q: float = BASELINE_QUANTILE, **split) -> DataFrame:
    """One low quantile per trace as its baseline."""
    base = exact_quantiles(df, trace, y, {"baseline": q}, **split)
    return df.join(base, list(trace), "left").withColumn(
        "corrected", quoted(y) - F.col("baseline"))


def smoothing_weights(window: int = SMOOTH_WINDOW, order: int = SMOOTH_ORDER) -> list[float]:
    """Least-squares polynomial weights for the middle of the window."""
    half = window // 2
    grid = np.vander(np.arange(-half, half + 1, dtype=float), order + 1, increasing=True)
    return [float(v) for v in np.linalg.pinv(grid)[0]]


def smooth(df: DataFrame, trace: Sequence[str], x: str, y: str, tie: Sequence[str] = (),
           window: int = SMOOTH_WINDOW, order: int = SMOOTH_ORDER,
           min_points: int = MIN_SMOOTH_POINTS, **kw) -> DataFrame:
    """Savitzky-Golay smoothing as a weighted sum of neighbours.

    Points whose window is not complete keep their value, and so do traces with
    fewer than ``min_points`` points.
    """
    half = window // 2
    rows = segmented(df, trace, x, half, tie, keep=True, **kw)
    w = _window(trace, x, tie)
    dot = None
    for k, weight in enumerate(smoothing_weights(window, order), -half):
        part = F.lag(clean(df, y).cast("double"), -k).over(w) * F.lit(weight)
        dot = part if dot is None else dot + part
    # A missing neighbour makes the sum NULL, so only complete windows count.
    out = _core(rows.withColumn("__dot", dot))
    sizes = df.groupBy(*[quoted(t) for t in trace]).agg(F.count(F.lit(1)).alias("__points"))
    return out.join(sizes, list(trace), "left").withColumn("smoothed", F.when(
        (F.col("__points") >= min_points) & F.col("__dot").isNotNull(), F.col("__dot")
    ).otherwise(quoted(y))).drop("__dot", "__points")


def turning_points(df: DataFrame, trace: Sequence[str], x: str, y: str, tie: Sequence[str] = (), *,
                   rows_per_segment: int = ROWS_PER_PIECE) -> DataFrame:
    """Maxima (``turn`` 1), minima and end points (``turn`` -1) of each trace.

    A flat top counts once, at its middle: each run of equal values becomes one row
    before neighbours are compared.
    """
    keys = [quoted(t) for t in trace]
    points = df.filter(clean(df, y).isNotNull()).select(
        *keys, quoted(x).cast("double").alias("x"), quoted(y).cast("double").alias("y"),
        *[quoted(t) for t in tie if t not in (x, y)])
    small = not cut_points(points, "x", rows_per_segment)
    kw = {"rows_per_segment": rows_per_segment, "small": small}
    w = _window(trace, "x", tie)
    starts = _core(segmented(points, trace, "x", 1, tie, **kw).withColumn(
        "__y", F.lag("y").over(w)).withColumn("__x", F.lag("x").over(w))).filter(
        F.col("__y").isNull() | (F.col("__y") != F.col("y")))
    left, right = F.lag("y").over(w), F.lead("y").over(w)
    runs = segmented(starts, trace, "x", 1, tie, **kw).withColumn("__l", left).withColumn(
        "__r", right).withColumn("__end", F.coalesce(F.lead("__x").over(w), F.col("x")))
    up = (F.col("__l") < F.col("y")) & (F.col("__r") < F.col("y"))
    down = (F.col("__l") > F.col("y")) & (F.col("__r") > F.col("y"))
    edge = F.col("__l").isNull() | F.col("__r").isNull()
    return _core(runs.withColumn("turn", F.when(up, 1).when(down | edge, -1))).filter(
        "turn is not null").select(*keys, ((F.col("x") + F.col("__end")) / 2.0).alias("x"),
                                   "y", "turn")


def _prominences(trace: Sequence[str]):
    """One ordered pass over turning points: the prominence of every peak.

    The stack holds peaks that no higher point has followed yet, heights falling.
    ``low`` is the least level since its top. Memory is the stack, not the trace.
    """
    names = list(trace)

    def release(stack, low, level, out):
        """Emit the waiting peaks below ``level``; returns the least level since the new top."""
        while stack and stack[-1][2] < level:
            key, x, y, left, valley = stack.pop()
            out.append((*key, x, y, y - max(left, low)))
            low = min(low, valley)
        return low

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names, "x", "height", "prominence"]
        key, stack, low = None, [], float("inf")
        for batch in batches:
            out: list[tuple] = []
            for row in batch[[*names, "x", "y", "turn"]].itertuples(index=False, name=None):
                k, x, y, turn = row[:-3], row[-3], row[-2], row[-1]
                if k != key:
                    release(stack, low, float("inf"), out)
                    key, stack, low = k, [], float("inf")
                low = release(stack, low, y, out)
                if turn == 1:
                    tied = stack and stack[-1][2] == y
                    left = min(low, stack[-1][3]) if tied else low
                    stack.append((k, x, y, left, low))
                    low = y
                else:
                    low = min(low, y)
            yield pd.DataFrame(out, columns=columns)
        out = []
        release(stack, low, float("inf"), out)
        yield pd.DataFrame(out, columns=columns)
    return run


def detect_peaks(df: DataFrame, trace: Sequence[str], x: str, y: str, tie: Sequence[str] = (), *,
                 min_height: float | None = None, min_prominence: float | None = None,
                 distance: float | None = None, **kw) -> DataFrame:
    """Peaks of each trace: position, height and prominence.

    Windows find the turning points, which are far fewer than the points. Their
    prominence then comes from one ordered pass. ``distance`` (in axis units) drops
    peaks that have a higher peak closer than that, the highest deciding first.
    """
    turns = turning_points(df, trace, x, y, tie, **kw)
    schema = T.StructType([turns.schema[t] for t in trace] + [
        T.StructField(n, T.DoubleType()) for n in ("x", "height", "prominence")])
    ordered = turns.repartition(*[quoted(t) for t in trace]).sortWithinPartitions(
        *[quoted(t) for t in trace], "x")
    peaks = ordered.mapInPandas(_prominences(trace), schema)
    if min_height is not None:
        peaks = peaks.filter(F.col("height") >= min_height)
    if distance is not None:
        peaks = _thin_out(peaks, trace, distance)
    if min_prominence is not None:
        peaks = peaks.filter(F.col("prominence") >= min_prominence)
    return peaks


def _thin_out(peaks: DataFrame, trace: Sequence[str], distance: float) -> DataFrame:
    """Greedy by height within runs of close peaks; runs end where a gap is wide enough."""
    names = list(trace)

    def settle(run: list[tuple]) -> list[tuple]:
        kept: list[tuple] = []
        for row in sorted(run, key=lambda r: (-r[-2], -r[-3])):
            if all(abs(row[-3] - k[-3]) >= distance for k in kept):
                kept.append(row)
        return sorted(kept, key=lambda r: r[-3])

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                if run and (run[-1][:-3] != row[:-3] or row[-3] - run[-1][-3] >= distance):
                    out += settle(run)
                    run = []
                run.append(row)
            yield pd.DataFrame(out, columns=batch.columns)
        if run:
            yield pd.DataFrame(settle(run), columns=[*names, "x", "height", "prominence"])
    return peaks.repartition(*[quoted(t) for t in trace]).sortWithinPartitions(
        *[quoted(t) for t in trace], "x").mapInPandas(apply, peaks.schema)


def trapezoids(df: DataFrame, trace: Sequence[str], x: str, y: str, tie: Sequence[str] = (), **kw
               ) -> DataFrame:
    """Add ``slice``: the area between each point and the one before it."""
    rows = segmented(df, trace, x, 1, tie, **kw)
    w = _window(trace, x, tie)
    area = (quoted(x) - F.lag(quoted(x)).over(w)) * (quoted(y) + F.lag(quoted(y)).over(w)) / 2.0
    return _core(rows.withColumn("slice", F.coalesce(area.cast("double"), F.lit(0.0))))


def peak_areas(df: DataFrame, trace: Sequence[str], x: str, y: str, peak: str,
               tie: Sequence[str] = (), **kw) -> DataFrame:
    """Area, height and share of the trace for points labelled with a peak."""
    keys = [quoted(t) for t in trace]
    sliced = trapezoids(df.filter(quoted(peak).isNotNull()), [*trace, peak], x, y, tie, **kw)
    areas = sliced.groupBy(*keys, quoted(peak)).agg(
        F.sum("slice").alias("area"), F.max(quoted(y)).alias("height"),
        F.max_by(quoted(x), quoted(y)).alias("apex"), F.count(F.lit(1)).alias("points"))
    total = areas.groupBy(*keys).agg(F.sum("area").alias("__total"))
    return areas.join(total, list(trace)).withColumn(
        "area_pct", F.try_divide("area", "__total") * 100).drop("__total")


def resolution(t1: Column, w1: Column, t2: Column, w2: Column) -> Column:
    """Resolution of two peaks; infinite when both widths are 0."""
    return F.when(w1 + w2 == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(2.0 * F.abs(t2 - t1), (w1 + w2).cast("double")))


def plate_count(t: Column, width: Column) -> Column:
    """Theoretical plates; 0 for a width of 0."""
    r = F.try_divide(t.cast("double"), width.cast("double"))
    return F.when(width == 0, F.lit(0.0)).otherwise(16.0 * r * r)


def adjacent_resolution(peaks: DataFrame, trace: Sequence[str], t: str, width: str) -> DataFrame:
    """Resolution of each peak against the previous one of its trace, with its band."""
    w = Window.partitionBy(*[quoted(c) for c in trace]).orderBy(quoted(t))
    out = peaks.withColumn("__t", F.lag(quoted(t)).over(w)).withColumn(
        "__w", F.lag(quoted(width)).over(w))
    rs = F.when(F.col("__t").isNotNull(),
                resolution(F.col("__t"), F.col("__w"), quoted(t), quoted(width)))
    return out.withColumn("rs", rs).withColumn("resolved", F.when(
        F.col("rs") > RESOLVED, "baseline").when(F.col("rs") >= PARTIAL, "partial").when(
        F.col("rs").isNotNull(), "unresolved")).drop("__t", "__w")


def suitability(df: DataFrame, rs: Column, plates: Column, asymmetry: Column) -> DataFrame:
    """System suitability flags."""
    return df.withColumn("rs_ok", rs >= RESOLVED).withColumn(
        "plates_ok", plates >= MIN_PLATES).withColumn("asymmetry_ok", asymmetry < MAX_ASYMMETRY)


def crossings(df: DataFrame, trace: Sequence[str], x: str, y: str, level: float,
              tie: Sequence[str] = (), **kw) -> DataFrame:
    """Where the main peak of each trace falls to ``level`` of its height, left and right.

    Each pair of neighbouring points that straddles the level is a crossing found
    by interpolation; the nearest one on each side of the apex is taken.
    """
    keys = [quoted(t) for t in trace]
    apex = df.groupBy(*keys).agg(F.max(clean(df, y)).alias("top"),
                                 F.max_by(quoted(x), clean(df, y)).alias("apex"))
    rows = segmented(df.filter(clean(df, y).isNotNull()), trace, x, 1, tie, **kw)
    w = _window(trace, x, tie)
    pairs = _core(rows.withColumn("__x", F.lag(quoted(x)).over(w)).withColumn(
        "__y", F.lag(quoted(y)).over(w))).filter("__x is not null").join(apex, list(trace))
    cut = F.col("top") * level
    at = F.col("__x") + (cut - F.col("__y")) * F.try_divide(
        (quoted(x) - F.col("__x")).cast("double"), (quoted(y) - F.col("__y")).cast("double"))
    rising = (F.col("__y") < cut) & (quoted(y) >= cut) & (quoted(x) <= F.col("apex"))
    falling = (F.col("__y") >= cut) & (quoted(y) < cut) & (F.col("__x") >= F.col("apex"))
    return pairs.groupBy(*keys).agg(
        F.max("apex").alias("apex"), F.max("top").alias("height"),
        F.max(F.when(rising, at)).alias("left"), F.min(F.when(falling, at)).alias("right"))


def peak_symmetry(df: DataFrame, trace: Sequence[str], x: str, y: str, tie: Sequence[str] = (),
                  **kw) -> DataFrame:
    """Asymmetry at 10 % and tailing factor at 5 % of the main peak's height."""
    a = crossings(df, trace, x, y, ASYMMETRY_LEVEL, tie, **kw)
    t = crossings(df, trace, x, y, TAILING_LEVEL, tie, **kw).select(
        *[quoted(c) for c in trace], F.col("left").alias("__l"), F.col("right").alias("__r"))
    front, back = F.col("apex") - F.col("left"), F.col("right") - F.col("apex")
    f5, b5 = F.col("apex") - F.col("__l"), F.col("__r") - F.col("apex")
    return a.join(t, list(trace), "left").select(
        *[quoted(c) for c in trace], "apex", "height",
        F.try_divide(back.cast("double"), front.cast("double")).alias("asymmetry"),
        F.try_divide((f5 + b5).cast("double"), (2.0 * f5).cast("double")).alias("tailing"))


def purity_ratio(df: DataFrame, trace: Sequence[str], y280: str, y260: str) -> DataFrame:
    """Ratio of the two absorbance means per trace and what it says about purity."""
    out = df.groupBy(*[quoted(t) for t in trace]).agg(
        F.try_divide(F.avg(clean(df, y280)), F.avg(clean(df, y260))).alias("ratio"))
    return out.withColumn("purity", F.when(F.col("ratio") > PURE_RATIO, "pure").when(
        F.col("ratio") <= CONTAMINATED_RATIO, "contaminated").when(
        F.col("ratio").isNotNull(), "intermediate"))


def aggregate_share(peaks: DataFrame, trace: Sequence[str], t: str, area: str) -> DataFrame:
    """Share of area that elutes before the main peak, flagged above 5 %.

    The main peak is the largest, of equally large ones the earliest. Peaks are written first: a
    place that is itself a mean has other last digits when it is computed again, and would then
    lie before itself. The share counts to twelve digits.
    """
    keys = [quoted(c) for c in trace]
    peaks = cut_lineage(peaks.select(*keys, quoted(t).alias("__t"), quoted(area).alias("__area")))
    known = F.col("__t").isNotNull() & F.col("__area").isNotNull()
    main = peaks.groupBy(*keys).agg(F.max(F.when(known, F.struct(
        F.col("__area"), (-F.col("__t")).alias("__back")))).alias("__main"))
    out = peaks.join(main, list(trace)).groupBy(*keys).agg(
        F.sum(F.when(F.col("__t") < -F.col("__main.__back"), F.col("__area")).otherwise(0.0)).alias("__early"),
        F.sum("__area").alias("__all"))
    return out.select(*keys, F.round(F.try_divide("__early", "__all") * 100, 12).alias("aggregate_pct")
                      ).withColumn("flagged", F.col("aggregate_pct") > AGGREGATE_SHARE)


def trace_summary(df: DataFrame, trace: Sequence[str], x: str, y: str,
                  min_points: int = MIN_POINTS) -> DataFrame:
    """Points, maximum, mean and axis position of the maximum; short traces are marked raw."""
    v = clean(df, y).cast("double")
    return df.groupBy(*[quoted(t) for t in trace]).agg(
        F.count(v).alias("points"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.max_by(quoted(x), v).alias("x_at_max")).withColumn(
        "method", F.when(F.col("points") < min_points, "raw").otherwise("signal"))


def whittaker_baseline(y: np.ndarray, lam: float, p: float, rounds: int) -> np.ndarray:
    """Penalised least-squares baseline of one stretch of signal; missing points weigh nothing."""
    n = len(y)
    seen = ~np.isnan(y)
    if n < 3 or seen.sum() < 3:
        return y.copy()
    y = np.where(seen, y, 0.0)
    main = np.full(n, 6.0)
    main[[0, -1]], main[[1, -2]] = 1.0, 5.0
    one = np.full(n - 1, -4.0)
    one[[0, -1]] = -2.0
    if n == 3:
        main, one = np.array([1.0, 4.0, 1.0]), np.array([-2.0, -2.0])
    two = np.ones(n - 2)
    w, z = seen.astype(float), y
    for _ in range(rounds):
        d, l1, l2 = np.empty(n), np.zeros(n), np.zeros(n)
        a0, a1, a2 = w + lam * main, lam * one, lam * two
        for i in range(n):  # banded factors, two off-diagonals
            d[i] = a0[i] - (l1[i - 1] ** 2 * d[i - 1] if i else 0.0) - (
                l2[i - 2] ** 2 * d[i - 2] if i > 1 else 0.0)
            if i < n - 1:
                l1[i] = (a1[i] - (l1[i - 1] * l2[i - 1] * d[i - 1] if i else 0.0)) / d[i]
            if i < n - 2:
                l2[i] = a2[i] / d[i]
        z = w * y
        for i in range(1, n):
            z[i] -= l1[i - 1] * z[i - 1] + (l2[i - 2] * z[i - 2] if i > 1 else 0.0)
        z = z / d
        for i in range(n - 2, -1, -1):
            z[i] -= l1[i] * z[i + 1] + (l2[i] * z[i + 2] if i < n - 2 else 0.0)
        w = np.where(y > z, p, 1.0 - p) * seen
    return z


def asymmetric_baseline(df: DataFrame, trace: Sequence[str], x: str, y: str,
                        tie: Sequence[str] = (), *, lam: float = 1e6, p: float = 0.01,
                        rounds: int = 10, rows_per_segment: int = ROWS_PER_PIECE) -> DataFrame:
    """Asymmetric least-squares baseline per trace, traces in parallel.

    A point feels others through the smoothness term only; its influence falls off
    over about (lam/p)^(1/4) points. Long traces are cut with a halo of sixty such
    lengths, beyond which it is below rounding error.
    """
    halo = int(60 * (lam / min(p, 1 - p)) ** 0.25) + 3
    rows = segmented(df, trace, x, halo, tie, rows_per_segment=max(rows_per_segment, 2 * halo), keep=True)
    schema = T.StructType([*rows.schema.fields, T.StructField("baseline", T.DoubleType())])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([x, *tie])
        values = pdf[y].to_numpy(dtype=float)
        return pdf.assign(baseline=whittaker_baseline(values, lam, p, rounds))

    out = rows.groupBy(*[quoted(t) for t in trace], SEGMENT).applyInPandas(solve, schema)
    return _core(out).withColumn("corrected", quoted(y) - F.col("baseline"))
