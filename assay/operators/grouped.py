"""Per-group statistics of measurements, deviations, outliers and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted, short_number, unpivot_values
from assay.functions.order_stats import exact_quantiles
from assay.plans.distributions import corrected_skew

IQR_FACTOR = 1.5
KEY_SEPARATOR = "__"

STATS = ("count", "mean", "std", "min", "max", "median", "cv", "skew")


def _present_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.filter(clean(df, k).isNotNull())
    return df


def group_key(keys: Sequence[str]):
    """Composite key text: the key values joined by two underscores."""
    return F.concat_ws(KEY_SEPARATOR, *[quoted(k).cast("string") for k in keys])


def group_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str], *,
                median: bool = True, **split) -> DataFrame:
    """Statistics of each metric per group, one row per (keys, metric).

    Moments come from one aggregate over the rows. Medians are read from value
    positions, so a hot group never sits in one task.
    """
    keys = list(keys)
    rows = _present_keys(df, keys)
    aggs, structs = [], []
    for i, m in enumerate(metrics):
        v = clean(df, m).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"),
                 F.stddev_samp(v).alias(f"s{i}"), F.min(v).alias(f"lo{i}"),
                 F.max(v).alias(f"hi{i}"), F.skewness(v).alias(f"g{i}")]
        structs.append(F.struct(F.lit(m).alias("metric"), *[
            F.col(f"{p}{i}").alias(q) for p, q in (
                ("n", "count"), ("m", "mean"), ("s", "std"), ("lo", "min"), ("hi", "max"),
                ("g", "g1"))]))
    wide = rows.groupBy(*[quoted(k) for k in keys]).agg(*aggs)
    out = wide.select(*[quoted(k) for k in keys], F.inline(F.array(*structs))).select(
        *[quoted(k) for k in keys], "metric", "count", "mean", "std", "min", "max",
        F.try_divide("std", "mean").alias("cv"),
        corrected_skew(F.col("g1"), F.col("count")).alias("skew"))
    if median:
        mids = exact_quantiles(unpivot_values(rows, keys, metrics), [*keys, "metric"], "value",
                               {"median": 0.5}, **split)
        out = out.join(mids, [*keys, "metric"], "left")
    return out


def group_metrics(stats: DataFrame, keys: Sequence[str], which: Sequence[str] = STATS) -> DataFrame:
    """Long table (group_key, metric, value) with one row per statistic."""
    named = F.array(*[F.struct(F.concat_ws("_", F.col("metric"), F.lit(s)).alias("metric"),
                               F.col(s).cast("double").alias("value")) for s in which])
    return stats.select(group_key(keys).alias("group_key"), F.inline(named))


def deviations(metrics: DataFrame, k: int | None = None) -> DataFrame:
    """Deviation of each group from the mean of groups, per metric of (group_key, metric, value).

    With ``k`` only the most deviant groups of each metric are kept.
    """
    means = metrics.groupBy("metric").agg(
        F.avg("value").alias("metric_mean"), F.stddev_pop("value").alias("metric_std"),
        F.count("value").alias("groups"))
    out = metrics.join(means, "metric").withColumn(
        "deviation", F.abs(F.col("value") - F.col("metric_mean"))).withColumn(
        "relative_pct", F.try_divide(F.col("deviation"), F.abs("metric_mean")) * 100)
    if k is None:
        return out
    w = Window.partitionBy("metric").orderBy(F.col("deviation").desc(), "group_key")
    return out.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def backfill_findings(metrics: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest relative deviations, one per metric, as finding text."""
    worst = deviations(metrics.filter(F.col("value").isNotNull()), 1).filter(
        (F.col("groups") >= 2) & (F.col("metric_mean") != 0) & (F.col("metric_std") > 0))
    # Fixed output format of a finding; other checks read these words.
    text = F.concat(
        F.col("group_key"), F.lit(" shows "), F.format_string("%.1f", F.col("relative_pct")),
        F.when(F.col("value") > F.col("metric_mean"), "% above").otherwise("% below"),
        F.lit(" group mean in "), F.col("metric"), F.lit(" (value="), short_number(F.col("value")),
        F.lit(", group mean="), short_number(F.col("metric_mean")), F.lit(")"))
    return worst.orderBy(F.col("relative_pct").desc(), "metric").limit(k).select(
        "metric", "group_key", "relative_pct", text.alias("text"))


def outlier_flags(metrics: DataFrame, sd: float = 2.0, factor: float = IQR_FACTOR, **split
                  ) -> DataFrame:
    """Z-score, ``sd`` rule and IQR fences for each group within its metric."""
    moments = metrics.groupBy("metric").agg(F.avg("value").alias("mu"),
                                            F.stddev_samp("value").alias("sigma"))
    fences = exact_quantiles(metrics, ["metric"], "value", {"q1": 0.25, "q3": 0.75}, **split)
    width = F.col("q3") - F.col("q1")
    return metrics.join(moments, "metric").join(fences, "metric").withColumn(
        "z", F.try_divide(F.col("value") - F.col("mu"), F.col("sigma"))).select(
        "group_key", "metric", "value", "z",
        F.coalesce(F.abs("z") > sd, F.lit(False)).alias("z_outlier"),
        ((F.col("value") < F.col("q1") - factor * width)
         | (F.col("value") > F.col("q3") + factor * width)).alias("iqr_outlier"))


def cv_label(df: DataFrame, keys: Sequence[str], column: str, threshold: float,
             label: str = "label") -> DataFrame:
    """Per group: coefficient of variation and whether it exceeds the threshold."""
    rows = _present_keys(df, keys)
    v = clean(df, column).cast("double")
    return rows.groupBy(*[quoted(k) for k in keys]).agg(
        F.try_divide(F.stddev_samp(v), F.avg(v)).alias("cv")).withColumn(
        label, F.coalesce(F.col("cv") > threshold, F.lit(False)))


def iqr_label(df: DataFrame, column: str, label: str = "label", factor: float = IQR_FACTOR,
              **split) -> DataFrame:
    """Mark rows outside the IQR fences of the whole column."""
    fences = exact_quantiles(df, [], column, {"__q1": 0.25, "__q3": 0.75}, **split)
    v = clean(df, column).cast("double")
    width = F.col("__q3") - F.col("__q1")
    # The fences are one row.
    return df.join(F.broadcast(fences), F.lit(True), "left").withColumn(
        label, F.coalesce((v < F.col("__q1") - factor * width)
                          | (v > F.col("__q3") + factor * width), F.lit(False))).drop(
        "__q1", "__q3")


def secondary_summary(df: DataFrame, dimensions: Sequence[str], grouping: Sequence[str],
                      metric: str) -> DataFrame:
    """mean, std and n per level of each dimension that the grouping leaves out."""
    left = [d for d in dimensions if d not in grouping]
    levels = F.array(*[F.struct(F.lit(d).alias("dimension"),
                                quoted(d).cast("string").alias("level")) for d in left])
    return (
        df.select(clean(df, metric).cast("double").alias("v"), F.inline(levels))
        .filter(F.col("level").isNotNull()).groupBy("dimension", "level")
        .agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.count("v").alias("n")))


def compare_datasets(frames: dict[str, DataFrame], keys: Sequence[str], metrics: Sequence[str]
                     ) -> DataFrame:
    """Per dataset and metric: mean of the groups and each group's deviation from it."""
    parts = [group_stats(df, keys, metrics, median=False).select(
        F.lit(name).alias("dataset"), group_key(keys).alias("group_key"), "metric",
        F.col("mean").alias("value")) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    means = out.groupBy("dataset", "metric").agg(F.avg("value").alias("dataset_mean"))
    return out.join(means, ["dataset", "metric"]).withColumn(
        "deviation_pct", F.try_divide(F.col("value") - F.col("dataset_mean"),
                                      F.abs("dataset_mean")) * 100)


def deviation_matrix(df: DataFrame, row: str, col: str, metric: str, columns: Sequence | None = None
                     ) -> DataFrame:
    """Matrix of relative deviations of group means, rows by ``row``, columns by ``col``."""
    means = df.groupBy(quoted(row), quoted(col)).agg(F.avg(clean(df, metric)).alias("mean"))
    grand = means.groupBy(quoted(col)).agg(F.avg("mean").alias("grand"))
    dev = means.join(grand, col).withColumn(
        "deviation_pct", F.try_divide(F.col("mean") - F.col("grand"), F.abs("grand")) * 100)
    pivot = dev.groupBy(quoted(row))
    return (pivot.pivot(col, list(columns)) if columns else pivot.pivot(col)).agg(
        F.first("deviation_pct"))


def wide_features(df: DataFrame, by: Sequence[str], metrics: Sequence[str], **split) -> DataFrame:
    """One row per unit with mean, std, cv, min, max, median, skew and count of each metric."""
    stats = group_stats(df, by, metrics, **split)
    return stats.groupBy(*[quoted(k) for k in by]).agg(*[
        F.max(F.when(F.col("metric") == m, F.col(s).cast("double"))).alias(f"{m}_{s}")
        for m in metrics for s in STATS])
