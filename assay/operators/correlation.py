"""Correlation, trend, components and clusters of measurements."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import value_positions
from assay.functions.tails import t_two_sided



def aggregate_first(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Group means to correlate instead of rows; the advised step above 100k rows."""
    return df.groupBy(*[quoted(b) for b in by]).agg(
        *[F.avg(clean(df, c)).alias(c) for c in columns])


def _with_p(pairs: DataFrame) -> DataFrame:
    r, n = F.col("r"), F.col("n").cast("double")
    t = F.when(F.abs(r) < 1, r * F.sqrt((n - 2) / (1 - r * r)))
    return pairs.withColumn("__t", F.when(F.col("n") > 2, t)).withColumn(
        "p", F.coalesce(t_two_sided("__t", n - 2),
                        F.when((F.abs(r) >= 1) & (F.col("n") > 2), F.lit(0.0)))).drop("__t")


def pearson(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pairwise Pearson correlation in one aggregate, with n and p per pair."""
    pairs = list(combinations(columns, 2))
    vals = {c: clean(df, c).cast("double") for c in columns}
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = vals[a].isNotNull() & vals[b].isNotNull()
        aggs += [F.corr(F.when(both, vals[a]), F.when(both, vals[b])).alias(f"r{i}"),
                 F.count_if(both).alias(f"n{i}")]
    rows = df.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{i}").alias("r"),
                 F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))
    return _with_p(rows.withColumn("r", F.when(~F.isnan("r"), F.col("r"))))


def _ranked(df: DataFrame, columns: Sequence[str], **split) -> DataFrame:
    """Replace each column by its average rank.

    One join per column on the value itself: ranks are found over distinct values,
    so there is no window over all rows.
    """
    out = df.select(*[clean(df, c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    out = out.dropna()
    base = out
    for i in range(len(columns)):
        pos = value_positions(base.select(f"c{i}"), [], f"c{i}", **split).select(
            f"c{i}", (F.col("before") + (F.col("n") + 1) / 2.0).alias(f"r{i}"))
        out = out.join(pos, f"c{i}")
    return out.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(columns)])


def spearman(df: DataFrame, columns: Sequence[str], **split) -> DataFrame:
    """Pairwise Spearman correlation of rows complete in the given columns."""
    return pearson(_ranked(df, columns, **split), columns)


def stage_trend(df: DataFrame, stage: str, columns: Sequence[str], **split) -> DataFrame:
    """Spearman correlation of each measurement with an ordered stage.

    Stages rank by value when numeric, else by the number in their name, then by name.
    """
    if dict(df.dtypes)[stage] == "string":
        levels = df.select(quoted(stage).alias("__s")).distinct().filter("__s is not null")
        order = levels.select("__s", F.struct(
            F.coalesce(F.expr("try_cast(regexp_extract(__s, '([0-9]+)', 1) AS double)"),
                       F.lit(0.0)), F.col("__s")).alias("__o"))
        ranked = order.collect()  # one row per stage
        place = {r["__s"]: float(i) for i, r in enumerate(sorted(ranked, key=lambda r: tuple(r["__o"])))}
        lookup = F.create_map(*[x for k, v in place.items() for x in (F.lit(k), F.lit(v))])
        df = df.withColumn("__stage", lookup[quoted(stage)])
    else:
        df = df.withColumn("__stage", quoted(stage).cast("double"))
    out = spearman(df, ["__stage", *columns], **split)
    return out.filter(F.col("col_a") == "__stage").select(
        F.lit(stage).alias("stage"), F.col("col_b").alias("metric"), "r", "n", "p")


def linear_trend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept and R squared of ``y`` over ``x`` per group."""
    xv, yv = clean(df, x).cast("double"), clean(df, y).cast("double")
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.regr_count(yv, xv).alias("n"), F.regr_slope(yv, xv).alias("slope"),
        F.regr_intercept(yv, xv).alias("intercept"), F.regr_r2(yv, xv).alias("r2"))


def _scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    vals = df.select("*", *[clean(df, c).cast("double").alias(f"__f{i}")
                            for i, c in enumerate(columns)]).dropna(
        subset=[f"__f{i}" for i in range(len(columns))])
    vec = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(columns))],
                          outputCol="__raw").transform(vals)
    return StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True).fit(vec).transform(vec)


def pca(df: DataFrame, columns: Sequence[str], k: int = 2) -> DataFrame:
    """Loadings and explained variance of the first ``k`` components of the scaled columns."""
    model = PCA(k=k, inputCol="__scaled", outputCol="__pc").fit(_scaled(df, columns))
    loads, share = model.pc.toArray(), model.explainedVariance.toArray()
    return df.sparkSession.createDataFrame(
        [(j + 1, c, float(loads[i][j]), float(share[j]))
         for j in range(k) for i, c in enumerate(columns)],
        "component int, column string, loading double, explained_variance double")


def clusters(df: DataFrame, columns: Sequence[str], k: int, method: str = "kmeans",
             seed: int = 42) -> DataFrame:
    """Add a ``cluster`` from k-means or a Gaussian mixture over the scaled columns."""
    scaled = _scaled(df, columns)
    kind = KMeans if method == "kmeans" else GaussianMixture
    model = kind(featuresCol="__scaled", predictionCol="cluster", k=k, seed=seed).fit(scaled)
    out = model.transform(scaled)
    return out.drop("__raw", "__scaled", "probability", *[f"__f{i}" for i in range(len(columns))])

