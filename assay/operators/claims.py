"""Recomputing claimed numbers from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import clean, numeric_columns, quoted, short_number
from assay.operators.grouped import group_key

# Fixed tolerances.
RELATIVE_TOLERANCE, ABSOLUTE_TOLERANCE = 0.01, 1e-6
MISMATCH_SHARE = 0.05
COLUMN_CLAIMS = 10


def recomputed_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(group_key, metric, actual): group means, rows with a null key left out as usual."""
    rows = df
    for k in keys:
        rows = rows.filter(quoted(k).isNotNull())
    wide = rows.groupBy(*[quoted(k) for k in keys]).agg(
        *[F.avg(clean(df, m).cast("double")).alias(f"__m{i}") for i, m in enumerate(metrics)])
    return wide.select(group_key(keys).alias("group_key"), F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"__m{i}").alias("actual"))
        for i, m in enumerate(metrics)]))).filter("actual is not null")


def tolerance(claimed: Column) -> Column:
    return F.greatest(F.abs(claimed) * RELATIVE_TOLERANCE, F.lit(ABSOLUTE_TOLERANCE))


def verify(claims: DataFrame, actual: DataFrame) -> DataFrame:
    """Compare (group_key, metric, value) claims with recomputed values.

    One join for all claims. ``status`` is match, mismatch or unmatched (nothing to
    compare with).
    """
    gap = F.abs(F.col("value") - F.col("actual"))
    return claims.join(actual, ["group_key", "metric"], "left").withColumn(
        "status", F.when(F.col("actual").isNull(), "unmatched").when(
            gap <= tolerance(F.col("value")), "match").otherwise("mismatch"))


def most_deviant(claims: DataFrame) -> DataFrame:
    """The claim of each metric farthest from the mean of its claims (two or more needed)."""
    means = claims.groupBy("metric").agg(F.avg("value").alias("__mean"),
                                         F.count("value").alias("__n"))
    far = claims.filter("value is not null").join(means.filter("__n >= 2"), "metric").withColumn(
        "__gap", F.abs(F.col("value") - F.col("__mean")))
    # Greatest gap first, then first key: an aggregate, so a wide metric needs no sort.
    best = far.groupBy("metric").agg(F.max("__gap").alias("__gap"))
    tied = far.join(best, ["metric", "__gap"])
    return tied.groupBy("metric").agg(F.min_by(F.struct("group_key", "value"), "group_key").alias(
        "c")).select("c.group_key", "metric", "c.value")


def first_claims(claims: DataFrame, n: int) -> DataFrame:
    """The first ``n`` claims by group key and metric."""
    return claims.filter("value is not null").orderBy("group_key", "metric").limit(n)


def column_means(df: DataFrame, n: int = COLUMN_CLAIMS) -> DataFrame:
    """Means of the first numeric columns, as claims that hold by construction."""
    names = numeric_columns(df)[:n]
    row = df.agg(*[F.avg(clean(df, c).cast("double")).alias(f"__m{i}") for i, c in enumerate(names)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"__m{i}").alias("mean"))
        for i, c in enumerate(names)]))).filter("mean is not null")


def claim_text(df: DataFrame) -> DataFrame:
    return df.withColumn("claim", F.concat(F.col("group_key"), F.lit(" "), F.col("metric"),
                                           F.lit(" = "), short_number(F.col("value"))))


def verified_claims(claims: DataFrame, df: DataFrame, keys: Sequence[str], metrics: Sequence[str],
                    minimum: int = 5) -> DataFrame:
    """Most deviant claim per metric, then further claims up to the minimum, then column means.

    Groups are recomputed once and joined to all chosen claims.
    """
    lead = most_deviant(claims).withColumn("strategy", F.lit(1))
    rest = first_claims(claims.join(lead, ["group_key", "metric"], "left_anti"), minimum).select(
        "group_key", "metric", "value").withColumn("strategy", F.lit(2))
    chosen = verify(lead.unionByName(rest), recomputed_means(df, keys, metrics))
    cols = column_means(df).select(
        F.lit(None).cast("string").alias("group_key"), F.col("column").alias("metric"),
        F.col("mean").alias("value"), F.lit(4).alias("strategy"), F.col("mean").alias("actual"))
    cols = cols.withColumn("status", F.when(
        F.abs(F.col("value") - F.col("actual")) <= tolerance(F.col("value")), "match").otherwise("mismatch"))
    every = chosen.select(*cols.columns).unionByName(cols)
    # A handful of rows per metric: claims are chosen above, not data rows.
    w = Window.orderBy("strategy", "metric", "group_key")
    needed = F.greatest(F.lit(minimum), F.col("__lead"))
    return every.withColumn("__i", F.row_number().over(w)).join(
        F.broadcast(lead.agg(F.count(F.lit(1)).alias("__lead"))), F.lit(True)).filter(
        F.col("__i") <= needed).drop("__i", "__lead")


def verify_statistics(claims: DataFrame, results: DataFrame, key: Sequence[str],
                      tol: float = RELATIVE_TOLERANCE) -> DataFrame:
    """Compare claimed statistics or p-values (key, value) with recomputed ones (key, actual)."""
    out = claims.join(results, list(key), "left")
    gap = F.abs(F.col("value") - F.col("actual"))
    near = gap <= F.greatest(F.abs(F.col("actual")) * tol, F.lit(ABSOLUTE_TOLERANCE))
    return out.withColumn("status", F.when(F.col("actual").isNull(), "unmatched").when(
        near, "match").otherwise("mismatch"))


def large_mismatches(claims: DataFrame, actual: DataFrame) -> DataFrame:
    """Claims more than 5 % off the recomputed value."""
    return claims.join(actual, ["group_key", "metric"]).withColumn(
        "relative_gap", F.abs(F.try_divide(F.col("value") - F.col("actual"), F.col("actual")))
    ).filter(F.col("relative_gap") > MISMATCH_SHARE)


def columns_without_stats(df: DataFrame, metrics: DataFrame) -> DataFrame:
    """Numeric columns that no group metric is named after (exactly or as a prefix)."""
    names = df.sparkSession.createDataFrame([(c,) for c in numeric_columns(df)], "column string")
    used = metrics.select("metric").distinct().select(F.explode(F.transform(
        F.sequence(F.lit(1), F.length("metric")), lambda n: F.substring("metric", F.lit(1), n))).alias(
        "column")).distinct()
    return names.join(used, "column", "left_anti")
