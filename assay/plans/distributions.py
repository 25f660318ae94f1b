"""Shape of continuous columns: moments, normality, number of modes, transform."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted

# Fixed values of the distribution rules.
NORMALITY_ALPHA = 0.05
MIN_SAMPLES = 8
MIN_SAMPLES_NORMALITY = 20
GRID_POINTS = 512
PROMINENCE_FACTOR = 0.10
HIGH_SKEW = 1.0
EXTREME_SKEW = 2.0

HISTOGRAM_BINS = 4096


def corrected_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected skewness from the population value."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def corrected_kurtosis(g2: Column, n: Column) -> Column:
    """Bias-corrected excess kurtosis from the population value."""
    n = n.cast("double")
    return F.when(n > 3, (n - 1) / F.when(n > 3, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def with_omnibus(rows: DataFrame) -> DataFrame:
    """Add ``k2``, the D'Agostino-Pearson statistic, from columns ``g1``, ``g2`` and ``n``.

    The terms are added step by step so that each is computed once per row.
    """
    n, g1, g2 = F.col("n").cast("double"), F.col("g1"), F.col("g2")
    enough = F.col("n") >= MIN_SAMPLES_NORMALITY
    beta2 = (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
             / ((n - 2) * (n + 5) * (n + 7) * (n + 9)))
    var_b2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    root_b1 = (6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
               * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))
    steps = {
        "__w2": F.sqrt(2.0 * (beta2 - 1)) - 1.0,
        "__y": g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))),
        "__x": (g2 + 3.0 - 3.0 * (n - 1) / (n + 1)) / F.sqrt(var_b2),
        "__b": root_b1,
        "__a": 6.0 + 8.0 / F.col("__b") * (
            2.0 / F.col("__b") + F.sqrt(1.0 + 4.0 / (F.col("__b") * F.col("__b")))),
        "__zs": F.asinh(F.col("__y") / F.sqrt(2.0 / (F.col("__w2") - 1.0)))
        / F.sqrt(0.5 * F.log("__w2")),
        "__in": (1.0 - 2.0 / F.col("__a"))
        / (1.0 + F.col("__x") * F.sqrt(2.0 / (F.col("__a") - 4.0))),
        "__zk": (1.0 - 2.0 / (9.0 * F.col("__a"))
                 - F.signum("__in") * F.pow(F.abs("__in"), F.lit(1.0 / 3.0)))
        / F.sqrt(2.0 / (9.0 * F.col("__a"))),
        "k2": F.col("__zs") * F.col("__zs") + F.col("__zk") * F.col("__zk"),
    }
    for name, expr in steps.items():
        rows = rows.withColumn(name, F.when(enough, expr))
    return rows.drop(*[s for s in steps if s != "k2"])


def suggested_transform(skew: Column, smallest: Column) -> Column:
    size = F.abs(skew)
    return F.when((size >= EXTREME_SKEW) & (smallest > 0), "log").when(
        (size >= HIGH_SKEW) & (smallest >= 0), "sqrt")


def shapes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments, normality and suggested transform, one row per column, in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        v = clean(df, c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.stddev_samp(v).alias(f"sd{i}"), F.skewness(v).alias(f"g{i}"),
                 F.kurtosis(v).alias(f"k{i}")]
    structs = [F.struct(F.lit(c).alias("name"), *[
        F.col(f"{p}{i}").alias(q) for p, q in (
            ("n", "n"), ("lo", "min"), ("hi", "max"), ("sd", "std"), ("g", "g1"), ("k", "g2"))])
        for i, c in enumerate(columns)]
    rows = df.agg(*aggs).select(F.inline(F.array(*structs))).filter(F.col("n") >= MIN_SAMPLES)
    rows = (
        with_omnibus(rows)
        .withColumn("skewness", corrected_skew(F.col("g1"), F.col("n")))
        .withColumn("p", F.exp(-F.col("k2") / 2.0)))
    return rows.select(
        "name", "n", "min", "max", "std", F.round("skewness", 4).alias("skewness"),
        F.round(corrected_kurtosis(F.col("g2"), F.col("n")), 4).alias("kurtosis"),
        F.round("k2", 4).alias("normality_stat"), F.round("p", 6).alias("normality_pvalue"),
        F.when(F.col("k2").isNotNull(), "dagostino").otherwise("insufficient_data").alias(
            "normality_test"),
        F.coalesce(F.col("p") > NORMALITY_ALPHA, F.lit(False)).alias("is_normal"),
        suggested_transform(F.col("skewness"), F.col("min")).alias("suggested_transform"))


def density(df: DataFrame, columns: Sequence[str], shape: DataFrame | None = None,
            bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Gaussian kernel density on 512 grid points per column (name, grid, density).

    Values are first counted in a fixed number of narrow bins, so the kernel work
    depends on the bins and never on the number of rows. The bandwidth is Scott's.
    """
    shape = shapes(df, columns) if shape is None else shape
    facts = shape.filter((F.col("std") > 0) & (F.col("max") > F.col("min"))).select(
        "name", "n", "min", "max", "std")
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), clean(df, c).cast("double").alias("v"))
                      for c in columns])
    # One row per column on the broadcast side.
    binned = (
        df.select(F.inline(pairs)).filter(F.col("v").isNotNull())
        .join(F.broadcast(facts), "name")
        .withColumn("bin", F.least(F.lit(bins - 1), F.floor(
            (F.col("v") - F.col("min")) / (F.col("max") - F.col("min")) * bins).cast("int")))
        .groupBy("name", "bin").agg(F.count(F.lit(1)).alias("w"), F.sum("v").alias("s")))
    step = (F.col("max") - F.col("min")) / (GRID_POINTS - 1)
    width = F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    centre = F.col("s") / F.col("w")
    reach = 9.0 * width
    first = F.greatest(F.lit(0), F.ceil((centre - reach - F.col("min")) / step).cast("int"))
    last = F.least(F.lit(GRID_POINTS - 1),
                   F.floor((centre + reach - F.col("min")) / step).cast("int"))
    distance = (F.col("min") + F.col("grid") * step - centre) / width
    near = (
        binned.join(F.broadcast(facts), "name")
        .withColumn("first", first).withColumn("last", last).filter(F.col("last") >= F.col("first"))
        .withColumn("grid", F.explode(F.sequence("first", "last")))
        .withColumn("part", F.col("w") * F.exp(-0.5 * distance * distance)
                    / (F.col("n") * width * F.lit(2.5066282746310002))))
    return near.groupBy("name", "grid").agg(F.sum("part").alias("density"))


def modes(df: DataFrame, columns: Sequence[str], shape: DataFrame | None = None,
          bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Number of density peaks with prominence of at least a tenth of the maximum."""
    points = density(df, columns, shape, bins)
    # 512 points per column: a bounded array.
    curves = points.groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("grid", "density"))).alias("pts")).select(
        "name", F.transform("pts", lambda p: p["density"]).alias("d"))
    tall = F.array_max("d") * PROMINENCE_FACTOR
    size = F.size("d")

    def base(side: Column, height: Column) -> Column:
        """Lowest point of the stretch from the peak to the next higher point."""
        stop = F.coalesce(F.array_position(F.transform(side, lambda x: x > height), True), F.lit(0))
        reach = F.when(stop > 0, F.slice(side, 1, F.greatest(stop - 1, F.lit(0)).cast("int"))
                       ).otherwise(side)
        return F.coalesce(F.array_min(reach), height)

    def prominence(i: Column) -> Column:
        height = F.element_at("d", i.cast("int"))
        left = F.reverse(F.slice("d", F.lit(1), i - 1))
        right = F.slice("d", i + 1, size - i)
        return height - F.greatest(base(left, height), base(right, height))

    def is_peak(i: Column) -> Column:
        here = F.element_at("d", i.cast("int"))
        return (here > F.element_at("d", (i - 1).cast("int"))) & (
            here > F.element_at("d", (i + 1).cast("int"))) & (prominence(i) >= tall)

    inner = F.when(size > 2, F.sequence(F.lit(2), size - 1)).otherwise(
        F.array().cast("array<int>"))
    count = F.greatest(F.lit(1), F.size(F.filter(inner, is_peak)))
    return curves.select("name", count.alias("n_modes")).withColumn(
        "modality", F.when(F.col("n_modes") == 1, "unimodal")
        .when(F.col("n_modes") == 2, "bimodal").otherwise("multimodal"))


def distribution_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shape and modes of every continuous column."""
    shape = shapes(df, columns)
    return shape.join(modes(df, columns, shape), "name", "left").select(
        *[c for c in shape.columns if c not in ("min", "max", "std")],
        F.coalesce("modality", F.lit("unimodal")).alias("modality"),
        F.coalesce("n_modes", F.lit(1)).alias("n_modes"))


def apply_transform(df: DataFrame, column: str, kind: str) -> DataFrame:
    """Variance-stabilising transform of one column (``log`` or ``sqrt``); NULL outside its domain."""
    v = quoted(column).cast("double")
    out = {"log": F.when(v > 0, F.log(v)), "sqrt": F.when(v >= 0, F.sqrt(v))}[kind]
    return df.withColumn(f"{kind}_{column}", out)
