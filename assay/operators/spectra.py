"""Mass spectra and process steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import exact_quantiles
from assay.operators.traces import trapezoids

# Fixed reference values.
PPM_PEPTIDE, PPM_INTACT = 10.0, 50.0
SN_GOOD, SN_FAIR = 10.0, 3.0
CHARGE_TOLERANCE = 0.005
NOISE_QUANTILE = 0.05
GLYCOFORM_SPACING = {"hexose": 162.0, "HexNAc": 203.0, "sialic acid": 291.0}
REFERENCE_MASSES = {"mAb": 148000.0, "Fab": 50000.0, "Fc": 50000.0, "HC": 50000.0, "LC": 25000.0}


def mass_accuracy_ppm(observed: Column, expected: Column) -> Column:
    """Absolute error in parts per million; infinite when nothing was expected."""
    return F.when(expected == 0, F.lit(float("inf"))).otherwise(
        F.try_divide(F.abs(observed - expected), expected.cast("double")) * 1e6)


def mass_accuracy(df: DataFrame, observed: str, expected: str) -> DataFrame:
    ppm = mass_accuracy_ppm(quoted(observed), quoted(expected))
    return df.withColumn("ppm", ppm).withColumn("accuracy", F.when(
        F.col("ppm") < PPM_PEPTIDE, "peptide").when(F.col("ppm") < PPM_INTACT, "intact").when(
        F.col("ppm").isNotNull(), "poor"))


def signal_to_noise(df: DataFrame, by: Sequence[str], y: str, **split) -> DataFrame:
    """Highest signal over the spread of the lowest 5 % of points, per spectrum."""
    cut = exact_quantiles(df, by, y, {"__cut": NOISE_QUANTILE}, **split)
    v = clean(df, y).cast("double")
    out = df.join(cut, list(by)).groupBy(*[quoted(b) for b in by]).agg(
        F.max(v).alias("signal"), F.stddev_samp(F.when(v <= F.col("__cut"), v)).alias("noise"))
    return out.withColumn("sn", F.try_divide("signal", "noise")).withColumn("quality", F.when(
        F.col("sn") > SN_GOOD, "good").when(F.col("sn") >= SN_FAIR, "acceptable").when(
        F.col("sn").isNotNull(), "poor"))


def charge_check(df: DataFrame, mz: str, z: str, mass: str) -> DataFrame:
    """Whether m/z times charge agrees with the neutral mass within 0.5 %."""
    off = F.abs(quoted(mz) * quoted(z) - quoted(mass))
    return df.withColumn("charge_ok", off <= F.abs(quoted(mass)) * CHARGE_TOLERANCE)


def charge_envelope(df: DataFrame, by: Sequence[str], z: str, intensity: str) -> DataFrame:
    """Intensity share of every charge state and the weighted mean charge of the spectrum."""
    keys = [quoted(b) for b in by]
    states = df.groupBy(*keys, quoted(z)).agg(F.sum(clean(df, intensity)).alias("intensity"))
    # One row per charge state here; totals come from the same small table.
    totals = states.groupBy(*keys).agg(
        F.sum("intensity").alias("__all"), F.count(F.lit(1)).alias("states"),
        F.try_divide(F.sum(quoted(z) * F.col("intensity")), F.sum("intensity")).alias("mean_charge"))
    return states.join(totals, list(by)).withColumn(
        "share", F.try_divide("intensity", "__all")).drop("__all")


def spacing_pairs(df: DataFrame, by: Sequence[str], mass: str, spacing: Mapping[str, float] | None = None,
                  tolerance: float = 1.0) -> DataFrame:
    """Pairs of masses of one spectrum that differ by a known spacing.

    Masses are first made distinct; each looks up the cells around its mass plus
    the spacing, so the join is an equi join on (spectrum, cell) and no mass meets
    more than the three cells that can hold a match.
    """
    spacing = spacing or GLYCOFORM_SPACING
    keys = [quoted(b) for b in by]
    width = 2.0 * tolerance
    masses = df.select(*keys, clean(df, mass).cast("double").alias("m")).dropna().distinct()
    steps = F.array(*[F.struct(F.lit(k).alias("unit"), F.lit(float(v)).alias("step"))
                      for k, v in spacing.items()])
    low = masses.select(*keys, F.col("m").alias("mass_low"), F.inline(steps))
    cell = F.floor((F.col("mass_low") + F.col("step")) / width)
    low = low.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    high = masses.select(*keys, F.col("m").alias("mass_high"),
                         F.floor(F.col("m") / width).alias("cell"))
    gap = F.abs(F.col("mass_high") - F.col("mass_low") - F.col("step"))
    return low.join(high, [*by, "cell"]).filter(gap <= tolerance).select(
        *keys, "unit", "mass_low", "mass_high", gap.alias("error"))


def reference_match(df: DataFrame, mass: str, references: Mapping[str, float] | None = None,
                    tolerance: float = 0.05) -> DataFrame:
    """Reference species within a relative tolerance of each mass (a fixed, tiny list)."""
    rows = [(k, float(v)) for k, v in (references or REFERENCE_MASSES).items()]
    ref = F.broadcast(df.sparkSession.createDataFrame(rows, "species string, reference double"))
    return df.join(ref, F.abs(quoted(mass) - F.col("reference")) <= F.col("reference") * tolerance)


def total_response(df: DataFrame, by: Sequence[str], t: str, response: str, bin_width: float,
                   ) -> DataFrame:
    """Total response per retention bin."""
    bin_ = F.floor(quoted(t) / F.lit(bin_width)) * F.lit(bin_width)
    return df.groupBy(*[quoted(b) for b in by], bin_.cast("double").alias("bin")).agg(
        F.sum(clean(df, response)).alias("response"))


def total_area(bins: DataFrame, by: Sequence[str], **kw) -> DataFrame:
    """Area under the total response of each run."""
    return trapezoids(bins, by, "bin", "response", **kw).groupBy(*[quoted(b) for b in by]).agg(
        F.sum("slice").alias("area"))


def step_recovery(df: DataFrame, batch: Sequence[str], stage: str, amount: str) -> DataFrame:
    """Amount per stage and its percentage of the stage before (one row per batch and stage)."""
    sums = df.groupBy(*[quoted(b) for b in batch], quoted(stage)).agg(
        F.sum(clean(df, amount)).alias("amount"))
    w = Window.partitionBy(*[quoted(b) for b in batch]).orderBy(quoted(stage))
    return sums.withColumn("recovery_pct", F.try_divide(
        F.col("amount").cast("double"), F.lag("amount").over(w).cast("double")) * 100)
