"""Domain of a dataset from its column names, and analyses expected but not reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import quoted

# Fixed word lists by domain, and fixed confidence limits.
DOMAIN_KEYWORDS = {
    "chromatography": (
        "retention_time", "rt", "peak_area", "peak_height", "absorbance", "mau", "au",
        "elution_volume", "wavelength", "chromatogram", "hplc", "sec", "iex", "hic"),
    "mass_spectrometry": (
        "m/z", "mz", "charge_state", "charge", "molecular_weight", "mw", "da", "dalton", "tic",
        "bpc", "spectrum", "scan", "mass_spec", "deconvolution", "intensity"),
}
REQUIRED_ANALYSES = {
    "chromatography": ("peak_detection", "run_to_run_comparison", "purity_ratio"),
    "mass_spectrometry": ("mass_accuracy", "charge_envelope"),
}
CONFIDENCE_FLOOR, CONFIDENCE_STRONG = 0.05, 0.2


def detect_domains(columns: DataFrame, by: Sequence[str], name: str = "name") -> DataFrame:
    """Confidence of each domain per dataset: share of its keywords found in a column name."""
    low = F.lower(quoted(name))
    aggs = [F.max(F.contains(low, F.lit(k))).alias(f"k{i}_{j}")
            for i, words in enumerate(DOMAIN_KEYWORDS.values()) for j, k in enumerate(words)]
    wide = columns.groupBy(*[quoted(b) for b in by]).agg(*aggs)
    rows = []
    for i, (domain, words) in enumerate(DOMAIN_KEYWORDS.items()):
        hits = F.lit(0)
        for j in range(len(words)):
            hits = hits + F.col(f"k{i}_{j}").cast("int")
        rows.append(F.struct(F.lit(domain).alias("domain"), (hits / F.lit(float(len(words)))).alias(
            "confidence")))
    return wide.select(*[quoted(b) for b in by], F.inline(F.array(*rows))).withColumn(
        "detected", F.col("confidence") >= CONFIDENCE_FLOOR).withColumn(
        "strong", F.col("confidence") >= CONFIDENCE_STRONG)


def missing_analyses(domains: DataFrame, findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Required analyses of a detected domain that no finding of the dataset mentions."""
    spark = domains.sparkSession
    wanted = spark.createDataFrame(
        [(d, a) for d, names in REQUIRED_ANALYSES.items() for a in names],
        "domain string, analysis string")
    need = domains.filter("detected").join(F.broadcast(wanted), "domain").select(
        *[quoted(b) for b in by], "domain", "analysis")
    low = F.lower("text")
    said = F.array(*[F.when(F.contains(low, F.lit(a)) | F.contains(low, F.lit(a.replace("_", " "))), a)
                     for names in REQUIRED_ANALYSES.values() for a in names])
    done = findings.select(*[quoted(b) for b in by], F.explode(F.filter(
        said, lambda x: x.isNotNull())).alias("analysis")).distinct()
    return need.join(done, [*by, "analysis"], "left_anti")
