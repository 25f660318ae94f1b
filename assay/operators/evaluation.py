"""Scores of runs: aggregation, comparison of configurations, correction, correlation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean, present, quoted
from assay.functions.order_stats import exact_quantiles, numbered_rows, value_positions
from assay.functions.tails import t_two_sided
from assay.operators import resampling as B
from assay.operators.hypothesis import _group_ranks, with_u_test

# Fixed criterion weights by rubric version.
RUBRICS = {
    "v1": {
        "analytical_depth": 0.20, "statistical_reasoning": 0.15, "figure_quality": 0.10,
        "claim_evidence_consistency": 0.20, "report_clarity": 0.10,
        "evidence_based_reasoning": 0.15, "domain_correctness": 0.10,
    },
    "global_v1": {
        "cross_dataset_synthesis": 0.25, "narrative_coherence": 0.20, "conclusion_scoping": 0.15,
        "actionable_insights": 0.15, "contradiction_identification": 0.10, "completeness": 0.15,
    },
}
STABLE_CV, MODERATE_CV = 0.15, 0.25
GLOBAL_DATASET = "__global__"


def _cols(names: Sequence[str]) -> list[Column]:
    return [quoted(n) for n in names]


def config_label(runs: DataFrame) -> DataFrame:
    """Add ``config``: the run label, or the run id when the label is empty."""
    return runs.withColumn("config", F.coalesce(F.nullif(F.col("run_label"), F.lit("")),
                                                F.col("run_id")))


def clamp_scores(df: DataFrame, score: str) -> DataFrame:
    """Whole scores from 0 to 10; a missing score counts as 0."""
    whole = F.coalesce(clean(df, score), F.lit(0)).cast("bigint")
    return df.withColumn(score, F.greatest(F.lit(0), F.least(F.lit(10), whole)).cast("int"))


def weighted_score(scores: DataFrame, unit: Sequence[str], criterion: str, score: str,
                   weights: Mapping[str, float] | str = "v1") -> DataFrame:
    """Weighted sum of criterion scores per unit; an absent criterion adds 0."""
    table = RUBRICS[weights] if isinstance(weights, str) else weights
    weight = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(float(v)))])[
        quoted(criterion)]
    return scores.groupBy(*_cols(unit)).agg(F.round(F.sum(
        F.coalesce(weight, F.lit(0.0)) * F.coalesce(clean(scores, score), F.lit(0.0))), 2).alias(
        "overall_score"))


def aggregate_judgments(df: DataFrame, by: Sequence[str], score: str, method: str = "weighted_mean",
                        weight: str | None = None, **split) -> DataFrame:
    """Mean, spread, least, greatest and number of judgments per unit.

    Methods: ``weighted_mean`` (population spread), ``median``, and
    ``trimmed_mean``, which drops one lowest and one highest of four or more.
    """
    v = F.coalesce(clean(df, score).cast("double"), F.lit(0.0))
    w = quoted(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(*_cols(by), v.alias("v"), w.alias("w"))
    base = rows.groupBy(*_cols(by)).agg(
        (F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("m"), F.stddev_pop("v").alias("s"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n"))
    plain = base.select(*_cols(by), F.round("m", 2).alias("mean"), F.round("s", 2).alias("std"),
                        F.col("lo").alias("min"), F.col("hi").alias("max"), "n")
    if method == "weighted_mean":
        return plain
    if method == "median":
        mids = exact_quantiles(rows, by, "v", {"m": 0.5}, **split)
        return plain.drop("mean", "std").join(mids, list(by)).select(
            *_cols(by), F.round("m", 2).alias("mean"), F.lit(0.0).alias("std"), "min", "max", "n")
    if method != "trimmed_mean":
        raise ValueError(f"unknown aggregation method: {method!r}")
    # Least and greatest of the kept values: second ranks when the end is a single row.
    pos = value_positions(rows, by, "v", **split)
    kept = pos.filter((F.col("before") + F.col("n") > 1) & (F.col("before") < F.col("total") - 1))
    inner = kept.groupBy(*_cols(by)).agg(F.min("v").alias("in_lo"), F.max("v").alias("in_hi"))
    out = base.withColumn("total_v", F.col("m") * F.col("n")) if weight is None else \
        rows.groupBy(*_cols(by)).agg(F.sum("v").alias("total_v")).join(base, list(by))
    enough = F.col("n") >= 4
    trimmed = (F.col("total_v") - F.col("lo") - F.col("hi")) / F.when(enough, F.col("n") - 2)
    return out.join(inner, list(by), "left").select(
        *_cols(by), F.round(F.when(enough, trimmed).otherwise(F.col("m")), 2).alias("mean"),
        F.when(enough, 0.0).otherwise(F.round("s", 2)).alias("std"),
        F.when(enough, F.col("in_lo")).otherwise(F.col("lo")).alias("min"),
        F.when(enough, F.col("in_hi")).otherwise(F.col("hi")).alias("max"), "n")


def replication_stats(scores: DataFrame, by: Sequence[str] = ("config", "metric"),
                      value: str = "value", replicates: int | None = 10_000, **split) -> DataFrame:
    """n, mean, std, median and a bootstrap interval over the runs of a configuration."""
    rows = scores.select(*_cols(by), clean(scores, value).cast("double").alias("v")).filter(
        "v is not null")
    base = rows.groupBy(*_cols(by)).agg(
        F.count("v").alias("n_runs"), F.round(F.avg("v"), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("v"), F.lit(0.0)), 4).alias("std"))
    mids = exact_quantiles(rows, by, "v", {"median": 0.5}, **split)
    out = base.join(mids.withColumn("median", F.round("median", 4)), list(by))
    if replicates:
        ci = B.bootstrap_ci(rows, by, "v", replicates, **split)
        out = out.join(ci.select(*_cols(by), F.round("ci_lower", 4).alias("ci_lower"),
                                 F.round("ci_upper", 4).alias("ci_upper")), list(by))
    return out


def stability(scores: DataFrame, by: Sequence[str] = ("config", "metric"), value: str = "value"
              ) -> DataFrame:
    """Coefficient of variation and its band; none for one run or a mean of 0."""
    v = clean(scores, value).cast("double")
    out = scores.groupBy(*_cols(by)).agg(F.count(v).alias("n"), F.round(
        F.try_divide(F.stddev_samp(v), F.avg(v)), 4).alias("cv"))
    out = out.withColumn("cv", F.when(F.col("n") >= 2, F.col("cv")))
    return out.withColumn("band", F.when(F.col("cv") < STABLE_CV, "stable").when(
        F.col("cv") < MODERATE_CV, "moderate").when(F.col("cv").isNotNull(), "unstable"))


def config_pairs(configs: DataFrame, baseline: str | None = None) -> DataFrame:
    """All unordered pairs of configuration labels, or the baseline against every other."""
    names = configs.select("config").distinct()
    if baseline is not None:
        return names.filter(F.col("config") != baseline).select(
            F.lit(baseline).alias("config_a"), F.col("config").alias("config_b"))
    # The pairs of labels are the answer itself; labels are few and made distinct first.
    return names.select(F.col("config").alias("config_a")).join(
        names.select(F.col("config").alias("config_b")), F.col("config_a") < F.col("config_b"))


def compare_configs(scores: DataFrame, baseline: str | None = None, permutations: int | None = None,
                    **split) -> DataFrame:
    """Difference, effect size and tests of each pair of configurations per metric.

    Input is (config, metric, value) with one value per run. Sides with fewer than
    two runs are left out.
    """
    rows = scores.select("config", "metric", clean(scores, "value").cast("double").alias("v")).filter(
        "v is not null")
    pairs = config_pairs(rows, baseline)
    sided = pairs.select("config_a", "config_b", F.inline(F.array(
        F.struct(F.col("config_a").alias("config"), F.lit("a").alias("side")),
        F.struct(F.col("config_b").alias("config"), F.lit("b").alias("side")))))
    by = ["config_a", "config_b", "metric"]
    moments = rows.groupBy("config", "metric").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))
    placed = sided.join(moments, "config")

    def only(s: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{s}")
    wide = placed.groupBy(*by).agg(
        *[only(s, c) for s in ("a", "b") for c in ("n", "mean", "var")]).filter(
        (F.col("n_a") >= 2) & (F.col("n_b") >= 2))
    spread = sided.join(rows, "config").select(*by, F.col("side").alias("grp"), "v")
    ranks = _group_ranks(spread, by, **split).groupBy(*by).agg(
        F.max(F.when(F.col("grp") == "a", F.col("rank_sum"))).alias("rank_a"),
        F.max("ties").alias("ties"))
    out = with_u_test(wide.join(ranks, by)).select(
        *by, F.round(F.round("mean_a", 4) - F.round("mean_b", 4), 4).alias("mean_diff"),
        F.round(B.hedges_g(), 4).alias("effect_size"), F.col("u").alias("mann_whitney_u"),
        F.round("p", 6).alias("mann_whitney_p"))
    if permutations:
        perm = B.permutation_test(spread, by, "grp", "v", permutations, **split)
        out = out.join(perm.withColumnRenamed("p", "permutation_p"), by)
    return out


def holm(comparisons: DataFrame, p: str = "mann_whitney_p", alpha: float = 0.05,
         family: Sequence[str] = (), tie: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Holm's corrected significance.

    Each comparison is held against alpha / (number - rank); equal p-values go by ``tie``, then by
    a hash of the row, so that any number of them is spread. ``strict`` also stops at the first
    failure, as the textbook procedure does.
    """
    by = _cols(family)
    known = comparisons.filter(present(comparisons, p))
    rest = F.xxhash64(*[quoted(c) for c in comparisons.columns])
    ranked = numbered_rows(known, family, [quoted(p), *_cols(tie), rest], "rank", "total").withColumn(
        "adjusted_alpha", alpha / (F.col("total") - F.col("rank") + 1))
    out = ranked.withColumn("significant", quoted(p) < F.col("adjusted_alpha"))
    if strict:
        fails = out.filter(~F.col("significant")).groupBy(*by).agg(F.min("rank").alias("__stop"))
        out = out.join(fails, list(family), "left") if family else out.join(
            F.broadcast(fails), F.lit(True), "left")
        out = out.withColumn("significant", F.col("significant") & (
            F.col("__stop").isNull() | (F.col("rank") < F.col("__stop")))).drop("__stop")
    return out.drop("total")


def two_level_mean(df: DataFrame, config: str, run: str, by: Sequence[str], value: str) -> DataFrame:
    """Mean per run first, then mean, spread and number of runs per configuration."""
    runs = df.groupBy(quoted(config), quoted(run), *_cols(by)).agg(
        F.avg(clean(df, value)).alias("__m")).filter("__m is not null")
    return runs.groupBy(quoted(config), *_cols(by)).agg(
        F.avg("__m").alias("mean"), F.stddev_samp("__m").alias("std"), F.count("__m").alias("runs"))


def gate_scores(gates: DataFrame, stages: Sequence[str] = ("cleaning", "analysis")) -> DataFrame:
    """Gate score per configuration and stage from first attempts (config, run_id, stage, ...)."""
    first = gates.filter((F.coalesce("attempt_label", F.lit("")) == "")
                         & F.col("stage").isin(*stages))
    return two_level_mean(first, "config", "run_id", ["stage"], "quality_score")


def structural_scores(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Structural metrics per configuration, runs averaged over datasets first."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), clean(df, m).cast("double").alias("value"))
                     for m in metrics])
    return two_level_mean(df.select("config", "run_id", F.inline(rows)), "config", "run_id",
                          ["metric"], "value")


def scores_by(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean score and count per configuration and dataset, judge or both."""
    return df.groupBy(*_cols(by)).agg(F.round(F.avg(clean(df, value)), 3).alias("mean"),
                                      F.count(clean(df, value)).alias("n"))


def cross_dataset_correlation(scores: DataFrame) -> DataFrame:
    """Pearson r and p over shared datasets for each pair of configurations.

    Input is (config, dataset, value). Fewer than three shared datasets give none.
    """
    rows = scores.filter(F.col("dataset").isNotNull() & (F.col("dataset") != GLOBAL_DATASET))
    means = rows.groupBy("config", "dataset").agg(F.avg(clean(scores, "value")).alias("m")).filter(
        "m is not null")
    a = means.select(F.col("config").alias("config_a"), "dataset", F.col("m").alias("ma"))
    b = means.select(F.col("config").alias("config_b"), "dataset", F.col("m").alias("mb"))
    # One mean per configuration and dataset: rows here are pairs of labels, as asked.
    out = a.join(b, "dataset").filter("config_a < config_b").groupBy("config_a", "config_b").agg(
        F.corr("ma", "mb").alias("r"), F.count(F.lit(1)).alias("n_datasets"))
    r = F.when((F.col("n_datasets") >= 3) & ~F.isnan("r"), F.col("r"))
    out = out.withColumn("r", r)
    n = F.col("n_datasets").cast("double")
    out = out.withColumn("__t", F.when(F.abs("r") < 1, F.col("r") * F.sqrt(
        (n - 2) / (1 - F.col("r") * F.col("r")))))
    return out.select("config_a", "config_b", F.round("r", 4).alias("pearson_r"), F.round(
        t_two_sided("__t", n - 2), 4).alias("p_value"), "n_datasets")


def metric_agreement(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and line of a computed metric against a judged score."""
    a, b = clean(df, x).cast("double"), clean(df, y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    xv, yv = F.when(both, a), F.when(both, b)
    return df.agg(F.count_if(both).alias("n"), F.corr(xv, yv).alias("r"),
                  F.regr_slope(yv, xv).alias("slope"), F.regr_intercept(yv, xv).alias("intercept"))


def compare_runs(files: DataFrame) -> DataFrame:
    """Per run: files, complete files and averages of plots, verified claims and gaps."""
    return files.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("complete").alias("complete"),
        *[F.round(F.avg(c), 1).alias(f"avg_{c}") for c in ("plots", "claims", "gaps")]).withColumn(
        "stages_complete", F.concat_ws("/", F.col("complete").cast("string"),
                                       F.col("files").cast("string")))


def ablation_tables(scores: DataFrame, replicates: int = 10_000, permutations: int | None = None, *,
                    gates: DataFrame | None = None, structure: DataFrame | None = None,
                    structural_metrics: Sequence[str] = (), strengths: DataFrame | None = None,
                    labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of an ablation study from (config, run_id, dataset, judge, metric, value).

    Gate records, structural rows, and strengths with run labels add their tables if given.
    """
    from assay.operators.agreement import krippendorff_alpha, spearman_agreement
    from assay.operators.rankings import config_rankings

    unit = ["config", "run_id", "dataset"]
    judged = scores.groupBy(*_cols([*unit, "judge", "metric"])).agg(F.avg("value").alias("value"))
    more = {
        "judge_alpha": krippendorff_alpha(judged, ["metric"], unit, "value"),
        "judge_rank_agreement": spearman_agreement(judged, ["metric"], unit, "judge", "value"),
    }
    if gates is not None:
        more["gates"] = gate_scores(gates)
    if structure is not None:
        more["structural"] = structural_scores(structure, structural_metrics)
    if strengths is not None and labels is not None:
        more["rankings"] = config_rankings(strengths, labels)
    runs = scores.groupBy("config", "run_id", "metric").agg(F.avg("value").alias("value"))
    compared = compare_configs(runs, permutations=permutations)
    return {
        "overview": replication_stats(runs, replicates=replicates),
        "comparisons": holm(compared, tie=["config_a", "config_b", "metric"]),
        "per_dataset": scores_by(scores, ["config", "dataset", "metric"], "value"),
        "per_judge": scores_by(scores, ["config", "judge", "metric"], "value"),
        "correlation": cross_dataset_correlation(scores),
        "repeatability": stability(runs),
    } | more
