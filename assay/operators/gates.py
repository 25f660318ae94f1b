"""Scores, gate decisions and trajectories of attempts from their check results.

``checks`` holds one row per check: the attempt columns, name, category, severity,
ref, detail and passed. Categories: structural, content_quality, plot_quality.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import quoted

# Fixed values of the gate.
EXPECTED_CRITERIA = {"cleaning": 4, "analysis": 7, "cross_validation": 3}
EXPECTED_EVALUATORS = ("content", "analytical_depth", "plot_quality")
SKIP_PENALTY = 0.05
MAX_SHORTLIST = 10
CATEGORY_ORDER = {"structural": 0, "content_quality": 1, "plot_quality": 2}
# Fixed rules: a check is dropped from the shortlist when another one is present.
SUBSUMED_BY = {
    "depth__bare_deviations": ("domain_interpretation",),
    "depth__missing_group_comparison": ("per_group_depth", "statistical_rigor"),
    "exec__finding_data_mismatch": ("domain_interpretation",),
}


def _cols(names: Sequence[str]) -> list[Column]:
    return [quoted(n) for n in names]


def check_score() -> Column:
    """1 for passed, a half for should_fix, 0 for must_fix."""
    return F.when(F.col("passed"), 1.0).when(F.lower("severity") == "should_fix", 0.5).otherwise(0.0)


def quality_scores(checks: DataFrame, attempt: Sequence[str], evaluators: DataFrame | None = None
                   ) -> DataFrame:
    """Overall, structural, content and visual score of each attempt.

    A plot weighs 2 whatever the number of its criteria, so checks are first summed
    per plot. ``evaluators`` (attempt, evaluators_ran map) lowers the overall score
    for each expected evaluator that did not run.
    """
    keys = _cols(attempt)
    plot = F.col("category") == "plot_quality"
    slot = F.when(plot, F.coalesce("ref", F.lit("")))
    s = check_score()
    cosmetic = F.coalesce(F.col("detail").startswith("[cosmetic]"), F.lit(False))
    seen = F.when(plot & ~cosmetic, s)
    parts = checks.groupBy(*keys, "category", slot.alias("slot")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.count(seen).alias("vn"),
        F.coalesce(F.sum(seen), F.lit(0.0)).alias("vs"))
    weight = F.when(F.col("category") == "plot_quality", F.lit(2.0) / F.col("n")).when(
        F.col("category") == "content_quality", 2.0).otherwise(1.0)

    def mean(category: str, num: str = "s", den: str = "n") -> Column:
        mine = F.col("category") == category
        return F.coalesce(F.round(F.try_divide(F.sum(F.when(mine, F.col(num))), F.sum(
            F.when(mine, F.col(den))).cast("double")), 4), F.lit(1.0)).alias(category)
    out = parts.groupBy(*keys).agg(
        F.round(F.sum(weight * F.col("s")) / F.sum(weight * F.col("n")), 4).alias("overall"),
        mean("structural"), mean("content_quality"), mean("plot_quality", "vs", "vn"),
        F.sum("n").alias("checks")).withColumnsRenamed(
        {"content_quality": "content", "plot_quality": "visual"})
    if evaluators is not None:
        skipped = F.size(F.filter(F.array(*[F.lit(e) for e in EXPECTED_EVALUATORS]),
                                  lambda e: F.try_element_at("evaluators_ran", e) == F.lit(False)))
        late = evaluators.select(*keys, skipped.alias("__skipped"))
        out = out.join(late, list(attempt), "left").withColumn("overall", F.greatest(
            F.lit(0.0), F.col("overall") - SKIP_PENALTY * F.coalesce("__skipped", F.lit(0)))).drop(
            "__skipped")
    return out


def coverage_ratio(checks: DataFrame, attempt: Sequence[str], stage: str = "stage") -> DataFrame:
    """Share of the expected content criteria of a stage that were returned."""
    wanted = F.create_map(*[x for k, v in EXPECTED_CRITERIA.items() for x in (F.lit(k), F.lit(v))])
    return checks.groupBy(*_cols(attempt)).agg(
        F.count_if(F.col("category") == "content_quality").alias("returned")).withColumn(
        "coverage", F.coalesce(F.round(F.least(F.lit(1.0), F.col("returned") / wanted[quoted(stage)]),
                                       4), F.lit(1.0)))


def issue_sets(checks: DataFrame, attempt: Sequence[str]) -> DataFrame:
    """Counts and the distinct must-fix names of each attempt.

    Names are check names, a fixed vocabulary, so the set stays short.
    """
    failed = ~F.col("passed")
    must = failed & (F.lower("severity") == "must_fix")
    should = failed & (F.lower("severity") == "should_fix")
    plot = F.col("category") == "plot_quality"
    return checks.groupBy(*_cols(attempt)).agg(
        F.count_if(must).alias("must_fix"), F.count_if(should).alias("should_fix"),
        F.count_if(should & ~plot).alias("should_fix_other"),
        F.array_sort(F.collect_set(F.when(must, F.col("name")))).alias("issues"))


def _in_order(unit: Sequence[str], attempt: str):
    return Window.partitionBy(*_cols(unit)).orderBy(quoted(attempt))


def stalls(sets: DataFrame, unit: Sequence[str], attempt: str = "attempt") -> DataFrame:
    """Length of the run of attempts repeating the same non-empty must-fix set.

    Attempts of one unit are few: a retry loop, not a data group.
    """
    w = _in_order(unit, attempt)
    same = (F.size("issues") > 0) & (F.col("issues") == F.lag("issues").over(w))
    marked = sets.withColumn("__same", F.coalesce(same, F.lit(False)))
    island = F.sum(F.when(F.col("__same"), 0).otherwise(1)).over(w)
    marked = marked.withColumn("__island", island)
    inside = Window.partitionBy(*_cols(unit), "__island").orderBy(quoted(attempt))
    return marked.withColumn("stall_count", (F.row_number().over(inside) - 1)).drop(
        "__same", "__island")


def oscillations(sets: DataFrame, unit: Sequence[str], attempt: str = "attempt") -> DataFrame:
    """Must-fix names of two attempts ago that were gone and are back."""
    w = _in_order(unit, attempt)
    two, one = F.lag("issues", 2).over(w), F.lag("issues", 1).over(w)
    back = F.array_except(F.array_intersect(two, F.col("issues")), one)
    return sets.withColumn("reappeared", F.coalesce(back, F.array().cast("array<string>"))).withColumn(
        "oscillating", F.size("reappeared") > 0)


def regressions(checks: DataFrame, unit: Sequence[str], attempt: str = "attempt") -> DataFrame:
    """Checks that turned from passed to failed and back between consecutive attempts.

    A name counts as passed (failed) when any check of that name passed (failed).
    """
    state = checks.groupBy(*_cols(unit), quoted(attempt), "name").agg(
        F.bool_or("passed").alias("p"), F.bool_or(~F.col("passed")).alias("f"))
    order = checks.select(*_cols(unit), quoted(attempt)).distinct().withColumn(
        "__before", F.lag(quoted(attempt)).over(_in_order(unit, attempt)))
    now = state.join(order.filter("__before is not null"), [*unit, attempt])
    old = state.select(*_cols(unit), quoted(attempt).alias("__before"), "name",
                       F.col("p").alias("p0"), F.col("f").alias("f0"))
    both = now.join(old, [*unit, "__before", "name"])
    return both.groupBy(*_cols(unit), quoted(attempt)).agg(
        F.count_if(F.col("p0") & F.col("f")).alias("regressed"),
        F.count_if(F.col("f0") & F.col("p")).alias("improved")).withColumn(
        "net_regression", (F.col("regressed") > 0) & (F.col("regressed") > F.col("improved")))


def gate(attempts: DataFrame, max_retries: int, *, accumulate: int = 4, max_stall: int = 2) -> DataFrame:
    """Status of each attempt: passed, passed_degraded or failed.

    Needs must_fix, should_fix, should_fix_other, stall_count, attempt and, when
    known, content_ran (boolean).
    """
    ran = F.coalesce("content_ran", F.lit(True)) if "content_ran" in attempts.columns else F.lit(True)
    clean_ = (F.col("must_fix") == 0) & (F.col("should_fix") == 0)
    piled = (F.col("must_fix") == 0) & (F.col("should_fix_other") >= accumulate) & (
        F.col("attempt") < max_retries)
    status = (
        F.when(clean_ & ~ran, "passed_degraded").when(clean_, "passed")
        .when(piled, "failed").when(F.col("must_fix") == 0, "passed")
        .when(F.col("attempt") >= max_retries, "passed_degraded")
        .when(F.col("stall_count") >= max_stall, "passed_degraded").otherwise("failed"))
    reason = (
        F.when(clean_ & ~ran, "content not evaluated").when(clean_, "all passed")
        .when(piled, "too many should_fix").when(F.col("must_fix") == 0, "advisory only")
        .when(F.col("attempt") >= max_retries, "retries used up")
        .when(F.col("stall_count") >= max_stall, "stalled").otherwise("must_fix open"))
    return attempts.withColumn("status", status).withColumn("reason", reason)


def convergence(attempts: DataFrame, unit: Sequence[str], *, target: float = 0.85,
                threshold: float = 0.02, attempt: str = "attempt") -> DataFrame:
    """Early acceptance of failed attempts: target reached, or no further gain.

    Gains stop mattering only after two attempts and once no must-fix issue of the
    first attempt is left.
    """
    w = _in_order(unit, attempt)
    first = F.first("issues").over(w.rowsBetween(Window.unboundedPreceding, 0))
    gain = F.col("overall") - F.lag("overall").over(w)
    out = attempts.withColumn("gain", gain).withColumn("__first", first).withColumn(
        "__n", F.row_number().over(w))
    left = F.size(F.array_intersect("__first", "issues")) > 0
    hit = (F.size("issues") == 0) & (F.col("overall") >= target)
    flat = (F.col("__n") >= 2) & (F.col("gain") < threshold) & ~left
    return out.withColumn("decision", F.when(F.col("status") != "failed", "keep").when(
        hit, "passed").when(flat, "passed_degraded").otherwise("retry")).drop("__first", "__n")


def shortlist(checks: DataFrame, attempt: Sequence[str], k: int = MAX_SHORTLIST) -> DataFrame:
    """Most urgent failures of an attempt: by category, then severity, covered ones left out."""
    failed = checks.filter(~F.col("passed"))
    rules = F.create_map(*[x for n, o in SUBSUMED_BY.items()
                           for x in (F.lit(n), F.array(*[F.lit(v) for v in o]))])
    dull = failed.select(*_cols(attempt), "name", F.explode(rules[F.col("name")]).alias("other"))
    present = failed.select(*_cols(attempt), F.col("name").alias("other")).distinct()
    covered = dull.join(present, [*attempt, "other"], "left_semi").select(
        *_cols(attempt), "name").distinct()
    rank = F.create_map(*[x for c, r in CATEGORY_ORDER.items() for x in (F.lit(c), F.lit(r))])
    hard = F.when(F.lower("severity") == "must_fix", 0).otherwise(1)
    w = Window.partitionBy(*_cols(attempt)).orderBy(
        F.coalesce(rank[F.col("category")], F.lit(99)), hard, "name", "ref", "detail")
    return failed.join(covered, [*attempt, "name"], "left_anti").withColumn(
        "position", F.row_number().over(w)).filter(F.col("position") <= k)


def pass_rates(checks: DataFrame, attempt: Sequence[str]) -> DataFrame:
    """Share of passed checks by declared severity, in any letter case."""
    def rate(level: str) -> Column:
        mine = F.lower("severity") == level
        return F.avg(F.when(mine, F.col("passed").cast("double"))).alias(f"{level}_pass_rate")
    return checks.groupBy(*_cols(attempt)).agg(
        rate("must_fix"), rate("should_fix"), F.count(F.lit(1)).alias("total_checks"))


def retry_counts(attempts: DataFrame, unit: Sequence[str], label: str = "attempt_label") -> DataFrame:
    """Number of retries of each unit."""
    return attempts.groupBy(*_cols(unit)).agg(
        F.count_if(quoted(label).startswith("retry")).alias("num_retries"))


def first_attempts(attempts: DataFrame, label: str = "attempt_label") -> DataFrame:
    return attempts.filter(F.coalesce(quoted(label), F.lit("")) == "")


def with_verdict(gates: DataFrame, verdicts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Gate records with their verdict, kept when there is none."""
    return gates.join(verdicts, list(key), "left")
