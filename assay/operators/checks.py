"""Quality checks over the metrics, findings and files of many runs at once.

Every check takes ``by`` (the columns naming a run) and gives one row per run:
(by, name, passed, severity, detail). Detail texts quote at most five examples;
the counts in them cover everything.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import exact_quantiles
from assay.functions.text import containment, mentions, stem
from assay.plans.groupings import PURPOSE_WEIGHTS

# Fixed word lists.
ML_METRIC_TOKENS = ("F1",)
CHART_TYPES = (
    "overlay", "line", "trend", "timeseries", "boxplot", "box", "violin", "heatmap", "heat",
    "scatter", "correlation", "bar", "histogram", "dist", "pca", "cluster", "residual", "qq",
)
INTERPRETATION_WORDS = (
    "degradation", "trend", "deviation", "anomaly", "outlier", "correlation", "interaction",
    "root cause", "hypothesis", "suggests", "indicates", "consistent with", "driven by",
    "attributed to", "mechanism", "process", "impact", "significance", "implication",
    "recommendation",
)
EXPLAINING_PHRASES = (
    " because ", " due to ", " which ", " this ", " may ", " could ", " likely ", " potential",
    " check ", " verify ", " investigate",
)
TWO_GROUP_WORDS = (
    "t-test", "t_test", "ttest", "mann-whitney", "wilcoxon", "cohen", "effect size", "p-value",
    "p_value", "p value", "pairwise", "between groups", "compared to",
    "statistically significant", "independent t", "welch", "levene", "hypothesis test",
    "significant difference", "two-sample", "non-parametric", "permutation test", "brunner",
    "munzel", "p-val", "significant at", "rank_biserial", "rank-biserial", "eta_squared",
    "eta-squared", "η²",
)
MANY_GROUP_WORDS = (
    "anova", "kruskal", "f-test", "f_oneway", "p-value", "p_value", "p value",
    "group comparison", "between groups", "among groups", "statistically significant",
    "friedman", "welch anova", "dunn", "post-hoc", "posthoc", "tukey", "bonferroni",
    "multiple comparison", "nemenyi", "pairwise comparison", "omnibus", "p-val",
    "significant at", "eta_squared", "eta-squared", "epsilon_squared", "η²",
)
OUTLIER_WORDS = ("outlier", "z-score", "iqr", "interquartile", "extreme", "deviation beyond",
                 "outside range")
INTERACTION_WORDS = (
    "interaction", "cross-group", "between groups", "group x", "two-way", "factorial",
    "moderation", "depends on", "varies across", "differs by",
)
# Fixed patterns.
IDENTIFIER = r"([A-Z][0-9]+(?:__[A-Z][0-9]+)*)"
P_NOTATION = r"p\s*[<>=≤≥]\s*0\.[0-9]"
ACROSS_GROUPS = r"across\s+\S+\s+groups|across\s+groups|between\s+the\s+groups"
P_VALUE = r"p\s*[=<]\s*(0\.[0-9]+)"
# Fixed limits.
MIN_FINDINGS = 3
MIN_FILE_BYTES, MIN_PLOT_BYTES = 100, 5000
MIN_PIXELS, WIDE_ASPECT, EXTREME_ASPECT = 400, 4.0, 20.0
COVERED_SHARE = 0.9
SMALL_N = 200
BASELINE_MARGIN = 0.05
LARGE_GROUP = 10_000
# Fixed overlap rules: a check is downgraded when one of the others already failed hard.
DOWNGRADED_BY = {
    "depth__bare_deviations": ("domain_interpretation",),
    "depth__missing_group_comparison": ("per_group_depth", "statistical_rigor"),
}


def _by(by: Sequence[str]) -> list[Column]:
    return [quoted(b) for b in by]


def _result(df: DataFrame, by: Sequence[str], name: str, passed: Column, severity,
            detail: Column) -> DataFrame:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return df.select(*_by(by), F.lit(name).alias("name"), passed.alias("passed"),
                     F.when(~passed, level).alias("severity"), detail.alias("detail"))


def _examples(bad: DataFrame, by: Sequence[str], text: str, k: int = 5) -> DataFrame:
    """Up to ``k`` examples per run, first by text; only those are ever gathered."""
    w = Window.partitionBy(*_by(by)).orderBy(text)
    return bad.withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= k).groupBy(
        *_by(by)).agg(F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("examples"))


def missing_value(value: Column, dtype: str) -> Column:
    if dtype == "string":
        return value.isNull() | F.lower(value).isin("nan", "null", "none")
    return value.isNull() | F.isnan(value.cast("double"))


def nan_leakage(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Null, NaN or textual stand-ins for them among group metrics."""
    bad = missing_value(F.col("value"), dict(metrics.dtypes)["value"])
    counts = metrics.groupBy(*_by(by)).agg(
        F.count_if(bad).alias("bad"), F.count(F.lit(1)).alias("total"))
    groups = metrics.filter(bad).select(*_by(by), "group_key").distinct()
    out = counts.join(_examples(groups, by, "group_key"), list(by), "left")
    detail = F.format_string("%d of %d metric values are missing (groups: %s)", F.col("bad"),
                             F.col("total"), F.coalesce("examples", F.lit("")))
    return _result(out, by, "exec__nan_leakage", F.col("bad") == 0, "must_fix", detail)


def impossible_values(metrics: DataFrame) -> DataFrame:
    """Metric rows that cannot be: negative counts or spreads, percentages out of range."""
    name, v = F.lower("metric"), F.col("value").try_cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    count = name.contains("count") | name.contains("n_")
    share = name.contains("pct") | name.contains("percent") | name.contains("ratio")
    spread = name.contains("std") | name.contains("stdev") | name.contains("sd_")
    reasons = F.filter(F.array(
        F.when(count & (v < 0), "negative count"),
        F.when(share & ((v > 200) | (v < -100)), "impossible percentage"),
        F.when(spread & (v < 0), "negative std")), lambda r: r.isNotNull())
    return metrics.filter(finite).select("*", F.explode(reasons).alias("reason"))


def impossible_check(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    bad = impossible_values(metrics).select(*_by(by), F.concat_ws(
        ".", "group_key", "metric").alias("where"))
    runs = metrics.select(*_by(by)).distinct()
    counts = bad.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("bad"))
    out = runs.join(counts, list(by), "left").join(_examples(bad, by, "where"), list(by), "left")
    detail = F.format_string("%d impossible values: %s", F.coalesce("bad", F.lit(0)),
                             F.coalesce("examples", F.lit("")))
    return _result(out, by, "exec__impossible_values", F.col("bad").isNull(), "must_fix", detail)


def uniform_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics equal in all of three or more groups; runs with fewer groups are not judged."""
    v = F.col("value").cast("double")
    usable = metrics.filter(v.isNotNull() & ~F.isnan(v)).withColumn("v", F.round(v, 8))
    flat = usable.groupBy(*_by(by), "metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn(
        "flat", (F.col("n") >= 3) & (F.col("lo") == F.col("hi")))
    groups = metrics.groupBy(*_by(by)).agg(F.count_distinct("group_key").alias("groups"))
    counts = flat.groupBy(*_by(by)).agg(F.count_if("flat").alias("bad"))
    out = groups.filter("groups >= 3").join(counts, list(by), "left").join(
        _examples(flat.filter("flat").select(*_by(by), "metric"), by, "metric"), list(by), "left")
    bad = F.coalesce("bad", F.lit(0))
    return _result(out, by, "exec__uniform_groups", bad == 0, "should_fix", F.format_string(
        "%d metrics equal in all groups: %s", bad, F.coalesce("examples", F.lit(""))))


def cited_identifiers(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, idx, ref): identifiers such as R4 or R16__E4 named by each finding."""
    refs = F.array_distinct(F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(1)))
    return findings.select(*_by(by), "idx", F.explode(refs).alias("ref")).filter(
        ~F.col("ref").isin(*ML_METRIC_TOKENS))


def known_identifiers(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every identifier that occurs anywhere inside a group key, so that a substring
    test becomes an equality. Keys are short, so this adds a few rows per key."""
    key = F.col("group_key")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.transform(
        F.sequence(F.lit(1), F.length(key) - i + 1), lambda n: F.substring(key, i, n))))
    found = F.array_distinct(F.filter(spans, lambda s: s.rlike("^" + IDENTIFIER + "$")))
    return keys.select(*_by(by), "group_key").distinct().filter(F.length(key) > 0).select(
        *_by(by), F.explode(found).alias("ref")).distinct()


def finding_mismatch(findings: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Identifiers cited but absent from the group keys; fails above half the findings."""
    missing = cited_identifiers(findings, by).join(
        known_identifiers(metrics, by), [*by, "ref"], "left_anti")
    counts = findings.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("findings"))
    bad = missing.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("bad"))
    out = counts.join(metrics.select(*_by(by)).distinct(), list(by), "left_semi").join(
        bad, list(by), "left")
    n = F.coalesce("bad", F.lit(0))
    return _result(out, by, "exec__finding_data_mismatch", ~(n > F.floor(F.col("findings") / 2)),
                   "should_fix", F.format_string("%d cited identifiers not in keys, %d findings",
                                                 n, F.col("findings")))


def figure_coverage(findings: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """At least 90 % of the plots of a run are named in a finding's text or reference."""
    plots = files.filter(F.col("path").endswith(".png")).select(
        *_by(by), stem(F.col("path")).alias("stem")).distinct()
    words = findings.select(*_by(by), F.lower(F.concat_ws(
        " ", "text", "figure_ref")).alias("corpus"))
    named = containment(plots, words, by, "stem", "corpus", keep_text=False).select(*_by(by), "stem").distinct()
    total = plots.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("plots"))
    hits = named.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("named"))
    out = total.join(findings.select(*_by(by)).distinct(), list(by), "left_semi").join(
        hits, list(by), "left")
    lost = F.col("plots") - F.coalesce("named", F.lit(0))
    return _result(out, by, "exec__plot_finding_alignment", ~(lost > F.col("plots") * (1 - COVERED_SHARE)),
                   "must_fix", F.format_string("%d of %d plots not named in a finding", lost,
                                               F.col("plots")))


def duplicate_pvalues(findings: DataFrame, pvalues: DataFrame, metrics: DataFrame,
                      by: Sequence[str]) -> DataFrame:
    """Three or more p-values that are all the same; p = 0 is allowed for large groups."""
    texts = findings.select(*_by(by), F.explode(F.regexp_extract_all(
        "text", F.lit(P_VALUE), F.lit(1))).alias("p")).select(
        *_by(by), F.round(F.col("p").cast("double"), 10).alias("p"))
    given = pvalues.filter(F.col("p").isNotNull() & ~F.isnan("p")).select(
        *_by(by), F.round("p", 10).alias("p"))
    seen = texts.unionByName(given).groupBy(*_by(by)).agg(
        F.count("p").alias("n"), F.min("p").alias("lo"), F.max("p").alias("hi"))
    sizes = metrics.filter((F.col("metric") == "row_count") & (F.col("value").cast("double") > 0))
    # Enough to know whether the upper middle size is above the limit.
    big = sizes.groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(F.col("value").cast("double") > LARGE_GROUP).alias("large"))
    out = seen.filter("n >= 3").join(big, list(by), "left")
    excused = (F.col("hi") == 0) & F.coalesce(
        F.col("large") >= F.col("groups") - F.floor(F.col("groups") / 2), F.lit(False)) & (
        F.coalesce("groups", F.lit(0)) > 0)
    same = F.col("lo") == F.col("hi")
    return _result(out.filter(~(same & excused)), by, "exec__duplicate_pvalues", ~same, "must_fix",
                   F.format_string("%d p-values between %s and %s", F.col("n"),
                                   F.col("lo").cast("string"), F.col("hi").cast("string")))


def accuracy_floor(tasks: DataFrame) -> DataFrame:
    """Classification tasks no better than chance plus five points."""
    base = 1.0 / F.when(F.col("n_classes") >= 2, F.col("n_classes"))
    return tasks.withColumn("baseline", base).withColumn(
        "at_chance", F.coalesce(F.col("accuracy") <= F.col("baseline") + BASELINE_MARGIN, F.lit(False)))


def importance_present(tasks: DataFrame, importance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs with modelling tasks must report feature importance."""
    n = importance.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("features"))
    out = tasks.select(*_by(by)).distinct().join(n, list(by), "left")
    return _result(out, by, "exec__feature_importance", F.col("features").isNotNull(), "must_fix",
                   F.format_string("%d features", F.coalesce("features", F.lit(0))))


def stability_present(tasks: DataFrame, stability: DataFrame, metrics: DataFrame,
                      by: Sequence[str]) -> DataFrame:
    """Small regression runs (under 200 rows) should report feature stability."""
    rows = metrics.filter(F.col("metric") == "row_count").groupBy(*_by(by)).agg(
        F.sum("value").alias("rows"))
    n = stability.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("features"))
    runs = tasks.filter(F.col("task_type").isin("regression", "supervised_regression")).select(
        *_by(by)).distinct().join(rows, list(by), "left")
    small = runs.filter(F.coalesce("rows", F.lit(0.0)) < SMALL_N).join(n, list(by), "left")
    return _result(small, by, "exec__feature_stability", F.col("features").isNotNull(),
                   "should_fix", F.format_string("%d features", F.coalesce("features", F.lit(0))))


def grouping_adequacy(dimensions: DataFrame, grouping: DataFrame, by: Sequence[str]) -> DataFrame:
    """Important purposes of a dataset that its grouping leaves out; three or more is hard.

    ``dimensions`` holds (by, name, purpose), ``grouping`` the grouped columns (by, name).
    """
    vital = [p for p in PURPOSE_WEIGHTS if p != "technical_replicate"]
    known = dimensions.filter(F.col("purpose").isin(*vital))
    covered = known.join(grouping, [*by, "name"], "left_semi").select(*_by(by), "purpose")
    missing = known.select(*_by(by), "purpose").distinct().join(
        covered.distinct(), [*by, "purpose"], "left_anti")
    n = missing.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("missing"), F.array_join(
        F.array_sort(F.collect_set("purpose")), ", ").alias("names"))
    out = known.select(*_by(by)).distinct().join(n, list(by), "left")
    return _result(out, by, "depth__grouping_adequacy", F.col("missing").isNull(),
                   F.when(F.col("missing") >= 3, "must_fix").otherwise("should_fix"),
                   F.concat(F.lit("missing: "), F.coalesce("names", F.lit("none"))))


def grouping_compliance(samples: DataFrame, keys: DataFrame, by: Sequence[str], n_keys: int = 20,
                        n_values: int = 5) -> DataFrame:
    """Whether group keys contain sample values of every recommended column.

    ``samples`` holds (by, column, value, position); the first keys are those first
    in key order, which is what the check looks at by definition.
    """
    w = Window.partitionBy(*_by(by)).orderBy("group_key")
    first = keys.select(*_by(by), "group_key").distinct().withColumn(
        "__i", F.row_number().over(w)).filter(F.col("__i") <= n_keys)
    text = first.groupBy(*_by(by)).agg(F.lower(F.array_join(F.collect_list("group_key"), " ")).alias("t"))
    hit = samples.filter(F.col("position") <= n_values).join(text, list(by)).groupBy(
        *_by(by), "column").agg(F.max(F.contains("t", F.lower("value"))).alias("found"))
    out = hit.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("cols"),
                                    F.count_if(~F.col("found")).alias("lost"))
    return _result(out, by, "depth__grouping_compliance", F.col("lost") == 0,
                   F.when(F.col("lost") == F.col("cols"), "must_fix").otherwise("should_fix"),
                   F.format_string("%d of %d columns absent from keys", F.col("lost"), F.col("cols")))


def context_coverage(contexts: DataFrame, findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Contexts named in the findings, drill-downs aside; all but one expected, two at least."""
    real = contexts.filter(~F.col("name").startswith("hierarchy_")).select(
        *_by(by), "name", F.explode(F.filter(F.array_union(
            F.array(F.lower("compare_across"), F.replace(F.lower("name"), F.lit("_"), F.lit(" "))),
            F.transform("group_by", lambda c: F.lower(c))),
            lambda t: t.isNotNull() & (F.length(t) > 0))).alias("term"))
    corpus = findings.select(*_by(by), F.lower("text").alias("corpus"))
    used = containment(real, corpus, by, "term", "corpus", keep_text=False).select(*_by(by), "name").distinct()
    total = real.groupBy(*_by(by)).agg(F.count_distinct("name").alias("n"))
    hits = used.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("used"))
    out = total.filter("n >= 2").join(hits, list(by), "left")
    n_used = F.coalesce("used", F.lit(0))
    return _result(out, by, "depth__context_coverage",
                   n_used >= F.greatest(F.lit(2), F.col("n") - 1), "should_fix",
                   F.format_string("%d of %d contexts addressed", n_used, F.col("n")))


def _per_run(findings: DataFrame, metrics: DataFrame, by: Sequence[str], **flags: Column) -> DataFrame:
    """Groups per run with boolean facts about its findings, folded before the shuffle."""
    groups = metrics.groupBy(*_by(by)).agg(F.count_distinct("group_key").alias("groups"))
    said = findings.groupBy(*_by(by)).agg(*[F.bool_or(c).alias(n) for n, c in flags.items()])
    out = groups.join(said, list(by), "left")
    for n in flags:
        out = out.withColumn(n, F.coalesce(n, F.lit(False)))
    return out


def comparison_present(findings: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """A test or comparison is reported: words for two groups, others for three or more."""
    low = F.lower("text")
    out = _per_run(findings, metrics, by,
                   two=mentions(F.col("text"), TWO_GROUP_WORDS) | low.rlike(P_NOTATION),
                   many=mentions(F.col("text"), MANY_GROUP_WORDS) | low.rlike(P_NOTATION)
                   | low.rlike(ACROSS_GROUPS)).filter("groups >= 2")
    ok = F.when(F.col("groups") == 2, F.col("two")).otherwise(F.col("many"))
    return _result(out, by, "depth__group_comparison", ok, "must_fix",
                   F.format_string("%d groups", F.col("groups")))


def outlier_mention(findings: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    out = _per_run(findings, metrics, by, said=mentions(F.col("text"), OUTLIER_WORDS))
    return _result(out.filter("groups >= 3"), by, "depth__outlier_analysis", F.col("said"),
                   "should_fix", F.format_string("%d groups", F.col("groups")))


def interaction_mention(findings: DataFrame, metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    out = _per_run(findings, metrics, by, said=mentions(F.col("text"), INTERACTION_WORDS))
    return _result(out.filter("groups >= 4"), by, "depth__interaction_analysis", F.col("said"),
                   "should_fix", F.format_string("%d groups", F.col("groups")))


def bare_findings(findings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Findings that give a percentage and nothing to explain it; a majority is hard."""
    low = F.lower("text")
    explained = mentions(F.col("text"), INTERPRETATION_WORDS + EXPLAINING_PHRASES) | (
        F.size(F.split(F.trim(low), r"\s+")) > 15)
    bare = F.col("text").rlike(r"[0-9]+\.?[0-9]*%") & ~explained
    out = findings.groupBy(*_by(by)).agg(F.count_if(bare).alias("bare"),
                                         F.count(F.lit(1)).alias("n"))
    return _result(out, by, "depth__interpretation", F.col("bare") == 0,
                   F.when(F.col("bare") > F.col("n") * 0.5, "must_fix").otherwise("should_fix"),
                   F.format_string("%d of %d findings bare", F.col("bare"), F.col("n")))


def chart_types(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Plots per run and the chart types their names tell."""
    name = stem(F.col("path"))
    kind = F.coalesce(*[F.when(F.contains(name, F.lit(c)), c) for c in CHART_TYPES])
    return files.filter(F.col("path").endswith(".png")).groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("plots"), F.collect_set(kind).alias("types"))


def chart_diversity(files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Three or more plots must show more than one chart type; five of a kind is hard."""
    out = chart_types(files, by).filter("plots >= 3")
    return _result(out, by, "depth__chart_diversity", F.size("types") > 1,
                   F.when(F.col("plots") >= 5, "must_fix").otherwise("should_fix"),
                   F.format_string("%d plots, types: %s", F.col("plots"),
                                   F.array_join(F.array_sort("types"), ", ")))


def chart_suitability(files: DataFrame, metrics: DataFrame, numeric: DataFrame, by: Sequence[str]
                      ) -> DataFrame:
    """Many groups want a heatmap or box plot, many columns a scatter or component plot."""
    out = chart_types(files, by).join(metrics.groupBy(*_by(by)).agg(
        F.count_distinct("group_key").alias("groups")), list(by), "left").join(
        numeric, list(by), "left")

    def has(*names: str) -> Column:
        return F.arrays_overlap("types", F.array(*[F.lit(n) for n in names]))
    multi = out.filter("groups >= 5")
    wide = out.filter("n_numeric > 10")
    return _result(multi, by, "depth__multigroup_chart", has("heatmap", "box", "violin"),
                   "should_fix", F.format_string("%d groups", F.col("groups"))).unionByName(
        _result(wide, by, "depth__dimensionality_chart",
                has("scatter", "correlation", "pca", "cluster"), "should_fix",
                F.format_string("%d numeric columns", F.col("n_numeric").cast("bigint"))))


def valid_references(findings: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Findings with a figure reference that names no file; names match by stem."""
    have = files.filter(F.lower("path").endswith(".png")).select(
        *_by(by), stem(F.col("path")).alias("stem")).distinct()
    ref = findings.withColumn("stem", stem(F.coalesce("figure_ref", F.lit(""))))
    return ref.join(have, [*by, "stem"], "left_anti").select(
        *_by(by), "idx", "figure_ref",
        F.when(F.coalesce("figure_ref", F.lit("")) == "", "missing").otherwise("unknown").alias("problem"))


def artifact_gate(expected: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """Expected files (by, name) that are absent or under 100 bytes."""
    have = files.select(*_by(by), F.element_at(F.split("path", "/"), -1).alias("name"), "size")
    best = have.groupBy(*_by(by), "name").agg(F.max("size").alias("size"))
    out = expected.join(best, [*by, "name"], "left")
    ok = F.coalesce(F.col("size") >= MIN_FILE_BYTES, F.lit(False))
    return out.select(*_by(by), F.col("name").alias("ref"), ok.alias("passed"), F.when(
        ~ok, "must_fix").alias("severity"), F.when(F.col("size").isNull(), "missing").when(
        ~ok, "too small").otherwise("present").alias("detail"))


def plot_gate(files: DataFrame, by: Sequence[str], min_plots: int = 1) -> DataFrame:
    """Plots per run: enough of them and none under 5000 bytes."""
    out = files.filter(F.lower("path").endswith(".png")).groupBy(*_by(by)).agg(
        F.count(F.lit(1)).alias("plots"), F.count_if(F.col("size") < MIN_PLOT_BYTES).alias("small"))
    runs = files.select(*_by(by)).distinct().join(out, list(by), "left")
    n, small = F.coalesce("plots", F.lit(0)), F.coalesce("small", F.lit(0))
    return _result(runs, by, "struct__plots", (n >= min_plots) & (small == 0), "must_fix",
                   F.format_string("%d plots, %d too small", n, small))


def content_gate(runs: DataFrame, findings: DataFrame, metrics: DataFrame, by: Sequence[str],
                 min_findings: int = MIN_FINDINGS) -> DataFrame:
    """Per run: enough findings, values per group, and a positive row count in every group.

    ``runs`` names the runs that should have content; ``metrics`` is (by, group_key, metric, value).
    """
    said = findings.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("found"))
    sized = F.when((F.col("metric") == "row_count") & (clean(metrics, "value").cast("double") > 0), F.col("group_key"))
    groups = metrics.groupBy(*_by(by)).agg(
        F.count_distinct("group_key").alias("groups"), F.count_distinct(sized).alias("sized"))
    out = runs.select(*_by(by)).distinct().join(said, list(by), "left").join(groups, list(by), "left")
    n, k, m = (F.coalesce(c, F.lit(0)) for c in ("found", "groups", "sized"))
    return _result(out, by, "struct__min_findings", n >= min_findings, "must_fix", F.format_string("%d findings", n)).unionByName(
        _result(out, by, "struct__group_values", k > 0, "must_fix", F.format_string("%d groups", k))).unionByName(
        _result(out.filter(k > 0), by, "struct__row_counts", m == k, "should_fix",
                F.format_string("%d of %d groups have a row count", m, k)))


def reasoning_gate(runs: DataFrame, entries: DataFrame, by: Sequence[str]) -> DataFrame:
    """Whether the reasoning section is there, has entries, and names changes and surprises.

    ``entries`` is (by, kind) with one row per hypothesis, modification or observation, and a
    row of another kind for a section without any.
    """
    kinds = entries.groupBy(*_by(by)).agg(*[
        F.count_if(F.col("kind") == k).alias(k) for k in ("hypothesis", "modification", "observation")])
    out = runs.select(*_by(by)).distinct().join(kinds, list(by), "left")
    total = F.col("hypothesis") + F.col("modification") + F.col("observation")
    passed = F.coalesce((F.col("modification") > 0) & (F.col("observation") > 0), F.lit(False))
    return _result(out, by, "struct__reasoning", passed, F.when(total.isNull(), "must_fix").otherwise("should_fix"),
                   F.when(total.isNull(), "no section").when(total == 0, "empty section").otherwise(F.format_string(
                       "%d hypotheses, %d modifications, %d observations", F.col("hypothesis"), F.col("modification"),
                       F.col("observation"))))


def image_audit(images: DataFrame, by: Sequence[str]) -> DataFrame:
    """Header checks of image files from (by, path, length, content).

    Only the first 1024 bytes of each file are kept, then sizes and sameness are
    judged within the run.
    """
    head = images.filter(F.lower("path").endswith(".png")).select(
        *_by(by), F.element_at(F.split("path", "/"), -1).alias("ref"), "length",
        F.hex(F.expr("substring(content, 1, 24)")).alias("h"),
        F.md5(F.expr("substring(content, 1, 1024)")).alias("digest"))
    magic = F.substring("h", 1, 16) == "89504E470D0A1A0A"
    header = magic & (F.substring("h", 25, 8) == "49484452")

    def number(start: int) -> Column:
        return F.when(header, F.conv(F.substring("h", start, 8), 16, 10).cast("bigint"))
    sized = head.withColumn("magic", magic).withColumn("width", number(33)).withColumn(
        "height", number(41)).drop("h")
    middle = exact_quantiles(sized, by, "length", {"middle": 0.5}).join(
        sized.groupBy(*_by(by)).agg(F.count(F.lit(1)).alias("images")), list(by))
    same = sized.filter("magic").groupBy(*_by(by), "digest").agg(F.count(F.lit(1)).alias("copies"))
    out = sized.join(middle, list(by)).join(same, [*by, "digest"], "left")
    aspect = F.try_divide(F.greatest("width", "height").cast("double"), F.least("width", "height"))
    problems = F.array(
        F.when(~F.col("magic"), F.struct(F.lit("corrupt_png").alias("name"), F.lit("must_fix").alias("severity"))),
        F.when((F.col("width") < MIN_PIXELS) | (F.col("height") < MIN_PIXELS),
               F.struct(F.lit("low_resolution").alias("name"), F.lit("should_fix").alias("severity"))),
        F.when(aspect > WIDE_ASPECT, F.struct(
            F.lit("extreme_aspect").alias("name"),
            F.when(aspect > EXTREME_ASPECT, "must_fix").otherwise("should_fix").alias("severity"))),
        F.when((F.col("images") >= 3) & (F.col("length") < F.col("middle") / 10)
               & (F.col("length") < MIN_PLOT_BYTES),
               F.struct(F.lit("size_outlier").alias("name"), F.lit("must_fix").alias("severity"))),
        F.when(F.col("copies") > 1,
               F.struct(F.lit("duplicate_plot").alias("name"), F.lit("should_fix").alias("severity"))))
    return out.select(*_by(by), "ref", "width", "height", F.explode(F.filter(
        problems, lambda p: p.isNotNull())).alias("p")).select(
        *_by(by), "ref", "width", "height", "p.name", "p.severity")


def threshold_flags(metrics: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Flag metric values outside their domain limits (metric, low, high)."""
    out = metrics.join(thresholds, "metric")
    return out.withColumn("flagged", F.coalesce(F.col("value") < F.col("low"), F.lit(False))
                          | F.coalesce(F.col("value") > F.col("high"), F.lit(False)))


def downgrade_overlaps(checks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Soften a hard failure that another hard failure of the same attempt already covers."""
    names = {o for others in DOWNGRADED_BY.values() for o in others}
    hard = checks.filter(~F.col("passed") & (F.col("severity") == "must_fix")
                         & F.col("name").isin(*names)).groupBy(*_by(by)).agg(
        F.collect_set("name").alias("__hard"))  # at most three names
    out = checks.join(hard, list(by), "left")
    covered = F.lit(False)
    for name, others in DOWNGRADED_BY.items():
        covered = covered | ((F.col("name") == name) & F.coalesce(F.arrays_overlap(
            "__hard", F.array(*[F.lit(o) for o in others])), F.lit(False)))
    return out.withColumn("severity", F.when(
        covered & (F.col("severity") == "must_fix"), "should_fix").otherwise(
        F.col("severity"))).drop("__hard")
