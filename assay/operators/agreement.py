"""Agreement between raters and calibration of a reviewer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import average_ranks
from assay.session import cut_lineage

# Fixed order of the ratings and limit of the bias rule.
RATING_VALUES = {"poor": 0, "acceptable": 1, "good": 2}
BIAS_SHARE = 0.3
ROWS_PER_TASK = 1 << 19


def krippendorff_alpha(ratings: DataFrame, by: Sequence[str], unit: Sequence[str], value: str,
                       level: str = "interval", **split) -> DataFrame:
    """Krippendorff's alpha per ``by``; one rating per row, missing ratings simply absent.

    The coincidence matrix is never built: within-unit and overall sums give the
    observed and expected disagreement. Ordinal distance is interval distance
    between the average ranks of the pairable values.
    """
    keys = [quoted(b) for b in by]
    u = [quoted(x) for x in unit]
    rows = ratings.select(*keys, *u, clean(ratings, value).cast("double").alias("v")).filter(
        "v is not null")
    everything = rows.groupBy(*keys).agg(
        F.count("v").alias("all_n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    if level == "ordinal":
        sizes = rows.groupBy(*keys, *u).agg(F.count("v").alias("__m"))
        pairable = rows.join(sizes.filter("__m >= 2"), [*by, *unit])
        rows = average_ranks(pairable, by, "v", "__rank", **split).select(
            *keys, *u, F.col("__rank").alias("v"))
    if level == "nominal":
        cells = rows.groupBy(*keys, *u, "v").agg(F.count(F.lit(1)).alias("c"))
        units = cells.groupBy(*keys, *u).agg(
            F.sum("c").alias("m"), F.sum(F.col("c").cast("double") * F.col("c")).alias("same"))
        units = units.filter("m >= 2")
        m = F.col("m").cast("double")
        seen = units.groupBy(*keys).agg(
            F.sum("m").alias("n"), F.sum((m * m - F.col("same")) / (m - 1)).alias("within"))
        kept = cells.join(units.select(*keys, *u), [*by, *unit])
        marginal = kept.groupBy(*keys, "v").agg(F.sum("c").alias("c")).groupBy(*keys).agg(
            F.sum(F.col("c").cast("double") * F.col("c")).alias("same"))
        seen = _join(seen, marginal, by)
        n = F.col("n").cast("double")
        expected = (n * n - F.col("same")) / (n * (n - 1))
    else:
        units = rows.groupBy(*keys, *u).agg(
            F.count("v").alias("m"), F.sum("v").alias("s"),
            F.sum(F.col("v") * F.col("v")).alias("q")).filter("m >= 2")
        m = F.col("m").cast("double")
        seen = units.groupBy(*keys).agg(
            F.sum("m").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
            F.sum(2.0 * (m * F.col("q") - F.col("s") * F.col("s")) / (m - 1)).alias("within"))
        n = F.col("n").cast("double")
        expected = 2.0 * (n * F.col("q") - F.col("s") * F.col("s")) / (n * (n - 1))
    out = _join(everything, seen.withColumn("expected", expected).withColumn(
        "observed", F.col("within") / n).select(*keys, "n", "observed", "expected"), by)
    alpha = (
        F.when(F.col("all_n") < 2, F.lit(None).cast("double"))
        .when(F.col("lo") == F.col("hi"), 1.0).when(F.col("n").isNull(), F.lit(None).cast("double"))
        .when(F.col("expected") == 0, F.when(F.col("observed") == 0, 1.0).otherwise(0.0))
        .otherwise(F.round(1.0 - F.try_divide("observed", "expected"), 4)))
    return out.select(*keys, F.col("all_n").alias("ratings"), alpha.alias("alpha"))


def _join(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    # Without keys both sides are one-row aggregates.
    return left.join(right, list(by), "left") if by else left.join(
        F.broadcast(right), F.lit(True), "left")


def judge_pairs(ratings: DataFrame, by: Sequence[str], unit: Sequence[str], judge: str,
                value: str) -> DataFrame:
    """Scores of the same unit by two judges, each pair of judges once.

    A judge rates a unit once (repeats are averaged first), so a unit yields no
    more rows than there are pairs of judges. Units are dealt to more tasks as ratings
    grow, so that a task holds some ``ROWS_PER_TASK`` of them whatever their number.
    """
    keys = [*by, *unit]
    ratings = cut_lineage(ratings.select(*[quoted(k) for k in keys], quoted(judge), quoted(value)))
    tasks = -(-ratings.count() // ROWS_PER_TASK)
    if tasks > int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        ratings = ratings.repartition(tasks, *[quoted(k) for k in keys])
    one = ratings.groupBy(*[quoted(k) for k in keys], quoted(judge)).agg(
        F.avg(clean(ratings, value)).alias("v"))
    a = one.select(*[quoted(k) for k in keys], quoted(judge).alias("judge_a"),
                   F.col("v").alias("score_a"))
    b = one.select(*[quoted(k) for k in keys], quoted(judge).alias("judge_b"),
                   F.col("v").alias("score_b"))
    return a.join(b, keys).filter("judge_a < judge_b")


def spearman_agreement(ratings: DataFrame, by: Sequence[str], unit: Sequence[str], judge: str,
                       value: str, **split) -> DataFrame:
    """Mean Spearman correlation over pairs of judges with three or more shared units.

    Pairs are counted by their two scores before they are ranked, so that a task holds different
    scores and not units. The correlation is that of the ranks, each as often as its pairs.
    """
    within = [*by, "judge_a", "judge_b"]
    pairs = cut_lineage(judge_pairs(ratings, by, unit, judge, value).groupBy(
        *[quoted(w) for w in within], "score_a", "score_b").agg(F.count(F.lit(1)).alias("__n")))
    ranked = average_ranks(pairs, within, "score_a", "__ra", weight="__n", **split)
    ranked = average_ranks(ranked, within, "score_b", "__rb", weight="__n", **split)
    both = F.col("__ra").isNotNull() & F.col("__rb").isNotNull()

    def total(of: Column) -> Column:
        return F.sum(F.when(both, of * F.col("__n")))
    # Ranks are taken from their middle, about which they lie evenly: no digits are lost in the squares.
    middle = ranked.groupBy(*[quoted(w) for w in within]).agg(
        F.sum("__n").alias("shared"), F.try_divide(total(F.col("__ra")), total(F.lit(1.0))).alias("__ma"),
        F.try_divide(total(F.col("__rb")), total(F.lit(1.0))).alias("__mb"))
    a, b = F.col("__ra") - F.col("__ma"), F.col("__rb") - F.col("__mb")
    rho = ranked.join(middle, within).groupBy(*[quoted(w) for w in within]).agg(
        F.max("shared").alias("shared"), F.try_divide(total(a * b), F.sqrt(total(a * a)) * F.sqrt(total(b * b))).alias("rho")
    ).filter((F.col("shared") >= 3) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    return rho.groupBy(*[quoted(b) for b in by]).agg(
        F.round(F.avg(F.round("rho", 4)), 4).alias("spearman"),
        F.count(F.lit(1)).alias("judge_pairs"))


def _level(c: Column) -> Column:
    return F.create_map(*[x for k, v in RATING_VALUES.items() for x in (F.lit(k), F.lit(v))])[
        F.lower(c)]


def confusion(pairs: DataFrame, by: Sequence[str], human: str, model: str) -> DataFrame:
    """Counts of each (human, model) rating combination."""
    return pairs.groupBy(*[quoted(b) for b in by], F.lower(quoted(human)).alias("human"),
                         F.lower(quoted(model)).alias("model")).agg(F.count(F.lit(1)).alias("n"))


def calibration(pairs: DataFrame, by: Sequence[str], human: str, model: str) -> DataFrame:
    """Accuracy, shares of lenient and strict ratings, and the bias they show."""
    cells = confusion(pairs, by, human, model)
    h, m = _level(F.col("human")), _level(F.col("model"))

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("n")).otherwise(0))
    out = cells.groupBy(*[quoted(b) for b in by]).agg(
        F.sum("n").alias("total"), total(F.col("human") == F.col("model")).alias("correct"),
        total(m > h).alias("lenient"), total(m < h).alias("strict"))
    lenient = F.try_divide(F.col("lenient").cast("double"), F.col("total"))
    strict = F.try_divide(F.col("strict").cast("double"), F.col("total"))
    return out.select(
        *[quoted(b) for b in by], "total", "correct",
        F.round(F.try_divide(F.col("correct").cast("double"), F.col("total")), 3).alias("accuracy"),
        F.round(lenient, 4).alias("lenient_rate"), F.round(strict, 4).alias("strict_rate"),
        (lenient > BIAS_SHARE).alias("too_lenient"), (strict > BIAS_SHARE).alias("too_strict"))
