"""Which keys to group a table by: size, balance and separation of every candidate key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean
from assay.plans.lattice import group_tables

# Fixed values of the grouping rules.
MIN_GROUPS = 2
MAX_GROUPS = 500
MIN_ROWS_PER_GROUP = 5
IDEAL_GROUP_RANGE = (5, 200)
MAX_KEY_COLUMNS = 3
CANDIDATE_NULL_CEILING = 0.8
COVERAGE_PENALTY_WEIGHT = 0.15
PURPOSE_WEIGHTS = {"process_phase": 3, "experimental_condition": 3,
                   "experimental_unit": 2, "technical_replicate": 1}


def candidate_keys(columns: Sequence[str], width: int = MAX_KEY_COLUMNS) -> list[tuple[str, ...]]:
    """All keys of one to ``width`` columns, in column order."""
    return [c for k in range(1, min(width, len(columns)) + 1) for c in combinations(columns, k)]


def grouping_score(groups: Column, smallest: Column, size_cv: Column, coverage: Column,
                   discriminability: Column, ordinal: Column, width: Column) -> Column:
    """Score in 0..1 of a grouping; ``coverage`` is a fraction."""
    low, high = IDEAL_GROUP_RANGE
    by_count = (
        F.when(groups.between(low, high), F.lit(1.0))
        .when(groups.between(MIN_GROUPS, low), groups / F.lit(float(low)))
        .when(groups.between(high, MAX_GROUPS),
              1.0 - (groups - high) / F.lit(float(MAX_GROUPS - high)))
        .otherwise(0.0))
    by_size = (
        F.when(smallest >= MIN_ROWS_PER_GROUP, F.lit(1.0))
        .when(smallest >= 2, smallest / F.lit(float(MIN_ROWS_PER_GROUP))).otherwise(0.0))
    evenness = F.when(size_cv < 2.0, F.greatest(F.lit(0.0), 1.0 - size_cv)).otherwise(0.0)
    separation = F.when(discriminability > 0, F.least(discriminability, F.lit(1.0))).otherwise(
        evenness)
    extra = F.least((width - 1) * F.lit(0.10), F.lit(0.30))
    total = (0.35 * by_count + 0.25 * by_size + 0.20 * separation + 0.20 * coverage
             + F.when(ordinal, 0.15).otherwise(0.0) + extra)
    return F.round(F.least(total, F.lit(1.0)), 4)


def evaluate_groupings(df: DataFrame, keys: Sequence[Sequence[str]],
                       measures: Sequence[str] = (), *, ordinal: Sequence[str] = (),
                       null_fraction: Mapping[str, float] | None = None,
                       total_rows: int | None = None,
                       max_groups: int = MAX_GROUPS) -> DataFrame:
    """Statistics and score of each key with 2 to ``max_groups`` groups.

    Pass ``null_fraction`` and ``total_rows`` from the column profile when known;
    otherwise one small aggregate finds them.
    """
    keys = [list(k) for k in keys]
    if null_fraction is None or total_rows is None:
        used = sorted({c for k in keys for c in k})
        row = df.agg(F.count(F.lit(1)), *[F.avg(clean(df, c).isNull().cast("double"))
                                          for c in used]).first()
        total_rows = row[0]
        null_fraction = {c: row[i + 1] or 0.0 for i, c in enumerate(used)}
    complete = [c for c, share in null_fraction.items() if not share]
    groups = group_tables(df, keys, measures, max_groups=max_groups, complete=complete)
    aggs = [F.count(F.lit(1)).alias("group_count"), F.min("n").alias("min_group_size"),
            F.sum("n").alias("covered"),
            # g groups over N rows have at most sqrt(2N) different sizes, so the
            # state of this exact median stays small for any table.
            F.percentile("n", F.lit(0.5)).alias("median_group_size"),
            F.coalesce(F.try_divide(F.stddev_samp("n"), F.avg("n")), F.lit(0.0)).alias("cv")]
    discs = []
    for i in range(len(measures)):
        mean = F.try_divide(F.col(f"s{i}"), F.col(f"c{i}").cast("double"))
        aggs.append(F.abs(F.try_divide(F.stddev_samp(mean), F.avg(mean))).alias(f"disc{i}"))
        discs.append(F.col(f"disc{i}"))
    summary = groups.groupBy("key_id").agg(*aggs).filter(
        F.col("group_count").between(MIN_GROUPS, max_groups))
    # At most one value per measurement: bounded by the table's width.
    disc = F.lit(0.0)
    if discs:
        kept = F.sort_array(F.filter(F.array(*discs), lambda d: d.isNotNull()))
        size = F.size(kept)
        lower = F.try_element_at(kept, F.floor((size + 1) / 2).cast("int"))
        upper = F.try_element_at(kept, F.floor(size / 2).cast("int") + 1)
        disc = F.when(size == 0, 0.0).otherwise((lower + upper) / 2.0)
    spark = df.sparkSession
    names = spark.createDataFrame(
        [(i, k, len(k), any(c in ordinal for c in k), float(max(null_fraction[c] for c in k)))
         for i, k in enumerate(keys)],
        "key_id int, columns array<string>, width int, has_ordinal boolean, worst_null double")
    joined = (
        F.broadcast(names).join(summary, "key_id")
        .withColumn("coverage", F.round(F.col("covered") / F.lit(float(total_rows)) * 100, 1))
        .withColumn("discriminability", disc))
    base = grouping_score(
        F.col("group_count"), F.col("min_group_size"), F.col("cv"), F.col("coverage") / 100,
        F.col("discriminability"), F.col("has_ordinal"), F.col("width"))
    penalised = F.when(
        F.col("worst_null") > 0.1,
        F.round(F.greatest(base - COVERAGE_PENALTY_WEIGHT * F.col("worst_null"), F.lit(0.0)), 4),
    ).otherwise(base)
    return joined.select(
        "key_id", "columns", "group_count", "min_group_size",
        F.round("median_group_size", 1).alias("median_group_size"),
        F.round("cv", 3).alias("size_cv"), F.col("coverage").alias("rows_covered_pct"),
        F.round("discriminability", 6).alias("discriminability"), penalised.alias("score"))


def purpose_multiplier(purposes: set[str]) -> float:
    """Multiplier for a key from the purposes its columns serve."""
    known = purposes & set(PURPOSE_WEIGHTS)
    if len(known) >= 3:
        return 1.5
    if len(known) == 2:
        return 1.25
    return {0: 1.0, 1: 0.7, 2: 1.0, 3: 1.10}[sum(PURPOSE_WEIGHTS[p] for p in known)]


def rank_groupings(df: DataFrame, columns: Sequence[str], measures: Sequence[str] = (), *,
                   ordinal: Sequence[str] = (), purposes: Mapping[str, str] | None = None,
                   null_fraction: Mapping[str, float] | None = None,
                   total_rows: int | None = None) -> DataFrame:
    """Every 1-, 2- and 3-column key, scored, weighted by purpose, best first."""
    keys = candidate_keys(columns)
    scored = evaluate_groupings(df, keys, measures, ordinal=ordinal,
                                null_fraction=null_fraction, total_rows=total_rows)
    weights = [purpose_multiplier({(purposes or {}).get(c, "") for c in k}) for k in keys]
    lookup = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("key_id") + 1)
    return scored.withColumn("multiplier", lookup).withColumn(
        "score", F.when(F.col("multiplier") == 1.0, F.col("score")).otherwise(
            F.round(F.least(F.col("score") * F.col("multiplier"), F.lit(1.0)), 4))
    ).orderBy(F.col("score").desc(), "key_id")


def count_distinct_keys(df: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Number of distinct non-null keys for each key, in one pass over the table."""
    keys = [list(k) for k in keys]
    return group_tables(df, keys).groupBy("key_id").agg(F.count(F.lit(1)).alias("groups"))
