"""How discrete columns relate: redundant, nested, crossed or partly overlapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean
from assay.plans.lattice import pair_values

# Fixed values of the relation rules; the profile compares columns below the first.
RELATIONSHIP_MAX_CARDINALITY = 5000
CROSSING_FILL_THRESHOLD = 0.8


def pair_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of each side and distinct pairs, over rows where both are present."""
    columns = list(columns)
    pairs = pair_values(df, columns)
    both = pairs.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_ab"))
    sides = [pairs.groupBy("i", "j", c).agg(F.lit(1).alias("one")).groupBy("i", "j").agg(F.count("one").alias(f"n_{c}"))
             for c in ("a", "b")]
    seen = both.join(sides[0], ["i", "j"]).join(sides[1], ["i", "j"])
    names = df.sparkSession.createDataFrame(
        [(i, j, columns[i], columns[j]) for i, j in combinations(range(len(columns)), 2)],
        "i int, j int, col_a string, col_b string")
    zero = F.lit(0).cast("bigint")
    return names.join(seen, ["i", "j"], "left").select(
        "col_a", "col_b", *[F.coalesce(F.col(c), zero).alias(c) for c in ("n_a", "n_b", "n_ab")])


def relationships(df: DataFrame, columns: Sequence[str],
                  cardinality: Mapping[str, int] | None = None) -> DataFrame:
    """Relation and strength of every pair of the given columns, of any number of values."""
    if cardinality is None:
        row = df.agg(*[F.count_distinct(clean(df, c)).alias(f"d{i}")
                       for i, c in enumerate(columns)]).first()
        cardinality = {c: row[i] for i, c in enumerate(columns)}
    levels = F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(int(cardinality[c])))])
    counts = pair_counts(df, columns)
    a_sets_b = F.col("n_ab") == F.col("n_a")
    b_sets_a = F.col("n_ab") == F.col("n_b")
    fill = F.coalesce(
        F.try_divide(F.col("n_ab").cast("double"), F.col("n_a") * F.col("n_b")), F.lit(0.0))
    same_size = levels[F.col("col_a")] == levels[F.col("col_b")]
    kind = (
        F.when(F.col("n_ab") == 0, "partial_overlap")
        .when(a_sets_b & b_sets_a & same_size, "redundant")
        .when(a_sets_b & ~b_sets_a, "nested_a_in_b")
        .when(b_sets_a & ~a_sets_b, "nested_b_in_a")
        .when(fill >= CROSSING_FILL_THRESHOLD, "crossed").otherwise("partial_overlap"))
    exact = F.col("relationship").isin("redundant", "nested_a_in_b", "nested_b_in_a")
    return counts.withColumn("relationship", kind).withColumn(
        "strength", F.when(exact, F.lit(1.0)).otherwise(F.round(fill, 4)))

