"""Inspecting a table and checking what cleaning did to it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.functions.columns import clean, numeric_columns, quoted, string_columns, unpivot_values
from assay.functions.order_stats import exact_quantiles
from assay.plans.columns import value_counts
from assay.sources.tables import table_name

# Fixed values.
KNOWN_GROUP_COLUMNS = ("run_no", "run", "chromatography_stage", "Sample_Code", "column")
PROTECTED_COLUMNS = (*KNOWN_GROUP_COLUMNS, "Fraction_number", "charge_state", "Spectrum_type",
                     "Observed_m/z", "Expected_mass_(Da)")
DESCRIBED_COLUMNS = 15
TOP_VALUES = 30
MIN_RETENTION = 0.50
RULE_WARN_SHARE = 0.10
PROTECTED_NULL_WARN = 0.95

CHECK_SCHEMA = "name string, severity string, category string, detail string, ref string, passed boolean"


def known_groups(df: DataFrame, extra: Sequence[str] = ()) -> list[str]:
    """Known group columns, then ``extra``, that the table really has."""
    return [c for c in dict.fromkeys((*KNOWN_GROUP_COLUMNS, *extra)) if c in df.columns]


def missingness(df: DataFrame) -> DataFrame:
    """Null count and fraction of every column, from one pass."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count(clean(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    structs = [F.struct(
        F.lit(c).alias("name"), (F.col("rows") - F.col(f"c{i}")).alias("null_count"),
        F.coalesce(F.round(F.try_divide((F.col("rows") - F.col(f"c{i}")).cast("double"),
                                        F.col("rows")), 4), F.lit(0.0)).alias("null_fraction"),
        F.col("rows").alias("row_count")) for i, c in enumerate(df.columns)]
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


def describe(df: DataFrame, columns: Sequence[str] | None = None, **split) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of the first numeric columns."""
    names = list(columns or numeric_columns(df)[:DESCRIBED_COLUMNS])
    long = unpivot_values(df, [], names, "name", "value")
    moments = long.groupBy("name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    quarts = exact_quantiles(long, ["name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75},
                             **split)
    return moments.join(quarts, "name", "left")


def inspect(df: DataFrame, rows: int = 5) -> dict:
    """Columns, types, row count, a few rows and numeric columns, for a person to look at."""
    return {"columns": df.columns, "dtypes": dict(df.dtypes), "row_count": df.count(),
            "preview_rows": [r.asDict(recursive=True) for r in df.take(rows)],
            "numeric_columns": numeric_columns(df)}


def group_summary(df: DataFrame, extra: Sequence[str] = (), top: int = TOP_VALUES) -> DataFrame:
    """Per known group column: unique values, nulls and the most frequent values."""
    names = known_groups(df, extra)
    # value_counts keeps the first positions map-side before its shuffle.
    counted = value_counts(df, names)
    levels = counted.groupBy("name").agg(F.count(F.lit(1)).alias("unique_count"))
    best = value_counts(df, names, top)
    nulls = missingness(df.select(*[quoted(c) for c in names])).select(
        "name", "null_count",
        F.round(F.coalesce(F.try_divide(F.col("null_count").cast("double"), F.col("row_count")),
                           F.lit(0.0)) * 100, 1).alias("null_pct"))
    return (best.join(F.broadcast(levels), "name").join(F.broadcast(nulls), "name")
            .select("name", "unique_count", "null_count", "null_pct", "position", "value", "n"))


def drop_empty_columns(df: DataFrame, protected: Sequence[str] = PROTECTED_COLUMNS) -> DataFrame:
    """Drop columns without any value, never the protected ones; no other threshold applies."""
    keep = {p.lower() for p in protected}
    gone = [r["name"] for r in missingness(df).collect()
            if r["row_count"] > 0 and r["null_count"] == r["row_count"]
            and r["name"].lower() not in keep]
    return df.drop(*[quoted(c) for c in gone])


def standardise_names(df: DataFrame) -> DataFrame:
    """Lower-case names of letters, digits and underscores; clashes get a number."""
    used: dict[str, int] = {}
    names = []
    for c in df.columns:
        base = table_name(c, keep_suffix=True) or "column"
        used[base] = used.get(base, 0) + 1
        names.append(base if used[base] == 1 else f"{base}_{used[base]}")
    return df.toDF(*names)


def validate_cleaned(df: DataFrame, preserve: Sequence[str] = ()) -> DataFrame:
    """Checks of a cleaned table: it has rows, keeps columns, has no all-null numeric column."""
    have = {c.lower() for c in df.columns}
    lost = [c for c in preserve if c.lower() not in have]
    numeric = set(numeric_columns(df))
    rows = missingness(df)
    empty = rows.filter(F.col("name").isin(*numeric) if numeric else F.lit(False)).filter(
        (F.col("null_count") == F.col("row_count")))
    spark = df.sparkSession
    fixed = spark.createDataFrame(
        [("missing_preserved_column", "should_fix", "structural", f"column {c} is missing", c, False)
         for c in lost], CHECK_SCHEMA)
    no_rows = df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("zero_rows").alias("name"), F.lit("must_fix").alias("severity"),
        F.lit("structural").alias("category"), F.lit("table has no rows").alias("detail"),
        F.lit(None).cast("string").alias("ref"), F.lit(False).alias("passed"))
    nulls = empty.select(
        F.lit("all_null_column").alias("name"), F.lit("should_fix").alias("severity"),
        F.lit("structural").alias("category"),
        F.concat(F.lit("column "), F.col("name"), F.lit(" has no value")).alias("detail"),
        F.col("name").alias("ref"), F.lit(False).alias("passed"))
    return no_rows.unionByName(fixed).unionByName(nulls)


def cleaning_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns before and after, with removed and kept columns."""
    names = after.sparkSession.createDataFrame(
        [(before.columns, after.columns)], "b array<string>, a array<string>")
    return (
        before.agg(F.count(F.lit(1)).alias("rows_before"))
        .join(after.agg(F.count(F.lit(1)).alias("rows_after")), F.lit(True))
        .join(names, F.lit(True))
        .select("rows_before", "rows_after", F.size("b").alias("columns_before"),
                F.size("a").alias("columns_after"),
                F.array_sort(F.array_except("b", "a")).alias("columns_removed"),
                F.array_sort("a").alias("columns_retained")))


def cleaned_columns(after: DataFrame) -> DataFrame:
    """Per column: null percentage, mean, std, min, max and three sample values.

    Samples are the three least values of each of three hash classes, so they do
    not depend on row order.
    """
    numeric = set(numeric_columns(after))
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(after.columns):
        v, text = clean(after, c), clean(after, c).cast("string")
        aggs.append(F.count(v).alias(f"c{i}"))
        aggs += [F.min(F.when(F.pmod(F.xxhash64(text), F.lit(3)) == k, text)).alias(f"e{i}_{k}")
                 for k in range(3)]
        if c in numeric:
            d = v.cast("double")
            aggs += [F.avg(d).alias(f"m{i}"), F.stddev_samp(d).alias(f"s{i}"),
                     F.min(d).alias(f"lo{i}"), F.max(d).alias(f"hi{i}")]
    none = F.lit(None).cast("double")

    def stat(i: int, c: str, p: str):
        return F.round(F.col(f"{p}{i}"), 4) if c in numeric else none
    structs = [F.struct(
        F.lit(c).alias("name"),
        F.round(F.try_divide((F.col("rows") - F.col(f"c{i}")).cast("double"), F.col("rows")) * 100,
                2).alias("null_pct"),
        stat(i, c, "m").alias("mean"), stat(i, c, "s").alias("std"), stat(i, c, "lo").alias("min"),
        stat(i, c, "hi").alias("max"),
        F.filter(F.array(*[F.col(f"e{i}_{k}") for k in range(3)]),
                 lambda x: x.isNotNull()).alias("samples"))
        for i, c in enumerate(after.columns)]
    return after.agg(*aggs).select(F.inline(F.array(*structs)))


def categorical_values(after: DataFrame, below: int = 50, top: int = 10) -> DataFrame:
    """Top values of string columns with fewer than ``below`` different values."""
    names = string_columns(after)
    levels = value_counts(after, names).groupBy("name").agg(
        F.count(F.lit(1)).alias("unique_count")).filter(F.col("unique_count") < below)
    return value_counts(after, names, top).join(F.broadcast(levels), "name").select(
        "name", "unique_count", "position", "value", "n")


def retention(rows: DataFrame) -> DataFrame:
    """Guard on (rule, rows_before, rows_after): error under 50 % kept, warning above 10 % lost."""
    kept = F.try_divide(F.col("rows_after").cast("double"), F.col("rows_before"))
    return rows.withColumn("retained", F.round(kept, 4)).withColumn(
        "status", F.when(kept < MIN_RETENTION, "error")
        .when(1 - kept > RULE_WARN_SHARE, "warning").otherwise("ok"))


def protected_audit(df: DataFrame, protected: Sequence[str] = PROTECTED_COLUMNS) -> DataFrame:
    """Protected columns of the table with their nulls; ``flagged`` above 95 % null."""
    names = [c for c in protected if c in df.columns]
    return missingness(df.select(*[quoted(c) for c in names])).withColumn(
        "flagged", F.col("null_count") > F.col("row_count") * PROTECTED_NULL_WARN)


def flag_anomalies(df: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Add a boolean ``flag_<name>`` per SQL condition; rows are marked, never removed."""
    return df.select("*", *[F.coalesce(F.expr(cond), F.lit(False)).alias(f"flag_{n}")
                            for n, cond in rules.items()])


def anomaly_counts(flagged: DataFrame) -> DataFrame:
    """Number of rows per flag."""
    names = [c for c in flagged.columns if c.startswith("flag_")]
    row = flagged.agg(*[F.count_if(quoted(c)).alias(c) for c in names])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c[5:]).alias("rule"), quoted(c).alias("n")) for c in names])))


def is_data_dictionary(df: DataFrame) -> bool:
    """Two columns, the first of text with no repeated value: a description of columns."""
    if len(df.columns) != 2 or df.columns[0] in numeric_columns(df):
        return False
    key = quoted(df.columns[0])
    row = df.agg(F.count(key).alias("n"), F.count_distinct(key).alias("d")).first()
    return row["n"] == row["d"]


def condition_map(df: DataFrame) -> DataFrame:
    """(run_id, conditions): the non-null conditions of each run as a text map."""
    key, others = df.columns[0], df.columns[1:]
    entries = F.filter(
        F.array(*[F.struct(F.lit(c).alias("k"), clean(df, c).cast("string").alias("v"))
                  for c in others]), lambda e: e["v"].isNotNull())
    return df.select(quoted(key).cast("string").alias("run_id"),
                     F.map_from_entries(entries).alias("conditions"))


def annotate(measures: DataFrame, conditions: DataFrame, key: str) -> DataFrame:
    """Left join of run conditions onto measurements; Spark chooses broadcast by size."""
    return measures.join(conditions, key, "left")
