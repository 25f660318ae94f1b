"""Column profiles: counts, roles, sample values and summary statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import clean, is_numeric, quoted, unpivot_values
from assay.functions.order_stats import exact_quantiles

# Fixed values of the role rules.
MAX_CATEGORICAL_UNIQUE = 50
CATEGORICAL_RATIO_CEIL = 0.05
IDENTIFIER_RATIO_FLOOR = 0.95
METADATA_TEXT_MIN_MEDIAN_LEN = 20
ORDINAL_SAMPLE = 20
ORDINAL_SHARE = 0.6
DATETIME_SAMPLE = 10
DATETIME_SHARE = 0.7
#: Relative error of the distinct-count sketches, and how many such errors an estimate may be off.
SKETCH_ERROR, SKETCH_MARGIN = 0.02, 6.0

# Fixed patterns: values that look like ordered stages.
ORDINAL_PATTERNS = (
    r"^[A-Za-z]*[0-9]+$",
    r"(?i)^(step|stage|phase|round|pass|cycle|day|hour|time[_\s]?point)\s*[0-9]*$",
    r"^[0-9]+(\.[0-9]+)?$",
)

# Fixed formats tried by the datetime test.
DATETIME_FORMATS = (
    "yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ssXXX",
    "MM/dd/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss", "dd MMM yyyy",
)

COUNTABLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType,
             T.TimestampNTZType, T.BinaryType)

ROLE_SCHEMA = ("ordinal int, name string, dtype string, role string, row_count bigint, "
               "cardinality bigint, cardinality_ratio double, null_count bigint, "
               "null_fraction double")


def _rows_from_one(wide: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return wide.select(F.inline(F.array(*structs)))


def sketched_count(value: Column, error: float) -> Column:
    """Estimated distinct count from a mergeable sketch, one binary buffer a column."""
    size = min(21, max(4, math.ceil(2 * math.log2(1.04 / error))))
    hashed = F.when(value.isNotNull(), F.xxhash64(value))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, size)), F.lit(0))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ordinal (place in ``columns``) and cardinality: exact distinct counts of many columns in one scan.

    Values meet as 8-byte hashes, which are one-to-one for numbers, dates and times, and merge
    on the map side first.
    """
    pairs = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.when(
        clean(df, c).isNotNull(), F.xxhash64(clean(df, c))).alias("h")) for i, c in enumerate(columns)])
    each = df.select(F.inline(pairs).alias("ordinal", "h")).filter(F.col("h").isNotNull())
    return each.groupBy("ordinal", "h").agg(F.lit(1).alias("one")).groupBy("ordinal").agg(F.count("one").alias("cardinality"))


def column_stats(df: DataFrame, approx_error: float | None = None) -> DataFrame:
    """dtype, cardinality, cardinality ratio and nulls of every column.

    Exact distinct counts come from one scan that all columns share. Set ``approx_error`` to
    estimate them by sketches, without any shuffle of values.
    """
    fields = df.schema.fields
    countable = [i for i, f in enumerate(fields) if isinstance(f.dataType, COUNTABLE)]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, field in enumerate(fields):
        aggs.append(F.count(clean(df, field.name)).alias(f"c{i}"))
        if approx_error is not None and i in countable:
            aggs.append(sketched_count(clean(df, field.name), approx_error).alias(f"d{i}"))
    none = F.lit(None).cast("bigint")
    structs = []
    for i, field in enumerate(fields):
        structs.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(field.name).alias("name"),
            F.lit(field.dataType.simpleString()).alias("dtype"), F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"c{i}")).alias("null_count"),
            (F.col(f"d{i}") if approx_error is not None and i in countable else none
             ).alias("estimate")))
    counts = _rows_from_one(df.agg(*aggs), structs)
    if approx_error is None and countable:
        places = F.array(*[F.lit(i) for i in countable])
        distinct = distinct_counts(df, [fields[i].name for i in countable]).select(
            places[F.col("ordinal")].alias("ordinal"), "cardinality")
        known = F.coalesce("cardinality", F.when(F.col("ordinal").isin(countable), 0))
        counts = counts.join(F.broadcast(distinct), "ordinal", "left").withColumn("cardinality", known.cast("bigint"))
    else:
        counts = counts.withColumn("cardinality", F.col("estimate"))

    def share(c: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(c.cast("double"), F.col("row_count")), 4),
                          F.lit(0.0))
    return counts.select(
        "ordinal", "name", "dtype", "row_count", "cardinality",
        share(F.col("cardinality")).alias("cardinality_ratio"), "null_count",
        share(F.col("null_count")).alias("null_fraction"))


def looks_ordinal(value: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.trim(value).rlike(p) for p in ORDINAL_PATTERNS])


def ordinal_share(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of up to 20 distinct values per string column that look ordered."""
    values = value_counts(df, columns, ORDINAL_SAMPLE, by="value")
    return values.groupBy("name").agg(
        F.avg(looks_ordinal(F.col("value")).cast("double")).alias("ordinal_share"))


def parses_as_datetime(value: Column) -> Column:
    return F.coalesce(*[
        F.try_to_timestamp(F.trim(value), F.lit(fmt)) for fmt in DATETIME_FORMATS]).isNotNull()


def _shape_aggs(name: str, i: int) -> list[Column]:
    """Median length, and the smallest value of each of ten hash classes, of a string column."""
    c = quoted(name)
    chosen = [F.pmod(F.xxhash64(c), F.lit(DATETIME_SAMPLE)) == k for k in range(DATETIME_SAMPLE)]
    return [F.percentile(F.length(c), F.lit(0.5)).alias(f"len{i}"),
            *[F.min(F.when(hit, c)).alias(f"v{i}_{k}") for k, hit in enumerate(chosen)]]


def _datetime_share(i: int) -> Column:
    sample = F.filter(F.array(*[F.col(f"v{i}_{k}") for k in range(DATETIME_SAMPLE)]), lambda v: v.isNotNull())
    hits = F.size(F.filter(sample, parses_as_datetime))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(sample)), F.lit(0.0))


def text_shape(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Median length and datetime share of string columns, in one pass.

    The datetime test looks at up to ten values per column. They are picked by a
    hash of the value (smallest value of each of ten hash classes), so the choice
    does not depend on row order.
    """
    structs = [F.struct(F.lit(name).alias("name"), F.col(f"len{i}").alias("median_length"),
                        _datetime_share(i).alias("datetime_share")) for i, name in enumerate(columns)]
    return _rows_from_one(df.agg(*[a for i, name in enumerate(columns) for a in _shape_aggs(name, i)]), structs)


def role_expression(kind: Column, integer: Column, rows: Column, distinct: Column,
                    spread: Column, median_length: Column, datetime_share: Column,
                    ordered_share: Column) -> Column:
    """Role of a column from its counts; the first rule that holds decides."""
    share = F.try_divide(distinct.cast("double"), rows)
    few = (distinct <= MAX_CATEGORICAL_UNIQUE) & (share < CATEGORICAL_RATIO_CEIL)
    long_text = median_length >= METADATA_TEXT_MIN_MEDIAN_LEN
    number = (
        F.when(few, "ordinal_stage")
        .when((share >= IDENTIFIER_RATIO_FLOOR) & integer, "identifier")
        .when(spread > 0, "continuous_measurement").otherwise("constant"))
    text = (
        F.when(datetime_share >= DATETIME_SHARE, "datetime")
        .when(share >= IDENTIFIER_RATIO_FLOOR,
              F.when(long_text, "metadata_text").otherwise("identifier"))
        .when(few, F.when(ordered_share >= ORDINAL_SHARE, "ordinal_stage")
              .otherwise("categorical_group"))
        .when(long_text, "metadata_text")
        .when(distinct <= MAX_CATEGORICAL_UNIQUE, "categorical_group")
        .otherwise("metadata_text"))
    return (
        F.when(rows == 0, "constant").when(kind == "datetime", "datetime")
        .when(kind == "other", "metadata_text").when(distinct <= 1, "constant")
        .when(kind == "number", number).when(kind == "boolean", "categorical_group")
        .otherwise(text))


def _kind(dt: T.DataType) -> str:
    if is_numeric(dt):
        return "number"
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "other"


_FACTS = ("ordinal int, name string, dtype string, kind string, integer boolean, row_count bigint, present bigint, "
          "cardinality bigint, spread double, median_length double, datetime_share double, ordered_share double")


def _first_pass(df: DataFrame, error: float) -> list[dict]:
    """Counts, estimated distinct counts, spreads and text shapes of all columns: one aggregate."""
    fields = df.schema.fields
    aggs, out = [F.count(F.lit(1)).alias("rows")], [F.col("rows")]

    def take(agg: Column, name: str) -> None:
        aggs.append(agg.alias(name))
        out.append(F.col(name))
    for i, field in enumerate(fields):
        kind, v = _kind(field.dataType), clean(df, field.name)
        take(F.count(v), f"c{i}")
        if isinstance(field.dataType, COUNTABLE):
            take(sketched_count(v, error), f"d{i}")
        if kind == "number":
            take(F.stddev_samp(v).cast("double"), f"s{i}")
        if kind == "text":
            aggs += _shape_aggs(field.name, i)
            out += [F.col(f"len{i}").cast("double"), _datetime_share(i).alias(f"t{i}")]
    row = df.agg(*aggs).select(*out).first().asDict() if fields else {}
    return [{
        "ordinal": i, "name": f.name, "dtype": f.dataType.simpleString(), "kind": _kind(f.dataType),
        "integer": isinstance(f.dataType, T.IntegralType), "row_count": row["rows"], "present": row[f"c{i}"],
        "cardinality": min(row[f"d{i}"], row[f"c{i}"]) if f"d{i}" in row else None,
        "spread": (row[f"s{i}"] or 0.0) if f"s{i}" in row else None, "median_length": row.get(f"len{i}"),
        "datetime_share": row.get(f"t{i}"), "ordered_share": 0.0} for i, f in enumerate(fields)]


def _role(facts: DataFrame) -> DataFrame:
    return facts.withColumn("role", role_expression(*[F.col(c) for c in (
        "kind", "integer", "row_count", "cardinality", "spread", "median_length", "datetime_share", "ordered_share")]))


def _undecided(spark, facts: list[dict], margin: float) -> set[int]:
    """Columns whose role is not the same for all distinct counts within the sketch's error."""
    points = []
    for f in facts:
        n, rows = f["cardinality"], f["row_count"]
        if n is None:
            continue
        low, high = int(n * (1 - margin)), min(f["present"], int(n * (1 + margin)) + 1)
        limits = [1, MAX_CATEGORICAL_UNIQUE, int(rows * CATEGORICAL_RATIO_CEIL), int(rows * IDENTIFIER_RATIO_FLOOR)]
        at = {low, high, *[x for limit in limits for x in (limit - 1, limit, limit + 1) if low <= x <= high]}
        points += [tuple({**f, "cardinality": x}.values()) for x in at]
    if not points:
        return set()
    roles = _role(spark.createDataFrame(points, _FACTS)).groupBy("ordinal").agg(F.count_distinct("role").alias("n"))
    return {r["ordinal"] for r in roles.filter("n > 1").collect()}


def _small_sets(df: DataFrame, facts: list[dict]) -> dict[int, tuple[int, float]]:
    """Exact distinct count and ordered share of columns with few values: one aggregate of small sets."""
    out = []
    for f in facts:
        values = F.col(f"set{f['ordinal']}")
        out.append(F.size(values).alias(f"n{f['ordinal']}"))
        if f["kind"] == "text":
            first = F.slice(F.sort_array(values), 1, ORDINAL_SAMPLE)
            out.append(F.try_divide(F.size(F.filter(first, looks_ordinal)).cast("double"), F.size(first)).alias(f"o{f['ordinal']}"))
    sets = df.agg(*[F.collect_set(clean(df, f["name"])).alias(f"set{f['ordinal']}") for f in facts])
    row = sets.select(*out).first().asDict()
    return {f["ordinal"]: (row[f"n{f['ordinal']}"], row.get(f"o{f['ordinal']}") or 0.0) for f in facts}


def column_roles(df: DataFrame, approx_error: float | None = None, exact_counts: bool = False) -> DataFrame:
    """Column profile with the role of each column.

    A first scan sketches all columns. A second one gathers the values of columns that have about
    ``MAX_CATEGORICAL_UNIQUE`` of them or fewer. Of the others, only those whose role changes within
    ``SKETCH_MARGIN`` deviations of the estimate are counted exactly, by one more scan, so roles are
    those of exact counts. ``cardinality`` is exact for all columns counted so, else the estimate;
    with ``exact_counts`` it is exact for all. ``approx_error`` leaves out every exact count.
    """
    spark = df.sparkSession
    error = approx_error or SKETCH_ERROR
    facts = _first_pass(df, error)
    if approx_error is None:
        margin = SKETCH_MARGIN * error
        counted = [f for f in facts if f["cardinality"] is not None]
        small = [f for f in counted if f["cardinality"] * (1 - margin) <= MAX_CATEGORICAL_UNIQUE and f["present"]]
        for i, (n, ordered) in (_small_sets(df, small).items() if small else ()):
            facts[i].update(cardinality=n, ordered_share=ordered)
        large = [f for f in counted if f not in small and f["present"]]
        open_ = {f["ordinal"] for f in large} if exact_counts else _undecided(spark, large, margin)
        wanted = [f for f in large if f["ordinal"] in open_]
        if wanted:
            for r in distinct_counts(df, [f["name"] for f in wanted]).collect():
                wanted[r["ordinal"]]["cardinality"] = r["cardinality"]
    else:
        short = [f for f in facts if f["kind"] == "text" and 1 < f["cardinality"] <= MAX_CATEGORICAL_UNIQUE]
        for i, (_, ordered) in (_small_sets(df, short).items() if short else ()):
            facts[i].update(ordered_share=ordered)
    rows = spark.createDataFrame([tuple(f.values()) for f in facts], _FACTS)

    def share(c: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(c.cast("double"), F.col("row_count")), 4), F.lit(0.0))
    missing = F.col("row_count") - F.col("present")
    return _role(rows).select(
        "ordinal", "name", "dtype", "role", "row_count", "cardinality", share(F.col("cardinality")).alias("cardinality_ratio"),
        missing.alias("null_count"), share(missing).alias("null_fraction"))


def value_counts(df: DataFrame, columns: Sequence[str], k: int | None = None,
                 by: str = "count") -> DataFrame:
    """Counts of the non-null values of each column as (name, value, n, position).

    Positions go by falling count and then by value; ``by="value"`` goes by value
    alone. The first ``k`` positions are kept.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("name"), clean(df, c).cast("string").alias("value"))
        for c in columns])
    counted = (
        df.select(F.inline(pairs).alias("name", "value"))
        .filter(F.col("value").isNotNull())
        .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n")))
    if k is None:
        return counted
    order = [F.col("value")] if by == "value" else [F.col("n").desc(), F.col("value")]
    w = Window.partitionBy("name").orderBy(*order)
    return counted.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def continuous_stats(df: DataFrame, columns: Sequence[str], **split: int) -> DataFrame:
    """min, max, mean, standard deviation and exact median of each column."""
    aggs = []
    for i, c in enumerate(columns):
        v = clean(df, c).cast("double")
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 F.avg(v).alias(f"m{i}"), F.stddev_samp(v).alias(f"s{i}")]
    structs = [F.struct(
        F.lit(c).alias("name"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}").alias("min"),
        F.col(f"hi{i}").alias("max"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
        for i, c in enumerate(columns)]
    moments = _rows_from_one(df.agg(*aggs), structs)
    medians = exact_quantiles(unpivot_values(df, [], columns, "name", "value"), ["name"],
                              "value", {"median": 0.5}, **split)
    return moments.join(medians, "name", "left")


def level_size_cv(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Coefficient of variation of the level sizes of each discrete column."""
    return value_counts(df, columns).groupBy("name").agg(
        F.count(F.lit(1)).alias("levels"),
        F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("size_cv"))
