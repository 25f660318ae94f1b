"""Small column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def quoted(name: str) -> Column:
    """Column by its exact name, dots and slashes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """Condition: the value is neither NULL nor NaN."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return col.isNotNull() & ~F.isnan(col)
    return col.isNotNull()


def clean(df: DataFrame, name: str) -> Column:
    """The value, with NaN read as NULL."""
    col = quoted(name)
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col)
    return col


def nan_to_null(df: DataFrame) -> DataFrame:
    """Read NaN as NULL in every floating-point column (rule used on ingest)."""
    return df.select(*[clean(df, c).alias(c) for c in df.columns])


def ratio(num: Column, den: Column) -> Column:
    """Division that gives NULL when the denominator is 0 or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def unpivot_values(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                   name: str = "metric", value: str = "value") -> DataFrame:
    """Long form (keys, metric, value) with values as double and NaN as NULL."""
    base = df.select(
        *[quoted(k) for k in keys],
        *[clean(df, v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)],
    )
    pairs = F.array(*[
        F.struct(F.lit(v).alias(name), quoted(f"__v{i}").alias(value))
        for i, v in enumerate(values)
    ])
    return base.select(*[quoted(k) for k in keys], F.inline(pairs).alias(name, value))


def short_number(v: Column) -> Column:
    """A number as text with four significant digits."""
    rounded = F.format_string("%.3e", v.cast("double")).cast("double").cast("string")
    return F.regexp_replace(rounded, r"\.0$", "")
