"""Measurement files: discovery, loading, Parquet output and group splits."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.columns import nan_to_null, numeric_columns, quoted

# Fixed word lists and values of the file classification.
METADATA_KEYWORDS = ("metadata", "meta", "param", "parameters", "config", "settings")
RAW_DATA_KEYWORDS = ("combined", "raw", "data", "measurements", "results")
METADATA_NUMERIC_SHARE = 0.3
PATTERN = "*.{csv,tsv,parquet}"


def table_name(name: str, keep_suffix: bool = False) -> str:
    """File or column name as a lower-case identifier."""
    stem = name if keep_suffix else re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])
    return re.sub(r"[-\s]+", "_", re.sub(r"[^\w\s-]", "_", stem)).strip("_").lower()


def _any_word(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))


def file_kind(name: Column, numeric_share: Column) -> Column:
    """``metadata`` or ``raw_data`` from the file name, else from its share of numeric columns."""
    low = F.lower(name)
    return (
        F.when(_any_word(low, METADATA_KEYWORDS), "metadata")
        .when(_any_word(low, RAW_DATA_KEYWORDS), "raw_data")
        .when(numeric_share < METADATA_NUMERIC_SHARE, "metadata").otherwise("raw_data"))


def list_files(spark: SparkSession, folder: str, pattern: str = PATTERN) -> DataFrame:
    """(path, name, length) of matching files; contents are never read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length"))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Data files under ``folder`` with their kind; an error when there are none.

    Only CSV files whose name says nothing are opened, for their schema.
    """
    files = list_files(spark, folder)
    named = files.withColumn("by_name", _any_word(
        F.lower("name"), METADATA_KEYWORDS + RAW_DATA_KEYWORDS))
    if named.isEmpty():
        raise ValueError(f"no data files in {folder}")
    unclear = named.filter(~F.col("by_name") & F.lower("name").endswith(".csv")).select("path")
    shares = []
    for row in unclear.toLocalIterator():
        table = load(spark, row["path"])
        shares.append((row["path"], len(numeric_columns(table)) / max(1, len(table.columns))))
    known = spark.createDataFrame(shares, "path string, numeric_share double")
    return named.join(known, "path", "left").select(
        "path", "name", "length", file_kind(F.col("name"), F.col("numeric_share")).alias("kind")
    ).orderBy("name")


def load(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read csv, tsv, txt or parquet; index columns named ``Unnamed...`` are dropped."""
    low = path.lower()
    if low.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    elif low.endswith((".csv", ".txt", ".tsv")):
        reader = spark.read.option("header", True).option("sep", "\t" if low.endswith(".tsv")
                                                          else ",")
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    return nan_to_null(df.drop(*[quoted(c) for c in df.columns if c.startswith("Unnamed")]))


def write_parquet(df: DataFrame, folder: str, name: str, compression: str = "snappy",
                  mode: str = "overwrite") -> str:
    """Write a table under its sanitised name and return its path."""
    path = f"{folder}/{table_name(name)}"
    df.write.mode(mode).option("compression", compression).parquet(path)
    return path


def split_manifest(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per group, groups with a NULL key value included."""
    return df.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("row_count"))


def split_by_groups(df: DataFrame, columns: Sequence[str], folder: str,
                    files_per_group: int = 1) -> DataFrame:
    """Write one folder per group and return the manifest.

    Rows are spread by group and a salt, so that a hot group is written by several
    tasks when ``files_per_group`` is above 1.
    """
    salt = F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(files_per_group))
    (df.repartition(*[quoted(c) for c in columns], salt)
     .write.mode("overwrite").partitionBy(*columns).parquet(folder))
    return split_manifest(df, columns)


def union_with_source(frames: dict[str, DataFrame]) -> DataFrame:
    """Union of differing tables by column name, with ``source_file``."""
    parts = [df.withColumn("source_file", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_source_file(df: DataFrame) -> DataFrame:
    """Add the file each row was read from."""
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))
