"""Evaluation store on Parquet: upsert, skip-existing, rankings and export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.functions.columns import present, quoted
from assay.functions.order_stats import numbered_rows

BUCKET, BUCKETS = "key_bucket", 64


def upsert(current: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write wins per key; NULL key parts equal each other.

    Kept as one aggregate (greatest ``order`` per key), so repeats of a hot key are
    folded before the shuffle. Rows of equal order are told apart by a hash of the rest.
    """
    both = current.unionByName(new, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    last = both.groupBy(*[quoted(k) for k in keys]).agg(
        F.max_by(F.struct(*[quoted(c) for c in rest]), F.struct(
            quoted(order), F.xxhash64(*[quoted(c) for c in rest]))).alias("__row"))
    return last.select(*[quoted(k) if k in keys else F.col("__row").getField(k).alias(k)
                         for k in both.columns])


def skip_existing(wanted: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Units without a stored row."""
    return wanted.join(stored.select(*[quoted(k) for k in keys]), list(keys), "left_anti")


def rank_positions(scores: DataFrame, method: str = "ranking_method", score: str = "strength",
                   name: str = "player") -> DataFrame:
    """Position by falling score within each ranking method, equal scores by name."""
    rows = scores.filter(present(scores, score))
    return numbered_rows(rows, [method], [quoted(score).desc(), quoted(name)], "rank_position")


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    parts = [x for k in keys for x in (quoted(k).isNull(), quoted(k))]
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int").alias(BUCKET)


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_store(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> None:
    """Start a keyed store: one folder for each hash bucket of the keys."""
    df.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.mode("errorifexists").partitionBy(BUCKET).parquet(path)


def read_store(spark: SparkSession, path: str, keys: Sequence[str] = (), wanted: DataFrame | None = None,
               buckets: int = BUCKETS) -> DataFrame:
    """The stored rows; with ``wanted`` (its keys) only the buckets that can hold one of them."""
    stored = spark.read.parquet(path)
    if wanted is not None:
        touched = [r[0] for r in wanted.select(_bucket(keys, buckets)).distinct().collect()]  # at most ``buckets``
        stored = stored.filter(F.col(BUCKET).isin(touched))
    return stored.drop(BUCKET)


def upsert_store(path: str, new: DataFrame, keys: Sequence[str], order: str, buckets: int = BUCKETS) -> None:
    """Last write wins per key, in the store at ``path``.

    Only the buckets that ``new`` touches are read and rewritten, by dynamic partition overwrite;
    the files of the others stay as they are. The new files take the place of the old ones when
    the job commits, and the same rows written again give the same store.
    """
    spark = new.sparkSession
    if not _exists(spark, path):
        none = spark.createDataFrame([], new.schema)
        write_store(upsert(none, new, keys, order), path, keys, buckets)
        return
    merged = upsert(read_store(spark, path, keys, new, buckets), new, keys, order)
    (merged.withColumn(BUCKET, _bucket(keys, buckets)).repartition(BUCKET).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path))


def comparison_set_hash(games: DataFrame) -> DataFrame:
    """One SHA-256 for a whole set of games, whatever their order.

    Equal games are counted first. Each run's list of (opponent, winner, count) is hashed,
    then the list of runs with their hashes; a list is as long as there are opponents or runs.
    """
    def listed(parts: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda x: x["text"]), ";"), 256)

    counts = games.groupBy("run_a", "run_b", "winner").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat_ws(",", "run_b", "winner", F.col("n").cast("string"))
    runs = counts.groupBy("run_a").agg(listed(F.struct("run_b", "winner", text.alias("text"))).alias("h"))
    return runs.agg(F.substring(listed(F.struct("run_a", F.concat_ws("=", "run_a", "h").alias("text"))), 1, 16).alias(
        "comparison_set_hash"))


def replace_rankings(rankings: DataFrame, path: str) -> None:
    """Replace the stored rankings of the methods present, leaving other methods alone."""
    (rankings.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("ranking_method").parquet(path))


def wide_by_metric(df: DataFrame, rows: Sequence[str], metric: str, value: str,
                   metrics: Sequence[str] | None = None) -> DataFrame:
    """One column per metric."""
    g = df.groupBy(*[quoted(r) for r in rows])
    return (g.pivot(metric, list(metrics)) if metrics else g.pivot(metric)).agg(F.avg(quoted(value)))


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write results as CSV with a header, or as JSON lines."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)
