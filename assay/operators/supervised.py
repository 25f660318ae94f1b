"""Supervised tasks on group features with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import value_positions
from assay.operators.resampling import bootstrap_ci
from assay.session import cut_lineage

# Fixed values of the task settings.
TREES, FOLDS, SEED = 200, 5, 42
RIDGE = 0.1


def auto_features(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    """All numeric columns that are neither keys nor target."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add the ``features`` vector, gaps filled with the column mean."""
    vals = df.select("*", *[clean(df, f).cast("double").alias(f"__f{i}")
                            for i, f in enumerate(features)])
    names = [f"__f{i}" for i in range(len(features))]
    filled = Imputer(inputCols=names, outputCols=[f"{n}_i" for n in names]).fit(vals).transform(vals)
    return VectorAssembler(inputCols=[f"{n}_i" for n in names], outputCol="features",
                           handleInvalid="keep").transform(filled).drop(
        *names, *[f"{n}_i" for n in names])


def with_fold(df: DataFrame, key: Sequence[str], folds: int = FOLDS) -> DataFrame:
    """Fold from a hash of the unit, the same in every run."""
    return df.withColumn("fold", F.pmod(F.xxhash64(*[quoted(k) for k in key]), F.lit(folds)).cast("int"))


def _learner(kind: str, trees: int, depth: int):
    if kind == "classification":
        return RandomForestClassifier(labelCol="target", numTrees=trees, maxDepth=depth, seed=SEED)
    if kind == "regression":
        return RandomForestRegressor(labelCol="target", numTrees=trees, maxDepth=depth, seed=SEED)
    if kind in ("linear", "ridge"):
        return LinearRegression(labelCol="target", solver="normal",
                                regParam=RIDGE if kind == "ridge" else 0.0)
    raise ValueError(f"unknown task kind: {kind}")


def cross_validate(df: DataFrame, key: Sequence[str], features: Sequence[str], target: str,
                   kind: str = "classification", folds: int = FOLDS, trees: int = TREES,
                   depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and the importance of each feature in each fold.

    The loop is over the few folds; every fit and prediction is a Spark job over
    the whole feature table.
    """
    rows = cut_lineage(with_fold(assemble(df.withColumn("target", quoted(target).cast("double")).filter(
        "target is not null"), features), key, folds).select(*[quoted(k) for k in key], "fold",
                                                            "target", "features"))
    preds, importance = None, []
    for fold in range(folds):
        model = _learner(kind, trees, depth).fit(rows.filter(F.col("fold") != fold))
        out = model.transform(rows.filter(F.col("fold") == fold))
        prob = vector_to_array("probability")[1] if kind == "classification" else F.lit(None)
        part = out.select(*[quoted(k) for k in key], "fold", "target", "prediction",
                          prob.cast("double").alias("score"))
        preds = part if preds is None else preds.unionByName(part)
        weights = (model.featureImportances if kind in ("classification", "regression")
                   else model.coefficients).toArray()
        importance += [(fold, f, float(abs(w))) for f, w in zip(features, weights)]
    return preds, df.sparkSession.createDataFrame(
        importance, "fold int, feature string, importance double")


def fold_metrics(preds: DataFrame, kind: str = "classification", **split) -> DataFrame:
    """R squared, RMSE and MAE, or accuracy and AUC, of every fold."""
    e = F.col("target") - F.col("prediction")
    if kind != "classification":
        return preds.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            (1 - F.try_divide(F.sum(e * e), F.var_pop("target") * F.count("target"))).alias("r2"))
    base = preds.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg((e == 0).cast("double")).alias("accuracy"),
        F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    pos = value_positions(preds, ["fold"], "score", **split).select(
        "fold", "score", (F.col("before") + (F.col("n") + 1) / 2.0).alias("r"))
    counts = preds.filter("target = 1").groupBy("fold", "score").agg(F.count(F.lit(1)).alias("c"))
    ranks = counts.join(pos, ["fold", "score"]).groupBy("fold").agg(
        F.sum(F.col("c") * F.col("r")).alias("s"))
    auc = F.try_divide(F.col("s") - F.col("pos") * (F.col("pos") + 1) / 2.0,
                       (F.col("pos") * F.col("neg")).cast("double"))
    return base.join(ranks, "fold", "left").select("fold", "n", "accuracy", auc.alias("auc"))


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean and spread over folds of each metric."""
    names = [c for c in metrics.columns if c not in ("fold", "n")]
    return metrics.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in names]))).groupBy(
        "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))


def bootstrap_metric(preds: DataFrame, replicates: int = 500, level: float = 0.95, **split) -> DataFrame:
    """Bootstrap interval of the mean error measure (absolute error, or share right)."""
    e = F.abs(F.col("target") - F.col("prediction"))
    rows = preds.select(F.inline(F.array(
        F.struct(F.lit("mae").alias("metric"), e.alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), (e == 0).cast("double").alias("value")))))
    return bootstrap_ci(rows, ["metric"], "value", replicates, level, **split)


def _numbered(df: DataFrame, key: str, seed: int, number: str, **split) -> DataFrame:
    """Number the rows from 0 in the order of a hash of their key."""
    rows = df.withColumn("__h", F.xxhash64(quoted(key), F.lit(seed)))
    pos = value_positions(rows, [], "__h", **split).select("__h", "before")
    tied = Window.partitionBy("__h").orderBy(quoted(key))
    return rows.join(pos, "__h").withColumn(
        number, F.col("before") + F.row_number().over(tied) - 1).drop("__h", "before")


def permuted(df: DataFrame, key: str, column: str, seed: int = SEED, **split) -> DataFrame:
    """Replace a column by a fixed permutation of its values over the rows (unique key).

    Rows and values are numbered in two hash orders and joined on the number, so no
    sort of the whole table in one task is needed.
    """
    rows = _numbered(df, key, seed, "__to", **split).drop(quoted(column))
    moved = _numbered(df.select(quoted(key), quoted(column)), key, seed + 1, "__to", **split).select(
        "__to", quoted(column))
    return rows.join(moved, "__to").select(*df.columns)


def permutation_importance(model, rows: DataFrame, key: str, features: Sequence[str], seed: int = SEED,
                           **split) -> DataFrame:
    """Rise of the mean absolute error when one feature is permuted, one row per feature."""
    def error(df: DataFrame, name: str) -> DataFrame:
        out = model.transform(assemble(df, features))
        return out.agg(F.avg(F.abs(F.col("target") - F.col("prediction"))).alias("e")).select(
            F.lit(name).alias("feature"), "e")
    base = error(rows, "").select(F.col("e").alias("base"))
    parts = [error(permuted(rows, key, f, seed + 2 * i, **split), f) for i, f in enumerate(features)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # The base is one row.
    return out.join(F.broadcast(base), F.lit(True)).select(
        "feature", (F.col("e") - F.col("base")).alias("importance"))


def mean_importance(importance: DataFrame) -> DataFrame:
    """Mean importance of each feature over folds."""
    return importance.groupBy("feature").agg(F.avg("importance").alias("importance"))


def feature_stability(importance: DataFrame) -> DataFrame:
    """Share of folds in which a feature had any importance."""
    return importance.groupBy("feature").agg(
        F.avg((F.col("importance") > 0).cast("double")).alias("stability"))
