"""Tables of the evaluation and checking model, derived from the driver tables.

Every row comes from the given tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import table

# Replicate scores: config = order priority, run = nation, dataset = market segment,
# judge = order status, score = price scaled to 0..10.
SCORES_SQL = """scores AS (
  SELECT o_orderpriority AS config, 'run_' || c_nationkey AS run_id, c_mktsegment AS dataset,
         o_orderstatus AS judge, 'overall' AS metric, o_totalprice / 50000.0 AS value
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def scores(spark, d):
    return table(spark, d, "orders").join(
        table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("config"),
        F.concat(F.lit("run_"), F.col("c_nationkey").cast("string")).alias("run_id"),
        F.col("c_mktsegment").alias("dataset"), F.col("o_orderstatus").alias("judge"),
        F.lit("overall").alias("metric"), (F.col("o_totalprice") / 50000.0).alias("value"))


RUNS_SQL = SCORES_SQL + """,
runs AS (SELECT config, metric, run_id, avg(value) AS value FROM scores GROUP BY ALL)"""


def run_scores(spark, d):
    return scores(spark, d).groupBy("config", "metric", "run_id").agg(F.avg("value").alias("value"))


# Games: supplier nation against customer nation on one order line; the larger of
# discount and tax wins for its side.
GAMES_SQL = """games AS (
  SELECT 'n' || s_nationkey AS run_a, 'n' || c_nationkey AS run_b, l_returnflag AS dataset,
         o_orderpriority AS judge,
         CASE WHEN l_discount > l_tax THEN 'n' || s_nationkey
              WHEN l_discount < l_tax THEN 'n' || c_nationkey ELSE 'tie' END AS winner
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey)"""


def games(spark, d):
    sides = (
        table(spark, d, "lineitem")
        .join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .filter(F.col("s_nationkey") != F.col("c_nationkey"))
        .withColumn("run_a", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
        .withColumn("run_b", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))))
    winner = F.when(F.col("l_discount") > F.col("l_tax"), F.col("run_a")).when(
        F.col("l_discount") < F.col("l_tax"), F.col("run_b")).otherwise("tie")
    return sides.select("run_a", "run_b", F.col("l_returnflag").alias("dataset"),
                        F.col("o_orderpriority").alias("judge"), winner.alias("winner"),
                        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# One verdict per ordered pair, dataset and judge: the side that won more lines.
VERDICTS_SQL = GAMES_SQL + """,
verdicts AS (SELECT run_a, run_b, dataset, judge,
  CASE WHEN sum(CASE WHEN winner = run_a THEN 1 WHEN winner = run_b THEN -1 ELSE 0 END) > 0 THEN run_a
       WHEN sum(CASE WHEN winner = run_a THEN 1 WHEN winner = run_b THEN -1 ELSE 0 END) < 0 THEN run_b
       ELSE 'tie' END AS winner FROM games GROUP BY run_a, run_b, dataset, judge)"""


def verdicts(spark, d):
    lead = F.sum(F.when(F.col("winner") == F.col("run_a"), 1).when(
        F.col("winner") == F.col("run_b"), -1).otherwise(0))
    return games(spark, d).groupBy("run_a", "run_b", "dataset", "judge").agg(
        lead.alias("lead")).select(
        "run_a", "run_b", "dataset", "judge", F.when(F.col("lead") > 0, F.col("run_a")).when(
            F.col("lead") < 0, F.col("run_b")).otherwise("tie").alias("winner"))


# Ratings: two raters of a document, and suppliers rated by order lines.
RATINGS_SQL = """ratings AS (
  SELECT doc_id AS unit, 'quality' AS judge, CAST(quality AS DOUBLE) AS score FROM labels
  UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS DOUBLE) FROM labels)"""


def label_ratings(spark, d):
    return table(spark, d, "labels").select(
        F.col("doc_id").alias("unit"), F.inline(F.array(
            F.struct(F.lit("quality").alias("judge"), F.col("quality").cast("double").alias("score")),
            F.struct(F.lit("toxic").alias("judge"), F.col("toxic").cast("double").alias("score")))))


LINE_RATINGS_SQL = """lines AS (
  SELECT l_returnflag AS criterion, l_orderkey AS unit, 'j' || l_linenumber AS judge,
         avg(floor(l_quantity / 5)) AS score FROM lineitem GROUP BY ALL)"""


def line_ratings(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_returnflag").alias("criterion"), F.col("l_orderkey").alias("unit"),
        F.concat(F.lit("j"), F.col("l_linenumber").cast("string")).alias("judge")).agg(
        F.avg(F.floor(F.col("l_quantity") / 5)).alias("score"))


# Checks of attempts: a supplier's lines of one return flag, line number = attempt.
CHECKS_SQL = """checks AS (
  SELECT 'run_' || l_suppkey AS run_id, l_returnflag AS dataset, l_linestatus AS stage,
         l_linenumber AS attempt, 'check_' || (l_partkey % 12) AS name,
         CASE WHEN l_quantity < 25 THEN 'should_fix' ELSE 'must_fix' END AS severity,
         CASE WHEN l_partkey % 3 = 0 THEN 'structural' WHEN l_partkey % 3 = 1 THEN 'content_quality'
              ELSE 'plot_quality' END AS category,
         'plot_' || (l_orderkey % 4) AS ref, l_discount < 0.08 AS passed,
         CASE WHEN l_tax > 0.06 THEN '[cosmetic] detail' ELSE 'detail' END AS detail FROM lineitem)"""
ATTEMPT = ["run_id", "dataset", "stage", "attempt"]


def checks(spark, d):
    kind = F.col("l_partkey") % 3
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("run_"), F.col("l_suppkey").cast("string")).alias("run_id"),
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("stage"),
        F.col("l_linenumber").alias("attempt"),
        F.concat(F.lit("check_"), (F.col("l_partkey") % 12).cast("string")).alias("name"),
        F.when(F.col("l_quantity") < 25, "should_fix").otherwise("must_fix").alias("severity"),
        F.when(kind == 0, "structural").when(kind == 1, "content_quality").otherwise(
            "plot_quality").alias("category"),
        F.concat(F.lit("plot_"), (F.col("l_orderkey") % 4).cast("string")).alias("ref"),
        (F.col("l_discount") < 0.08).alias("passed"),
        F.when(F.col("l_tax") > 0.06, "[cosmetic] detail").otherwise("detail").alias("detail"))


# Group metrics of a run: one value per (supplier, flag) and metric, some missing.
GROUP_METRIC_SQL = """group_metric AS (
  SELECT l_suppkey AS run, 'R' || l_suppkey || '__E' || l_linenumber AS group_key, metric, value FROM (
    SELECT l_suppkey, l_linenumber, 'row_count' AS metric, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_suppkey, l_linenumber, 'net_count', sum(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE -1.0 END) FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_suppkey, l_linenumber, 'tax_pct', avg(l_tax) * 5000 FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_suppkey, l_linenumber, 'price_std', CASE WHEN max(l_discount) < 0.1 THEN NULL ELSE stddev_samp(l_extendedprice) END FROM lineitem GROUP BY ALL
    UNION ALL SELECT l_suppkey, l_linenumber, 'l_quantity', avg(l_quantity) FROM lineitem GROUP BY ALL))"""


def group_metric(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.count(F.lit(1)).cast("double").alias("row_count"),
        F.sum(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(-1.0)).alias("net_count"),
        (F.avg("l_tax") * 5000).alias("tax_pct"),
        F.when(F.max("l_discount") >= 0.1, F.stddev_samp("l_extendedprice")).alias("price_std"),
        F.avg("l_quantity").alias("l_quantity"))
    names = ("row_count", "net_count", "tax_pct", "price_std", "l_quantity")
    return wide.select(
        F.col("l_suppkey").alias("run"),
        F.concat(F.lit("R"), F.col("l_suppkey").cast("string"), F.lit("__E"),
                 F.col("l_linenumber").cast("string")).alias("group_key"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"))
                           for n in names])))
