"""Queries on sources, inspection and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import cleaning as C
from assay.plans import columns as P
from assay.sources import tables as S
from catalog.profile import LINEITEM_COLUMNS, _per_column
from catalog.registry import query, table

_MISSING = """
SELECT '{c}' AS name, count(*) - count({c}) AS null_count,
       round((count(*) - count({c})) / count(*), 4) AS null_fraction, count(*) AS row_count
FROM conversations"""


@query(_per_column(_MISSING, ["conv_id", "turn", "role", "text"]))
def missingness(spark, d):
    return C.missingness(table(spark, d, "conversations"))


_DESCRIBE = """
SELECT '{c}' AS name, count({c}) AS count, round(avg({c}), 4) AS mean,
       round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS min,
       CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont({c}, 0.25), 4) AS q25,
       round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75
FROM orders"""


@query(_per_column(_DESCRIBE, ["o_orderkey", "o_custkey", "o_totalprice"]))
def describe_numeric(spark, d):
    out = C.describe(table(spark, d, "orders"))
    return out.select("name", "count", "min", "max", *[
        F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")])


_SUMMARY = """
SELECT '{c}' AS name, unique_count, null_count, round(null_count * 100.0 / total, 1) AS null_pct,
       position, value, n
FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS n,
             row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS position,
             count(*) OVER () AS unique_count
      FROM orders WHERE {c} IS NOT NULL GROUP BY {c}),
     (SELECT count(*) AS total, count(*) - count({c}) AS null_count FROM orders)
WHERE position <= 30"""


@query(_per_column(_SUMMARY, ["o_custkey", "o_orderstatus", "o_orderpriority"]))
def group_summary(spark, d):
    out = C.group_summary(table(spark, d, "orders"), ["o_custkey", "o_orderstatus",
                                                      "o_orderpriority"])
    return out.withColumn("position", F.col("position").cast("bigint"))


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS row_count FROM
(SELECT CASE WHEN l_quantity < 10 THEN NULL ELSE l_returnflag END AS l_returnflag, l_linestatus
 FROM lineitem) GROUP BY ALL""")
def split_manifest(spark, d):
    li = table(spark, d, "lineitem").withColumn(
        "l_returnflag", F.when(F.col("l_quantity") >= 10, F.col("l_returnflag")))
    return S.split_manifest(li, ["l_returnflag", "l_linestatus"])


@query("""
SELECT source_file, count(*) AS n, count(c_nationkey) AS n_customer, count(s_nationkey) AS n_supplier
FROM (SELECT 'customer' AS source_file, c_nationkey, NULL AS s_nationkey FROM customer
      UNION ALL SELECT 'supplier', NULL, s_nationkey FROM supplier) GROUP BY ALL""")
def union_with_source(spark, d):
    out = S.union_with_source({t: table(spark, d, t) for t in ("customer", "supplier")})
    return out.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_nationkey").alias("n_customer"),
        F.count("s_nationkey").alias("n_supplier"))


@query("""
SELECT column_name AS name FROM (
  SELECT 'l_orderkey' AS column_name, count(l_orderkey) AS n FROM lineitem
  UNION ALL SELECT 'low_tax', count(CASE WHEN l_tax < 0.04 THEN l_tax END) FROM lineitem
  UNION ALL SELECT 'never', count(CASE WHEN l_tax < 0 THEN l_tax END) FROM lineitem
  UNION ALL SELECT 'run_no', 1) WHERE n > 0""")
def kept_columns(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_orderkey", F.when(F.col("l_tax") < 0.04, F.col("l_tax")).alias("low_tax"),
        F.when(F.col("l_tax") < 0, F.col("l_tax")).alias("never"),
        F.when(F.col("l_tax") < 0, F.col("l_tax")).alias("run_no"))
    return spark.createDataFrame([(c,) for c in C.drop_empty_columns(li).columns], "name string")


@query("""
SELECT (SELECT count(*) FROM lineitem) AS rows_before, count(*) AS rows_after,
       CAST(11 AS INTEGER) AS columns_before, CAST(10 AS INTEGER) AS columns_after,
       'l_tax' AS columns_removed FROM lineitem WHERE l_discount <= 0.08""")
def cleaning_summary(spark, d):
    raw = table(spark, d, "lineitem")
    out = C.cleaning_summary(raw, raw.filter("l_discount <= 0.08").drop("l_tax"))
    return out.drop("columns_retained").withColumn(
        "columns_removed", F.array_join("columns_removed", ","))


_CLEANED = """
SELECT '{c}' AS name, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
       round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
       round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max FROM lineitem"""
_CLEANED_TEXT = """
SELECT '{c}' AS name, round((count(*) - count({c})) * 100.0 / count(*), 2) AS null_pct,
       NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max
FROM lineitem"""


@query(_per_column(_CLEANED, LINEITEM_COLUMNS[:8]) + " UNION ALL "
       + _per_column(_CLEANED_TEXT, LINEITEM_COLUMNS[8:]))
def cleaned_columns(spark, d):
    return C.cleaned_columns(table(spark, d, "lineitem")).drop("samples")


@query(_per_column("""
SELECT '{c}' AS name, unique_count, position, value, n FROM (
  SELECT {c} AS value, count(*) AS n, count(*) OVER () AS unique_count,
         row_number() OVER (ORDER BY count(*) DESC, {c}) AS position
  FROM part GROUP BY {c}) WHERE position <= 10 AND unique_count < 50""",
                   ["p_name", "p_brand", "p_type"]))
def categorical_values(spark, d):
    return C.categorical_values(table(spark, d, "part")).withColumn(
        "position", F.col("position").cast("bigint"))


@query("""
WITH r(rule, hits) AS (
  SELECT 'tax', count(CASE WHEN l_tax > 0.03 THEN 1 END) FROM lineitem
  UNION ALL SELECT 'discount', count(CASE WHEN l_discount >= 0.09 THEN 1 END) FROM lineitem
  UNION ALL SELECT 'quantity', count(CASE WHEN l_quantity > 49 THEN 1 END) FROM lineitem),
t AS (SELECT count(*) AS rows_before FROM lineitem)
SELECT rule, rows_before, rows_before - hits AS rows_after,
  round((rows_before - hits) / rows_before, 4) AS retained,
  CASE WHEN (rows_before - hits) / rows_before < 0.5 THEN 'error'
       WHEN hits / rows_before > 0.1 THEN 'warning' ELSE 'ok' END AS status FROM r, t""")
def retention_guard(spark, d):
    flagged = C.flag_anomalies(table(spark, d, "lineitem"), {
        "tax": "l_tax > 0.03", "discount": "l_discount >= 0.09", "quantity": "l_quantity > 49"})
    total = flagged.agg(F.count(F.lit(1)).alias("rows_before"))
    return C.retention(C.anomaly_counts(flagged).join(F.broadcast(total), F.lit(True)).select(
        "rule", "rows_before", (F.col("rows_before") - F.col("n")).alias("rows_after")))


@query("""
SELECT 'run_no' AS name, count(*) - count(r) AS null_count,
       round((count(*) - count(r)) / count(*), 4) AS null_fraction, count(*) AS row_count,
       (count(*) - count(r)) > 0.95 * count(*) AS flagged
FROM (SELECT CASE WHEN l_quantity >= 49 THEN l_orderkey END AS r FROM lineitem)
UNION ALL SELECT 'column', 0, 0.0, count(*), false FROM lineitem""")
def protected_audit(spark, d):
    li = table(spark, d, "lineitem").select(
        F.when(F.col("l_quantity") >= 49, F.col("l_orderkey")).alias("run_no"),
        F.col("l_returnflag").alias("column"))
    return C.protected_audit(li)


@query("""
SELECT 'negative_balance' AS rule, count(CASE WHEN c_acctbal < 0 THEN 1 END) AS n FROM customer
UNION ALL SELECT 'rich', count(CASE WHEN c_acctbal > 9000 THEN 1 END) FROM customer""")
def anomaly_flags(spark, d):
    return C.anomaly_counts(C.flag_anomalies(table(spark, d, "customer"), {
        "negative_balance": "c_acctbal < 0", "rich": "c_acctbal > 9000"}))


@query("""
SELECT c_mktsegment, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
GROUP BY ALL""")
def annotate_conditions(spark, d):
    conditions = (table(spark, d, "customer")
                  .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                  .select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name"))
    out = C.annotate(table(spark, d, "orders"), conditions, "o_custkey")
    return out.groupBy("c_mktsegment", "n_name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_mktsegment AS segment,
       CAST(c_nationkey AS VARCHAR) AS nation FROM customer""")
def condition_map(spark, d):
    out = C.condition_map(table(spark, d, "customer").select(
        "c_custkey", "c_mktsegment", "c_nationkey"))
    return out.select("run_id", F.col("conditions")["c_mktsegment"].alias("segment"),
                      F.col("conditions")["c_nationkey"].alias("nation"))


@query("""
SELECT 'all_null_column' AS name, 'gone' AS ref, false AS passed
FROM (SELECT count(n) AS k FROM (SELECT NULL::DOUBLE AS n FROM lineitem)) WHERE k = 0
UNION ALL SELECT 'missing_preserved_column', 'batch', false
UNION ALL SELECT 'zero_rows', NULL, false FROM (SELECT count(*) AS k FROM lineitem) WHERE k = 0""")
def table_checks(spark, d):
    li = table(spark, d, "lineitem").withColumn("gone", F.lit(None).cast("double"))
    return C.validate_cleaned(li, ["l_quantity", "batch", "GONE"]).select("name", "ref", "passed")


@query("""
SELECT o_orderkey AS order_key, o_orderstatus AS status, o_totalprice AS total_price, o_orderpriority AS total_price_2
FROM orders""")
def standard_names(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("Order Key"), F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("Total-Price"), F.col("o_orderpriority").alias("total price"))
    return C.standardise_names(o)


_SHAPE = """
SELECT '{c}' AS name, quantile_cont(length(CAST({c} AS VARCHAR)), 0.5) AS median_length,
       avg(CASE WHEN TRY_CAST(CAST({c} AS VARCHAR) AS TIMESTAMP) IS NULL THEN 0.0 ELSE 1.0 END) AS datetime_share
FROM orders"""


@query(_per_column(_SHAPE, ["o_orderstatus", "o_orderpriority", "o_orderdate"]))
def text_shapes(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"))
    return P.text_shape(o, o.columns)
