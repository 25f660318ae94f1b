"""Profiling queries: roles, relations, groupings, distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.plans import columns as cols
from assay.plans import groupings, relations
from catalog.registry import query, table

LINEITEM_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice "
                    "l_discount l_tax l_returnflag l_linestatus l_shipdate").split()
KEYS = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
ORDINAL = ["l_linenumber", "l_quantity", "l_discount", "l_tax"]
MEASURES = ["l_extendedprice"]


def _per_column(template: str, names) -> str:
    return " UNION ALL ".join(template.format(c=c, i=i) for i, c in enumerate(names))


_STATS = """
SELECT CAST({i} AS INTEGER) AS ordinal, '{c}' AS name, count(*) AS row_count,
       count(DISTINCT {c}) AS cardinality,
       CAST(round(CAST(count(DISTINCT {c}) / count(*) AS DECIMAL(20, 12)), 4) AS DOUBLE) AS cardinality_ratio,
       count(*) - count({c}) AS null_count,
       CAST(round(CAST((count(*) - count({c})) / count(*) AS DECIMAL(20, 12)), 4) AS DOUBLE) AS null_fraction
FROM lineitem"""


@query(_per_column(_STATS, LINEITEM_COLUMNS))
def column_stats(spark, d):
    return cols.column_stats(table(spark, d, "lineitem")).drop("dtype")


_NUMERIC_ROLE = """
SELECT '{c}' AS name,
       CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant'
            WHEN count(DISTINCT {c}) <= 50 AND count(DISTINCT {c}) < 0.05 * count(*)
              THEN 'ordinal_stage'
            WHEN count(DISTINCT {c}) >= 0.95 * count(*) AND typeof(min({c})) IN ('BIGINT', 'INTEGER')
              THEN 'identifier'
            WHEN stddev_samp({c}) > 0 THEN 'continuous_measurement' ELSE 'constant' END AS role
FROM {t}"""
_TEXT_ROLE = """
SELECT '{c}' AS name,
       CASE WHEN count(DISTINCT {c}) <= 1 THEN 'constant'
            WHEN count(DISTINCT {c}) >= 0.95 * count(*)
              THEN CASE WHEN median(length({c})) >= 20 THEN 'metadata_text' ELSE 'identifier' END
            WHEN count(DISTINCT {c}) <= 50 AND count(DISTINCT {c}) < 0.05 * count(*)
              THEN CASE WHEN (SELECT avg(CASE WHEN regexp_matches(trim(v), '^[A-Za-z]*[0-9]+$')
                                              OR regexp_matches(trim(v), '^[0-9]+(\\.[0-9]+)?$')
                                         THEN 1.0 ELSE 0.0 END)
                              FROM (SELECT DISTINCT {c} AS v FROM {t} ORDER BY v LIMIT 20)) >= 0.6
                        THEN 'ordinal_stage' ELSE 'categorical_group' END
            WHEN median(length({c})) >= 20 THEN 'metadata_text'
            WHEN count(DISTINCT {c}) <= 50 THEN 'categorical_group' ELSE 'metadata_text' END AS role
FROM {t}"""


def _roles_sql(t, numeric, text, dates):
    parts = [_NUMERIC_ROLE.format(c=c, t=t) for c in numeric]
    parts += [_TEXT_ROLE.format(c=c, t=t) for c in text]
    parts += [f"SELECT '{c}' AS name, 'datetime' AS role" for c in dates]
    return " UNION ALL ".join(parts)


@query(_roles_sql("lineitem", LINEITEM_COLUMNS[:8], ["l_returnflag", "l_linestatus"],
                  ["l_shipdate"]))
def column_roles(spark, d):
    return cols.column_roles(table(spark, d, "lineitem")).select("name", "role")


@query(_roles_sql("part", ["p_partkey", "p_size", "p_retailprice"],
                  ["p_name", "p_brand", "p_type"], []))
def column_roles_text(spark, d):
    return cols.column_roles(table(spark, d, "part")).select("name", "role")


_ORDINAL = """
SELECT '{c}' AS name, round(avg(CASE WHEN regexp_matches(trim(v), '^[A-Za-z]*[0-9]+$')
    OR regexp_matches(trim(v), '^[0-9]+(\\.[0-9]+)?$') THEN 1.0 ELSE 0.0 END), 6) AS ordinal_share
FROM (SELECT DISTINCT {c} AS v FROM part ORDER BY v LIMIT 20)"""


@query(_per_column(_ORDINAL, ["p_brand", "p_type", "p_name"]))
def ordinal_share(spark, d):
    return cols.ordinal_share(table(spark, d, "part"), ["p_brand", "p_type", "p_name"]).select(
        "name", F.round("ordinal_share", 6).alias("ordinal_share"))


_TOP = """
SELECT name, value, n, position FROM (
  SELECT '{c}' AS name, CAST({c} AS VARCHAR) AS value, count(*) AS n,
         row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS position
  FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}) WHERE position <= 10"""


@query(_per_column(_TOP, KEYS))
def value_counts_top(spark, d):
    return cols.value_counts(table(spark, d, "lineitem"), KEYS, 10).withColumn(
        "position", F.col("position").cast("bigint"))


_CONT = """
SELECT '{c}' AS name, count({c}) AS n, CAST(min({c}) AS DOUBLE) AS min,
       CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean,
       round(stddev_samp({c}), 4) AS std, round(median({c}), 4) AS median
FROM lineitem"""
CONTINUOUS = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(_per_column(_CONT, CONTINUOUS))
def continuous_stats(spark, d):
    out = cols.continuous_stats(table(spark, d, "lineitem"), CONTINUOUS)
    return out.select("name", "n", "min", "max",
                      *[F.round(c, 4).alias(c) for c in ("mean", "std", "median")])


_CV = """
SELECT '{c}' AS name, count(*) AS levels, round(stddev_samp(n) / avg(n), 6) AS size_cv
FROM (SELECT count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c})"""


@query(_per_column(_CV, KEYS))
def level_size_cv(spark, d):
    return cols.level_size_cv(table(spark, d, "lineitem"), KEYS).select(
        "name", "levels", F.round("size_cv", 6).alias("size_cv"))


def _pair_sql(a, b, source):
    return f"""
SELECT '{a}' AS col_a, '{b}' AS col_b,
       count(DISTINCT {a}) AS n_a, count(DISTINCT {b}) AS n_b,
       count(DISTINCT ({a}, {b})) AS n_ab,
       (SELECT count(DISTINCT {a}) FROM {source}) AS all_a,
       (SELECT count(DISTINCT {b}) FROM {source}) AS all_b
FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"""


def _relations_sql(names, source):
    pairs = [_pair_sql(a, b, source) for i, a in enumerate(names) for b in names[i + 1:]]
    return f"""
SELECT col_a, col_b, n_a, n_b, n_ab,
  CASE WHEN n_ab = n_a AND n_ab = n_b AND all_a = all_b THEN 'redundant'
       WHEN n_ab = n_a AND n_ab <> n_b THEN 'nested_a_in_b'
       WHEN n_ab = n_b AND n_ab <> n_a THEN 'nested_b_in_a'
       WHEN n_ab / (n_a * n_b) >= 0.8 THEN 'crossed' ELSE 'partial_overlap' END AS relationship,
  CASE WHEN n_ab = n_a OR n_ab = n_b THEN 1.0 ELSE round(n_ab / (n_a * n_b), 4) END::DOUBLE AS strength
FROM ({' UNION ALL '.join(pairs)})"""


_GEO = ("(SELECT n_nationkey, n_name, n_regionkey, r_name, c_mktsegment FROM customer "
        "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)")
GEO_COLUMNS = ["n_nationkey", "n_name", "n_regionkey", "r_name", "c_mktsegment"]


@query(_relations_sql(GEO_COLUMNS, _GEO))
def relations_nested(spark, d):
    geo = (table(spark, d, "customer")
           .join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
           .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(*GEO_COLUMNS))
    return relations.relationships(geo, GEO_COLUMNS)


@query(_relations_sql(KEYS, "lineitem"))
def relations_crossed(spark, d):
    return relations.relationships(table(spark, d, "lineitem"), KEYS)


def _grouping_sql(keys, ordinal, measures):
    parts = []
    for i, key in enumerate(keys):
        ks = ", ".join(key)
        means = ", ".join(f"avg({m}) AS m{j}" for j, m in enumerate(measures))
        discs = ", ".join(f"abs(stddev_samp(m{j}) / avg(m{j}))" for j in range(len(measures)))
        label = ",".join(key)
        parts.append(f"""
SELECT '{label}' AS key, count(*) AS group_count, min(n) AS min_group_size,
       median(n) AS median_group_size, coalesce(stddev_samp(n) / avg(n), 0) AS cv,
       round(sum(n) / (SELECT count(*) FROM lineitem) * 100, 1) AS rows_covered_pct,
       list_aggregate([{discs}], 'median') AS disc, {len(key)} AS width,
       {any(c in ordinal for c in key)} AS has_ordinal
FROM (SELECT count(*) AS n, {means} FROM lineitem GROUP BY {ks})""")
    return f"""
WITH g AS ({' UNION ALL '.join(parts)})
SELECT key, group_count, CAST(min_group_size AS BIGINT) AS min_group_size,
  round(median_group_size, 1) AS median_group_size, round(cv, 3) AS size_cv, rows_covered_pct,
  round(disc, 6) AS discriminability,
  round(least(1.0,
    CASE WHEN group_count BETWEEN 5 AND 200 THEN 0.35
         WHEN group_count < 5 THEN 0.35 * group_count / 5.0
         ELSE 0.35 * (1.0 - (group_count - 200) / 300.0) END
    + CASE WHEN min_group_size >= 5 THEN 0.25 WHEN min_group_size >= 2 THEN 0.25 * min_group_size / 5.0 ELSE 0 END
    + 0.20 * CASE WHEN disc > 0 THEN least(disc, 1.0) WHEN cv < 2 THEN greatest(0, 1.0 - cv) ELSE 0 END
    + 0.20 * rows_covered_pct / 100.0
    + CASE WHEN has_ordinal THEN 0.15 ELSE 0 END
    + least(0.10 * (width - 1), 0.30)), 4) AS score
FROM g WHERE group_count BETWEEN 2 AND 500"""


@query(_grouping_sql(groupings.candidate_keys(KEYS), ORDINAL, MEASURES))
def ranked_groupings(spark, d):
    out = groupings.rank_groupings(table(spark, d, "lineitem"), KEYS, MEASURES, ordinal=ORDINAL)
    return out.select(
        F.array_join("columns", ",").alias("key"), "group_count", "min_group_size",
        "median_group_size", "size_cv", "rows_covered_pct", "discriminability", "score")


@query(_grouping_sql([("l_returnflag", "l_linestatus")], ORDINAL, ["l_extendedprice", "l_tax", "l_discount"]))
def evaluated_grouping(spark, d):
    out = groupings.evaluate_groupings(
        table(spark, d, "lineitem"), [["l_returnflag", "l_linestatus"]],
        ["l_extendedprice", "l_tax", "l_discount"], ordinal=ORDINAL)
    return out.select(
        F.array_join("columns", ",").alias("key"), "group_count", "min_group_size",
        "median_group_size", "size_cv", "rows_covered_pct", "discriminability", "score")


def _distinct_key_sql(keys):
    return " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS key_id, count(*) AS groups FROM "
        f"(SELECT DISTINCT {', '.join(k)} FROM lineitem WHERE "
        + " AND ".join(f"{c} IS NOT NULL" for c in k) + ")"
        for i, k in enumerate(keys))


DRILL = [["l_returnflag"], ["l_returnflag", "l_linestatus"],
         ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_suppkey", "l_returnflag"]]


@query(_distinct_key_sql(DRILL))
def distinct_key_counts(spark, d):
    return groupings.count_distinct_keys(table(spark, d, "lineitem"), DRILL)
