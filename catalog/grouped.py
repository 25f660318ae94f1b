"""Queries on grouped statistics, hypothesis tests and correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import correlation as R
from assay.operators import grouped as G
from assay.operators import hypothesis as H
from assay.plans import distributions as D
from assay.plans.groupings import candidate_keys, rank_groupings
from catalog.profile import KEYS, ORDINAL, _grouping_sql, _per_column
from catalog import tails_sql as P
from catalog.registry import query, table

METRICS = ["l_quantity", "l_extendedprice", "l_discount"]
FLAGS = ["l_returnflag", "l_linestatus"]


def _rounded(df, cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


_STATS = """
SELECT {k}, '{c}' AS metric, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max,
  round(stddev_samp({c}) / avg({c}), 6) AS cv, round(skewness({c}), 6) AS skew,
  round(median({c}), 6) AS median FROM lineitem GROUP BY {k}"""


@query(" UNION ALL ".join(_STATS.format(k="l_returnflag, l_linestatus", c=m) for m in METRICS))
def group_stats(spark, d):
    return _rounded(G.group_stats(table(spark, d, "lineitem"), FLAGS, METRICS),
                    ["mean", "std", "cv", "skew", "median"])


_MEANS = " UNION ALL ".join(
    f"SELECT concat_ws('__', l_suppkey, l_returnflag) AS group_key, '{m}' AS metric, "
    f"avg({m}) AS value FROM lineitem GROUP BY l_suppkey, l_returnflag" for m in METRICS)


def _supplier_means(spark, d):
    stats = G.group_stats(table(spark, d, "lineitem"), ["l_suppkey", "l_returnflag"], METRICS,
                          median=False)
    return stats.select(G.group_key(["l_suppkey", "l_returnflag"]).alias("group_key"), "metric",
                        F.col("mean").alias("value"))


@query(f"""
WITH m AS ({_MEANS}), g AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS metric_mean FROM m)
SELECT group_key, metric, round(value, 4) AS value, round(metric_mean, 4) AS metric_mean,
       round(abs(value - metric_mean), 4) AS deviation, position FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY abs(value - metric_mean) DESC, group_key)
    AS position FROM g) WHERE position <= 5""")
def top_deviants(spark, d):
    out = G.deviations(_supplier_means(spark, d), 5)
    return out.select("group_key", "metric", *[F.round(c, 4).alias(c) for c in (
        "value", "metric_mean", "deviation")], F.col("position").cast("bigint").alias("position"))


@query(f"""
WITH m AS ({_MEANS}),
s AS (SELECT metric, avg(value) AS mu, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1,
             quantile_cont(value, 0.75) AS q3 FROM m GROUP BY metric)
SELECT group_key, metric, round(value, 4) AS value, round((value - mu) / sd, 4) AS z,
  abs((value - mu) / sd) > 2 AS z_outlier,
  value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS iqr_outlier
FROM m JOIN s USING (metric)""")
def outlier_flags(spark, d):
    return _rounded(G.outlier_flags(_supplier_means(spark, d)), ["value", "z"], 4)


@query("""
SELECT l_suppkey, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv,
       stddev_samp(l_quantity) / avg(l_quantity) > 0.58 AS unstable
FROM lineitem GROUP BY l_suppkey""")
def cv_threshold_label(spark, d):
    return _rounded(G.cv_label(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", 0.58,
                               "unstable"), ["cv"])


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3
           FROM orders)
SELECT o_orderstatus, count(CASE WHEN o_totalprice < q1 - 0.5 * (q3 - q1) OR o_totalprice > q3 + 0.5 * (q3 - q1) THEN 1 END) AS n_out,
       count(*) AS n FROM orders, q GROUP BY o_orderstatus""")
def iqr_label(spark, d):
    out = G.iqr_label(table(spark, d, "orders"), "o_totalprice", "out", 0.5)
    return out.groupBy("o_orderstatus").agg(F.count_if("out").alias("n_out"),
                                            F.count(F.lit(1)).alias("n"))


@query(_per_column("""
SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS level, round(avg(l_extendedprice), 4) AS mean,
       round(stddev_samp(l_extendedprice), 4) AS std, count(*) AS n FROM lineitem GROUP BY {c}""",
                   ["l_linenumber", "l_suppkey"]))
def secondary_summary(spark, d):
    return _rounded(G.secondary_summary(
        table(spark, d, "lineitem"), [*FLAGS, "l_linenumber", "l_suppkey"], FLAGS,
        "l_extendedprice"), ["mean", "std"], 4)


@query("""
WITH m AS (SELECT 'customer' AS dataset, CAST(c_nationkey AS VARCHAR) AS group_key, avg(c_acctbal) AS value
           FROM customer GROUP BY c_nationkey
           UNION ALL SELECT 'supplier', CAST(s_nationkey AS VARCHAR), avg(s_acctbal) FROM supplier
           GROUP BY s_nationkey),
g AS (SELECT *, avg(value) OVER (PARTITION BY dataset) AS dm FROM m)
SELECT dataset, group_key, 'balance' AS metric, round(value, 4) AS value,
       round(dm, 4) AS dataset_mean, round((value - dm) / abs(dm) * 100, 4) AS deviation_pct FROM g""")
def compare_datasets(spark, d):
    frames = {t: table(spark, d, t).withColumnsRenamed(
        {f"{p}_nationkey": "nation", f"{p}_acctbal": "balance"})
        for t, p in (("customer", "c"), ("supplier", "s"))}
    return _rounded(G.compare_datasets(frames, ["nation"], ["balance"]),
                    ["value", "dataset_mean", "deviation_pct"], 4)


@query("""
WITH m AS (SELECT l_linenumber, l_returnflag, avg(l_extendedprice) AS mean FROM lineitem GROUP BY ALL),
g AS (SELECT *, (mean - avg(mean) OVER (PARTITION BY l_returnflag))
      / abs(avg(mean) OVER (PARTITION BY l_returnflag)) * 100 AS p FROM m)
SELECT l_linenumber, round(max(CASE WHEN l_returnflag = 'A' THEN p END), 6) AS "A",
  round(max(CASE WHEN l_returnflag = 'N' THEN p END), 6) AS "N",
  round(max(CASE WHEN l_returnflag = 'R' THEN p END), 6) AS "R" FROM g GROUP BY l_linenumber""")
def deviation_matrix(spark, d):
    return _rounded(G.deviation_matrix(table(spark, d, "lineitem"), "l_linenumber", "l_returnflag",
                                       "l_extendedprice", ["A", "N", "R"]), ["A", "N", "R"])


@query("""
SELECT o_custkey, count(o_totalprice)::DOUBLE AS o_totalprice_count,
  round(avg(o_totalprice), 6) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 6) AS o_totalprice_std,
  min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max,
  round(median(o_totalprice), 6) AS o_totalprice_median,
  round(stddev_samp(o_totalprice) / avg(o_totalprice), 6) AS o_totalprice_cv
FROM orders GROUP BY o_custkey""")
def wide_features(spark, d):
    out = G.wide_features(table(spark, d, "orders"), ["o_custkey"], ["o_totalprice"])
    return _rounded(out, [f"o_totalprice_{s}" for s in ("mean", "std", "median", "cv")], 6).drop(
        "o_totalprice_skew")


def _deviants_sql():
    """Top five keys, and the three most deviant groups of the best one for each metric."""
    keys = candidate_keys(KEYS)
    labels = ", ".join(f"'{','.join(k)}'" for k in keys)
    means = " UNION ALL ".join(
        f"SELECT '{','.join(k)}' AS key, concat_ws('__', {', '.join(k)}) AS gk, avg(l_extendedprice) AS p, avg(l_tax) AS t "
        f"FROM lineitem GROUP BY {', '.join(k)}" for k in keys)
    return f"""WITH scored AS ({_grouping_sql(keys, ORDINAL, ["l_extendedprice"])}),
top AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, list_position([{labels}], key)) AS rn FROM scored),
groups AS ({means}),
v AS (SELECT key, gk, unnest(['l_extendedprice', 'l_tax']) AS metric, unnest([p, t]) AS value FROM groups JOIN top USING (key) WHERE rn = 1),
d AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY metric)) AS dev, avg(value) OVER (PARTITION BY metric) AS mu FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY dev DESC, gk) AS position FROM d)
SELECT 'grouping' AS part, key, score AS value FROM top WHERE rn <= 5
UNION ALL SELECT 'deviant', concat_ws(':', key, metric, gk), round(dev / abs(mu) * 100, 4) FROM n WHERE position <= 3"""


@query(_deviants_sql())
def grouping_with_deviants(spark, d):
    """Ranked keys of line items, and the groups of the best key that deviate most."""
    li = table(spark, d, "lineitem")
    ranked = rank_groupings(li, KEYS, ["l_extendedprice"], ordinal=ORDINAL).limit(5)
    best = ranked.first()["columns"]
    stats = G.group_stats(li, best, ["l_extendedprice", "l_tax"], median=False).select(
        G.group_key(best).alias("group_key"), "metric", F.col("mean").alias("value"))
    deviants = G.deviations(stats, 3).select(
        F.lit("deviant").alias("part"), F.concat_ws(":", F.lit(",".join(best)), "metric",
                                                    "group_key").alias("key"),
        F.round("relative_pct", 4).alias("value"))
    keys = ranked.select(F.lit("grouping").alias("part"), F.array_join("columns", ",").alias("key"),
                         F.col("score").alias("value"))
    return keys.unionByName(deviants)


# Shapes of distributions ------------------------------------------------------

_SHAPE = """
SELECT '{c}' AS name, count({c}) AS n, round(skewness({c}), 4) AS skewness,
  round(kurtosis({c}), 4) AS kurtosis,
  CASE WHEN abs(skewness({c})) >= 2 AND min({c}) > 0 THEN 'log'
       WHEN abs(skewness({c})) >= 1 AND min({c}) >= 0 THEN 'sqrt' END AS suggested_transform
FROM {t}"""


@query(_SHAPE.format(c="value", t="events") + " UNION ALL "
       + _SHAPE.format(c="spread", t="(SELECT value * value * value AS spread FROM events)"))
def distribution_moments(spark, d):
    ev = table(spark, d, "events").withColumn("spread", F.expr("value * value * value"))
    return D.shapes(ev, ["value", "spread"]).select(
        "name", "n", "skewness", "kurtosis", "suggested_transform")


@query()
def distribution_profile(spark, d):
    docs = table(spark, d, "documents").withColumn("log_chars", F.log(F.col("n_chars") + 1.0))
    return D.distribution_profile(docs, ["n_chars", "log_chars"])


_GRID = """
WITH s AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM events),
b AS (SELECT least(4095, floor((value - lo) / (hi - lo) * 4096)) AS bin, count(*) AS w,
             sum(value) / count(*) AS c FROM events, s GROUP BY 1),
g AS (SELECT unnest(range(512)) AS grid)
SELECT 'value' AS name, CAST(grid AS INTEGER) AS grid,
  round(sum(w * exp(-0.5 * pow((lo + grid * (hi - lo) / 511.0 - c) / (sd * pow(n, -0.2)), 2))
      / (n * sd * pow(n, -0.2) * 2.5066282746310002)), 8) AS density
FROM b, s, g WHERE abs(lo + grid * (hi - lo) / 511.0 - c) <= 9.0 * sd * pow(n, -0.2) GROUP BY grid"""


@query(_GRID)
def kernel_density(spark, d):
    return D.density(table(spark, d, "events"), ["value"]).select(
        "name", "grid", F.round("density", 8).alias("density"))


@query("""
SELECT CAST(event_id AS BIGINT) AS event_id, round(CASE WHEN value > 0 THEN ln(value) END, 6) AS log_value,
       round(CASE WHEN value >= 0 THEN sqrt(value) END, 6) AS sqrt_value FROM events""")
def variance_transform(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    out = D.apply_transform(D.apply_transform(ev, "value", "log"), "value", "sqrt")
    return _rounded(out.drop("value"), ["log_value", "sqrt_value"])


# Hypothesis tests --------------------------------------------------------------

@query("""
WITH m AS (SELECT event_type, avg(CASE WHEN u = 0 THEN value END) AS a, avg(CASE WHEN u = 1 THEN value END) AS b,
  var_samp(CASE WHEN u = 0 THEN value END) AS va, var_samp(CASE WHEN u = 1 THEN value END) AS vb,
  count(CASE WHEN u = 0 THEN 1 END) AS na, count(CASE WHEN u = 1 THEN 1 END) AS nb
  FROM (SELECT event_type, value, user_id % 2 AS u FROM events) GROUP BY event_type)
SELECT event_type, na AS n_a, nb AS n_b, round((a - b) / sqrt(va / na + vb / nb), 6) AS t,
  round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df
FROM m""")
def welch_t_test(spark, d):
    ev = table(spark, d, "events").withColumn("u", F.col("user_id") % 2)
    out = H.t_test(ev, ["event_type"], "u", "value", 0, 1)
    return out.select("event_type", "n_a", "n_b", F.round("t", 6).alias("t"),
                      F.round("df", 4).alias("df"))


_RANKS = """ranked AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v)
    + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0 AS r FROM rows_)"""


@query(f"""
WITH rows_ AS (SELECT event_type, value AS v, user_id % 2 AS g FROM events),
{_RANKS.format(by='event_type')},
t AS (SELECT event_type, sum(pow(n, 3) - n) AS ties FROM (SELECT event_type, v, count(*) AS n FROM rows_ GROUP BY ALL) GROUP BY event_type),
u AS (SELECT event_type, count(CASE WHEN g = 0 THEN 1 END) AS n_a, count(CASE WHEN g = 1 THEN 1 END) AS n_b,
  sum(CASE WHEN g = 0 THEN r END) - count(CASE WHEN g = 0 THEN 1 END) * (count(CASE WHEN g = 0 THEN 1 END) + 1) / 2.0 AS u
  FROM ranked GROUP BY event_type)
SELECT event_type, n_a, n_b, round(u, 4) AS u, round({P.u_two_sided('u', 'n_a', 'n_b', 'ties')}, 8) AS p FROM u JOIN t USING (event_type)""")
def mann_whitney_u(spark, d):
    ev = table(spark, d, "events").withColumn("g", F.col("user_id") % 2)
    return H.mann_whitney(ev, ["event_type"], "g", "value", 0, 1).select(
        "event_type", "n_a", "n_b", F.round("u", 4).alias("u"), F.round("p", 8).alias("p"))


_ANOVA = """
WITH c AS (SELECT {g} AS g, count(*) AS n, avg({v}) AS m, var_samp({v}) AS s2 FROM {t} GROUP BY 1),
t AS (SELECT sum(n * m) / sum(n) AS mu FROM c),
s AS (SELECT count(*) AS k, sum(n) AS total, sum(n * pow(m - mu, 2)) AS ssb,
             sum((n - 1) * coalesce(s2, 0)) AS ssw, sum(n * n) AS n2 FROM c, t)"""


@query(_ANOVA.format(g="o_orderpriority", v="o_totalprice", t="orders") + """
SELECT k, CAST(total AS BIGINT) AS total, round((ssb / (k - 1)) / (ssw / (total - k)), 6) AS f,
       round(ssb / (ssb + ssw), 8) AS eta_squared FROM s""")
def one_way_anova(spark, d):
    return H.anova(table(spark, d, "orders"), [], "o_orderpriority", "o_totalprice").select(
        "k", "total", F.round("f", 6).alias("f"), F.round("eta_squared", 8).alias("eta_squared"))


_KW = f"""
WITH rows_ AS (SELECT 1 AS one, o_totalprice AS v, o_orderpriority AS g FROM orders),
{_RANKS.format(by='one')},
n AS (SELECT count(*)::DOUBLE AS n FROM ranked),
ties AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM ranked GROUP BY v)),
s AS (SELECT g, count(*) AS ng, sum(r) AS rs FROM ranked GROUP BY g)"""


@query(_KW + """,
h AS (SELECT count(*) AS k, max(n) AS n,
  (12.0 / (max(n) * (max(n) + 1)) * sum(rs * rs / ng) - 3.0 * (max(n) + 1))
  / (1 - max(ties) / (pow(max(n), 3) - max(n))) AS h FROM s, n, ties)
SELECT k, CAST(n AS BIGINT) AS total, round(h, 5) AS h, round((h - k + 1) / (n - k), 8) AS eta_squared FROM h""")
def kruskal_wallis(spark, d):
    return H.kruskal_wallis(table(spark, d, "orders"), [], "o_orderpriority", "o_totalprice").select(
        "k", "total", F.round("h", 5).alias("h"), F.round("eta_squared", 8).alias("eta_squared"))


@query(_KW + """
SELECT a.g AS group_a, b.g AS group_b,
  round((a.rs / a.ng - b.rs / b.ng) / sqrt((n * (n + 1) / 12.0 - ties / (12.0 * (n - 1)))
    * (1.0 / a.ng + 1.0 / b.ng)), 6) AS z
FROM s a JOIN s b ON a.g < b.g, n, ties""")
def dunn_post_hoc(spark, d):
    return H.dunn(table(spark, d, "orders"), [], "o_orderpriority", "o_totalprice").select(
        "group_a", "group_b", F.round("z", 6).alias("z"))


@query(_ANOVA.format(g="o_orderpriority", v="o_totalprice", t="orders") + """
SELECT a.g AS group_a, b.g AS group_b, round(abs(a.m - b.m) / sqrt(ssw / (total - s.k) / 2.0
  * (1.0 / a.n + 1.0 / b.n)), 6) AS q FROM c a JOIN c b ON a.g < b.g, s""")
def tukey_hsd(spark, d):
    return H.tukey_q(table(spark, d, "orders"), [], "o_orderpriority", "o_totalprice").select(
        "group_a", "group_b", F.round("q", 6).alias("q"))


@query("""
WITH x AS (SELECT o_orderstatus AS a, o_orderpriority AS b,
             o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS d FROM orders),
t AS (SELECT pow(sum(d), 2) / count(*) AS cf, sum(d * d) AS q, count(*) AS n FROM x),
sa AS (SELECT sum(p) AS p, count(*) AS k FROM (SELECT pow(sum(d), 2) / count(*) AS p FROM x GROUP BY a)),
c AS (SELECT a, b, count(*) AS n, sum(d) AS s FROM x GROUP BY a, b),
w AS (SELECT b, sum(n) AS n, sum(s) AS s, sum(CASE WHEN a = 'F' THEN n ELSE 0 END) AS nf, sum(CASE WHEN a = 'O' THEN n ELSE 0 END) AS no,
             sum(CASE WHEN a = 'F' THEN s ELSE 0 END) AS sf, sum(CASE WHEN a = 'O' THEN s ELSE 0 END) AS so FROM c GROUP BY b),
m AS (SELECT sum(nf - nf * nf / n) AS ff, sum(no - no * no / n) AS oo, -sum(nf * no / n) AS fo,
             sum(sf - nf * s / n) AS rf, sum(so - no * s / n) AS ro FROM w),
-- the first factor (three levels) given the second, so that both orders add up to the same model
ab AS (SELECT (oo * rf * rf - 2 * fo * rf * ro + ff * ro * ro) / (ff * oo - fo * fo) AS p FROM m),
sm AS (SELECT sum(p) AS p, count(*) AS k FROM (SELECT pow(sum(d), 2) / count(*) AS p FROM x GROUP BY b)),
sb AS (SELECT sm.p + ab.p - sa.p + cf AS p, sm.k AS k FROM sm, ab, sa, t),
sc AS (SELECT sum(p) AS p, count(*) AS k FROM (SELECT pow(sum(d), 2) / count(*) AS p FROM x GROUP BY a, b)),
e AS (SELECT (q - sc.p) / (n - sc.k) AS mse, q - cf AS sst FROM t, sc)
SELECT 'o_orderstatus' AS source, sa.k - 1 AS df, round((sa.p - cf) / (sa.k - 1) / mse, 5) AS f,
       round((sa.p - cf) / sst, 8) AS eta_squared FROM sa, t, e
UNION ALL SELECT 'o_orderpriority', sb.k - 1, round((sb.p - cf) / (sb.k - 1) / mse, 5),
       round((sb.p - cf) / sst, 8) FROM sb, t, e
UNION ALL SELECT 'o_orderstatus:o_orderpriority', sc.k - sa.k - sb.k + 1,
  round((sc.p - sa.p - sb.p + cf) / (sc.k - sa.k - sb.k + 1) / mse, 5),
  round((sc.p - sa.p - sb.p + cf) / sst, 8) FROM sa, sb, sc, t, e""")
def two_way_anova(spark, d):
    return H.two_way_anova(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority",
                           "o_totalprice").select(
        "source", "df", F.round("f", 5).alias("f"), F.round("eta_squared", 8).alias("eta_squared"))


@query("""
WITH c AS (SELECT l_suppkey AS u, l_linenumber AS s, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
f AS (SELECT * FROM c WHERE u IN (SELECT u FROM c GROUP BY u HAVING count(*) = (SELECT count(DISTINCT s) FROM c))),
r AS (SELECT *, rank() OVER (PARTITION BY u ORDER BY v) + (count(*) OVER (PARTITION BY u, v) - 1) / 2.0 AS r,
        count(*) OVER (PARTITION BY u, v) AS p FROM f),
t AS (SELECT s, sum(r) AS r, count(*) AS n, sum(p * p - 1) AS ties FROM r GROUP BY s),
z AS (SELECT count(*) AS k, max(n) AS n, sum(r * r) AS ss, sum(ties) AS ties FROM t)
SELECT n, k, round((12.0 / (n * k * (k + 1)) * ss - 3.0 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 6) AS chi2
FROM z""")
def friedman_test(spark, d):
    return H.friedman(table(spark, d, "lineitem"), "l_suppkey", "l_linenumber",
                      "l_extendedprice").select("n", "k", F.round("chi2", 6).alias("chi2"))


@query(_ANOVA.format(g="l_suppkey", v="l_extendedprice", t="lineitem") + """,
v AS (SELECT ssw / (total - k) AS vw, greatest(0, ((ssb / (k - 1)) - ssw / (total - k))
      / ((total - n2 / total) / (k - 1))) AS vb FROM s)
SELECT round(vb, 4) AS var_between, round(vw, 2) AS var_within, round(vb / (vb + vw), 8) AS icc FROM v""")
def variance_components(spark, d):
    return H.variance_components(table(spark, d, "lineitem"), [], "l_suppkey",
                                 "l_extendedprice").select(
        F.round("var_between", 4).alias("var_between"), F.round("var_within", 2).alias("var_within"),
        F.round("icc", 8).alias("icc"))


@query("""
WITH d AS (SELECT o_orderpriority, abs(o_totalprice - median(o_totalprice) OVER (PARTITION BY o_orderpriority)) AS d
           FROM orders),
c AS (SELECT o_orderpriority AS g, count(*) AS n, avg(d) AS m, var_samp(d) AS s2 FROM d GROUP BY 1),
t AS (SELECT sum(n * m) / sum(n) AS mu FROM c),
s AS (SELECT count(*) AS k, sum(n) AS total, sum(n * pow(m - mu, 2)) AS ssb, sum((n - 1) * s2) AS ssw FROM c, t)
SELECT k, CAST(total AS BIGINT) AS total, round((ssb / (k - 1)) / (ssw / (total - k)), 6) AS f FROM s""")
def levene_test(spark, d):
    return H.levene(table(spark, d, "orders"), [], "o_orderpriority", "o_totalprice").select(
        "k", "total", F.round("f", 6).alias("f"))


@query(f"""
WITH o AS (SELECT o_orderpriority AS g, o_orderstatus AS s, o_totalprice AS v FROM orders),
r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM o),
ties AS (SELECT sum(pow(n, 3) - n) AS ties FROM (SELECT count(*) AS n FROM o GROUP BY v)),
c AS (SELECT g, count(*) AS n, avg(v) AS m, var_samp(v) AS s2, sum(r) AS rs FROM r GROUP BY g),
a AS (SELECT count(*) AS k, sum(n) AS total, sum(n * pow(m - (SELECT avg(v) FROM o), 2)) AS ssb, sum((n - 1) * s2) AS ssw,
      sum(rs * rs / n) AS q FROM c),
f AS (SELECT (ssb / (k - 1)) / (ssw / (total - k)) AS f, k - 1 AS d1, (total - k)::DOUBLE AS d2 FROM a),
h AS (SELECT (12.0 / (total * (total + 1)) * q - 3 * (total + 1)) / (1 - ties / (pow(total, 3) - total)) AS h FROM a, ties),
w AS (SELECT s, count(*) AS n, avg(v) AS m, var_samp(v) / count(*) AS e FROM o WHERE s IN ('F', 'O') GROUP BY s),
t AS (SELECT (x.m - y.m) / sqrt(x.e + y.e) AS t, pow(x.e + y.e, 2) / (x.e * x.e / (x.n - 1) + y.e * y.e / (y.n - 1)) AS df
      FROM w x JOIN w y ON x.s = 'F' AND y.s = 'O'),
b AS (SELECT s, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM o WHERE s IN ('F', 'O')),
u AS (SELECT count(CASE WHEN s = 'F' THEN 1 END)::DOUBLE AS na, count(CASE WHEN s = 'O' THEN 1 END)::DOUBLE AS nb,
      sum(CASE WHEN s = 'F' THEN r END) AS ra, (SELECT sum(pow(n, 3) - n) FROM (SELECT count(*) AS n FROM b GROUP BY v)) AS ties FROM b),
v AS (SELECT *, ra - na * (na + 1) / 2.0 AS u FROM u)
SELECT 'anova' AS test, round(f, 6) AS statistic, round({P.f_upper('f', 'd1', 'd2')}, 8) AS p FROM f
UNION ALL SELECT 'kruskal', round(h, 6), round({P.chi2_upper_even('h', 2)}, 8) FROM h
UNION ALL SELECT 't', round(t, 6), round({P.t_two_sided('t', 'df')}, 8) FROM t
UNION ALL SELECT 'u', round(u, 6), round({P.u_two_sided('u', 'na', 'nb', 'ties')}, 8) FROM v""")
def test_p_values(spark, d):
    """p-values of the tests above."""
    orders = table(spark, d, "orders")
    a = H.anova(orders, [], "o_orderpriority", "o_totalprice").select(
        F.lit("anova").alias("test"), F.col("f").alias("statistic"), "p")
    k = H.kruskal_wallis(orders, [], "o_orderpriority", "o_totalprice").select(
        F.lit("kruskal"), "h", "p")
    t = H.t_test(orders, [], "o_orderstatus", "o_totalprice", "F", "O").select(F.lit("t"), "t", "p")
    u = H.mann_whitney(orders, [], "o_orderstatus", "o_totalprice", "F", "O").select(
        F.lit("u"), "u", "p")
    return a.union(k).union(t).union(u).select("test", F.round("statistic", 6).alias("statistic"), F.round("p", 8).alias("p"))


# Correlation ---------------------------------------------------------------------

CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_PAIRS = [(a, b) for i, a in enumerate(CORR) for b in CORR[i + 1:]]


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS r, count(*) AS n FROM lineitem"
    for a, b in _PAIRS))
def pearson_matrix(spark, d):
    return R.pearson(table(spark, d, "lineitem"), CORR).select(
        "col_a", "col_b", F.round("r", 8).alias("r"), "n")


_AVG_RANK = ("rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}")


@query("WITH r AS (SELECT " + ", ".join(_AVG_RANK.format(c=c) for c in CORR) + " FROM lineitem) "
       + " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 8) AS r FROM r"
                            for a, b in _PAIRS))
def spearman_matrix(spark, d):
    return R.spearman(table(spark, d, "lineitem"), CORR).select(
        "col_a", "col_b", F.round("r", 8).alias("r"))


@query("""
WITH r AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS s,
  rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS v
  FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS s, o_totalprice AS v FROM orders))
SELECT 'o_orderpriority' AS stage, 'o_totalprice' AS metric, round(corr(s, v), 8) AS r FROM r""")
def stage_trend(spark, d):
    return R.stage_trend(table(spark, d, "orders"), "o_orderpriority", ["o_totalprice"]).select(
        "stage", "metric", F.round("r", 8).alias("r"))


@query("""
SELECT o_orderstatus, regr_count(o_totalprice, t)::BIGINT AS n, round(regr_slope(o_totalprice, t), 6) AS slope,
       round(regr_r2(o_totalprice, t), 8) AS r2
FROM (SELECT *, epoch(o_orderdate) / 86400.0 AS t FROM orders) GROUP BY o_orderstatus""")
def linear_trend(spark, d):
    orders = table(spark, d, "orders").withColumn(
        "t", F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400.0)
    return R.linear_trend(orders, ["o_orderstatus"], "t", "o_totalprice").select(
        "o_orderstatus", "n", F.round("slope", 6).alias("slope"), F.round("r2", 8).alias("r2"))


@query("""
WITH m AS (SELECT l_suppkey, l_linenumber, avg(l_quantity) AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY ALL)
SELECT round(corr(q, p), 8) AS r, count(*) AS n FROM m""")
def aggregated_correlation(spark, d):
    means = R.aggregate_first(table(spark, d, "lineitem"), ["l_suppkey", "l_linenumber"],
                              ["l_quantity", "l_extendedprice"])
    return R.pearson(means, ["l_quantity", "l_extendedprice"]).select(
        F.round("r", 8).alias("r"), "n")


@query()
def pca_loadings(spark, d):
    return R.pca(table(spark, d, "lineitem"), CORR, 2)


@query()
def kmeans_clusters(spark, d):
    out = R.clusters(table(spark, d, "events"), ["value"], 3)
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query()
def gaussian_mixture(spark, d):
    out = R.clusters(table(spark, d, "events"), ["value"], 2, "gmm")
    return out.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("""
SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_extendedprice), 4) AS mean
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus, l_linenumber)""")
def hierarchy_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean"))
