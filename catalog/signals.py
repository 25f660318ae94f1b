"""Queries on traces and spectra. A trace is one user's events in time order."""

from __future__ import annotations

from pyspark.sql import functions as F

from assay.operators import grouped as G
from assay.operators import spectra as M
from assay.operators import traces as T
from catalog.grouped import _rounded
from catalog.registry import query, table

TRACE, TIE = ["user_id"], ["event_id"]


def _trace(spark, d):
    """Events as points: x in hours since the start of 2024."""
    origin = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - origin
    return table(spark, d, "events").select(
        "user_id", "event_id", "event_type", (micros / F.lit(3.6e9)).alias("x"), "value")


_T = """t AS (SELECT user_id, event_id, event_type, value,
  (epoch_us(ts) - 1704067200000000) / 3.6e9 AS x FROM events)"""
_W = "PARTITION BY user_id ORDER BY x, event_id"


@query(f"""WITH {_T} SELECT event_id,
  min(value) OVER ({_W} ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING) AS baseline,
  round(value - min(value) OVER ({_W} ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING), 6) AS corrected
FROM t""")
def rolling_baseline(spark, d):
    out = T.rolling_baseline(_trace(spark, d), TRACE, "x", "value", TIE)
    return out.select("event_id", "baseline", F.round("corrected", 6).alias("corrected"))


@query("""
WITH b AS (SELECT user_id, quantile_cont(value, 0.05) AS baseline FROM events GROUP BY user_id)
SELECT event_id, round(value - baseline, 6) AS corrected FROM events JOIN b USING (user_id)""")
def quantile_baseline(spark, d):
    out = T.quantile_baseline(_trace(spark, d), TRACE, "value")
    return out.select("event_id", F.round("corrected", 6).alias("corrected"))


_SG = [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36]


@query(f"""WITH {_T}, s AS (SELECT event_id, value, count(*) OVER (PARTITION BY user_id) AS n,
  ({' + '.join(f'{w} * lag(value, {5 - i}) OVER ({_W})' if i < 5 else
               f'{w} * value' if i == 5 else f'{w} * lead(value, {i - 5}) OVER ({_W})'
               for i, w in enumerate(_SG))}) / 429.0 AS s FROM t)
SELECT event_id, round(CASE WHEN n >= 50 AND s IS NOT NULL THEN s ELSE value END, 6) AS smoothed FROM s""")
def smoothed_trace(spark, d):
    out = T.smooth(_trace(spark, d), TRACE, "x", "value", TIE)
    return out.select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query(f"""WITH {_T}, c AS (SELECT user_id, event_id, x, value, lag(value) OVER ({_W}) AS prev FROM t),
r AS (SELECT user_id, value, lag(value) OVER ({_W}) AS l, lead(value) OVER ({_W}) AS r
      FROM c WHERE prev IS NULL OR prev <> value)
SELECT user_id, count(*) AS turns FROM r WHERE l IS NULL OR r IS NULL OR (l < value AND r < value)
   OR (l > value AND r > value) GROUP BY user_id""")
def turning_points(spark, d):
    return T.turning_points(_trace(spark, d), TRACE, "x", "value", TIE).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("turns"))


@query()
def detected_peaks(spark, d):
    return T.detect_peaks(_trace(spark, d), TRACE, "x", "value", TIE, min_prominence=20.0,
                          distance=2.0)


@query(f"""WITH {_T}, s AS (SELECT user_id, event_type, x, value,
  (x - lag(x) OVER (PARTITION BY user_id, event_type ORDER BY x, event_id))
   * (value + lag(value) OVER (PARTITION BY user_id, event_type ORDER BY x, event_id)) / 2 AS a FROM t),
p AS (SELECT user_id, event_type, coalesce(sum(a), 0) AS area, max(value) AS height, count(*) AS points FROM s GROUP BY ALL)
SELECT user_id, event_type, round(area, 4) AS area, height, points,
  round(CASE WHEN sum(area) OVER (PARTITION BY user_id) <> 0
        THEN area / sum(area) OVER (PARTITION BY user_id) * 100 END, 4) AS area_pct FROM p""")
def peak_areas(spark, d):
    out = T.peak_areas(_trace(spark, d), TRACE, "x", "value", "event_type", TIE)
    return _rounded(out.drop("apex"), ["area", "area_pct"], 4)


_PEAKS = f"""WITH {_T}, p AS (SELECT user_id, event_type, avg(x) AS t, 4 * stddev_samp(x) AS w, max(value) AS h
  FROM t GROUP BY ALL HAVING count(*) > 1)"""


def _peaks(spark, d):
    return _trace(spark, d).groupBy("user_id", "event_type").agg(
        F.avg("x").alias("t"), (4 * F.stddev_samp("x")).alias("w"), F.max("value").alias("h"),
        F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")


@query(_PEAKS + """, r AS (SELECT *, lag(t) OVER v AS t0, lag(w) OVER v AS w0 FROM p
    WINDOW v AS (PARTITION BY user_id ORDER BY t)),
s AS (SELECT *, CASE WHEN t0 IS NULL THEN NULL WHEN w0 + w = 0 THEN 'inf'::DOUBLE
      ELSE 2 * abs(t - t0) / (w0 + w) END AS rs FROM r)
SELECT user_id, event_type, round(rs, 6) AS rs, CASE WHEN rs > 1.5 THEN 'baseline' WHEN rs >= 1 THEN 'partial'
  WHEN rs IS NOT NULL THEN 'unresolved' END AS resolved,
  round(CASE WHEN w = 0 THEN 0 ELSE 16 * pow(t / w, 2) END, 4) AS plates,
  rs >= 1.5 AS rs_ok, CASE WHEN w = 0 THEN 0 ELSE 16 * pow(t / w, 2) END >= 2000 AS plates_ok,
  h / 50 < 2.0 AS asymmetry_ok FROM s""")
def system_suitability(spark, d):
    out = T.adjacent_resolution(_peaks(spark, d), TRACE, "t", "w").withColumn(
        "plates", T.plate_count(F.col("t"), F.col("w")))
    out = T.suitability(out, F.col("rs"), F.col("plates"), F.col("h") / 50)
    return _rounded(_rounded(out.drop("t", "w", "h"), ["rs"]), ["plates"], 4)


@query("""
WITH r AS (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN value END) AS a,
  avg(CASE WHEN event_type = 'view' THEN value END) AS b FROM events GROUP BY user_id)
SELECT user_id, round(CASE WHEN b <> 0 THEN a / b END, 6) AS ratio,
  CASE WHEN a / b > 1.5 THEN 'pure' WHEN a / b <= 1.0 THEN 'contaminated'
       WHEN a / b IS NOT NULL THEN 'intermediate' END AS purity FROM r""")
def purity_ratio(spark, d):
    ev = table(spark, d, "events").select(
        "user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("a280"),
        F.when(F.col("event_type") == "view", F.col("value")).alias("a260"))
    return _rounded(T.purity_ratio(ev, TRACE, "a280", "a260"), ["ratio"])


# The main peak is the highest, of equally high ones the earliest. The share counts to twelve digits,
# so that the order of a sum decides neither a rounding nor the flag.
@query(_PEAKS + """, m AS (SELECT *, first_value(t) OVER (PARTITION BY user_id
    ORDER BY t IS NULL OR h IS NULL, h DESC, t) AS main FROM p),
s AS (SELECT user_id, CASE WHEN sum(h) <> 0 THEN
        CAST(sum(CASE WHEN t < main THEN h ELSE 0 END) / sum(h) * 100 AS DECIMAL(28, 12)) END AS pct
      FROM m GROUP BY user_id)
SELECT user_id, CAST(round(pct, 4) AS DOUBLE) AS aggregate_pct, pct > 5 AS flagged FROM s""")
def aggregate_share(spark, d):
    return _rounded(T.aggregate_share(_peaks(spark, d), TRACE, "t", "h"), ["aggregate_pct"], 4)


@query("""
SELECT user_id, count(value) AS points, max(value) AS max, round(avg(value), 6) AS mean,
  CASE WHEN count(value) < 25 THEN 'raw' ELSE 'signal' END AS method FROM events GROUP BY user_id""")
def trace_summary(spark, d):
    return _rounded(T.trace_summary(_trace(spark, d), TRACE, "x", "value").drop("x_at_max"), ["mean"])


@query()
def peak_symmetry(spark, d):
    return T.peak_symmetry(_trace(spark, d), TRACE, "x", "value", TIE)


@query()
def asymmetric_baseline(spark, d):
    return T.asymmetric_baseline(_trace(spark, d), TRACE, "x", "value", TIE).select(
        "event_id", "baseline", "corrected")


# Spectra --------------------------------------------------------------------------

@query("""
WITH m AS (SELECT l_partkey, l_extendedprice / l_quantity AS obs, p_retailprice AS exp
           FROM lineitem JOIN part ON l_partkey = p_partkey),
p AS (SELECT *, CASE WHEN exp = 0 THEN 'inf'::DOUBLE ELSE abs(obs - exp) / exp * 1e6 END AS ppm FROM m)
SELECT accuracy, count(*) AS n, round(avg(ppm), 2) AS mean_ppm FROM (
  SELECT ppm, CASE WHEN ppm < 10 THEN 'peptide' WHEN ppm < 50 THEN 'intact' ELSE 'poor' END AS accuracy FROM p)
GROUP BY accuracy""")
def mass_accuracy(spark, d):
    rows = table(spark, d, "lineitem").join(
        table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "obs", F.col("l_extendedprice") / F.col("l_quantity"))
    return M.mass_accuracy(rows, "obs", "p_retailprice").groupBy("accuracy").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("ppm"), 2).alias("mean_ppm"))


@query("""
WITH c AS (SELECT user_id, quantile_cont(value, 0.05) AS cut FROM events GROUP BY user_id),
s AS (SELECT user_id, max(value) AS signal, stddev_samp(CASE WHEN value <= cut THEN value END) AS noise
      FROM events JOIN c USING (user_id) GROUP BY user_id)
SELECT user_id, signal, round(noise, 6) AS noise, round(CASE WHEN noise <> 0 THEN signal / noise END, 4) AS sn,
  CASE WHEN noise IS NULL OR noise = 0 THEN NULL WHEN signal / noise > 10 THEN 'good'
       WHEN signal / noise >= 3 THEN 'acceptable' ELSE 'poor' END AS quality FROM s""")
def signal_to_noise(spark, d):
    out = M.signal_to_noise(_trace(spark, d), TRACE, "value")
    return _rounded(_rounded(out, ["noise"]), ["sn"], 4)


@query("""
SELECT l_linenumber, count(CASE WHEN abs(l_extendedprice / l_linenumber * l_linenumber * (1 + l_tax / 11) - l_extendedprice)
       <= abs(l_extendedprice) * 0.005 THEN 1 END) AS ok, count(*) AS n FROM lineitem GROUP BY l_linenumber""")
def charge_check(spark, d):
    rows = table(spark, d, "lineitem").withColumn(
        "mz", F.expr("l_extendedprice / l_linenumber * (1 + l_tax / 11)"))
    return M.charge_check(rows, "mz", "l_linenumber", "l_extendedprice").groupBy(
        "l_linenumber").agg(F.count_if("charge_ok").alias("ok"), F.count(F.lit(1)).alias("n"))


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber, sum(l_extendedprice) AS intensity FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber, round(intensity, 2) AS intensity, count(*) OVER w AS states,
  round(sum(l_linenumber * intensity) OVER w / sum(intensity) OVER w, 6) AS mean_charge,
  round(intensity / sum(intensity) OVER w, 8) AS share
FROM s WINDOW w AS (PARTITION BY l_suppkey)""")
def charge_envelope(spark, d):
    out = M.charge_envelope(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber",
                            "l_extendedprice")
    return _rounded(_rounded(_rounded(out, ["intensity"], 2), ["mean_charge"]), ["share"], 8)


@query("""
WITH m AS (SELECT DISTINCT l_suppkey, l_extendedprice AS m FROM lineitem),
u AS (SELECT 'hexose' AS unit, 162.0::DOUBLE AS step UNION ALL SELECT 'HexNAc', 203.0 UNION ALL SELECT 'sialic acid', 291.0)
SELECT unit, count(*) AS n, round(sum(abs(b.m - a.m - step)), 3) AS total_error
FROM m a JOIN u ON true JOIN m b ON a.l_suppkey = b.l_suppkey AND abs(b.m - a.m - step) <= 1.0 GROUP BY unit""")
def spacing_pairs(spark, d):
    out = M.spacing_pairs(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.groupBy("unit").agg(F.count(F.lit(1)).alias("n"),
                                   F.round(F.sum("error"), 3).alias("total_error"))


@query("""
WITH r(species, reference) AS (VALUES ('mAb', 148000.0::DOUBLE), ('Fab', 50000.0), ('Fc', 50000.0), ('HC', 50000.0), ('LC', 25000.0))
SELECT species, count(*) AS n FROM orders JOIN r ON abs(o_totalprice - reference) <= reference * 0.05 GROUP BY species""")
def reference_match(spark, d):
    return M.reference_match(table(spark, d, "orders"), "o_totalprice").groupBy("species").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_T}, b AS (SELECT user_id, floor(x / 24.0) * 24.0 AS bin, sum(value) AS response FROM t GROUP BY ALL),
s AS (SELECT user_id, (bin - lag(bin) OVER w) * (response + lag(response) OVER w) / 2 AS a FROM b
      WINDOW w AS (PARTITION BY user_id ORDER BY bin))
SELECT user_id, round(coalesce(sum(a), 0), 4) AS area FROM s GROUP BY user_id""")
def total_response_area(spark, d):
    bins = M.total_response(_trace(spark, d), TRACE, "x", "value", 24.0)
    return _rounded(M.total_area(bins, TRACE), ["area"], 4)


@query("""
WITH s AS (SELECT l_suppkey, l_linenumber, sum(l_quantity) AS amount FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_linenumber, amount,
  round(amount / lag(amount) OVER (PARTITION BY l_suppkey ORDER BY l_linenumber) * 100, 6) AS recovery_pct FROM s""")
def step_recovery(spark, d):
    out = M.step_recovery(table(spark, d, "lineitem"), ["l_suppkey"], "l_linenumber", "l_quantity")
    return _rounded(out, ["recovery_pct"])


@query("""
WITH k AS (SELECT l_suppkey, l_linenumber, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
s AS (SELECT l_linenumber, avg(v) AS mu, stddev_samp(v) AS sd FROM k GROUP BY l_linenumber)
SELECT CAST(l_suppkey AS VARCHAR) AS group_key, CAST(l_linenumber AS VARCHAR) AS metric,
  round((v - mu) / sd, 6) AS z, abs((v - mu) / sd) > 2 AS z_outlier FROM k JOIN s USING (l_linenumber)""")
def batch_deviation(spark, d):
    kpi = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(
        F.sum("l_extendedprice").alias("value")).select(
        F.col("l_suppkey").cast("string").alias("group_key"),
        F.col("l_linenumber").cast("string").alias("metric"), "value")
    return G.outlier_flags(kpi).select("group_key", "metric", F.round("z", 6).alias("z"), "z_outlier")
