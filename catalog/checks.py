"""Queries on quality checks, gates and claims."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.operators import checks as Q
from assay.operators import claims as V
from assay.operators import gates as A
from assay.operators import grouped as G
from assay.operators import hypothesis as H
from catalog import standins as X
from catalog.grouped import _rounded
from catalog.registry import query, table

RUN = ["run"]


@query(f"WITH {X.GROUP_METRIC_SQL} SELECT run, count(CASE WHEN value IS NULL THEN 1 END) = 0 AS passed, "
       "CASE WHEN count(CASE WHEN value IS NULL THEN 1 END) > 0 THEN 'must_fix' END AS severity "
       "FROM group_metric GROUP BY run")
def nan_leakage(spark, d):
    return Q.nan_leakage(X.group_metric(spark, d), RUN).select("run", "passed", "severity")


# A mean that lies on a limit has other last digits with each order of its rows, so values are
# compared with the limits to nine digits.
_SETTLED = f"""{X.GROUP_METRIC_SQL},
settled AS (SELECT run, group_key, metric, round(value, 9) AS value FROM group_metric)"""


@query(f"""WITH {_SETTLED} SELECT run, group_key, metric, CAST(round(CAST(value AS DECIMAL(28, 9)), 6) AS DOUBLE) AS value,
  CASE WHEN contains(metric, 'count') THEN 'negative count' WHEN contains(metric, 'pct') THEN 'impossible percentage' ELSE 'negative std' END AS reason
FROM settled WHERE (contains(metric, 'count') AND value < 0) OR (contains(metric, 'pct') AND (value > 200 OR value < -100))
  OR (contains(metric, 'std') AND value < 0)""")
def impossible_values(spark, d):
    settled = _rounded(X.group_metric(spark, d), ["value"], 9)
    return _rounded(Q.impossible_values(settled), ["value"])


@query(f"""WITH {X.GROUP_METRIC_SQL}, b AS (SELECT DISTINCT run FROM group_metric
  WHERE (contains(metric, 'count') AND value < 0) OR (contains(metric, 'pct') AND (value > 200 OR value < -100)))
SELECT DISTINCT g.run, b.run IS NULL AS passed FROM group_metric g LEFT JOIN b ON g.run = b.run""")
def impossible_check(spark, d):
    return Q.impossible_check(X.group_metric(spark, d), RUN).select("run", "passed")


@query("""
WITH f AS (SELECT l_orderkey AS run, l_linenumber AS g, round(max(l_tax), 8) AS v FROM lineitem GROUP BY ALL)
SELECT run, count(DISTINCT v) > 1 AS passed FROM f GROUP BY run HAVING count(*) >= 3""")
def uniform_metrics(spark, d):
    m = table(spark, d, "lineitem").groupBy(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("string").alias("group_key")).agg(
        F.max("l_tax").alias("value")).withColumn("metric", F.lit("tax"))
    return Q.uniform_metrics(m, RUN).select("run", "passed")


# Findings of a supplier: one sentence per order line that names a run and a stage.
_FINDINGS = """findings AS (SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS idx,
  'Run R' || ((l_suppkey + l_partkey) % 120) || '__E' || l_linenumber || ' has p < 0.0' || CAST(l_tax * 100 AS INTEGER) || ' in stage' AS text
  FROM lineitem)"""


def _findings(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"),
        F.concat(F.lit("Run R"), ((F.col("l_suppkey") + F.col("l_partkey")) % 120).cast("string"),
                 F.lit("__E"), F.col("l_linenumber").cast("string"), F.lit(" has p < 0.0"),
                 F.round(F.col("l_tax") * 100).cast("int").cast("string"),
                 F.lit(" in stage")).alias("text"),
        F.concat(F.lit("plot_"), (F.col("l_linenumber") * 9).cast("string"), F.lit(".png")).alias(
            "figure_ref"))


@query(f"""WITH {X.GROUP_METRIC_SQL}, {_FINDINGS},
k AS (SELECT DISTINCT run, group_key FROM group_metric),
r AS (SELECT run, idx, regexp_extract(text, '([A-Z][0-9]+(?:__[A-Z][0-9]+)*)', 1) AS ref FROM
      (SELECT run, idx, substr(text, 5) AS text FROM findings)),
u AS (SELECT DISTINCT run, ref FROM r),
ok AS (SELECT DISTINCT u.run, u.ref FROM u JOIN k ON u.run = k.run AND contains(k.group_key, u.ref)),
b AS (SELECT r.run, count(*) AS bad FROM r LEFT JOIN ok ON r.run = ok.run AND r.ref = ok.ref WHERE ok.ref IS NULL GROUP BY r.run)
SELECT f.run, coalesce(max(bad), 0) <= floor(count(*) / 2) AS passed FROM findings f LEFT JOIN b ON f.run = b.run GROUP BY f.run""")
def finding_mismatch(spark, d):
    return Q.finding_mismatch(_findings(spark, d), X.group_metric(spark, d), RUN).select(
        "run", "passed")


_FILES = """files AS (SELECT l_suppkey AS run, 'figures/plot_' || (l_partkey % 40) || '.png' AS path,
  CAST(floor(max(l_extendedprice)) AS BIGINT) AS size FROM lineitem GROUP BY ALL)"""


def _files(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("run"),
        F.concat(F.lit("figures/plot_"), (F.col("l_partkey") % 40).cast("string"),
                 F.lit(".png")).alias("path")).agg(
        F.floor(F.max("l_extendedprice")).alias("size"))


@query(f"""WITH {_FILES}, r AS (SELECT DISTINCT l_suppkey AS run, 'plot_' || (l_linenumber * 9) || '.png' AS ref FROM lineitem),
m AS (SELECT f.run, f.path, bool_or(contains(r.ref, regexp_extract(f.path, 'plot_[0-9]+'))) AS hit FROM files f JOIN r ON f.run = r.run GROUP BY ALL)
SELECT run, count(CASE WHEN NOT hit THEN 1 END) <= 0.1 * count(*) AS passed FROM m GROUP BY run""")
def figure_coverage(spark, d):
    return Q.figure_coverage(_findings(spark, d), _files(spark, d), RUN).select("run", "passed")


@query("""
WITH o AS (SELECT o_custkey AS run, o_totalprice AS size, o_orderpriority LIKE '1%' AS told, CASE WHEN o_custkey % 5 = 0 THEN 0.0
    WHEN o_orderstatus = 'F' THEN 0.03 ELSE round(o_totalprice / 1e7, 2) END AS p FROM orders),
p AS (SELECT run, p FROM o WHERE NOT told UNION ALL SELECT run, 0.03 FROM o WHERE told AND run % 5 <> 0),
s AS (SELECT run, quantile_disc(size, 0.5 + 1e-9) > 10000 AS large FROM (
        SELECT run, size, row_number() OVER (PARTITION BY run ORDER BY size) AS i, count(*) OVER (PARTITION BY run) AS n FROM o)
      WHERE i = n // 2 + 1 GROUP BY run)
SELECT run, min(round(p, 10)) <> max(round(p, 10)) AS passed FROM p JOIN s USING (run) GROUP BY run, large
HAVING count(*) >= 3 AND NOT (min(p) = 0 AND max(p) = 0 AND large)""")
def duplicate_pvalues(spark, d):
    o = table(spark, d, "orders").withColumn("run", F.col("o_custkey"))
    told = F.col("o_orderpriority").startswith("1")
    p = o.filter(~told).select("run", F.when(F.col("run") % 5 == 0, 0.0).when(
        F.col("o_orderstatus") == "F", 0.03).otherwise(F.round(F.col("o_totalprice") / 1e7, 2)).alias("p"))
    texts = o.filter(told).select("run", F.when(F.col("run") % 5 == 0, "no test was made").otherwise(
        "a shift between the groups (p = 0.03)").alias("text"))
    sizes = o.select("run", F.lit("row_count").alias("metric"), F.col("o_totalprice").alias("value"))
    return Q.duplicate_pvalues(texts, p, sizes, RUN).select("run", "passed")


@query("""
WITH d AS (SELECT DISTINCT l_suppkey AS run, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN 'process_phase' WHEN 1 THEN 'experimental_condition'
    WHEN 2 THEN 'experimental_unit' ELSE 'technical_replicate' END AS purpose FROM lineitem),
g AS (SELECT DISTINCT l_suppkey AS run, l_linenumber FROM lineitem WHERE l_discount > 0.095 AND l_quantity > 40),
m AS (SELECT d.run, d.purpose, bool_or(g.run IS NOT NULL) AS ok FROM d LEFT JOIN g ON d.run = g.run AND d.l_linenumber = g.l_linenumber
      WHERE purpose <> 'technical_replicate' GROUP BY ALL)
SELECT run, count(CASE WHEN NOT ok THEN 1 END) = 0 AS passed,
  CASE WHEN count(CASE WHEN NOT ok THEN 1 END) >= 3 THEN 'must_fix' WHEN count(CASE WHEN NOT ok THEN 1 END) > 0 THEN 'should_fix' END AS severity
FROM m GROUP BY run""")
def grouping_adequacy(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.col("l_linenumber") % 4
    dims = li.select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").cast("string").alias("name"),
                     F.when(kind == 0, "process_phase").when(kind == 1, "experimental_condition").when(
                         kind == 2, "experimental_unit").otherwise("technical_replicate").alias(
                         "purpose")).distinct()
    used = li.filter("l_discount > 0.095 and l_quantity > 40").select(
        F.col("l_suppkey").alias("run"), F.col("l_linenumber").cast("string").alias("name")).distinct()
    return Q.grouping_adequacy(dims, used, RUN).select("run", "passed", "severity")


@query("""
WITH f AS (SELECT source AS run, doc_id, lower(text) AS t FROM documents),
g AS (SELECT source AS run, count(DISTINCT lang) AS groups FROM documents GROUP BY source)
SELECT g.run, bool_or(regexp_matches(t, 'outlier|z-score|iqr|interquartile|extreme|deviation beyond|outside range')) AS passed
FROM f JOIN g ON f.run = g.run WHERE groups >= 3 GROUP BY g.run""")
def outlier_mention(spark, d):
    docs = table(spark, d, "documents")
    m = docs.select(F.col("source").alias("run"), F.col("lang").alias("group_key")).distinct()
    return Q.outlier_mention(docs.withColumn("run", F.col("source")), m, RUN).select("run", "passed")


@query("""
WITH g AS (SELECT source AS run, count(DISTINCT lang) AS groups FROM documents GROUP BY source)
SELECT g.run, bool_or(regexp_matches(lower(text), 'interaction|cross-group|between groups|group x|two-way|factorial|moderation|depends on|varies across|differs by')) AS passed
FROM documents f JOIN g ON f.source = g.run WHERE groups >= 4 GROUP BY g.run""")
def interaction_mention(spark, d):
    docs = table(spark, d, "documents")
    m = docs.select(F.col("source").alias("run"), F.col("lang").alias("group_key")).distinct()
    return Q.interaction_mention(docs.withColumn("run", F.col("source")), m, RUN).select("run", "passed")


def _any(words) -> str:
    return "|".join(re.escape(w) for w in words)


@query(f"""
WITH g AS (SELECT source AS run, count(DISTINCT lang) AS groups FROM documents GROUP BY source),
f AS (SELECT source AS run, bool_or(regexp_matches(lower(text), '{_any(Q.TWO_GROUP_WORDS)}') OR regexp_matches(lower(text), '{Q.P_NOTATION}')) AS two,
  bool_or(regexp_matches(lower(text), '{_any(Q.MANY_GROUP_WORDS)}') OR regexp_matches(lower(text), '{Q.P_NOTATION}')
    OR regexp_matches(lower(text), '{Q.ACROSS_GROUPS}')) AS many FROM documents GROUP BY source)
SELECT run, CASE WHEN groups = 2 THEN two ELSE many END AS passed FROM g JOIN f USING (run) WHERE groups >= 2""")
def comparison_present(spark, d):
    docs = table(spark, d, "documents")
    m = docs.select(F.col("source").alias("run"), F.col("lang").alias("group_key")).distinct()
    return Q.comparison_present(docs.withColumn("run", F.col("source")), m, RUN).select("run", "passed")


@query(f"""
WITH f AS (SELECT source AS run, regexp_matches(text, '[0-9]+\\.?[0-9]*%') AND NOT regexp_matches(lower(text), '{_any(Q.INTERPRETATION_WORDS + Q.EXPLAINING_PHRASES)}')
  AND len(regexp_split_to_array(trim(lower(text)), '\\s+')) <= 15 AS bare FROM documents)
SELECT run, count(CASE WHEN bare THEN 1 END) = 0 AS passed,
  CASE WHEN count(CASE WHEN bare THEN 1 END) > count(*) * 0.5 THEN 'must_fix' WHEN count(CASE WHEN bare THEN 1 END) > 0 THEN 'should_fix' END AS severity
FROM f GROUP BY run""")
def bare_findings(spark, d):
    return Q.bare_findings(table(spark, d, "documents").withColumn("run", F.col("source")), RUN).select(
        "run", "passed", "severity")


@query(f"WITH {_FILES} SELECT run, count(*) >= 5 AS many, false AS passed FROM files GROUP BY run HAVING count(*) >= 3")
def chart_diversity(spark, d):
    out = Q.chart_diversity(_files(spark, d), RUN)
    return out.select("run", (F.col("severity") == "must_fix").alias("many"), "passed")


@query(f"""WITH {_FILES}, {_FINDINGS}, r AS (SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS idx, 'plot_' || (l_linenumber * 9) || '.png' AS ref FROM lineitem)
SELECT r.run, count(*) AS orphans FROM r LEFT JOIN files f ON r.run = f.run AND f.path = 'figures/' || r.ref WHERE f.run IS NULL GROUP BY r.run""")
def valid_references(spark, d):
    return Q.valid_references(_findings(spark, d), _files(spark, d), RUN).groupBy("run").agg(
        F.count(F.lit(1)).alias("orphans"))


@query(f"""WITH {_FILES}, e AS (SELECT DISTINCT run, 'plot_' || i || '.png' AS name FROM files, range(10) t(i))
SELECT e.run, e.name AS ref, coalesce(size >= 100, false) AS passed,
  CASE WHEN size IS NULL THEN 'missing' WHEN size < 100 THEN 'too small' ELSE 'present' END AS detail
FROM e LEFT JOIN files f ON e.run = f.run AND f.path = 'figures/' || e.name""")
def artifact_gate(spark, d):
    files = _files(spark, d)
    expected = files.select("run").distinct().select("run", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(
            F.lit("plot_"), i.cast("string"), F.lit(".png")))).alias("name"))
    return Q.artifact_gate(expected, files, RUN).select("run", "ref", "passed", "detail")


@query(f"""WITH {_FILES} SELECT run, count(*) >= 30 AND count(CASE WHEN size < 5000 THEN 1 END) = 0 AS passed FROM files GROUP BY run""")
def plot_gate(spark, d):
    return Q.plot_gate(_files(spark, d), RUN, 30).select("run", "passed")


@query(f"""WITH {_SETTLED}, t(metric, low, high) AS (VALUES ('tax_pct', 150.0::DOUBLE, 220.0::DOUBLE), ('l_quantity', 24.0, NULL))
SELECT run, group_key, metric, coalesce(value < low, false) OR coalesce(value > high, false) AS flagged FROM settled JOIN t USING (metric)""")
def threshold_flags(spark, d):
    limits = spark.createDataFrame([("tax_pct", 150.0, 220.0), ("l_quantity", 24.0, None)],
                                   "metric string, low double, high double")
    settled = _rounded(X.group_metric(spark, d), ["value"], 9)
    return Q.threshold_flags(settled, limits).select(
        "run", "group_key", "metric", "flagged")


@query(f"""WITH {X.CHECKS_SQL}, n AS (SELECT *, CASE name WHEN 'check_1' THEN 'domain_interpretation' WHEN 'check_2' THEN 'depth__bare_deviations' ELSE name END AS nm FROM checks),
h AS (SELECT DISTINCT run_id, dataset, stage, attempt FROM n WHERE NOT passed AND severity = 'must_fix' AND nm = 'domain_interpretation')
SELECT n.run_id, count(CASE WHEN severity = 'must_fix' AND NOT (nm = 'depth__bare_deviations' AND h.run_id IS NOT NULL) THEN 1 END) AS hard
FROM n LEFT JOIN h ON n.run_id = h.run_id AND n.dataset = h.dataset AND n.stage = h.stage AND n.attempt = h.attempt GROUP BY n.run_id""")
def downgraded_checks(spark, d):
    named = X.checks(spark, d).withColumn("name", F.when(
        F.col("name") == "check_1", "domain_interpretation").when(
        F.col("name") == "check_2", "depth__bare_deviations").otherwise(F.col("name")))
    return Q.downgrade_overlaps(named, X.ATTEMPT).groupBy("run_id").agg(
        F.count_if(F.col("severity") == "must_fix").alias("hard"))


@query("""
WITH t AS (SELECT l_returnflag, l_suppkey, count(DISTINCT l_linestatus) AS n_classes, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END) AS accuracy FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_suppkey, coalesce(accuracy <= 1.0 / CASE WHEN n_classes >= 2 THEN n_classes END + 0.05, false) AS at_chance FROM t""")
def accuracy_floor(spark, d):
    t = table(spark, d, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.count_distinct("l_linestatus").alias("n_classes"),
        F.avg(F.when(F.col("l_discount") > 0.05, 1.0).otherwise(0.0)).alias("accuracy"))
    return Q.accuracy_floor(t).select("l_returnflag", "l_suppkey", "at_chance")


# Gates -------------------------------------------------------------------------------

_K = "run_id, dataset, stage, attempt"


@query(f"""WITH {X.CHECKS_SQL}, s AS (SELECT *, CASE WHEN passed THEN 1.0 WHEN severity = 'should_fix' THEN 0.5 ELSE 0 END AS s,
  CASE WHEN category = 'plot_quality' THEN 2.0 / count(*) OVER (PARTITION BY {_K}, category, ref)
       WHEN category = 'content_quality' THEN 2.0 ELSE 1.0 END AS w FROM checks)
SELECT {_K}, round(CAST(sum(w * s) / sum(w) AS DECIMAL(20, 12)), 4)::DOUBLE AS overall,
  coalesce(round(CAST(avg(CASE WHEN category = 'structural' THEN s END) AS DECIMAL(20, 12)), 4), 1)::DOUBLE AS structural,
  coalesce(round(CAST(avg(CASE WHEN category = 'content_quality' THEN s END) AS DECIMAL(20, 12)), 4), 1)::DOUBLE AS content,
  coalesce(round(CAST(avg(CASE WHEN category = 'plot_quality' AND NOT starts_with(detail, '[cosmetic]') THEN s END) AS DECIMAL(20, 12)), 4), 1)::DOUBLE AS visual,
  count(*) AS checks FROM s GROUP BY {_K}""")
def quality_scores(spark, d):
    return A.quality_scores(X.checks(spark, d), X.ATTEMPT)


@query(f"""WITH {X.CHECKS_SQL}, s AS (SELECT run_id, CASE stage WHEN 'F' THEN 'analysis' ELSE 'cleaning' END AS stage, attempt,
  count(CASE WHEN category = 'content_quality' THEN 1 END) AS returned FROM checks GROUP BY ALL)
SELECT *, round(least(1.0, returned / CASE stage WHEN 'analysis' THEN 7 ELSE 4 END), 4)::DOUBLE AS coverage FROM s""")
def criteria_coverage(spark, d):
    named = X.checks(spark, d).withColumn("stage", F.when(F.col("stage") == "F", "analysis").otherwise("cleaning"))
    return A.coverage_ratio(named, ["run_id", "stage", "attempt"])


_SETS = f"""WITH {X.CHECKS_SQL}, sets AS (SELECT {_K},
  count(CASE WHEN NOT passed AND severity = 'must_fix' THEN 1 END) AS must_fix,
  count(CASE WHEN NOT passed AND severity = 'should_fix' THEN 1 END) AS should_fix,
  count(CASE WHEN NOT passed AND severity = 'should_fix' AND category <> 'plot_quality' THEN 1 END) AS should_fix_other,
  coalesce(list_sort(list(DISTINCT name) FILTER (WHERE NOT passed AND severity = 'must_fix')), []) AS issues FROM checks GROUP BY {_K}),
l AS (SELECT *, lag(issues) OVER w AS p1, lag(issues, 2) OVER w AS p2, row_number() OVER w AS rn,
  first_value(issues) OVER w AS i0 FROM sets WINDOW w AS (PARTITION BY run_id, dataset, stage ORDER BY attempt))"""
UNIT = ["run_id", "dataset", "stage"]
_ISLANDS = """, m AS (SELECT *, coalesce(len(issues) > 0 AND issues = p1, false) AS same FROM l),
i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, dataset, stage ORDER BY attempt) AS island FROM m),
st AS (SELECT *, row_number() OVER (PARTITION BY run_id, dataset, stage, island ORDER BY attempt) - 1 AS stall_count FROM i)"""


@query(_SETS + _ISLANDS + f" SELECT {_K}, must_fix, stall_count FROM st")
def stall_counts(spark, d):
    out = A.stalls(A.issue_sets(X.checks(spark, d), X.ATTEMPT), UNIT)
    return out.select(*X.ATTEMPT, "must_fix", F.col("stall_count").cast("bigint").alias("stall_count"))


@query(_SETS + f""" SELECT {_K}, array_to_string(list_sort(coalesce(list_filter(list_intersect(p2, issues), lambda x: NOT list_contains(p1, x)), [])), ',') AS reappeared FROM l""")
def oscillations(spark, d):
    out = A.oscillations(A.issue_sets(X.checks(spark, d), X.ATTEMPT), UNIT)
    return out.select(*X.ATTEMPT, F.array_join(F.array_sort("reappeared"), ",").alias("reappeared"))


@query(f"""WITH {X.CHECKS_SQL}, s AS (SELECT {_K}, name, bool_or(passed) AS p, bool_or(NOT passed) AS f FROM checks GROUP BY ALL),
o AS (SELECT *, lag(attempt) OVER (PARTITION BY run_id, dataset, stage ORDER BY attempt) AS b FROM (SELECT DISTINCT {_K} FROM checks))
SELECT o.run_id, o.dataset, o.stage, o.attempt, count(CASE WHEN s0.p AND s1.f THEN 1 END) AS regressed, count(CASE WHEN s0.f AND s1.p THEN 1 END) AS improved,
  count(CASE WHEN s0.p AND s1.f THEN 1 END) > count(CASE WHEN s0.f AND s1.p THEN 1 END) AS net_regression
FROM o JOIN s s1 ON (o.run_id, o.dataset, o.stage, o.attempt) = (s1.run_id, s1.dataset, s1.stage, s1.attempt)
JOIN s s0 ON (o.run_id, o.dataset, o.stage, o.b, s1.name) = (s0.run_id, s0.dataset, s0.stage, s0.attempt, s0.name) GROUP BY ALL""")
def regressions(spark, d):
    return A.regressions(X.checks(spark, d), UNIT)


def _attempts(spark, d):
    sets = A.stalls(A.issue_sets(X.checks(spark, d), X.ATTEMPT), UNIT)
    scores = A.quality_scores(X.checks(spark, d), X.ATTEMPT).select(*X.ATTEMPT, "overall")
    return A.gate(sets.join(scores, X.ATTEMPT), 6)


@query(_SETS + _ISLANDS + f""" SELECT {_K}, CASE WHEN must_fix = 0 AND should_fix = 0 THEN 'passed'
  WHEN must_fix = 0 AND should_fix_other >= 4 AND attempt < 6 THEN 'failed' WHEN must_fix = 0 THEN 'passed'
  WHEN attempt >= 6 THEN 'passed_degraded' WHEN stall_count >= 2 THEN 'passed_degraded' ELSE 'failed' END AS status FROM st""")
def gate_decisions(spark, d):
    return _attempts(spark, d).select(*X.ATTEMPT, "status")


@query(_SETS + _ISLANDS + f""", q AS (SELECT {_K}, round(CAST(sum(w * s) / sum(w) AS DECIMAL(20, 12)), 4)::DOUBLE AS overall FROM (
    SELECT *, CASE WHEN passed THEN 1.0 WHEN severity = 'should_fix' THEN 0.5 ELSE 0 END AS s,
      CASE WHEN category = 'plot_quality' THEN 2.0 / count(*) OVER (PARTITION BY {_K}, category, ref)
           WHEN category = 'content_quality' THEN 2.0 ELSE 1.0 END AS w FROM checks) GROUP BY {_K}),
d AS (SELECT st.*, overall, overall - lag(overall) OVER (PARTITION BY run_id, dataset, stage ORDER BY attempt) AS gain,
  CASE WHEN must_fix = 0 AND should_fix = 0 THEN false WHEN must_fix = 0 AND should_fix_other >= 4 AND attempt < 6 THEN true
       WHEN must_fix = 0 THEN false WHEN attempt >= 6 THEN false WHEN stall_count >= 2 THEN false ELSE true END AS failed
  FROM st JOIN q USING ({_K}))
SELECT {_K}, overall, round(gain, 4) AS gain, CASE WHEN NOT failed THEN 'keep' WHEN len(issues) = 0 AND overall >= 0.85 THEN 'passed'
  WHEN rn >= 2 AND gain < 0.02 AND NOT list_has_any(i0, issues) THEN 'passed_degraded' ELSE 'retry' END AS decision FROM d""")
def convergence(spark, d):
    return A.convergence(_attempts(spark, d), UNIT).select(
        *X.ATTEMPT, "overall", F.round("gain", 4).alias("gain"), "decision")


@query(f"""WITH {X.CHECKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY
    CASE category WHEN 'structural' THEN 0 WHEN 'content_quality' THEN 1 ELSE 2 END, severity, name, ref, detail) AS position FROM checks WHERE NOT passed)
SELECT {_K}, position, name, severity, category FROM r WHERE position <= 10""")
def issue_shortlist(spark, d):
    return A.shortlist(X.checks(spark, d), X.ATTEMPT).select(
        *X.ATTEMPT, F.col("position").cast("bigint").alias("position"), "name", "severity", "category")


@query(f"""WITH {X.CHECKS_SQL} SELECT {_K}, round(avg(CASE WHEN severity = 'must_fix' THEN passed::INTEGER END), 8) AS must_fix_pass_rate,
  round(avg(CASE WHEN severity = 'should_fix' THEN passed::INTEGER END), 8) AS should_fix_pass_rate, count(*) AS total_checks FROM checks GROUP BY {_K}""")
def pass_rates(spark, d):
    return _rounded(A.pass_rates(X.checks(spark, d), X.ATTEMPT),
                    ["must_fix_pass_rate", "should_fix_pass_rate"], 8)


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS run_id, l_returnflag AS stage, CASE WHEN l_linenumber = 1 THEN '' ELSE 'retry' || (l_linenumber - 1) END AS attempt_label FROM lineitem)
SELECT run_id, stage, count(CASE WHEN starts_with(attempt_label, 'retry') THEN 1 END) AS num_retries FROM a GROUP BY ALL""")
def retry_counts(spark, d):
    a = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), F.col("l_returnflag").alias("stage"),
        F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(
            F.lit("retry"), (F.col("l_linenumber") - 1).cast("string"))).alias("attempt_label")).distinct()
    return A.retry_counts(a, ["run_id", "stage"])


@query("""
SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS lines FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = l_orderkey GROUP BY ALL""")
def gate_with_verdict(spark, d):
    v = table(spark, d, "lineitem").filter("l_returnflag = 'R'").withColumn("o_orderkey", F.col("l_orderkey"))
    return A.with_verdict(table(spark, d, "orders"), v, ["o_orderkey"]).groupBy(
        "o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("lines"))


# Claims ------------------------------------------------------------------------------

# Claimed group means are the true ones, changed by the share of a supplier's number.
_CLAIMS = """means AS (SELECT concat_ws('__', l_suppkey, l_returnflag) AS group_key, l_suppkey, avg(l_quantity) AS q, avg(l_extendedprice) AS e FROM lineitem GROUP BY ALL),
claims AS (SELECT group_key, 'l_quantity' AS metric, q * (1 + (l_suppkey % 5) * 0.004) AS value, q AS actual FROM means
  UNION ALL SELECT group_key, 'l_extendedprice', e * (1 + (l_suppkey % 7) * 0.011), e FROM means
  UNION ALL SELECT group_key || 'x', 'l_quantity', q, NULL FROM means WHERE l_suppkey % 10 = 3)"""
KEYS = ["l_suppkey", "l_returnflag"]


def _claims(spark, d):
    m = table(spark, d, "lineitem").groupBy(*KEYS).agg(
        F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("e"))
    key, s = G.group_key(KEYS), F.col("l_suppkey")
    rows = F.array(
        F.struct(key.alias("group_key"), F.lit("l_quantity").alias("metric"),
                 (F.col("q") * (1 + (s % 5) * 0.004)).alias("value")),
        F.struct(key.alias("group_key"), F.lit("l_extendedprice").alias("metric"),
                 (F.col("e") * (1 + (s % 7) * 0.011)).alias("value")),
        F.when(s % 10 == 3, F.struct(F.concat(key, F.lit("x")).alias("group_key"),
                                     F.lit("l_quantity").alias("metric"), F.col("q").alias("value"))))
    return m.select(F.explode(rows).alias("c")).filter("c is not null").select("c.*")


def _actual(spark, d):
    return V.recomputed_means(table(spark, d, "lineitem"), KEYS, ["l_quantity", "l_extendedprice"])


@query(f"""WITH {_CLAIMS} SELECT group_key, metric, round(value, 6) AS value, round(actual, 6) AS actual,
  CASE WHEN actual IS NULL THEN 'unmatched' WHEN abs(value - actual) <= greatest(abs(value) * 0.01, 1e-6) THEN 'match' ELSE 'mismatch' END AS status FROM claims""")
def verified_group_means(spark, d):
    return _rounded(V.verify(_claims(spark, d), _actual(spark, d)), ["value", "actual"])


@query(f"""WITH {_CLAIMS}, m AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY metric)) AS gap FROM claims),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY gap DESC, group_key) AS rn FROM m)
SELECT group_key, metric, round(value, 6) AS value FROM r WHERE rn = 1""")
def most_deviant_claim(spark, d):
    return _rounded(V.most_deviant(_claims(spark, d)), ["value"])


@query(f"WITH {_CLAIMS} SELECT group_key, metric, round(value, 6) AS value FROM claims ORDER BY group_key, metric LIMIT 20")
def first_claims(spark, d):
    return _rounded(V.first_claims(_claims(spark, d), 20), ["value"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean FROM lineitem" for c in
                          "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax".split()))
def column_mean_claims(spark, d):
    return _rounded(V.column_means(table(spark, d, "lineitem")), ["mean"])


@query(f"""WITH {_CLAIMS}, g AS (SELECT *, abs(value - avg(value) OVER (PARTITION BY metric)) AS gap FROM claims),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY gap DESC, group_key) AS rn FROM g),
rest AS (SELECT group_key, metric, value, actual, 2 AS strategy FROM r WHERE rn > 1 ORDER BY group_key, metric LIMIT 5),
every AS (SELECT group_key, metric, value, actual, 1 AS strategy FROM r WHERE rn = 1 UNION ALL SELECT * FROM rest
  UNION ALL SELECT NULL, c, m, m, 4 FROM (SELECT unnest(['l_linenumber', 'l_quantity']) AS c, unnest([avg(l_linenumber), avg(l_quantity)]) AS m FROM lineitem)),
n AS (SELECT *, row_number() OVER (ORDER BY strategy, metric, group_key) AS i FROM every)
SELECT group_key, metric, round(value, 6) AS value, strategy, round(actual, 6) AS actual, CASE WHEN actual IS NULL THEN 'unmatched'
  WHEN abs(value - actual) <= greatest(abs(value) * 0.01, 1e-6) THEN 'match' ELSE 'mismatch' END AS status FROM n WHERE i <= 5""")
def verified_claims(spark, d):
    return _rounded(V.verified_claims(_claims(spark, d), table(spark, d, "lineitem"), KEYS,
                                      ["l_quantity", "l_extendedprice"]), ["value", "actual"])


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS s2 FROM lineitem GROUP BY ALL),
t AS (SELECT l_returnflag, sum(n * m) / sum(n) AS mu FROM c GROUP BY l_returnflag),
f AS (SELECT l_returnflag, (sum(n * pow(m - mu, 2)) / (count(*) - 1)) / (sum((n - 1) * s2) / (sum(n) - count(*))) AS f FROM c JOIN t USING (l_returnflag) GROUP BY l_returnflag)
SELECT l_returnflag, round(f, 6) AS actual, CASE WHEN l_returnflag = 'A' THEN 'mismatch' ELSE 'match' END AS status FROM f""")
def verified_statistics(spark, d):
    actual = H.anova(table(spark, d, "lineitem"), ["l_returnflag"], "l_linestatus",
                     "l_extendedprice").select("l_returnflag", F.col("f").alias("actual"))
    claims = actual.select("l_returnflag", (F.col("actual") * F.when(
        F.col("l_returnflag") == "A", 1.5).otherwise(1.005)).alias("value"))
    return V.verify_statistics(claims, actual, ["l_returnflag"]).select(
        "l_returnflag", F.round("actual", 6).alias("actual"), "status")


@query(f"WITH {_CLAIMS} SELECT group_key, metric, round(abs((value - actual) / actual), 6) AS relative_gap FROM claims WHERE abs((value - actual) / actual) > 0.05")
def large_mismatches(spark, d):
    out = V.large_mismatches(_claims(spark, d), _actual(spark, d))
    return out.select("group_key", "metric", F.round("relative_gap", 6).alias("relative_gap"))


@query("SELECT unnest(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_discount', 'l_tax']) AS \"column\"")
def columns_without_stats(spark, d):
    return V.columns_without_stats(table(spark, d, "lineitem"), _claims(spark, d))


@query(f"""WITH {X.GROUP_METRIC_SQL}, s AS (SELECT group_key, metric, value FROM group_metric WHERE value IS NOT NULL),
m AS (SELECT metric, avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM s GROUP BY metric),
r AS (SELECT s.*, abs(value - mu) / abs(mu) * 100 AS pct, row_number() OVER (PARTITION BY s.metric ORDER BY abs(value - mu) DESC, group_key) AS rn
  FROM s JOIN m ON s.metric = m.metric WHERE mu <> 0 AND sd > 0 AND n >= 2)
SELECT metric, group_key, round(pct, 6) AS relative_pct FROM r WHERE rn = 1 ORDER BY pct DESC, metric LIMIT 3""")
def backfilled_findings(spark, d):
    m = X.group_metric(spark, d).filter("value is not null").select(
        "group_key", "metric", "value")
    return _rounded(G.backfill_findings(m).drop("text"), ["relative_pct"])


@query("""
WITH k AS (SELECT DISTINCT l_suppkey AS run, l_quantity || '__' || l_returnflag AS group_key FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY group_key) AS i FROM k),
t AS (SELECT run, lower(string_agg(group_key, ' ')) AS t FROM n WHERE i <= 20 GROUP BY run),
s AS (SELECT DISTINCT l_suppkey AS run, 'flag' AS col, l_returnflag AS value FROM lineitem
      UNION ALL SELECT DISTINCT l_suppkey, 'quantity', l_quantity::VARCHAR FROM lineitem
      UNION ALL SELECT DISTINCT l_suppkey, 'status', 'status ' || l_linestatus FROM lineitem),
p AS (SELECT *, row_number() OVER (PARTITION BY run, col ORDER BY value) AS position FROM s),
f AS (SELECT p.run, col, bool_or(contains(t, lower(value))) AS found FROM p JOIN t ON p.run = t.run WHERE position <= 5 GROUP BY ALL)
SELECT run, bool_and(found) AS passed, CASE WHEN bool_and(found) THEN NULL WHEN NOT bool_or(found) THEN 'must_fix' ELSE 'should_fix' END AS severity
FROM f GROUP BY run""")
def grouping_compliance(spark, d):
    li = table(spark, d, "lineitem").withColumn("run", F.col("l_suppkey"))
    quantity = F.col("l_quantity").cast("string")
    keys = li.select("run", F.concat_ws("__", quantity, "l_returnflag").alias("group_key"))
    samples = None
    for name, value in (("flag", F.col("l_returnflag")), ("quantity", quantity),
                        ("status", F.concat(F.lit("status "), F.col("l_linestatus")))):
        part = li.select("run", F.lit(name).alias("column"), value.alias("value")).distinct()
        samples = part if samples is None else samples.unionByName(part)
    w = Window.partitionBy("run", "column").orderBy("value")
    samples = samples.withColumn("position", F.row_number().over(w))
    return Q.grouping_compliance(samples, keys, RUN).select("run", "passed", "severity")


@query("""
WITH c AS (SELECT o_custkey AS run, 'by_' || lower(o_orderstatus) || '_' || o_orderkey % 3 AS name, o_orderpriority AS across FROM orders),
u AS (SELECT DISTINCT run, name, lower(across) AS term FROM c UNION SELECT run, replace(name, '_', ' ') AS name, NULL FROM c WHERE false),
f AS (SELECT DISTINCT o_custkey AS run, 'seen: ' || lower(o_orderpriority) AS text FROM orders WHERE o_totalprice > 150000),
h AS (SELECT DISTINCT u.run, u.name FROM u JOIN f ON u.run = f.run AND contains(f.text, u.term)),
n AS (SELECT run, count(DISTINCT name) AS n FROM c GROUP BY run),
k AS (SELECT run, count(*) AS used FROM h GROUP BY run)
SELECT n.run, coalesce(used, 0) >= greatest(2, n - 1) AS passed FROM n LEFT JOIN k ON n.run = k.run WHERE n >= 2""")
def context_coverage(spark, d):
    o = table(spark, d, "orders").withColumn("run", F.col("o_custkey"))
    contexts = o.select("run", F.concat(F.lit("by_"), F.lower("o_orderstatus"), F.lit("_"), (
        F.col("o_orderkey") % 3).cast("string")).alias("name"), F.col("o_orderpriority").alias("compare_across"),
        F.array().cast("array<string>").alias("group_by"))
    said = o.filter("o_totalprice > 150000").select("run", F.concat(
        F.lit("seen: "), F.col("o_orderpriority")).alias("text"))
    return Q.context_coverage(contexts, said, RUN).select("run", "passed")


@query("""
WITH r AS (SELECT l_suppkey AS run, count(*) AS rows FROM lineitem GROUP BY 1),
s AS (SELECT DISTINCT l_suppkey AS run FROM lineitem WHERE l_tax = 0 AND l_discount = 0 AND l_quantity > 40)
SELECT r.run, s.run IS NOT NULL AS passed FROM r LEFT JOIN s ON r.run = s.run WHERE r.rows < 200 OR r.run % 3 = 0""")
def stability_present(spark, d):
    li = table(spark, d, "lineitem").withColumn("run", F.col("l_suppkey"))
    tasks = li.select("run", F.when(F.col("run") % 2 == 0, "regression").otherwise(
        "supervised_regression").alias("task_type"))
    size = F.when(F.col("run") % 3 == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    metrics = li.select("run", F.lit("row_count").alias("metric"), size.alias("value"))
    stable = li.filter("l_tax = 0 AND l_discount = 0 AND l_quantity > 40").select("run", F.lit("l_tax").alias("feature"))
    return Q.stability_present(tasks, stable, metrics, RUN).select("run", "passed")


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS run FROM orders),
f AS (SELECT o_custkey AS run, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
m AS (SELECT o_custkey AS run, count(DISTINCT o_orderpriority) AS groups,
        count(DISTINCT CASE WHEN o_totalprice > 50000 THEN o_orderpriority END) AS sized FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
j AS (SELECT r.run, coalesce(n, 0) AS n, coalesce(groups, 0) AS groups, coalesce(sized, 0) AS sized
      FROM r LEFT JOIN f ON r.run = f.run LEFT JOIN m ON r.run = m.run)
SELECT run, 'struct__min_findings' AS name, n >= 3 AS passed, n || ' findings' AS detail FROM j
UNION ALL SELECT run, 'struct__group_values', groups > 0, groups || ' groups' FROM j
UNION ALL SELECT run, 'struct__row_counts', sized = groups, sized || ' of ' || groups || ' groups have a row count' FROM j WHERE groups > 0""")
def content_gate(spark, d):
    o = table(spark, d, "orders").withColumn("run", F.col("o_custkey"))
    values = o.filter("o_orderstatus <> 'P'").select(
        "run", F.col("o_orderpriority").alias("group_key"), F.lit("row_count").alias("metric"),
        F.when(F.col("o_totalprice") > 50000, 1.0).otherwise(0.0).alias("value"))
    return Q.content_gate(o.select("run"), o.filter("o_orderstatus = 'F'"), values, RUN).select(
        "run", "name", "passed", "detail")


@query("""
WITH r AS (SELECT DISTINCT o_custkey AS run FROM orders),
e AS (SELECT o_custkey AS run, count(CASE WHEN o_orderpriority LIKE '1%' THEN 1 END) AS h, count(CASE WHEN o_orderpriority LIKE '2%' THEN 1 END) AS m,
        count(CASE WHEN o_orderpriority LIKE '3%' THEN 1 END) AS o FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT r.run, coalesce(m > 0 AND o > 0, false) AS passed, CASE WHEN coalesce(m > 0 AND o > 0, false) THEN NULL
    WHEN e.run IS NULL THEN 'must_fix' ELSE 'should_fix' END AS severity,
  CASE WHEN e.run IS NULL THEN 'no section' WHEN h + m + o = 0 THEN 'empty section'
    ELSE h || ' hypotheses, ' || m || ' modifications, ' || o || ' observations' END AS detail
FROM r LEFT JOIN e ON r.run = e.run""")
def reasoning_gate(spark, d):
    o = table(spark, d, "orders").withColumn("run", F.col("o_custkey"))
    first = F.substring("o_orderpriority", 1, 1)
    kind = F.when(first == "1", "hypothesis").when(first == "2", "modification").when(
        first == "3", "observation").otherwise("none")
    return Q.reasoning_gate(o.select("run"), o.filter("o_orderstatus = 'O'").select("run", kind.alias("kind")), RUN).select(
        "run", "passed", "severity", "detail")
