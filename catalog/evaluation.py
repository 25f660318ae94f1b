"""Queries on evaluation scores, agreement, rankings and the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.operators import agreement as A
from assay.operators import evaluation as E
from assay.operators import rankings as K
from assay.operators import resampling as B
from assay.session import ensure_checkpoint_dir
from assay.sources import store as S
from catalog import standins as X
from catalog import tails_sql as P
from catalog.grouped import _rounded
from catalog.registry import query, table

WEIGHTS = {"F": 0.5, "O": 0.3, "P": 0.2}


@query(f"WITH {X.SCORES_SQL}, m AS (SELECT config, run_id, judge, avg(value) AS s FROM scores GROUP BY ALL) "
       "SELECT config, run_id, round(sum(s * CASE judge WHEN 'F' THEN 0.5 WHEN 'O' THEN 0.3 ELSE 0.2 END), 2) "
       "AS overall_score FROM m GROUP BY ALL")
def weighted_score(spark, d):
    means = X.scores(spark, d).groupBy("config", "run_id", "judge").agg(F.avg("value").alias("s"))
    return E.weighted_score(means, ["config", "run_id"], "judge", "s", WEIGHTS)


@query("""
SELECT o_orderstatus, greatest(0, least(10, CAST(trunc(o_totalprice / 40000 - 1) AS INTEGER))) AS score, count(*) AS n
FROM orders GROUP BY ALL""")
def clamped_scores(spark, d):
    rows = table(spark, d, "orders").withColumn("score", F.col("o_totalprice") / 40000 - 1)
    return E.clamp_scores(rows, "score").groupBy("o_orderstatus", "score").agg(
        F.count(F.lit(1)).alias("n"))


@query(f"WITH {X.SCORES_SQL} SELECT config, run_id, round(avg(value), 2) AS mean, "
       "round(stddev_pop(value), 2) AS std, min(value) AS min, max(value) AS max, count(*) AS n "
       "FROM scores GROUP BY ALL")
def judgment_mean(spark, d):
    return E.aggregate_judgments(X.scores(spark, d), ["config", "run_id"], "value")


@query(f"WITH {X.SCORES_SQL} SELECT config, run_id, round(median(value), 2) AS mean, "
       "0.0::DOUBLE AS std, min(value) AS min, max(value) AS max, count(*) AS n "
       "FROM scores GROUP BY ALL")
def judgment_median(spark, d):
    return E.aggregate_judgments(X.scores(spark, d), ["config", "run_id"], "value", "median")


@query(f"""WITH {X.SCORES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY config, run_id ORDER BY value) AS up,
  row_number() OVER (PARTITION BY config, run_id ORDER BY value DESC) AS down,
  count(*) OVER (PARTITION BY config, run_id) AS n FROM scores)
SELECT config, run_id, round(avg(value), 2) AS mean, CASE WHEN n >= 4 THEN 0.0 ELSE round(stddev_pop(value), 2) END AS std,
  min(value) AS min, max(value) AS max, n
FROM r WHERE n < 4 OR (up > 1 AND down > 1) GROUP BY config, run_id, n""")
def judgment_trimmed(spark, d):
    return E.aggregate_judgments(X.scores(spark, d), ["config", "run_id"], "value",
                                 "trimmed_mean")


def _draw_sql(r, i, seed=42):
    a = f"(({r})::BIGINT * 48271 + ({i})::BIGINT * 69621 + {seed}) % 2147483647"
    b = f"(({a}) * ({a}) + {i} + 1) % 2147483647"
    return f"(({b}) * ({b}) + {r} + 1) % 2147483647"


def _wide_draw_sql(r, i, seed=42):
    return f"(({_draw_sql(r, i, seed)}) * 2147483647 + ({_draw_sql(r, i, seed + 1)}))"


@query(f"""WITH {X.RUNS_SQL}, v AS (SELECT config, metric, value, row_number() OVER (PARTITION BY config, metric ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY config, metric) AS n FROM runs),
p AS (SELECT config, metric, b, {_wide_draw_sql('b', 'i')} % n AS j FROM v, (SELECT unnest(range(1, 10001)) AS b)),
s AS (SELECT p.config, p.metric, b, avg(value) AS m FROM p JOIN v ON p.config = v.config AND p.metric = v.metric AND p.j = v.i GROUP BY ALL),
c AS (SELECT config, metric, round(quantile_cont(m, 0.025), 4) AS ci_lower, round(quantile_cont(m, 0.975), 4) AS ci_upper FROM s GROUP BY ALL)
SELECT config, metric, count(*) AS n_runs, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
  round(median(value), 4) AS median, ci_lower, ci_upper FROM runs JOIN c USING (config, metric) GROUP BY ALL""")
def replication_stats(spark, d):
    return E.replication_stats(X.run_scores(spark, d))


@query(f"""WITH {X.RUNS_SQL}, v AS (SELECT config, value, row_number() OVER (PARTITION BY config ORDER BY value) - 1 AS i,
  count(*) OVER (PARTITION BY config) AS n FROM runs),
p AS (SELECT config, b, {_wide_draw_sql('b', 'i')} % n AS j FROM v, (SELECT unnest(range(1, 10001)) AS b)),
s AS (SELECT p.config, b, avg(value) AS m FROM p JOIN v ON p.config = v.config AND p.j = v.i GROUP BY ALL)
SELECT config, round(quantile_cont(m, 0.025), 8) AS ci_lower, round(quantile_cont(m, 0.975), 8) AS ci_upper
FROM s GROUP BY config""")
def bootstrap_ci(spark, d):
    return _rounded(B.bootstrap_ci(X.run_scores(spark, d), ["config"], "value"),
                    ["ci_lower", "ci_upper"], 8)


@query(f"""WITH {X.RUNS_SQL}, v AS (SELECT CASE WHEN config < '3' THEN 'a' ELSE 'b' END AS side, value,
  row_number() OVER (ORDER BY value) - 1 AS i FROM runs),
f AS (SELECT count(CASE WHEN side = 'a' THEN 1 END) AS na, count(CASE WHEN side = 'b' THEN 1 END) AS nb, sum(value) AS total,
  abs(avg(CASE WHEN side = 'a' THEN value END) - avg(CASE WHEN side = 'b' THEN value END)) AS obs FROM v),
p AS (SELECT r, value, row_number() OVER (PARTITION BY r ORDER BY ({_draw_sql('r', 'i')}), i) AS pos
  FROM v, (SELECT unnest(range(1, 10001)) AS r)),
s AS (SELECT r, sum(value) AS sa FROM p, f WHERE pos <= na GROUP BY r)
SELECT 'overall' AS metric, count(CASE WHEN abs(sa / na - (total - sa) / nb) >= obs - 1e-12 THEN 1 END) / 10000.0 AS p FROM s, f""")
def permutation_test(spark, d):
    rows = X.run_scores(spark, d).withColumn("side", F.when(F.col("config") < "3", "a").otherwise("b"))
    return B.permutation_test(rows, ["metric"], "side", "value")


@query(f"""WITH {X.RUNS_SQL}, v AS (SELECT CASE WHEN config < '3' THEN 'a' ELSE 'b' END AS side, value FROM runs),
i AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM v),
p AS (SELECT side, b, CASE WHEN side = 'a' THEN {_wide_draw_sql('b', 'i')} ELSE {_wide_draw_sql('(b + 7000003)', 'i')} END % n AS j
      FROM i, (SELECT unnest(range(1, 5001)) AS b)),
m AS (SELECT b, p.side, count(*) AS n, avg(value) AS mu, var_samp(value) AS s2 FROM p JOIN i ON p.side = i.side AND p.j = i.i GROUP BY ALL),
d AS (SELECT x.b, (x.mu - y.mu) / sqrt(((x.n - 1) * x.s2 + (y.n - 1) * y.s2) / (x.n + y.n - 2)) * (1 - 3.0 / (4 * (x.n + y.n) - 9)) AS d
      FROM m x JOIN m y ON x.b = y.b AND x.side = 'a' AND y.side = 'b')
SELECT 'overall' AS metric, round(quantile_cont(d, 0.025), 8) AS d_lower, round(quantile_cont(d, 0.975), 8) AS d_upper FROM d""")
def bootstrap_effect(spark, d):
    rows = X.run_scores(spark, d).withColumn("side", F.when(F.col("config") < "3", "a").otherwise("b"))
    return _rounded(B.bootstrap_effect(rows, ["metric"], "side", "value"), ["d_lower", "d_upper"], 8)


_PAIRS = f"""WITH {X.RUNS_SQL},
m AS (SELECT config, metric, count(*) AS n, avg(value) AS mu, var_samp(value) AS s2 FROM runs GROUP BY ALL),
c AS (SELECT a.config AS config_a, b.config AS config_b, a.metric,
  round(round(a.mu, 4) - round(b.mu, 4), 4) AS mean_diff,
  round((a.mu - b.mu) / sqrt(((a.n - 1) * a.s2 + (b.n - 1) * b.s2) / (a.n + b.n - 2)) * (1 - 3.0 / (4 * (a.n + b.n) - 9)), 4) AS effect_size,
  a.n AS na FROM m a JOIN m b ON a.metric = b.metric AND a.config < b.config),
u AS (SELECT c.config_a, c.config_b, c.metric, c.na, r.config,
  rank() OVER (PARTITION BY config_a, config_b, c.metric ORDER BY value)
  + (count(*) OVER (PARTITION BY config_a, config_b, c.metric, value) - 1) / 2.0 AS r
  FROM c JOIN runs r ON r.config IN (c.config_a, c.config_b)),
s AS (SELECT config_a, config_b, metric, sum(CASE WHEN config = config_a THEN r END) - na * (na + 1) / 2.0 AS u FROM u GROUP BY config_a, config_b, metric, na)"""


@query(_PAIRS + f""",
z AS (SELECT config_a, config_b, metric, sum(pow(n, 3) - n) AS ties FROM (
  SELECT config_a, config_b, c.metric, value, count(*) AS n FROM c JOIN runs r ON r.metric = c.metric AND r.config IN (c.config_a, c.config_b)
  GROUP BY ALL) GROUP BY ALL),
sizes AS (SELECT config_a, config_b, c.metric, count(CASE WHEN config = config_a THEN 1 END) AS na, count(CASE WHEN config = config_b THEN 1 END) AS nb,
  sum(value) AS total, abs(avg(CASE WHEN config = config_a THEN value END) - avg(CASE WHEN config = config_b THEN value END)) AS obs
  FROM c JOIN runs r ON r.metric = c.metric AND r.config IN (c.config_a, c.config_b) GROUP BY ALL),
v AS (SELECT config_a, config_b, c.metric, value, row_number() OVER (PARTITION BY config_a, config_b, c.metric ORDER BY value) - 1 AS i
  FROM c JOIN runs r ON r.metric = c.metric AND r.config IN (c.config_a, c.config_b)),
o AS (SELECT config_a, config_b, metric, b, value, row_number() OVER (PARTITION BY config_a, config_b, metric, b ORDER BY {_draw_sql('b', 'i')}, i) AS pos
  FROM v, (SELECT unnest(range(1, 1001)) AS b)),
h AS (SELECT config_a, config_b, metric, b, sum(value) AS sa FROM o JOIN sizes USING (config_a, config_b, metric) WHERE pos <= na GROUP BY ALL),
pp AS (SELECT config_a, config_b, metric, count(CASE WHEN abs(sa / na - (total - sa) / nb) >= obs - 1e-12 * greatest(1.0, obs) THEN 1 END) / 1000.0 AS p
  FROM h JOIN sizes USING (config_a, config_b, metric) GROUP BY ALL)
SELECT config_a, config_b, metric, mean_diff, effect_size, u AS mann_whitney_u,
  round({P.u_two_sided('u', 'sizes.na', 'sizes.nb', 'ties')}, 6) AS mann_whitney_p, p AS permutation_p
FROM c JOIN s USING (config_a, config_b, metric) JOIN z USING (config_a, config_b, metric) JOIN sizes USING (config_a, config_b, metric)
JOIN pp USING (config_a, config_b, metric)""")
def compare_configs(spark, d):
    return E.compare_configs(X.run_scores(spark, d), permutations=1000)


@query("""
WITH p AS (SELECT l_suppkey, l_returnflag, count(CASE WHEN l_discount > 0.09 THEN 1 END) / count(*) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p, l_suppkey) AS rank,
  count(*) OVER (PARTITION BY l_returnflag) AS n FROM p)
SELECT l_suppkey, l_returnflag, rank, p < 0.5 / (n - rank + 1) AS significant FROM r""")
def holm_correction(spark, d):
    p = table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        (F.count_if(F.col("l_discount") > 0.09) / F.count(F.lit(1))).alias("p"))
    return E.holm(p, "p", 0.5, ["l_returnflag"], ["l_suppkey"]).select(
        "l_suppkey", "l_returnflag", "rank", "significant")


@query(f"""WITH {X.RUNS_SQL}, c AS (SELECT config, metric, count(*) AS n, round(stddev_samp(value) / avg(value), 4) AS cv FROM runs GROUP BY ALL)
SELECT *, CASE WHEN cv < 0.15 THEN 'stable' WHEN cv < 0.25 THEN 'moderate' ELSE 'unstable' END AS band FROM c""")
def score_stability(spark, d):
    return E.stability(X.run_scores(spark, d))


@query(f"WITH {X.SCORES_SQL}, c AS (SELECT DISTINCT config FROM scores) "
       "SELECT a.config AS config_a, b.config AS config_b FROM c a JOIN c b ON a.config < b.config")
def config_pairs(spark, d):
    return E.config_pairs(X.scores(spark, d))


_ALPHA = """u AS (SELECT {k} unit, count(*) AS m, sum({v}) AS s, sum({v} * {v}) AS q FROM {t} GROUP BY ALL HAVING count(*) >= 2),
s AS (SELECT {k} sum(m) AS n, sum(s) AS s, sum(q) AS q, sum(2 * (m * q - s * s) / (m - 1)) AS w FROM u {g})"""


@query(f"WITH {X.RATINGS_SQL}, " + _ALPHA.format(k="", v="score", t="ratings", g="")
       + " SELECT (SELECT count(*) FROM ratings) AS ratings, "
         "round(1 - (w / n) / (2 * (n * q - s * s) / (n * (n - 1))), 4) AS alpha FROM s")
def alpha_interval(spark, d):
    return A.krippendorff_alpha(X.label_ratings(spark, d), [], ["unit"], "score")


@query(f"WITH {X.LINE_RATINGS_SQL}, "
       + _ALPHA.format(k="criterion,", v="score", t="lines", g="GROUP BY criterion")
       + " SELECT criterion, (SELECT count(*) FROM lines l WHERE l.criterion = s.criterion) AS ratings, "
         "round(1 - (w / n) / (2 * (n * q - s * s) / (n * (n - 1))), 4) AS alpha FROM s")
def alpha_per_criterion(spark, d):
    return A.krippendorff_alpha(X.line_ratings(spark, d), ["criterion"], ["unit"], "score")


@query(f"""WITH {X.LINE_RATINGS_SQL}, p AS (SELECT *, count(*) OVER (PARTITION BY criterion, unit) AS m FROM lines),
k AS (SELECT criterion, unit, rank() OVER (PARTITION BY criterion ORDER BY score)
   + (count(*) OVER (PARTITION BY criterion, score) - 1) / 2.0 AS v FROM p WHERE m >= 2), """
       + _ALPHA.format(k="criterion,", v="v", t="k", g="GROUP BY criterion")
       + " SELECT criterion, (SELECT count(*) FROM lines l WHERE l.criterion = s.criterion) AS ratings, "
         "round(1 - (w / n) / (2 * (n * q - s * s) / (n * (n - 1))), 4) AS alpha FROM s")
def alpha_ordinal(spark, d):
    return A.krippendorff_alpha(X.line_ratings(spark, d), ["criterion"], ["unit"], "score", "ordinal")


@query(f"""WITH {X.LINE_RATINGS_SQL}, p AS (SELECT *, count(*) OVER (PARTITION BY criterion, unit) AS m FROM lines),
c AS (SELECT criterion, unit, m, score, count(*)::DOUBLE AS c FROM p WHERE m >= 2 GROUP BY ALL),
u AS (SELECT criterion, unit, m, sum(c * c) AS same FROM c GROUP BY ALL),
s AS (SELECT criterion, sum(m)::DOUBLE AS n, sum((m * m - same) / (m - 1)) AS w FROM u GROUP BY criterion),
e AS (SELECT criterion, sum(t * t) AS same FROM (SELECT criterion, score, sum(c) AS t FROM c GROUP BY ALL) GROUP BY criterion)
SELECT criterion, (SELECT count(*) FROM lines l WHERE l.criterion = s.criterion) AS ratings,
  round(1 - (w / n) / ((n * n - same) / (n * (n - 1))), 4) AS alpha FROM s JOIN e USING (criterion)""")
def alpha_nominal(spark, d):
    return A.krippendorff_alpha(X.line_ratings(spark, d), ["criterion"], ["unit"], "score", "nominal")


@query(f"""WITH {X.LINE_RATINGS_SQL}, p AS (SELECT a.criterion, a.judge AS ja, b.judge AS jb, a.score AS sa, b.score AS sb
  FROM lines a JOIN lines b ON a.criterion = b.criterion AND a.unit = b.unit AND a.judge < b.judge),
r AS (SELECT criterion, ja, jb, rank() OVER (PARTITION BY criterion, ja, jb ORDER BY sa)
    + (count(*) OVER (PARTITION BY criterion, ja, jb, sa) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY criterion, ja, jb ORDER BY sb)
    + (count(*) OVER (PARTITION BY criterion, ja, jb, sb) - 1) / 2.0 AS rb FROM p),
c AS (SELECT criterion, ja, jb, round(corr(ra, rb), 4) AS rho FROM r GROUP BY ALL HAVING count(*) >= 3)
SELECT criterion, round(avg(rho), 4) AS spearman, count(*) AS judge_pairs FROM c WHERE rho IS NOT NULL GROUP BY criterion""")
def spearman_agreement(spark, d):
    return A.spearman_agreement(X.line_ratings(spark, d), ["criterion"], ["unit"], "judge", "score")


@query("""
WITH p AS (SELECT l_linestatus AS criterion, CASE WHEN l_quantity < 17 THEN 'poor' WHEN l_quantity < 34 THEN 'acceptable' ELSE 'good' END AS human,
  CASE WHEN l_discount < 0.03 THEN 'poor' WHEN l_discount < 0.07 THEN 'acceptable' ELSE 'good' END AS model FROM lineitem),
v AS (SELECT criterion, list_position(['poor', 'acceptable', 'good'], human) AS h, list_position(['poor', 'acceptable', 'good'], model) AS m FROM p)
SELECT criterion, count(*) AS total, count(CASE WHEN h = m THEN 1 END) AS correct,
  round(count(CASE WHEN h = m THEN 1 END) / count(*), 3) AS accuracy,
  round(count(CASE WHEN m > h THEN 1 END) / count(*), 4) AS lenient_rate,
  round(count(CASE WHEN m < h THEN 1 END) / count(*), 4) AS strict_rate,
  count(CASE WHEN m > h THEN 1 END) / count(*) > 0.3 AS too_lenient,
  count(CASE WHEN m < h THEN 1 END) / count(*) > 0.3 AS too_strict FROM v GROUP BY criterion""")
def reviewer_calibration(spark, d):
    def band(c, lo, hi):
        return F.when(F.col(c) < lo, "poor").when(F.col(c) < hi, "acceptable").otherwise("good")
    pairs = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("criterion"), band("l_quantity", 17, 34).alias("human"),
        band("l_discount", 0.03, 0.07).alias("model"))
    return A.calibration(pairs, ["criterion"], "human", "model")


@query(f"""WITH {X.VERDICTS_SQL}, b AS (SELECT dataset, judge, least(run_a, run_b) AS lo, greatest(run_a, run_b) AS hi,
  max(CASE WHEN run_a < run_b THEN winner END) AS w1, max(CASE WHEN run_a > run_b THEN winner END) AS w2 FROM verdicts GROUP BY ALL)
SELECT dataset, judge, lo AS run_a, hi AS run_b, coalesce(w1 = w2, false) AS consistent,
  CASE WHEN w1 = w2 THEN w1 ELSE 'tie' END AS winner FROM b""")
def swap_consensus(spark, d):
    return K.swap_consensus(X.verdicts(spark, d))


@query(f"""WITH {X.GAMES_SQL}, s AS (
  SELECT run_a AS player, run_b AS opponent, CASE WHEN winner = run_a THEN 1.0 WHEN winner = 'tie' THEN 0.5 ELSE 0 END AS w FROM games
  UNION ALL SELECT run_b, run_a, CASE WHEN winner = run_b THEN 1.0 WHEN winner = 'tie' THEN 0.5 ELSE 0 END FROM games)
SELECT player, opponent, sum(w)::DOUBLE AS wins, count(*) AS games, round((sum(w) / count(*))::DOUBLE, 8) AS win_rate FROM s GROUP BY ALL""")
def win_rate_matrix(spark, d):
    return _rounded(K.win_matrix(X.games(spark, d)), ["win_rate"], 8)


@query()
def bradley_terry(spark, d):
    return K.bradley_terry(X.games(spark, d))


ELO_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "run_a", "run_b"]


@query()
def elo_ratings(spark, d):
    return K.elo(X.games(spark, d), ["dataset", "judge"], ELO_ORDER)


@query(f"""WITH {X.GAMES_SQL}, s AS (
  SELECT run_a AS player, CASE WHEN winner = run_a THEN 1.0 WHEN winner = 'tie' THEN 0.5 ELSE 0 END AS w FROM games
  UNION ALL SELECT run_b, CASE WHEN winner = run_b THEN 1.0 WHEN winner = 'tie' THEN 0.5 ELSE 0 END FROM games),
r AS (SELECT player, (sum(w) / count(*))::DOUBLE AS strength FROM s GROUP BY player),
l AS (SELECT 'n' || n_nationkey AS run_id, CASE WHEN n_regionkey = 0 THEN '' ELSE r_name END AS run_label FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT coalesce(nullif(run_label, ''), player) AS config, round(avg(strength), 4) AS strength, count(*) AS runs
FROM r LEFT JOIN l ON player = run_id GROUP BY 1""")
def config_rankings(spark, d):
    return K.config_rankings(*_strengths(spark, d))


def _strengths(spark, d):
    counts = K.win_counts(X.games(spark, d)).groupBy("player").agg(
        (F.sum("wins") / F.sum("games")).alias("strength"))
    labels = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("run_id"),
        F.when(F.col("n_regionkey") == 0, "").otherwise(F.col("r_name")).alias("run_label"))
    return counts, labels


@query("""
WITH g AS (SELECT o_orderpriority AS config, 'r' || o_custkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'cleaning' WHEN 'O' THEN 'analysis' ELSE 'report' END AS stage,
  CASE WHEN o_orderkey % 3 = 0 THEN 'retry1' ELSE '' END AS attempt_label, o_totalprice / 500000 AS q FROM orders),
r AS (SELECT config, run_id, stage, avg(q) AS m FROM g WHERE attempt_label = '' AND stage IN ('cleaning', 'analysis') GROUP BY ALL)
SELECT config, stage, round(avg(m), 8) AS mean, round(stddev_samp(m), 8) AS std, count(*) AS runs FROM r GROUP BY ALL""")
def gate_scores(spark, d):
    return _rounded(E.gate_scores(_gates(spark, d)), ["mean", "std"], 8)


def _gates(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("config"),
        F.concat(F.lit("r"), F.col("o_custkey").cast("string")).alias("run_id"),
        F.when(F.col("o_orderstatus") == "F", "cleaning").when(
            F.col("o_orderstatus") == "O", "analysis").otherwise("report").alias("stage"),
        F.when(F.col("o_orderkey") % 3 == 0, "retry1").otherwise("").alias("attempt_label"),
        (F.col("o_totalprice") / 500000).alias("quality_score"))


@query("""
WITH r AS (SELECT l_returnflag AS config, l_suppkey AS run_id, avg(l_quantity) AS a, avg(CASE WHEN l_tax > 0 THEN l_tax END) AS b FROM lineitem GROUP BY ALL)
SELECT config, 'l_quantity' AS metric, round(avg(a), 8) AS mean, round(stddev_samp(a), 8) AS std, count(a) AS runs FROM r GROUP BY config
UNION ALL SELECT config, 'tax', round(avg(b), 8), round(stddev_samp(b), 8), count(b) FROM r GROUP BY config""")
def structural_scores(spark, d):
    return _rounded(E.structural_scores(_structure(spark, d), ["l_quantity", "tax"]), ["mean", "std"], 8)


def _structure(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("config"), F.col("l_suppkey").alias("run_id"), "l_quantity",
        F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"))


@query(f"WITH {X.SCORES_SQL} SELECT config, dataset, judge, CAST(round(CAST(avg(value) AS DECIMAL(24, 14)), 3) AS DOUBLE) AS mean, count(*) AS n FROM scores GROUP BY ALL")
def scores_by_dataset_judge(spark, d):
    return E.scores_by(X.scores(spark, d), ["config", "dataset", "judge"], "value")


@query(f"""WITH {X.SCORES_SQL}, m AS (SELECT config, run_id AS dataset, avg(value) AS m FROM scores GROUP BY ALL),
r AS (SELECT a.config AS config_a, b.config AS config_b, corr(a.m, b.m) AS r, count(*) AS n_datasets
  FROM m a JOIN m b ON a.dataset = b.dataset AND a.config < b.config GROUP BY ALL)
SELECT config_a, config_b, round(r, 4) AS pearson_r,
  round({P.t_two_sided('(r * sqrt((n_datasets - 2) / (1 - r * r)))', '(n_datasets - 2)')}, 4) AS p_value, n_datasets FROM r""")
def cross_dataset_correlation(spark, d):
    rows = X.scores(spark, d).select("config", F.col("run_id").alias("dataset"), "value")
    return E.cross_dataset_correlation(rows)


@query("""
SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS r,
  round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem""")
def metric_agreement(spark, d):
    out = E.metric_agreement(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", F.round("r", 8).alias("r"), F.round("slope", 6).alias("slope"),
                      F.round("intercept", 4).alias("intercept"))


@query("""
SELECT run_id, count(*) AS files, count(CASE WHEN complete THEN 1 END) AS complete,
  round(avg(plots), 1) AS avg_plots, round(avg(claims), 1) AS avg_claims, round(avg(gaps), 1) AS avg_gaps,
  count(CASE WHEN complete THEN 1 END) || '/' || count(*) AS stages_complete FROM (
  SELECT l_suppkey AS run_id, l_discount < 0.07 AS complete, l_quantity + 0.003 AS plots, l_linenumber + 0.007 AS claims, l_tax * 100 + 0.011 AS gaps FROM lineitem) GROUP BY run_id""")
def compare_runs(spark, d):
    files = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("run_id"), (F.col("l_discount") < 0.07).alias("complete"),
        (F.col("l_quantity") + 0.003).alias("plots"), (F.col("l_linenumber") + 0.007).alias("claims"),
        (F.col("l_tax") * 100 + 0.011).alias("gaps"))
    return E.compare_runs(files)


@query("""
WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS run_label FROM orders)
SELECT coalesce(nullif(run_label, ''), run_id) AS config, count(*) AS n FROM r GROUP BY 1""")
def config_labels(spark, d):
    runs = table(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("").alias("run_label"))
    return E.config_label(runs).groupBy("config").agg(F.count(F.lit(1)).alias("n"))


@query()
def ablation_overview(spark, d):
    counts, labels = _strengths(spark, d)
    tables = E.ablation_tables(
        X.scores(spark, d), gates=_gates(spark, d), structure=_structure(spark, d),
        structural_metrics=["l_quantity", "tax"], strengths=counts, labels=labels)
    parts = [t.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
             for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# Store -----------------------------------------------------------------------------

_UPSERT = """
SELECT l_suppkey, l_returnflag, arg_max(l_linestatus, l_orderkey * 10 + l_linenumber) AS l_linestatus,
  arg_max(l_extendedprice, l_orderkey * 10 + l_linenumber) AS l_extendedprice, max(l_orderkey * 10 + l_linenumber) AS version FROM (
  SELECT * FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT * FROM lineitem WHERE l_linestatus = 'F')
GROUP BY ALL"""


@query(_UPSERT)
def keyed_upsert(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"))
    out = S.upsert(li.filter("l_linestatus = 'O'"), li.filter("l_linestatus = 'F'"),
                   ["l_suppkey", "l_returnflag"], "version")
    return out.select("l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice", "version")


@query(_UPSERT)
def stored_upsert(spark, d):
    li = table(spark, d, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_extendedprice",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"))
    path = f"{ensure_checkpoint_dir(spark)}/store-{uuid.uuid4().hex}"
    for status in ("O", "F"):
        S.upsert_store(path, li.filter(F.col("l_linestatus") == status), ["l_suppkey", "l_returnflag"], "version")
    return S.read_store(spark, path)



@query("""
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def skip_existing(spark, d):
    stored = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey"))
    return S.skip_existing(table(spark, d, "customer"), stored, ["c_custkey"]).select("c_custkey")


@query(f"""WITH {X.SCORES_SQL} SELECT config, round(avg(CASE WHEN dataset = 'BUILDING' THEN value END), 6) AS "BUILDING",
  round(avg(CASE WHEN dataset = 'MACHINERY' THEN value END), 6) AS "MACHINERY" FROM scores GROUP BY config""")
def export_wide(spark, d):
    out = S.wide_by_metric(X.scores(spark, d), ["config"], "dataset", "value",
                           ["BUILDING", "MACHINERY"])
    return _rounded(out, ["BUILDING", "MACHINERY"])


@query("""
WITH s AS (SELECT o_orderpriority AS player, o_orderstatus AS ranking_method, avg(o_totalprice) AS strength FROM orders GROUP BY ALL)
SELECT player, ranking_method, round(strength, 4) AS strength,
  row_number() OVER (PARTITION BY ranking_method ORDER BY strength DESC, player) AS rank_position FROM s""")
def rank_positions(spark, d):
    s = table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("player"), F.col("o_orderstatus").alias("ranking_method")).agg(
        F.avg("o_totalprice").alias("strength"))
    return _rounded(S.rank_positions(s).withColumn(
        "rank_position", F.col("rank_position").cast("bigint")), ["strength"], 4)


@query(f"""WITH {X.GAMES_SQL}, t AS (SELECT run_a, run_b, winner, count(*) AS n FROM games GROUP BY ALL),
r AS (SELECT run_a, sha256(string_agg(run_b || ',' || winner || ',' || n, ';' ORDER BY run_b, winner)) AS h FROM t GROUP BY run_a)
SELECT substr(sha256(string_agg(run_a || '=' || h, ';' ORDER BY run_a)), 1, 16) AS comparison_set_hash FROM r""")
def comparison_set_hash(spark, d):
    return S.comparison_set_hash(X.games(spark, d))
