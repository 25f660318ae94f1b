import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions import tails
from assay.operators import agreement as A
from assay.operators import correlation as R
from assay.operators import evaluation as E
from assay.operators import hypothesis as H
from assay.operators import rankings as K
from assay.operators import resampling as B


def test_tails_against_tables(spark):
    df = spark.range(1).select(
        tails.normal_two_sided(F.lit(1.959964)).alias("z"),
        tails.t_two_sided(F.lit(2.228139), F.lit(10.0)).alias("t"),
        tails.f_upper(F.lit(4.102821), F.lit(2.0), F.lit(10.0)).alias("f"),
        tails.chi2_upper(F.lit(11.0705), F.lit(5.0)).alias("c"))
    row = df.first()
    assert all(row[c] == pytest.approx(0.05, abs=2e-6) for c in ("z", "t", "f", "c"))


@pytest.fixture(scope="module")
def groups(spark):
    # Textbook three-group example: F = 9.3, df 2 and 15.
    data = {"a": [6, 8, 4, 5, 3, 4], "b": [8, 12, 9, 11, 6, 8], "c": [13, 9, 11, 8, 7, 12]}
    return spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs], "g string, v double")


def test_anova_known(groups):
    r = H.anova(groups, [], "g", "v").first()
    assert r["f"] == pytest.approx(9.2647, abs=1e-3) and r["p"] == pytest.approx(0.0024, abs=1e-4)


def test_kruskal_and_mann_whitney(groups):
    vals = {g: [] for g in "abc"}
    for r in groups.collect():
        vals[r["g"]].append(r["v"])
    u = sum((x > y) + 0.5 * (x == y) for x in vals["a"] for y in vals["b"])
    assert H.mann_whitney(groups, [], "g", "v", "a", "b").first()["u"] == u
    h = H.kruskal_wallis(groups, [], "g", "v", rows_per_piece=4).first()
    assert h["k"] == 3 and 0 < h["p"] < 0.02
    few = groups.filter("g = 'a'").limit(3).union(groups.filter("g = 'b'").limit(1))
    assert tuple(H.mann_whitney(few, [], "g", "v", "a", "b").first())[2:] == (0.0, 1.0)


def test_zero_variance(spark):
    flat = spark.createDataFrame([(g, 1.0) for g in "aabb"], "g string, v double")
    assert H.anova(flat, [], "g", "v").first()["f"] is None
    assert H.t_test(flat, [], "g", "v", "a", "b").first()["t"] is None
    assert H.anova(flat.filter("g = 'a'"), [], "g", "v").count() == 0


def test_spearman_split(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, 300).astype(float)
    y = x + rng.normal(size=300) * 20
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    whole = R.spearman(df, ["x", "y"]).first()["r"]
    assert R.spearman(df, ["x", "y"], rows_per_piece=25).first()["r"] == pytest.approx(whole)


def brute_alpha(units, distance):
    pairs, values = [], []
    for vs in units:
        if len(vs) > 1:
            values += vs
            pairs += [(a, b, 1 / (len(vs) - 1)) for i, a in enumerate(vs) for j, b in enumerate(vs) if i != j]
    n = len(values)
    do = sum(w * distance(a, b) for a, b, w in pairs) / n
    de = sum(distance(a, b) for a in values for b in values) / (n * (n - 1))
    return 1 - do / de


def test_alpha_against_pairs(spark):
    rng = np.random.default_rng(4)
    units = [[float(v) for v in rng.integers(0, 4, rng.integers(1, 4))] for _ in range(40)]
    df = spark.createDataFrame([(i, v) for i, vs in enumerate(units) for v in vs], "u int, v double")
    got = A.krippendorff_alpha(df, [], ["u"], "v").first()["alpha"]
    assert got == pytest.approx(brute_alpha(units, lambda a, b: (a - b) ** 2), abs=1e-4)
    got = A.krippendorff_alpha(df, [], ["u"], "v", "nominal").first()["alpha"]
    assert got == pytest.approx(brute_alpha(units, lambda a, b: float(a != b)), abs=1e-4)
    kept = sorted(v for vs in units if len(vs) > 1 for v in vs)
    rank = {v: kept.index(v) + (kept.count(v) + 1) / 2 for v in kept}
    got = A.krippendorff_alpha(df, [], ["u"], "v", "ordinal").first()["alpha"]
    assert got == pytest.approx(brute_alpha(units, lambda a, b: (rank[a] - rank[b]) ** 2), abs=1e-4)


@pytest.mark.parametrize("rows, alpha", [
    ([(1, 2.0)], None), ([(1, 2.0), (2, 2.0)], 1.0), ([(1, 2.0), (2, 3.0)], None),
    ([(1, 1.0), (1, 1.0), (2, 5.0), (2, 5.0)], 1.0)])
def test_alpha_edges(spark, rows, alpha):
    df = spark.createDataFrame(rows, "u int, v double")
    assert A.krippendorff_alpha(df, [], ["u"], "v").first()["alpha"] == alpha


GAMES = [("a", "b", "a"), ("b", "a", "a"), ("a", "c", "tie"), ("b", "c", "c"), ("c", "b", "b"),
         ("a", "b", "b"), ("c", "a", "a"), ("b", "c", "c")]


@pytest.fixture(scope="module")
def games(spark):
    rows = [(i, "d", *g) for i, g in enumerate(GAMES)]
    return spark.createDataFrame(rows, "i int, dataset string, run_a string, run_b string, winner string")


def test_bradley_terry_fixed_point(games):
    got = {r["player"]: r["strength"] for r in K.bradley_terry(games).collect()}
    assert sum(got.values()) == pytest.approx(0, abs=1e-3)
    p = {k: math.exp(v) for k, v in got.items()}
    for me in p:  # wins equal expected wins at the maximum
        won = sum(1.0 if w == me else 0.5 if w == "tie" else 0 for a, b, w in GAMES if me in (a, b))
        want = sum(p[me] / (p[a] + p[b]) for a, b, _ in GAMES if me in (a, b))
        assert won == pytest.approx(want, abs=1e-3)


def test_no_win_player_ranks_last(spark):
    g = spark.createDataFrame([("a", "z", "a"), ("b", "z", "b"), ("a", "b", "a"), ("b", "a", "b")],
                              "run_a string, run_b string, winner string")
    got = {r["player"]: r["strength"] for r in K.bradley_terry(g).collect()}
    assert min(got, key=got.get) == "z" and got["z"] < -5


def test_elo_matches_sequence(games):
    want = {}
    for a, b, w in GAMES:
        ra, rb = want.get(a, 1000.0), want.get(b, 1000.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        s = 1.0 if w == a else 0.0 if w == b else 0.5
        want[a], want[b] = ra + 32 * (s - e), rb - 32 * (s - e)
    got = {r["player"]: r["rating"] for r in K.elo(games.repartition(4), ["dataset"], ["i"]).collect()}
    assert got == {k: round(v, 1) for k, v in want.items()}


def test_swap_consensus(spark):
    g = spark.createDataFrame([
        ("d", "j", "a", "b", "a"), ("d", "j", "b", "a", "a"),      # both orders say a
        ("d", "j", "a", "c", "a"), ("d", "j", "c", "a", "c"),      # the first shown wins: biased
        ("d", "j", "b", "c", "tie")], "dataset string, judge string, run_a string, run_b string, winner string")
    got = {(r["run_a"], r["run_b"]): (r["consistent"], r["winner"]) for r in K.swap_consensus(g).collect()}
    assert got == {("a", "b"): (True, "a"), ("a", "c"): (False, "tie"), ("b", "c"): (False, "tie")}


def test_bootstrap_and_permutation(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(0, 1, 12), rng.normal(1.2, 1, 12)
    df = spark.createDataFrame([("m", "a", float(v)) for v in a] + [("m", "b", float(v)) for v in b],
                               "metric string, side string, v double")
    ci = B.bootstrap_ci(df.filter("side = 'a'"), ["metric"], "v", 800).first()
    draws = [rng.choice(a, 12).mean() for _ in range(4000)]
    assert ci["ci_lower"] == pytest.approx(np.percentile(draws, 2.5), abs=0.15)
    assert ci["ci_upper"] == pytest.approx(np.percentile(draws, 97.5), abs=0.15)
    again = B.bootstrap_ci(df.filter("side = 'a'").repartition(3), ["metric"], "v", 800,
                           rows_per_piece=4).first()
    assert again["ci_lower"] == pytest.approx(ci["ci_lower"])
    p = B.permutation_test(df, ["metric"], "side", "v", 400).first()["p"]
    pool = np.concatenate([a, b])
    ref = np.mean([abs((s := rng.permutation(pool))[:12].mean() - s[12:].mean())
                   >= abs(a.mean() - b.mean()) for _ in range(4000)])
    assert p == pytest.approx(ref, abs=0.04)
    one = spark.createDataFrame([("m", "a", 2.0)], "metric string, side string, v double")
    r = B.bootstrap_ci(one, ["metric"], "v", 50).first()
    assert (r["ci_lower"], r["ci_upper"]) == (2.0, 2.0)
    assert B.permutation_test(one, ["metric"], "side", "v", 50).first()["p"] == 1.0


def test_compare_and_holm(spark):
    rows = [(c, "m", float(v)) for c, vs in {"x": [1, 2, 3], "y": [4, 5, 7], "z": [2, 2, 2], "s": [1]}.items()
            for v in vs]
    df = spark.createDataFrame(rows, "config string, metric string, value double")
    got = {(r["config_a"], r["config_b"]): r for r in E.compare_configs(df).collect()}
    assert set(got) == set(itertools.combinations(["x", "y", "z"], 2))
    xy = got[("x", "y")]
    sd = math.sqrt((np.var([1, 2, 3], ddof=1) + np.var([4, 5, 7], ddof=1)) / 2)
    assert xy["effect_size"] == pytest.approx((2 - 16 / 3) / sd * (1 - 3 / 15), abs=1e-3)
    assert xy["mann_whitney_u"] == 0.0
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.045)], "n string, p double")
    loose = {r["n"]: r["significant"] for r in E.holm(p, "p", tie=["n"]).collect()}
    strict = {r["n"]: r["significant"] for r in E.holm(p, "p", tie=["n"], strict=True).collect()}
    assert loose == {"a": True, "c": False, "b": False, "d": True}
    assert strict == {"a": True, "c": False, "b": False, "d": False}


def test_trimmed_mean(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 5.0, 9.0, 9.0)] + [("b", 2.0), ("b", 4.0)],
                               "u string, s double")
    got = {r["u"]: r for r in E.aggregate_judgments(df, ["u"], "s", "trimmed_mean").collect()}
    assert (got["a"]["mean"], got["a"]["min"], got["a"]["max"], got["a"]["n"]) == (5.0, 1.0, 9.0, 5)
    assert (got["b"]["mean"], got["b"]["std"]) == (3.0, 1.0)


def test_two_way_anova_with_unequal_cells(spark):
    rows = [("x", "p", v) for v in (1.0, 2.0, 4.0, 3.0, 2.5)] + [("x", "q", v) for v in (5.0, 7.0)]
    rows += [("y", "p", v) for v in (9.0,)] + [("y", "q", v) for v in (2.0, 1.0, 0.5, 3.0, 2.2, 1.1)]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    got = {r.source: r for r in H.two_way_anova(df, "a", "b", "v").collect()}
    y = np.array([r[2] for r in rows])
    a, b = (np.array([float(r[i] == k) for r in rows]) for i, k in ((0, "x"), (1, "p")))

    def residual(*columns):
        x = np.stack([np.ones(len(y)), *columns], 1)
        return float(((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum())

    steps = [residual(), residual(a), residual(a, b), residual(a, b, a * b)]
    for name, high, low in zip(("a", "b", "a:b"), steps, steps[1:]):
        assert abs(got[name].ss - (high - low)) < 1e-9 and got[name].ss >= 0


def test_two_way_anova_of_many_levels(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, 9000), rng.integers(0, 2500, 9000)
    y = rng.normal(size=9000) + a + 0.01 * b
    df = spark.createDataFrame([(int(i), int(j), float(v)) for i, j, v in zip(a, b, y)], "a int, b int, v double")
    got = {r.source: r for r in H.two_way_anova(df, "a", "b", "v").collect()}
    levels = {v: i for i, v in enumerate(np.unique(b))}
    at = np.array([levels[v] for v in b])
    k, size = len(levels), np.bincount(at)
    assert k > 2000
    # b is eliminated here: residuals within b, then three equations for a
    def within(v):
        return v - (np.bincount(at, v) / size)[at]

    x = np.stack([within((a == i).astype(float)) for i in range(3)], 1)
    r = within(y)
    both = float((r ** 2).sum() - r @ x @ np.linalg.pinv(x.T @ x) @ x.T @ r)
    alone = sum(((y[a == i] - y[a == i].mean()) ** 2).sum() for i in range(3))
    cell = np.unique(a * 10_000 + b, return_inverse=True)[1]
    full = float(((y - (np.bincount(cell, y) / np.bincount(cell))[cell]) ** 2).sum())
    assert got["b"].ss == pytest.approx(alone - both, rel=1e-9) and got["b"].df == k - 1
    assert got["a:b"].ss == pytest.approx(both - full, rel=1e-9) and 0 < got["a:b"].p < 1


def test_exact_mann_whitney_of_small_samples(spark):
    first, second = [1.1, 2.3, 0.4, 5.5], [3.3, 6.1, 7.2, 8.8, 2.9]
    df = spark.createDataFrame([("a", v) for v in first] + [("b", v) for v in second], "g string, v double")
    got = H.mann_whitney(df, [], "g", "v", "a", "b").first()
    every = first + second
    us = [sum(x > y for x in pick for y in set(every) - set(pick)) for pick in itertools.combinations(every, len(first))]
    big = max(got.u, len(first) * len(second) - got.u)
    assert abs(got.p - min(1.0, 2 * sum(u >= big for u in us) / len(us))) < 1e-12


def test_small_sample_p_against_known_tables():
    from assay.functions.tails import _u_tail

    assert abs(_u_tail(3, 3)[9] - 1 / 20) < 1e-12 and _u_tail(3, 3)[0] == 1.0
    assert abs(_u_tail(2, 4)[8] - 1 / 15) < 1e-12 and len(_u_tail(5, 40)) == 201


def test_leaf_counts_add_up_and_follow_their_law():
    take = np.full(4000, 1000, np.int64)
    for replace in (True, False):
        counts = B.leaf_counts(1000 if replace else 1700, take, range(17), replace, 3, 100)
        assert (sum(counts.values()) == 1000).all()
        if replace:
            assert counts[4].mean() == pytest.approx(100, abs=1) and counts[4].var() == pytest.approx(90, rel=0.1)
        else:
            n, share = 1700, 1000 / 1700
            assert counts[4].mean() == pytest.approx(100 * share, abs=0.5)
            assert counts[4].var() == pytest.approx(100 * share * (1 - share) * (n - 100) / (n - 1), rel=0.1)
    # A task that needs two leaves only finds the counts that all tasks find.
    some, all_ = B.leaf_counts(1000, take, [3, 8], True, 3, 100), B.leaf_counts(1000, take, range(10), True, 3, 100)
    assert (some[3] == all_[3]).all() and (some[8] == all_[8]).all() and len(some) == 2
    big = B.leaf_counts(1 << 40, np.full(2000, 1 << 39, np.int64), [0, 7], False, 3, 1 << 36)
    assert big[7].mean() == pytest.approx(2 ** 35, rel=1e-4)


def test_splits_keep_the_distribution(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.normal(10, 2, 700), 1), np.round(rng.normal(10.4, 2, 500), 1)
    rows = [("m", "a", float(v)) for v in a] + [("m", "b", float(v)) for v in b] + [("k", "a", 5.0)] * 300 + [("k", "b", 5.0)] * 300
    df = spark.createDataFrame(rows, "metric string, side string, v double")
    whole, cut = ({r["metric"]: r for r in B.bootstrap_ci(df, ["metric"], "v", 2000, leaf_size=n).collect()} for n in (1 << 16, 64))
    for m, spread in (("m", 0.02), ("k", 1e-12)):
        assert cut[m]["ci_lower"] == pytest.approx(whole[m]["ci_lower"], abs=spread)
        assert cut[m]["ci_upper"] == pytest.approx(whole[m]["ci_upper"], abs=spread)
    p, q = ({r["metric"]: r["p"] for r in B.permutation_test(df, ["metric"], "side", "v", 2000, leaf_size=n).collect()} for n in (1 << 16, 64))
    assert q["m"] == pytest.approx(p["m"], abs=0.01) and p["k"] == q["k"] == 1.0
    d, e = ({r["metric"]: r for r in B.bootstrap_effect(df, ["metric"], "side", "v", 2000, leaf_size=n).collect()} for n in (1 << 16, 64))
    assert e["m"]["d_lower"] == pytest.approx(d["m"]["d_lower"], abs=0.03) and (d["k"]["d_lower"], e["k"]["d_upper"]) == (0.0, 0.0)


def test_resampling_plan_moves_no_replicated_rows(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "CAST(id AS DOUBLE) AS v")
    plan = B.bootstrap_means(df, ["g"], "v", 100)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence") == 1  # leaves of a run of equal values
    assert "FlatMapGroupsInArrow" in plan and plan.index("posexplode") < plan.index("FlatMapGroupsInArrow")
    free = B.bootstrap_ci(df, [], "v", 200).first()
    assert free["ci_lower"] < 2499.5 < free["ci_upper"]


def test_rows_are_numbered_within_equal_values(spark):
    from assay.functions.order_stats import numbered_rows

    df = spark.range(4000).selectExpr("id", "CAST(id % 3 AS STRING) AS k", "CAST(id % 2 AS DOUBLE) / 2 AS p").unionByName(
        spark.createDataFrame([(-1, None, 0.1)], "id long, k string, p double"))
    got = numbered_rows(df, ["k"], [F.col("p").desc(), F.col("id")], "no", "total").collect()
    for k in "012":
        rows = sorted((r for r in got if r["k"] == k), key=lambda r: (-r["p"], r["id"]))
        assert [r["no"] for r in rows] == list(range(1, len(rows) + 1)) and {r["total"] for r in rows} == {len(rows)}
    assert len(got) == 4000
    free = numbered_rows(df, [], [F.col("id")], "no").orderBy("no").collect()
    assert [r["id"] for r in free] == sorted([-1, *range(4000)])


def test_holm_spreads_equal_p_values(spark):
    df = spark.range(3000).selectExpr("id AS n", "0.01 AS p", "'f' AS fam")
    out = E.holm(df, "p", family=["fam"], tie=["n"])
    rows = sorted((r["n"], r["rank"], r["significant"]) for r in out.collect())
    assert [r[1] for r in rows] == list(range(1, 3001))
    assert [r[2] for r in rows] == [0.01 < 0.05 / (3000 - i) for i in range(3000)]
    parts = out.select("rank").rdd.glom().map(len).collect()  # the range exchange leaves no task with all ties
    assert max(parts) < 3000
