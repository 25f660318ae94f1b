"""Values on a limit, peaks of equal height, and joins that must not grow faster than their input."""

from itertools import accumulate

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from assay.functions.text import containment
from assay.operators import reports as R
from assay.operators import traces as T


def test_equal_peaks_the_earliest_is_the_main_one(spark):
    rows = [("a", 1.0, 2.0), ("a", 2.0, 8.0), ("a", 3.0, 8.0), ("b", 5.0, 8.0), ("b", 4.0, 8.0), ("c", 1.0, 0.0),
            ("d", None, 9.0), ("d", 1.0, 1.0), ("d", 2.0, 3.0)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "u string, t double, h double").repartition(3, "t")
        got = {r["u"]: (r["aggregate_pct"], r["flagged"]) for r in T.aggregate_share(df, ["u"], "t", "h").collect()}
        assert got == {"a": (pytest.approx(100 / 9), True), "b": (0.0, False), "c": (None, None),
                       "d": (pytest.approx(100 / 13), True)}


def test_equal_peaks_in_the_sql(spark, tmp_path):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for order in ("event_id", "event_id DESC"):
        con.execute(f"""COPY (SELECT * FROM (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(i AS INTEGER)) AS ts,
            1 AS user_id, 'e' || (i // 2) AS event_type, CASE WHEN i < 2 THEN 1.0 ELSE 9.0 END AS value FROM range(8) t(i))
            ORDER BY {order}) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
        con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        assert con.execute(entry.oracle_sql()["aggregate_share"]).fetchall() == [(1, 3.5714, False)]
        assert [tuple(r) for r in entry.queries()["aggregate_share"](spark, str(tmp_path)).collect()] == [(1, 3.5714, False)]


def _lines(con, folder, groups, limit, side):
    """A group of each list of taxes; their means are on the limit, summed in this order they are beyond it."""
    sums = [list(accumulate(x / 100 for x in taxes))[-1] for taxes in groups]  # sum() would correct itself
    assert all((total / len(taxes) * 5000 - limit) * side > 0 for total, taxes in zip(sums, groups))
    rows = ", ".join(f"({i}, {x / 100})" for i, taxes in enumerate(groups) for x in taxes)
    con.execute(f"""COPY (SELECT i AS l_orderkey, i AS l_suppkey, 1 AS l_linenumber, 24.0::DOUBLE AS l_quantity,
        5.0::DOUBLE AS l_extendedprice, 0.0::DOUBLE AS l_discount, x::DOUBLE AS l_tax FROM (VALUES {rows}) t(i, x))
        TO '{folder}/lineitem.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet'")


def test_a_mean_on_the_limit_is_not_impossible(spark, tmp_path):
    con = duckdb.connect()
    _lines(con, tmp_path, [(0, 2, 7, 7), (0, 4, 7, 5), (0, 7, 2, 7), (0, 2, 7, 7, 4)], 200, 1)
    got = entry.queries()["impossible_values"](spark, str(tmp_path)).filter("metric = 'tax_pct'").collect()
    want = con.execute(entry.oracle_sql()["impossible_values"]).fetchall()
    assert got == [] and [r for r in want if r[2] == "tax_pct"] == []


def test_a_mean_on_the_limit_is_not_flagged(spark, tmp_path):
    con = duckdb.connect()
    _lines(con, tmp_path, [(1, 6, 4, 1), (6, 1, 4, 1), (1, 6, 1, 1, 6), (1, 6, 4, 1, 3)], 150, -1)
    got = entry.queries()["threshold_flags"](spark, str(tmp_path)).collect()
    want = con.execute(entry.oracle_sql()["threshold_flags"]).fetchall()
    assert len(got) == len(want) == 8
    assert not any(r["flagged"] for r in got) and not any(r[3] for r in want)


@pytest.mark.parametrize("limits", [{}, {"shard_chars": 40}, {"shard_chars": 40, "max_passes": 1},
                                    {"shard_chars": 40, "max_passes": 1, "direct_terms": 0},
                                    {"shard_chars": 30, "max_passes": 1, "slice_chars": 100, "direct_terms": 3}])
def test_containment_without_the_text(spark, limits):
    rng = np.random.default_rng(17)
    rows = lambda n, most: [(g, i, "".join(rng.choice(list("abé "), rng.integers(0, most)))) for g in ("x", "y", None) for i in range(n)]
    terms, texts = rows(25, 7), rows(15, 80)
    terms += [("x", 99, None), ("x", 98, ""), *terms[:4], ("z", 97, "a"), ("z", 97, "b")]
    texts += [("y", 99, None), *texts[:3], ("z", 5, "cab"), ("z", 5, "cab"), ("z", 6, "")]
    t = spark.createDataFrame(terms, "`a.g` string, no int, term string")
    d = spark.createDataFrame(texts, "`a.g` string, i int, text string")
    want = sorted((g, n, x, i) for g, n, x in terms for h, i, y in texts if g and g == h and x and y is not None and x in y)
    out = containment(t, d, ["a.g"], "term", "text", keep_text=False, **limits)
    assert out.columns == ["a.g", "no", "term", "i"]
    assert sorted(map(tuple, out.collect())) == want
    kept = containment(t, d, ["a.g"], "term", "text", **limits)
    assert sorted(map(tuple, kept.drop("text").collect())) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_matches_are_joined_with_terms_only(spark):
    plan = _plan(entry.queries()["terms_in_texts"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Join ") == 1  # not with the texts again, for which every match was shuffled
    assert plan.count("Aggregate ") == 1  # and matches are not made distinct


def test_few_terms_of_a_group_are_joined_directly(spark):
    terms = [(g, f"{g:05d}.{k}") for g in range(300) for k in range(2)] + [(7, "00007.1"), (400, "x")]
    texts = [(g, i, f"price {g:05d}.1 or {g + 1:05d}.0") for g in range(300) for i in range(2)]
    t = spark.createDataFrame(terms, "g int, claimed string")
    d = spark.createDataFrame(texts, "g int, i int, text string")
    out = containment(t, d, ["g"], "claimed", "text", keep_text=False, shard_chars=100, max_passes=1)
    assert "MapInArrow" not in _plan(out) and _plan(out).count("Join ") == 1
    want = sorted((g, x, i) for g, x in terms for h, i, y in texts if g == h and x in y)
    assert sorted(map(tuple, out.collect())) == want and len(want) == 602


def test_stated_values_are_looked_up_by_name(spark):
    docs = spark.createDataFrame([(1, 1, "a b. price = 7, Price: 7 and price_mean = 10.2 %"), (1, 2, "total: 3,5 mean = 20 x = 1"),
                                  (1, 3, None), (2, 4, "price = 7")], "g int, i int, text string")
    means = spark.createDataFrame([(1, "Price_Mean", 10.0), (1, "total", 3.5), (1, "zero", 0.0)], "g int, metric string, mean double")
    out = R.value_contradictions(docs, means, ["g"], keep=["i"])
    assert sorted(map(tuple, out.collect())) == [(1, "mean", 2, 20.0, 10.0), (1, "price", 1, 7.0, 10.0), (1, "price", 1, 7.0, 10.0)]
    assert _plan(out).count("regexp_extract_all") <= 2  # the search itself and the test that it found any


def test_agreement_counts_pairs_of_scores(spark, monkeypatch):
    import pandas as pd

    from assay.functions import order_stats
    from assay.operators import agreement as A

    rng = np.random.default_rng(4)
    scores = rng.integers(0, 4, (400, 3)).astype(float) + rng.integers(0, 2, (400, 1))
    rows = [("k", u, f"j{j}", float(v)) for u, vs in enumerate(scores) for j, v in enumerate(vs)]
    rows += [("k", 900, "j0", None), ("k", 900, "j1", 2.0), ("few", 1, "j0", 1.0), ("few", 1, "j1", 1.0)]
    df = spark.createDataFrame(rows, "c string, u int, j string, v double")
    ranked = []
    monkeypatch.setattr(A, "average_ranks", lambda d, *a, **k: ranked.append(d.count()) or order_stats.average_ranks(d, *a, **k))
    ranks = pd.DataFrame(scores).rank()
    first = pd.DataFrame(np.vstack([scores[:, :2], [np.nan, 2.0]])).rank()  # the unit with one score missing
    want = np.mean([first[0].corr(first[1]), ranks[0].corr(ranks[2]), ranks[1].corr(ranks[2])])
    for most in (A.ROWS_PER_TASK, 50):  # 50 deals the units to more tasks than the session's own
        monkeypatch.setattr(A, "ROWS_PER_TASK", most)
        got = A.spearman_agreement(df, ["c"], ["u"], "j", "v").collect()
        assert [(r["c"], r["judge_pairs"]) for r in got] == [("k", 3)]
        assert got[0]["spearman"] == pytest.approx(want, abs=1e-4)
    assert max(ranked) < 100  # of 1,201 pairs
