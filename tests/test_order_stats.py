import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assay.functions.order_stats import average_ranks, cut_points, exact_quantiles, value_positions


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values repeat; some are missing."""
    rng = np.random.default_rng(7)
    rows = [("hot", float(v)) for v in rng.integers(0, 400, 1500)]
    rows += [(f"k{i % 9}", float(v)) for i, v in enumerate(rng.normal(size=300))]
    rows += [("hot", None), (None, 1.0), ("k1", float("nan"))]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def clean(df):
    return pd.DataFrame([tuple(r) for r in df.collect()], columns=["k", "v"]).dropna()


@pytest.mark.parametrize("rows_per_piece", [None, 40])
def test_positions_and_quantiles(skewed, rows_per_piece):
    if rows_per_piece:
        assert len(cut_points(skewed, "v", rows_per_piece)) > 5
    pdf = clean(skewed)
    pos = value_positions(skewed, ["k"], "v", rows_per_piece=rows_per_piece).collect()
    for r in pos:
        mine = pdf[pdf.k == r["k"]].v
        assert r["before"] == (mine < r["v"]).sum()
        assert r["n"] == (mine == r["v"]).sum() and r["total"] == len(mine)
    assert sum(r["n"] for r in pos) == len(pdf)
    got = {r["k"]: r for r in exact_quantiles(
        skewed, ["k"], "v", {"q1": 0.25, "m": 0.5, "q9": 0.9}, rows_per_piece=rows_per_piece).collect()}
    for k, g in pdf.groupby("k"):
        for c, p in (("q1", 0.25), ("m", 0.5), ("q9", 0.9)):
            assert got[k][c] == pytest.approx(g.v.quantile(p))


def test_pieces_bound_every_key(skewed):
    """No (key, piece) pair holds more than a few pieces' worth of rows."""
    from assay.functions.order_stats import with_piece
    cuts = cut_points(skewed, "v", 40)
    top = with_piece(skewed.filter("v is not null and not isnan(v)"), "v", cuts).groupBy(
        "k", "__piece").count().agg(F.max("count")).first()[0]
    assert top <= 120


def test_average_ranks_match_pandas(skewed):
    out = average_ranks(skewed, ["k"], "v", rows_per_piece=40)
    rows = [r for r in out.collect() if r["k"] is not None and r["avg_rank"] is not None]
    pdf = pd.DataFrame([(r["k"], r["v"], r["avg_rank"]) for r in rows], columns=["k", "v", "r"])
    assert np.allclose(pdf.groupby("k").v.rank(), pdf.r)


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert exact_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0
    one = spark.createDataFrame([("a", 3.0)], "k string, v double")
    assert exact_quantiles(one, [], "v", {"m": 0.5}).first()["m"] == 3.0
