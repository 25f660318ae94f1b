import numpy as np
import pytest

from assay.operators import traces as T


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(8)
    rows = []
    for name, n in (("hot", 700), ("b", 90), ("c", 20)):
        y = 10 + 5 * np.sin(np.arange(n) / 9.0) + rng.normal(size=n)
        y[5:8] = 40.0  # flat top
        rows += [(name, float(i), float(v)) for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "t string, x double, y double").repartition(6).cache()


def prominences(y):
    out = {}
    i, n = 1, len(y)
    while i < n - 1:
        j = i
        while j + 1 < n and y[j + 1] == y[i]:
            j += 1
        if y[i - 1] < y[i] and j < n - 1 and y[j + 1] < y[i]:
            left, k = y[i], i
            while k >= 0 and y[k] <= y[i]:
                left = min(left, y[k])
                k -= 1
            right, k = y[i], j
            while k < n and y[k] <= y[i]:
                right = min(right, y[k])
                k += 1
            out[(i + j) / 2] = y[i] - max(left, right)
        i = j + 1
    return out


def by_trace(df):
    out = {}
    for r in df.orderBy("t", "x").collect():
        out.setdefault(r["t"], []).append(r)
    return out


@pytest.mark.parametrize("rows", [T.ROWS_PER_PIECE, 60])
def test_peaks_against_brute_force(signal, rows):
    got = by_trace(T.detect_peaks(signal, ["t"], "x", "y", rows_per_segment=rows))
    for name, pts in by_trace(signal).items():
        want = prominences([p["y"] for p in pts])
        have = {r["x"]: r["prominence"] for r in got[name]}
        assert have.keys() == want.keys()
        assert all(have[k] == pytest.approx(want[k]) for k in want)


def test_distance_keeps_the_highest(signal):
    got = by_trace(T.detect_peaks(signal, ["t"], "x", "y", distance=20.0))
    for rows in got.values():
        xs = [r["x"] for r in rows]
        assert all(b - a >= 20 for a, b in zip(xs, xs[1:]))
        assert max(r["height"] for r in rows) == 40.0


@pytest.mark.parametrize("fn, col", [(T.rolling_baseline, "baseline"), (T.smooth, "smoothed"),
                                     (T.trapezoids, "slice")])
def test_segments_change_nothing(signal, fn, col):
    whole = {(r["t"], r["x"]): r[col] for r in fn(signal, ["t"], "x", "y").collect()}
    cut = fn(signal, ["t"], "x", "y", rows_per_segment=70).collect()
    assert len(cut) == len(whole)
    assert all(r[col] == pytest.approx(whole[(r["t"], r["x"])]) for r in cut)


def test_smoothing_weights():
    assert np.allclose(np.array(T.smoothing_weights()) * 429, [-36, 9, 44, 69, 84, 89, 84, 69, 44, 9, -36])


def test_asymmetric_baseline(spark, signal):
    y = np.array([r["y"] for r in by_trace(signal)["b"]])
    n = len(y)
    d = np.diff(np.eye(n), 2, axis=0)
    w = np.ones(n)
    for _ in range(10):
        z = np.linalg.solve(np.diag(w) + 100.0 * d.T @ d, w * y)
        w = np.where(y > z, 0.01, 0.99)
    assert np.allclose(T.whittaker_baseline(y, 100.0, 0.01, 10), z)
    whole = T.asymmetric_baseline(signal, ["t"], "x", "y", lam=1.0, p=0.1)
    cut = T.asymmetric_baseline(signal, ["t"], "x", "y", lam=1.0, p=0.1, rows_per_segment=220)
    a = {(r["t"], r["x"]): r["baseline"] for r in whole.collect()}
    assert all(r["baseline"] == pytest.approx(a[(r["t"], r["x"])], abs=1e-8) for r in cut.collect())


def test_quality_formulas(spark):
    peaks = spark.createDataFrame([("a", 1.0, 0.5), ("a", 3.0, 0.5), ("b", 2.0, 0.0), ("b", 2.5, 0.0)],
                                  "t string, at double, w double")
    out = {(r["t"], r["at"]): r for r in T.adjacent_resolution(peaks, ["t"], "at", "w").withColumn(
        "n", T.plate_count(peaks["at"], peaks["w"])).collect()}
    assert out[("a", 3.0)]["rs"] == 4.0 and out[("a", 3.0)]["n"] == 16 * 36.0
    assert out[("b", 2.5)]["rs"] == float("inf") and out[("b", 2.5)]["n"] == 0.0
    tri = spark.createDataFrame([("a", 0.0, 0.0), ("a", 2.0, 10.0), ("a", 6.0, 0.0)], "t string, x double, y double")
    r = T.peak_symmetry(tri, ["t"], "x", "y").first()
    assert r["asymmetry"] == pytest.approx(2.0) and r["tailing"] == pytest.approx(1.5)


def test_rows_without_a_place_stay_in_every_size(spark):
    rows = [(i % 2, float(i), float((i * 7) % 13)) for i in range(120)] + [(0, None, 5.0), (0, float("nan"), 6.0), (None, 3.0, 7.0)]
    df = spark.createDataFrame(rows, "t int, x double, y double")
    for job in (T.rolling_baseline, T.smooth):
        small = sorted(map(repr, job(df, ["t"], "x", "y").collect()))
        large = sorted(map(repr, job(df, ["t"], "x", "y", rows_per_segment=20).collect()))
        assert small == large and len(small) == len(rows)


def test_a_missing_point_does_not_void_the_baseline(spark):
    rows = [(1, float(i), None if i == 30 else 2.0 + 0.01 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, x double, y double")
    got = T.asymmetric_baseline(df, ["t"], "x", "y").collect()
    assert len(got) == 60 and all(r.baseline == r.baseline and abs(r.baseline - 2.3) < 0.5 for r in got)
