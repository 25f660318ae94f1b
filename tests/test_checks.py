import struct

import pytest

from assay.operators import checks as Q
from assay.operators import claims as V
from assay.operators import cleaning as C
from assay.operators import gates as A
from assay.operators import grouped as G


def metric_rows(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"run int, group_key string, metric string, value {kind}")


def test_missing_values(spark):
    m = metric_rows(spark, [(1, "R1", "a", "1.5"), (1, "R2", "a", "NaN"), (2, "R1", "a", "3"), (1, "R3", "a", None)],
                    "string")
    got = {r["run"]: r for r in Q.nan_leakage(m, ["run"]).collect()}
    assert not got[1]["passed"] and "2 of 3" in got[1]["detail"] and "R2, R3" in got[1]["detail"]
    assert got[2]["passed"] and got[2]["severity"] is None
    nan = metric_rows(spark, [(1, "R1", "a", float("nan"))])
    assert not Q.nan_leakage(nan, ["run"]).first()["passed"]


def test_impossible_and_uniform(spark):
    m = metric_rows(spark, [(1, "R1", "row_count", -1.0), (1, "R2", "pct", 201.0), (1, "R3", "std", -0.1),
                            (1, "R4", "pct", -100.0), (1, "R5", "row_count", float("nan"))])
    assert sorted(r["reason"] for r in Q.impossible_values(m).collect()) == [
        "impossible percentage", "negative count", "negative std"]
    u = metric_rows(spark, [(1, f"R{i}", "a", 1.0 + 1e-10 * i) for i in range(3)]
                    + [(2, f"R{i}", "a", float(i)) for i in range(3)] + [(3, "R1", "a", 1.0), (3, "R2", "a", 1.0)])
    assert {r["run"]: r["passed"] for r in Q.uniform_metrics(u, ["run"]).collect()} == {1: False, 2: True}


def test_identifiers_match_inside_keys(spark):
    keys = metric_rows(spark, [(1, "R16__E4", "m", 1.0), (1, "blockR2x", "m", 1.0)])
    f = spark.createDataFrame([(1, 1, "Run R16 and R1 and E4", None), (1, 2, "R16__E4 beats R99; F1 high", None),
                               (1, 3, "R77 and R78 fail", None)], "run int, idx int, text string, figure_ref string")
    missing = {r["ref"] for r in Q.cited_identifiers(f, ["run"]).join(
        Q.known_identifiers(keys, ["run"]), ["run", "ref"], "left_anti").collect()}
    assert missing == {"R99", "R77", "R78"}
    assert not Q.finding_mismatch(f, keys, ["run"]).first()["passed"]


def png(w, h, extra=b""):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h) + extra


def test_image_audit(spark):
    files = {"ok.png": png(800, 600, b"a" * 9000), "same1.png": png(500, 500, b"b" * 9000),
             "same2.png": png(500, 500, b"b" * 9000), "tiny.png": png(100, 500, b"c"),
             "long.png": png(9000, 401, b"d" * 9000), "bad.png": b"not an image" * 900}
    df = spark.createDataFrame([(1, f"/x/{n}", len(b), bytearray(b)) for n, b in files.items()],
                               "run int, path string, length bigint, content binary")
    got = {(r["ref"], r["name"], r["severity"]) for r in Q.image_audit(df, ["run"]).collect()}
    assert got == {("same1.png", "duplicate_plot", "should_fix"), ("same2.png", "duplicate_plot", "should_fix"),
                   ("tiny.png", "low_resolution", "should_fix"), ("tiny.png", "extreme_aspect", "should_fix"),
                   ("tiny.png", "size_outlier", "must_fix"), ("long.png", "extreme_aspect", "must_fix"),
                   ("bad.png", "corrupt_png", "must_fix")}


def test_keyword_checks(spark):
    f = spark.createDataFrame([(1, 1, "UV rose 12% above the rest", None), (2, 1, "UV rose 12% due to resin", None),
                               (2, 2, "ANOVA gave p < 0.01", None)], "run int, idx int, text string, figure_ref string")
    m = metric_rows(spark, [(r, f"R{i}", "a", 1.0) for r in (1, 2) for i in range(4)])
    assert {r["run"]: (r["passed"], r["severity"]) for r in Q.bare_findings(f, ["run"]).collect()} == {
        1: (False, "must_fix"), 2: (True, None)}
    assert {r["run"]: r["passed"] for r in Q.comparison_present(f, m, ["run"]).collect()} == {1: False, 2: True}
    files = spark.createDataFrame([(1, f"{n}.png", 9) for n in ("box_a", "box_b", "box_c")]
                                  + [(2, f"{n}.png", 9) for n in ("box_a", "heat_b", "pca_c")],
                                  "run int, path string, size bigint")
    assert {r["run"]: r["passed"] for r in Q.chart_diversity(files, ["run"]).collect()} == {1: False, 2: True}


def check_rows(spark, rows):
    return spark.createDataFrame(
        [("u", a, n, s, c, None, "d", p) for a, n, s, c, p in rows],
        "u string, attempt int, name string, severity string, category string, ref string, detail string, passed boolean")


def test_scores_and_gate(spark):
    c = check_rows(spark, [(1, "a", "must_fix", "structural", False), (1, "b", "should_fix", "content_quality", False),
                           (2, "a", "must_fix", "structural", False), (3, "a", "must_fix", "structural", False),
                           (4, "a", "must_fix", "structural", True), (4, "b", "should_fix", "content_quality", True)])
    s = {r["attempt"]: r for r in A.quality_scores(c, ["u", "attempt"]).collect()}
    assert s[1]["overall"] == pytest.approx(1 / 3, abs=1e-4) and s[4]["overall"] == 1.0
    sets = A.stalls(A.issue_sets(c, ["u", "attempt"]), ["u"])
    got = {r["attempt"]: (r["stall_count"], r["status"]) for r in A.gate(sets, 5).collect()}
    assert got == {1: (0, "failed"), 2: (1, "failed"), 3: (2, "passed_degraded"), 4: (0, "passed")}
    reg = {r["attempt"]: (r["regressed"], r["improved"]) for r in A.regressions(c, ["u"]).collect()}
    assert reg[4] == (0, 1)


def test_oscillation_and_convergence(spark):
    c = check_rows(spark, [(1, "a", "must_fix", "structural", False), (1, "z", "must_fix", "structural", True),
                           (2, "b", "must_fix", "structural", False), (2, "z", "must_fix", "structural", True),
                           (3, "a", "must_fix", "structural", False)])
    sets = A.issue_sets(c, ["u", "attempt"])
    got = {r["attempt"]: r["reappeared"] for r in A.oscillations(sets, ["u"]).collect()}
    assert got == {1: [], 2: [], 3: ["a"]}
    full = A.gate(A.stalls(sets, ["u"]).join(A.quality_scores(c, ["u", "attempt"]).select(
        "u", "attempt", "overall"), ["u", "attempt"]), 9)
    dec = {r["attempt"]: r["decision"] for r in A.convergence(full, ["u"]).collect()}
    assert dec == {1: "retry", 2: "passed_degraded", 3: "retry"}


def test_skipped_evaluators_lower_the_score(spark):
    c = check_rows(spark, [(1, "a", None, "structural", True)])
    ev = spark.createDataFrame([("u", 1, {"content": False, "plot_quality": False, "analytical_depth": True})],
                               "u string, attempt int, evaluators_ran map<string,boolean>")
    assert A.quality_scores(c, ["u", "attempt"], ev).first()["overall"] == pytest.approx(0.9)


@pytest.mark.parametrize("off, status", [(0.009, "match"), (0.011, "mismatch"), (0.051, "mismatch")])
def test_claim_tolerance(spark, off, status):
    df = spark.createDataFrame([("R1", "E1", 10.0), ("R1", "E1", 20.0), (None, "E1", 5.0)], "r string, s string, v double")
    actual = V.recomputed_means(df, ["r", "s"], ["v"])
    claim = metric_rows(spark, [(1, "R1__E1", "v", 15.0 / (1 - off)), (1, "R9__E1", "v", 1.0)])
    got = {r["group_key"]: r["status"] for r in V.verify(claim, actual).collect()}
    assert got == {"R1__E1": status, "R9__E1": "unmatched"}


def test_cleaning_rules(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, None, None, None)],
                               "`My Col` int, gone double, run_no string, `my-col` string")
    assert C.drop_empty_columns(df).columns == ["My Col", "run_no", "my-col"]
    assert C.standardise_names(df).columns == ["my_col", "gone", "run_no", "my_col_2"]
    names = {r["name"] for r in C.validate_cleaned(df, ["Sample_Code"]).collect()}
    assert names == {"missing_preserved_column", "all_null_column"}
    assert {r["name"] for r in C.validate_cleaned(df.limit(0)).collect()} >= {"zero_rows"}
    assert C.is_data_dictionary(spark.createDataFrame([("a", "x"), ("b", "y")], "v string, d string"))
    assert not C.is_data_dictionary(spark.createDataFrame([("a", "x"), ("a", "y")], "v string, d string"))


def test_group_stats_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", float("nan")), (None, 9.0)],
                               "k string, v double")
    got = {r["k"]: r for r in G.group_stats(df, ["k"], ["v"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"]["count"], got["a"]["median"], got["b"]["count"], got["b"]["mean"]) == (2, 2.0, 0, None)
    assert G.backfill_findings(metric_rows(spark, [(1, "R1", "m", 5.0), (1, "R2", "m", 15.0)])).first()["text"] == (
        "R1 shows 50.0% below group mean in m (value=5, group mean=10)")
