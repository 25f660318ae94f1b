from assay.operators import checks as Q
from assay.operators import cleaning as C

FINDING = "run int, idx int, text string, figure_ref string"


def metrics(spark, rows):
    return spark.createDataFrame(rows, "run int, group_key string, metric string, value double")


def test_grouping_compliance(spark):
    samples = spark.createDataFrame(
        [(r, c, v, i) for r in (1, 2, 3) for c, vs in {"run": ["R1", "R2"], "stage": ["E1", "E2"]}.items()
         for i, v in enumerate(vs, 1)], "run int, column string, value string, position int")
    keys = metrics(spark, [(1, "R1__E1", "m", 1.0), (2, "R1", "m", 1.0), (3, "other", "m", 1.0)])
    got = {r["run"]: (r["passed"], r["severity"]) for r in Q.grouping_compliance(samples, keys, ["run"]).collect()}
    assert got == {1: (True, None), 2: (False, "should_fix"), 3: (False, "must_fix")}


def test_context_coverage(spark):
    ctx = spark.createDataFrame(
        [(1, n, c, [c]) for n, c in (("process_trend", "stage"), ("run_comparison", "run_no"),
                                     ("condition_comparison", "resin"), ("hierarchy_a_to_b", "zz"))],
        "run int, name string, compare_across string, group_by array<string>")
    one = spark.createDataFrame([(1, 1, "the Stage matters", None)], FINDING)
    two = one.union(spark.createDataFrame([(1, 2, "a run comparison shows more", None)], FINDING))
    assert not Q.context_coverage(ctx, one, ["run"]).first()["passed"]
    assert Q.context_coverage(ctx, two, ["run"]).first()["passed"]


def test_chart_suitability(spark):
    files = spark.createDataFrame([(1, "a/bar_x.png", 9), (2, "heatmap_y.png", 9)], "run int, path string, size bigint")
    m = metrics(spark, [(r, f"R{i}", "m", 1.0) for r in (1, 2) for i in range(5)])
    numeric = spark.createDataFrame([(1, 11), (2, 3)], "run int, n_numeric int")
    got = {(r["run"], r["name"]): r["passed"] for r in Q.chart_suitability(files, m, numeric, ["run"]).collect()}
    assert got == {(1, "depth__multigroup_chart"): False, (2, "depth__multigroup_chart"): True,
                   (1, "depth__dimensionality_chart"): False}


def test_importance_and_stability(spark):
    tasks = spark.createDataFrame([(1, "t", "regression"), (2, "t", "regression"), (3, "t", "classification")],
                                  "run int, task string, task_type string")
    feats = spark.createDataFrame([(1, "x", 0.5)], "run int, feature string, score double")
    m = metrics(spark, [(1, "a", "row_count", 50.0), (2, "a", "row_count", 500.0)])
    got = {r["run"]: r["passed"] for r in Q.importance_present(tasks, feats, ["run"]).collect()}
    assert got == {1: True, 2: False, 3: False}
    got = {r["run"]: r["passed"] for r in Q.stability_present(tasks, feats.limit(0), m, ["run"]).collect()}
    assert got == {1: False}


def test_identical_pvalues(spark):
    f = spark.createDataFrame([(1, i, "p = 0.03 here", None) for i in range(3)]
                              + [(2, i, f"p < 0.0{i}", None) for i in range(1, 4)], FINDING)
    zero = spark.createDataFrame([(3, "a", 0.0), (3, "b", 0.0), (3, "c", 0.0), (4, "a", 0.0), (4, "b", 0.0), (4, "c", 0.0)],
                                 "run int, name string, p double")
    m = metrics(spark, [(3, f"R{i}", "row_count", 20000.0) for i in range(3)])
    got = {r["run"]: r["passed"] for r in Q.duplicate_pvalues(f, zero, m, ["run"]).collect()}
    assert got == {1: False, 2: True, 4: False}


def test_inspect(spark):
    got = C.inspect(spark.createDataFrame([(1, "a"), (2, None)], "n int, s string"), 1)
    assert (got["row_count"], got["numeric_columns"], len(got["preview_rows"])) == (2, ["n"], 1)
