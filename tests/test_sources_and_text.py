import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.functions.text import containment
from assay.operators import domains as D
from assay.operators import reports as T
from assay.operators import retrieval as I
from assay.operators import supervised as L
from assay.sources import artifacts as S
from assay.sources import store
from assay.sources import tables as X


def test_discover_and_load(spark, tmp_path):
    (tmp_path / "run_params.csv").write_text("id,note\n1,a\n")
    (tmp_path / "combined.csv").write_text("Unnamed: 0,id,v\n0,1,2.5\n1,2,\n")
    (tmp_path / "words.csv").write_text("a,b,c,n\nx,y,z,1\n")
    (tmp_path / "plain.tsv").write_text("p\tq\n1\t2\n")
    (tmp_path / "skip.docx").write_text("no")
    got = {r["name"]: r["kind"] for r in X.discover(spark, str(tmp_path)).collect()}
    assert got == {"run_params.csv": "metadata", "combined.csv": "raw_data", "words.csv": "metadata",
                   "plain.tsv": "raw_data"}
    df = X.load(spark, str(tmp_path / "combined.csv"))
    assert df.columns == ["id", "v"] and df.filter("v is null").count() == 1
    assert X.load(spark, str(tmp_path / "plain.tsv")).columns == ["p", "q"]
    with pytest.raises(ValueError):
        X.load(spark, "x.xlsx")
    assert X.table_name("My Data-File (v2).csv") == "my_data_file__v2"
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(ValueError):
        X.discover(spark, str(empty))


def test_split_and_write(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "run_no string, v int")
    got = {r["run_no"]: r["row_count"] for r in X.split_by_groups(df, ["run_no"], str(tmp_path / "s"), 2).collect()}
    assert got == {"a": 2, None: 1}
    assert spark.read.parquet(str(tmp_path / "s")).filter("run_no is null").count() == 1
    path = X.write_parquet(df, str(tmp_path), "Run Table.csv")
    assert path.endswith("run_table") and spark.read.parquet(path).count() == 3


def test_artifacts(spark, tmp_path):
    for run, label, broken in (("r1", "base", False), ("r2", "", True)):
        debug = tmp_path / run / "debug"
        debug.mkdir(parents=True)
        check = {"name": "a", "passed": run == "r1", "severity": None if run == "r1" else "must_fix", "category": "structural"}
        (debug / "ds__analysis__gate.json").write_text(json.dumps({"status": "passed", "quality_score": 0.9}))
        (debug / "ds__analysis__retry1__gate.json").write_text(json.dumps({"status": "failed", "quality_score": 0.5}))
        (debug / "ds__analysis__verdict.json").write_text(json.dumps({"structural_checks": [check], "evaluators_ran": {"content": True}}))
        (debug / "ds__cleaning__gate.json").write_text("{broken")
        body = {"timestamp": f"2024-{run}", "model": "m", "run_config": {"run_label": label}}
        (tmp_path / run / "judge_input.json").write_text("{oops" if broken else json.dumps(body))
        (tmp_path / run / "manifest_1.json").write_text(json.dumps({**body, "model": "spare"}))
    gates = S.read_gates(spark, str(tmp_path)).collect()
    assert sorted((r["run_id"], r["stage"], r["attempt_label"]) for r in gates) == [
        (r, "analysis", a) for r in ("r1", "r2") for a in ("", "retry1")]
    v = {r["run_id"]: r for r in S.read_verdicts(spark, str(tmp_path)).collect()}
    assert v["r1"]["checks"][0]["passed"] and not v["r2"]["checks"][0]["passed"]
    reg = S.run_registry(spark, str(tmp_path)).collect()
    assert [(r["run_id"], r["model"], r["run_label"]) for r in reg] == [("r1", "m", "base"), ("r2", "spare", "")]
    idx = {(r["run_id"], r["dataset"]): r for r in S.artifact_index(spark, str(tmp_path)).collect()}
    assert (idx[("r1", "ds")]["gate"], idx[("r1", "ds")]["verdict"]) == (3, 1)
    lost = S.unreadable(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split("/")[-1], r["problem"]) for r in lost) == [("ds__cleaning__gate.json", "not JSON")] * 2


def test_store(spark, tmp_path):
    a = spark.createDataFrame([("r", None, 1, 1.0), ("r", "d", 1, 2.0)], "run string, ds string, at int, v double")
    b = spark.createDataFrame([("r", None, 2, 9.0)], "run string, ds string, at int, v double")
    got = {r["ds"]: r["v"] for r in store.upsert(a, b, ["run", "ds"], "at").collect()}
    assert got == {None: 9.0, "d": 2.0}
    rank = spark.createDataFrame([("x", "elo", 1.0), ("y", "bt", 2.0)], "player string, ranking_method string, strength double")
    store.replace_rankings(rank, str(tmp_path / "r"))
    store.replace_rankings(rank.filter("player = 'x'").withColumn("strength", F.lit(5.0)), str(tmp_path / "r"))
    assert {r["player"]: r["strength"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"x": 5.0, "y": 2.0}
    games = spark.createDataFrame([("a", "b", "a"), ("b", "c", "c")], "run_a string, run_b string, winner string")
    h = [store.comparison_set_hash(g).first()[0] for g in (games, games.orderBy(F.col("run_a").desc()), games.limit(1))]
    assert h[0] == h[1] != h[2] and len(h[0]) == 16
    store.export(rank, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_containment_is_substring_search(spark):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abc "), rng.integers(0, 60))) for _ in range(30)]
    terms = sorted({"".join(rng.choice(list("abc "), rng.integers(1, 9))) for _ in range(40)})
    t = spark.createDataFrame([(1, x) for x in terms], "g int, term string")
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(texts)], "g int, i int, text string")
    got = {(r["term"], r["i"]) for r in containment(t, d, ["g"], "term", "text").collect()}
    assert got == {(x, i) for x in terms for i, y in enumerate(texts) if x in y}


def test_grounding(spark):
    long = "word " * 15
    text = f"# T\n\nIntro 5 {long}\n\n## Results\n\n{long} 42.\n\n{long}\n\n| {long} 7 |\n\nshort 9"
    row = spark.createDataFrame([(text,), ("",)], "t string").select(T.grounding_rate(F.col("t")).alias("g")).collect()
    assert [r["g"] for r in row] == [0.5, None]


def test_model_json(spark):
    raw = ["<think>{x}</think>{\"a\": 1}", "text ```json\n{\"a\": 2}\n``` more", "so {\"a\": 3} it is", "none"]
    got = T.parse_model_text(spark.createDataFrame([(r,) for r in raw], "t string"), "t", "a int").collect()
    assert [r["parsed"]["a"] if r["parsed"] else None for r in got] == [1, 2, 3, None]


def test_chunks_and_trim(spark):
    text = "  " + "".join(chr(97 + i % 26) for i in range(1300)) + " "
    got = I.chunks(spark.createDataFrame([("d", text), ("e", "  ")], "id string, t string"), "id", "t").orderBy("chunk_id").collect()
    body = text.strip()
    assert [(r["chunk_id"], r["text"]) for r in got] == [(f"d__{j}", body[s:s + 600]) for j, s in enumerate(range(0, 1300, 520))]
    out = spark.createDataFrame([("x" * 600,)], "t string").select(I.trim_text(F.col("t"), 500).alias("t")).first()["t"]
    assert out == "x" * 450 + "\n...[truncated]"


def test_figures_and_matching(spark):
    files = spark.createDataFrame([(1, "a/heatmap_runs.png", 9000), (1, "b/heatmap_runs.png", 9500), (1, "c/other.png", 8000),
                                   (1, "d/tiny.png", 10)], "run int, path string, size bigint")
    f = spark.createDataFrame([(1, 1, "see", "other"), (1, 2, "the heatmap of all runs", None), (1, 3, "a much longer sentence here", None)],
                              "run int, idx int, text string, figure_ref string")
    assert [r["path"] for r in T.ranked_figures(files, f, ["run"]).orderBy("position").collect()] == [
        "c/other.png", "b/heatmap_runs.png"]
    got = {r["idx"]: (r["path"], r["how"]) for r in T.match_files(f, files, ["run"]).collect()}
    assert got[2] == ("b/heatmap_runs.png", "words") and got[3][1] == "length"


def test_domains(spark):
    cols = spark.createDataFrame([("d", "retention_time"), ("d", "peak_area"), ("e", "city")], "ds string, name string")
    got = {(r["ds"], r["domain"]): r["detected"] for r in D.detect_domains(cols, ["ds"]).collect()}
    assert got[("d", "chromatography")] and not got[("e", "chromatography")]
    f = spark.createDataFrame([("d", "did peak detection")], "ds string, text string")
    left = {r["analysis"] for r in D.missing_analyses(D.detect_domains(cols, ["ds"]), f, ["ds"]).filter(
        "domain = 'chromatography'").collect()}
    assert left == {"run_to_run_comparison", "purity_ratio"}


def test_supervised(spark):
    rng = np.random.default_rng(9)
    rows = [(i, float(x), float(z), int(x > 0)) for i, (x, z) in enumerate(rng.normal(size=(120, 2)))]
    df = spark.createDataFrame(rows, "id int, x double, z double, y int")
    preds, imp = L.cross_validate(df, ["id"], ["x", "z"], "y", folds=3, trees=5)
    assert preds.count() == 120 and imp.count() == 6
    m = {r["metric"]: r["mean"] for r in L.metric_summary(L.fold_metrics(preds)).collect()}
    assert m["accuracy"] > 0.85 and m["auc"] > 0.85
    weights = {r["feature"]: r["importance"] for r in L.mean_importance(imp).collect()}
    assert weights["x"] > weights["z"]
    moved = L.permuted(df, "id", "x", rows_per_piece=20).orderBy("id").collect()
    assert sorted(r["x"] for r in moved) == sorted(r[1] for r in rows)
    assert [r["x"] for r in moved] != [r[1] for r in rows]
    ci = {r["metric"]: r for r in L.bootstrap_metric(preds, 50).collect()}
    assert ci["accuracy"]["ci_lower"] <= m["accuracy"] + 0.1 and ci["mae"]["ci_upper"] < 0.3


def test_permutation_importance(spark):
    from pyspark.ml.regression import LinearRegression
    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(z), 3.0 * float(x)) for i, (x, z) in enumerate(rng.normal(size=(80, 2)))]
    df = spark.createDataFrame(rows, "id int, x double, z double, target double")
    model = LinearRegression(labelCol="target").fit(L.assemble(df, ["x", "z"]))
    got = {r["feature"]: r["importance"] for r in L.permutation_importance(model, df, "id", ["x", "z"]).collect()}
    assert got["x"] > 1.0 and abs(got["z"]) < 0.1


def test_nearest_rows_with_missing_vectors(spark):
    from assay.operators.retrieval import top_k

    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (4, [1.0]), (5, []), (6, [None, 1.0]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(10, [1.0, 0.1]), (11, None), (12, [2.0])], "query_id long, embedding array<double>")
    got = {(r.query_id, r.position): r.id for r in top_k(df, asked, 2).collect()}
    assert got == {(10, 1): 1, (10, 2): 7, (12, 1): 4}


def test_containment_in_shards_and_cells_equals_substring_search(spark):
    rng = np.random.default_rng(16)
    rows = lambda n, most: [(g, i, "".join(rng.choice(list("abé "), rng.integers(0, most)))) for g in ("x", "y", None) for i in range(n)]
    terms, texts = rows(25, 7), rows(15, 80)
    terms += [("x", 99, None), ("x", 98, ""), *terms[:4]]
    texts += [("y", 99, None), *texts[:3]]
    t = spark.createDataFrame(terms, "`a.g` string, no int, term string")
    d = spark.createDataFrame(texts, "`a.g` string, i int, text string")
    want = sorted((g, n, x, i, y) for g, n, x in terms for h, i, y in texts if g and g == h and x and y is not None and x in y)
    for limits in ({}, {"shard_chars": 40}, {"shard_chars": 40, "max_passes": 1}, {"shard_chars": 30, "max_passes": 1, "slice_chars": 100}):
        out = containment(t, d, ["a.g"], "term", "text", **limits)
        assert out.columns == ["a.g", "no", "term", "i", "text"]
        assert sorted(map(tuple, out.collect())) == want
    assert containment(t.limit(0), d, ["a.g"], "term", "text").count() == 0


def test_containment_of_many_terms_in_a_long_text(spark):
    words = [f"term{i:06d}x" for i in range(120_000)]
    body = " ".join(f"term{i:06d}x" for i in range(0, 900_000, 7))  # about 1.5 MB, every seventh number
    d = spark.createDataFrame([(1, body), (2, "none")], "i int, text string").withColumn("g", F.lit(1))
    t = spark.createDataFrame([(1, w) for w in words], "g int, term string")
    out = containment(t, d, ["g"], "term", "text", shard_chars=1 << 19).select("i", "term")
    assert "Contains" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r["term"] for r in out.collect()) == words[::7]


def test_grid_of_queries_equals_passes(spark):
    from assay.operators.retrieval import top_k

    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 8 if i % 5 else 4).astype(float).tolist()) for i in range(300)] + [(900, None), (901, [])]
    asked = [(f"q{i}", rng.integers(-2, 3, 8 if i % 7 else 4).astype(float).tolist()) for i in range(40)] + [("none", None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame(asked, "query_id string, embedding array<double>")
    want = sorted(map(tuple, top_k(df, q, 4).collect()))
    assert want == sorted(map(tuple, top_k(df, q, 4, queries_per_pass=5, block=(6, 50)).collect()))
    best = {}
    for name, v in asked[:40]:
        best[name] = [i for _, i in sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if w and len(w) == len(v))[:4]]
    assert {(n, p): i for n, i, _, p in want} == {(n, p + 1): i for n, ids in best.items() for p, i in enumerate(ids)}


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    import os

    path = str(tmp_path / "store")
    files = lambda: {f for d, _, names in os.walk(path) for n in names if n.endswith(".parquet") for f in [os.path.join(d, n)]}
    first = spark.range(500).selectExpr("CAST(id AS STRING) AS run", "CASE WHEN id % 9 > 0 THEN id % 9 END AS part", "id AS v", "1 AS at")
    store.upsert_store(path, first, ["run", "part"], "at", 16)
    before = files()
    new = spark.createDataFrame([("9", None, 90, 2), ("9", None, 91, 3), ("x", 1, 5, 1), ("10", 1, -1, 0)],
                                "run string, part long, v long, at int")
    for _ in range(2):  # a second time changes nothing
        store.upsert_store(path, new, ["run", "part"], "at", 16)
        rows = {(r["run"], r["part"]): r["v"] for r in store.read_store(spark, path).collect()}
        assert len(rows) == 501 and rows[("9", None)] == 91 and rows[("x", 1)] == 5 and rows[("10", 1)] == 10
    assert len(before & files()) >= len(before) - 3 and before != files()
    some = store.read_store(spark, path, ["run", "part"], new, 16)
    assert some.count() < 501 and store.skip_existing(new, some, ["run"]).count() == 0
    assert "PartitionFilters: [key_bucket" in some._jdf.queryExecution().executedPlan().toString()
