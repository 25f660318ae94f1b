import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.plans import columns as C
from assay.plans import distributions as D
from assay.plans import groupings as G
from assay.plans import relations as R
from assay.plans import structure as S
from assay.plans.profile import profile, write_profile


@pytest.fixture(scope="module")
def runs(spark):
    """20 runs x 5 stages x 6 rows; site holds runs; campaign_text repeats run; half the tags are null."""
    rng = np.random.default_rng(3)
    rows = []
    for run in range(20):
        for stage in range(5):
            for k in range(6):
                rows.append((
                    f"R{run}", f"run {run} of the long campaign", f"site{run % 4}", f"E{stage}",
                    float(rng.normal(10 + stage, 1)), len(rows), k % 2 == 0,
                    f"tag{k % 3}" if run % 2 else None, "2024-01-%02d" % (1 + k)))
    return spark.createDataFrame(rows, "run_no string, campaign_text string, site string, stage string, "
                                 "uv double, row int, flag boolean, tag string, day string").cache()


def test_roles(runs):
    roles = {r["name"]: r["role"] for r in C.column_roles(runs).collect()}
    assert roles == {"run_no": "ordinal_stage", "campaign_text": "categorical_group", "site": "ordinal_stage",
                     "stage": "ordinal_stage", "uv": "continuous_measurement", "row": "identifier",
                     "flag": "categorical_group", "tag": "ordinal_stage", "day": "datetime"}


def test_empty_and_constant(spark):
    empty = spark.createDataFrame([], "a string, b double")
    assert {r["role"] for r in C.column_roles(empty).collect()} == {"constant"}
    flat = spark.createDataFrame([(1, None), (1, None)], "a int, b string")
    assert {r["role"] for r in C.column_roles(flat).collect()} == {"constant"}
    assert profile(empty).row_count == 0


def test_relations(runs):
    rel = {(r["col_a"], r["col_b"]): (r["relationship"], r["strength"])
           for r in R.relationships(runs, ["run_no", "campaign_text", "site", "stage"]).collect()}
    assert rel[("run_no", "campaign_text")] == ("redundant", 1.0)
    assert rel[("run_no", "site")] == ("nested_a_in_b", 1.0)
    assert rel[("run_no", "stage")] == ("crossed", 1.0)


@pytest.mark.parametrize("pairs, kind", [(79, "partial_overlap"), (80, "crossed"), (100, "crossed")])
def test_crossing_threshold(spark, pairs, kind):
    cells = [(i % 10, i // 10) for i in range(pairs)]
    # every level appears, so the fill ratio is pairs / 100
    cells = sorted({(a, (a + b) % 10) for a, b in cells})
    df = spark.createDataFrame(cells, "a int, b int")
    row = R.relationships(df, ["a", "b"]).first()
    assert (row["n_a"], row["n_b"], row["relationship"]) == (10, 10, kind)


def test_grouping_scores(runs):
    out = {tuple(r["columns"]): r for r in G.evaluate_groupings(
        runs, [["stage"], ["run_no", "stage"], ["tag"], ["row"]], ["uv"], ordinal=["stage"]).collect()}
    assert ("row",) not in out  # 600 groups
    stage = out[("stage",)]
    assert (stage["group_count"], stage["min_group_size"], stage["median_group_size"]) == (5, 120, 120.0)
    # 0.35 + 0.25 + 0.2 * disc + 0.2 + 0.15
    assert stage["score"] == pytest.approx(0.95 + 0.2 * stage["discriminability"], abs=2e-4)
    tag = out[("tag",)]
    assert tag["rows_covered_pct"] == 50.0
    assert tag["score"] == pytest.approx(
        0.35 * 3 / 5 + 0.25 + 0.2 * tag["discriminability"] + 0.1 - 0.15 * 0.5, abs=2e-4)


def test_profile_structure(spark, runs, tmp_path):
    p = profile(runs, "full")
    assert p.recommended is not None and p.recommended["group_count"] >= 2
    purposes = {c.name: c.purpose for c in p.columns}
    assert purposes["run_no"] == "experimental_unit" and purposes["stage"] == "process_phase"
    dims = {d.name: d for d in p.dimensions}
    assert dims["run_no"].columns == ["run_no", "campaign_text"] and "campaign_text" not in dims
    assert p.hierarchy.index("site") < p.hierarchy.index("run_no")
    assert p.shapes["uv"]["normality_test"] == "dagostino"
    names = {c.name for c in p.contexts}
    assert {"process_trend", "run_comparison"} <= names
    write_profile(spark, p, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "dimension")).count() == len(p.dimensions)


def test_override_and_warnings(runs):
    p = profile(runs, group_by=["stage"], extend_by=["tag", "nope"])
    assert p.recommended["columns"] == ["stage"] and p.extended["columns"] == ["stage", "tag"]
    q = profile(runs.select("stage", "uv"), group_by=["stage", "missing"])
    assert q.recommended["columns"] == ["stage"] and "used in part" in q.warnings[0]


def test_shapes_match_formulas(spark):
    x = np.random.default_rng(5).lognormal(sigma=1.2, size=400)
    df = spark.createDataFrame([(float(v), float(v) ** 0.0) for v in x], "x double, one double")
    row = D.shapes(df, ["x"]).first()
    n, m = len(x), x.mean()
    g1 = ((x - m) ** 3).mean() / ((x - m) ** 2).mean() ** 1.5
    assert row["skewness"] == pytest.approx(g1 * np.sqrt(n * (n - 1)) / (n - 2), abs=1e-4)
    assert row["suggested_transform"] == "log" and not row["is_normal"]


def test_modes(spark):
    rng = np.random.default_rng(2)
    two = np.concatenate([rng.normal(0, 1, 3000), rng.normal(9, 1, 3000)])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(two, rng.normal(size=6000))],
                               "two double, one double")
    got = {r["name"]: r["n_modes"] for r in D.modes(df, ["two", "one"]).collect()}
    assert got == {"two": 2, "one": 1}


def test_purpose_rules():
    col = S.Column("Replicate", "int", "ordinal_stage", 3, 0.01, 0.0)
    assert S.first_purpose(col) == "technical_replicate"
    assert S.first_purpose(S.Column("sample_id", "string", "identifier", 500, 1.0, 0.0)) == "linking_identifier"
    assert S.first_purpose(S.Column("uv", "double", "continuous_measurement", 500, 1.0, 0.0)) == "uncategorised"
    assert G.purpose_multiplier({"technical_replicate"}) == 0.7
    assert G.purpose_multiplier({"process_phase", "experimental_unit"}) == 1.25


def test_row_order_does_not_matter(runs):
    a = C.value_counts(runs, ["stage", "tag"], 3).orderBy("name", "position").collect()
    b = C.value_counts(runs.orderBy(F.rand(1)).repartition(7), ["stage", "tag"], 3).orderBy(
        "name", "position").collect()
    assert a == b


def test_forty_columns_have_pairs_and_groupings(spark):
    from assay.plans.lattice import group_tables
    from assay.plans.relations import pair_counts

    names = [f"c{i}" for i in range(40)]
    df = spark.range(60).selectExpr(*[f"CAST(id % {i % 5 + 2} AS STRING) AS c{i}" for i in range(40)])
    pairs = pair_counts(df, names).collect()
    assert len(pairs) == 780 == len({(r.col_a, r.col_b) for r in pairs})
    got = {(r.col_a, r.col_b): r.n_ab for r in pairs}
    assert got.get(("c0", "c39"), got.get(("c39", "c0"))) == df.select("c0", "c39").distinct().count()
    sizes = group_tables(df, [[n] for n in names] + [["c0", "c39"]]).groupBy("key_id").agg({"n": "sum"}).collect()
    assert len(sizes) == 41 and all(r[1] == 60 for r in sizes)


def test_sets_of_sixty_columns(spark):
    """Same scores as plain grouping; wide keys are ruled out, and few rows leave a task."""
    names = [f"c{i}" for i in range(60)]
    wide = [f"CAST(pmod(xxhash64(id, {i}), {700 if i < 40 else 3 + i % 4}) AS INT) AS c{i}" for i in range(60)]
    df = spark.range(6000).selectExpr(*wide, "CAST(id % 97 AS DOUBLE) AS m").selectExpr(
        *[c if c != "c45" else "CASE WHEN m > 9 THEN c45 END AS c45" for c in names], "m")
    keys = G.candidate_keys(names)
    got = {tuple(r["columns"]): r for r in G.evaluate_groupings(df, keys, ["m"]).collect()}
    small = names[40:]
    assert set(got) == set(G.candidate_keys(small))  # 700 groups are too many, alone and with others
    rows = df.collect()
    for key in [("c40",), ("c41", "c45"), ("c44", "c52", "c59"), ("c45", "c46", "c47")]:
        groups = {}
        for r in rows:
            if all(r[c] is not None for c in key):
                groups.setdefault(tuple(r[c] for c in key), []).append(r["m"])
        sizes = sorted(map(len, groups.values()))
        assert (got[key]["group_count"], got[key]["min_group_size"]) == (len(sizes), sizes[0])
        assert got[key]["rows_covered_pct"] == round(100 * sum(sizes) / len(rows), 1)
        means = [sum(v) / len(v) for v in groups.values()]
        spread = (sum((x - sum(means) / len(means)) ** 2 for x in means) / (len(means) - 1)) ** 0.5
        assert got[key]["discriminability"] == pytest.approx(spread / (sum(means) / len(means)), abs=1e-6)
    plan = G.evaluate_groupings(df, keys, ["m"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_a_column_with_nulls_rules_nothing_out(spark):
    """A key may have fewer groups than its part, where the other column is NULL."""
    df = spark.range(900).selectExpr("id AS a", "CASE WHEN id < 3 THEN id END AS b", *[f"1 AS c{i}" for i in range(10)])
    names = ["a", "b", *[f"c{i}" for i in range(10)]]
    got = {tuple(r["columns"]): r["group_count"] for r in G.evaluate_groupings(df, G.candidate_keys(names)).collect()}
    assert ("a",) not in got and ("a", "c0") not in got and got[("a", "b")] == 3 and got[("a", "b", "c4")] == 3


def test_relations_of_columns_with_many_values(spark):
    df = spark.range(20_000).selectExpr("id", "CAST(id AS STRING) AS text", "id % 7 AS d", "CASE WHEN id % 2 = 0 THEN id END AS half")
    rel = {(r["col_a"], r["col_b"]): r for r in R.relationships(df, ["id", "text", "d", "half"]).collect()}
    assert rel[("id", "text")]["relationship"] == "redundant" and rel[("id", "d")]["relationship"] == "nested_a_in_b"
    assert (rel[("text", "half")]["n_a"], rel[("text", "half")]["n_ab"]) == (10_000, 10_000)


def test_roles_near_every_limit_equal_those_of_exact_counts(spark):
    rows = 4000
    counts = [1, 2, 49, 50, 51, 52, 60, 190, 199, 200, 201, 215, 3700, 3799, 3800, 3801, 3950, 4000]
    exprs = [e for n in counts for e in (
        f"CAST(id % {n} AS INT) AS i{n}", f"CAST(id % {n} AS DOUBLE) AS d{n}", f"concat('k', id % {n}) AS s{n}",
        f"concat('some rather long text no ', id % {n}, ' of all') AS t{n}")]
    df = spark.range(rows).selectExpr(*exprs, "CAST(NULL AS STRING) AS nothing", "id % 2 = 0 AS flag")
    got = {r["name"]: r["role"] for r in C.column_roles(df).collect()}
    want = {r["name"]: r["role"] for r in C.column_roles(df, exact_counts=True).collect()}
    assert got == want
    for n in counts[1:]:
        few = n <= 50 and n < 0.05 * rows
        assert got[f"i{n}"] == ("ordinal_stage" if few else "identifier" if n >= 3800 else "continuous_measurement")
        assert got[f"s{n}"] == ("identifier" if n >= 3800 else "ordinal_stage" if few else "categorical_group" if n <= 50 else "metadata_text")
        assert got[f"t{n}"] == ("metadata_text" if n > 50 else "categorical_group")
    assert got["nothing"] == got["i1"] == "constant" and got["flag"] == "categorical_group"


def test_hundreds_of_columns(spark):
    df = spark.range(40).selectExpr(*[f"id % {i % 7 + 1} AS c{i}" for i in range(300)])
    roles = C.column_roles(df).collect()
    assert len(roles) == 300 and {r["cardinality"] for r in roles} == {1, 2, 3, 4, 5, 6, 7}
