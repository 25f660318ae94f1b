import random
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from assay.llm import near_texts
from tests.llm.samples import ODD, no_docs, odd_docs


def shingles(text, n=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similarity(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def slow_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    members = {}
    for i, (doc_id, _) in enumerate(rows):
        members.setdefault(find(i), []).append(doc_id)
    return [min((d for d in members[find(i)] if d is not None), default=None) for i in range(len(rows))]


def changed(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def copies():
    """Texts of 100 to 600 words, each with two copies in which a few words are replaced."""
    r = random.Random(7)
    rows = []
    for k in range(150):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(100, 600))]
        rows += [(3 * k, " ".join(words))] + [
            (3 * k + i, changed(r, words, max(1, int(len(words) * r.uniform(0.002, 0.03))))) for i in (1, 2)]
    return rows


def test_near_copies_against_brute_force(spark, copies):
    got = {r.doc_id: r.component_id for r in near_texts.groups(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    want = {d: c for (d, _), c in zip(copies, slow_components(copies))}
    assert all(want[d] == want[c] for d, c in got.items())  # no false link
    assert sum(got[d] == want[d] for d in want) >= 0.99 * len(want)


def test_pipeline_stage_drops_near_copies(spark, copies):
    docs = spark.createDataFrame(copies, "doc_id long, text string")
    left = {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()}
    want = set(slow_components(copies))
    assert want <= left and len(left - want) <= 0.01 * len(copies)


def test_near_groups_of_odd_rows(spark):
    rows = [x for x in ODD if x[1] is None or len(x[1]) < 10_000]
    docs = odd_docs(spark).filter("text IS NULL OR length(text) < 10000")
    got = Counter((r.doc_id, r.component_id) for r in near_texts.groups(docs).collect())
    assert got == Counter((d, c) for (d, _), c in zip(rows, slow_components(rows)))
    assert near_texts.groups(no_docs(spark)).count() == 0 and near_texts.dedup(docs).columns == docs.columns


def test_dense_groups_and_chains(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, changed(r, base, 2)) for i in range(60)]
    chain = [f"c{i}" for i in range(200)]
    for i in range(60, 80):  # each one near the last, the ends far apart
        rows.append((i, " ".join(chain)))
        chain = chain[8:] + [f"d{i}x{j}" for j in range(8)]
    got = {r.doc_id: r.component_id for r in near_texts.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for (d, _), c in zip(rows, slow_components(rows))}


def test_families_below_the_limit_cost_few_checks(spark, monkeypatch):
    """600 texts of one template, pairs near 0.66: none is linked, and hardly one is checked."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, changed(r, base, 6)) for i in range(600)] + [(600 + i, t) for i in range(4) for t in (changed(r, base, 1),)]
    seen = []
    checked = near_texts._checked
    monkeypatch.setattr(near_texts, "_checked", lambda pairs, *rest: (seen.append(pairs.distinct().count()), checked(pairs, *rest))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_texts.groups(df).collect()}
    want = {d: c for (d, _), c in zip(rows, slow_components(rows))}
    assert sum(got[d] == want[d] for d in want) >= 0.99 * len(want)
    assert all(want[d] == want[c] for d, c in got.items())
    assert sum(seen) < 5000


@pytest.mark.parametrize("n", [300, 900, 3000, 20_000])
def test_sketches_tell_similar_sets(n):
    import numpy as np

    r = np.random.default_rng(n)
    for s, sure, maybe in ((0.9, True, True), (0.81, False, True), (0.66, False, False)):
        both = int(n * 2 * s / (1 + s))
        for _ in range(5):
            x = r.integers(0, 1 << 64, 2 * n - both, np.uint64, endpoint=False)
            a, b = x[:n], np.concatenate([x[:both], x[n:]])
            k = near_texts.level_of(n)
            bits = [np.frombuffer(near_texts.parity_sketch(v, k), np.uint64) for v in (a, b)]
            low, high = near_texts.bit_limits(np.array([2.0 * n]), np.array([float(k)]), 0.8)
            d = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert (d <= high[0]) == maybe if n < 2000 or s != 0.66 else True
            assert not (d <= low[0]) or sure


def test_tiles_and_levels(spark, monkeypatch, copies):
    monkeypatch.setattr(near_texts, "TILE", 2)
    monkeypatch.setattr(near_texts, "SKETCHED", 128)
    test_near_copies_against_brute_force(spark, copies[:120])


def test_rows_without_id_keep_one_of_each_component(spark):
    rows = [(None, "aaa bbb"), (5, "aaa bbb"), (None, "ccc ddd"), (None, "ccc ddd"), (None, "CCC DDD")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = Counter((r.doc_id, r.text.lower()) for r in near_texts.dedup(df).collect())
    assert left == Counter([(5, "aaa bbb"), (None, "ccc ddd")])


def test_sets_are_compared_without_python(spark):
    """Two sets on a row are too much for batches of rows that Python holds."""
    class Kept:
        def __init__(self):
            self.plans = []

        def cut(self, df):
            self.plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df

        def free(self, *done):
            pass

    texts = spark.createDataFrame([(i, f"a b c d e f g h i j k {x}") for i, x in enumerate(["l m n", "l m n", "o", ""])], "node long, text string")
    sets = texts.mapInArrow(near_texts._sets(5), "node long, own array<long>, level long, s0 binary, s1 binary").cache()
    sets.count()
    scratch = Kept()
    pairs = spark.createDataFrame([(0, 1), (1, 0), (0, 2), (2, 3)], "a long, b long")
    got = near_texts._checked(pairs, spark.createDataFrame(sets.toArrow()), 0.8, scratch)
    assert {tuple(r) for r in got.collect()} == {(0, 1), (2, 3)}
    assert len(scratch.plans) == 2 and not any("InArrow" in p for p in scratch.plans)


def test_sets_and_pairs_leave_a_task_in_pieces():
    batch = pa.RecordBatch.from_pydict({"node": [*range(12)], "text": [" ".join(f"{k}w{i}" for i in range(120_000)) for k in range(12)]})
    out = list(near_texts._sets(5)([batch]))
    assert sum(b.num_rows for b in out) == 12 and max(b.num_rows for b in out) < 6
    n = 600
    sketch = bytes(128)
    same = {c: [0] * n for c in ("band", "key", "ti", "tj", "level", "side")}
    cell = pa.RecordBatch.from_pydict(same | {
        "node": [*range(n)], "label": [*range(n)], "size": [100] * n, "s0": [sketch] * n, "s1": [sketch] * n, "bands": [[1] * near_texts.BANDS] * n})
    for parts in ([cell], [cell.slice(0, 250), cell.slice(250)]):
        out = list(near_texts._pairs_of_cells(0.8, False)(parts))
        assert sum(b.num_rows for b in out) == n * (n - 1) // 2 and max(b.num_rows for b in out) <= near_texts.PAIRS_AT_ONCE + n
        assert sum(b.num_rows for b in near_texts._pairs_of_cells(0.8, True)(parts)) == n - 1
