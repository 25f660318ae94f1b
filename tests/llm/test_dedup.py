import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from assay.llm import exact_dedup, quality_rules, simhash, suffix_dedup
from assay.llm.components import components
from tests.llm.samples import ODD, no_docs, odd_docs, table


def ascii_lower(text):
    return (text or "").encode().lower()


# ---- exact


def test_exact_groups_of_odd_rows(spark):
    members = defaultdict(list)
    for doc_id, text in ODD:
        members[ascii_lower(text)].append(doc_id)
    got = exact_dedup.groups(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    by_text = defaultdict(list)
    for r in got:
        by_text[r.text_sha256].append(r)
    for body, ids in members.items():
        rows = by_text[hashlib.sha256(body).hexdigest()]
        known = [i for i in ids if i is not None]
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in rows)
        assert {r.keep_id for r in rows} == {max(known) if known else None}
        assert {r.group_size for r in rows} == {len(ids)}
        assert [r.doc_id for r in rows if r.kept] == [max(known) if known else None]


def test_exact_dedup_keeps_columns_and_one_row(spark):
    docs = odd_docs(spark)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert Counter(ascii_lower(r.text) for r in kept.collect()) == Counter({ascii_lower(t): 1 for _, t in ODD})
    assert exact_dedup.dedup(no_docs(spark)).count() == 0


def test_small_buckets_and_merges_change_nothing(spark):
    docs = table(spark, "documents")
    want = {tuple(r) for r in exact_dedup.groups(docs).collect()}
    assert {tuple(r) for r in exact_dedup.groups(docs, bucket_bytes=2000).collect()} == want
    keys = exact_dedup.cut_lineage(exact_dedup.keyed(docs))
    index, directory = exact_dedup.build_index(docs, keys, bucket_bytes=2000, max_depth=6, merge_bytes=100)
    rows = index.collect()
    assert sum(r.group_size for r in rows) == docs.count() and directory.depth == 6
    assert all(r.local_depth == directory.local_depth[r.bucket] for r in rows)


def test_directory_doubles_and_splits():
    d = exact_dedup.build_directory({0b0000: 90, 0b0001: 90, 0b1000: 50}, 100, 4)
    assert d.depth == 4 and d.buckets == len(set(d.bucket)) and d.load.sum() == 230
    keys = np.array([0b0000 << 60, 0b0001 << 60, 0b1000 << 60, 0b1111 << 60], np.uint64)
    a, b, c, e = d.of(keys)
    assert len({a, b, c}) == 3 and c == e
    assert exact_dedup.build_directory({}, 10).depth == 0
    assert (np.diff(d.owners(3)) >= 0).all()


def test_equal_keys_are_chained_by_bytes():
    import pyarrow as pa

    cols = {"bucket": [0] * 4, "key": [7] * 4, "body": [b"a", b"b", b"a", b"b"], "keep_id": [1, 2, None, 5], "group_size": [1, 1, 2, 1]}
    batch = pa.RecordBatch.from_pydict(cols)
    out = [r for b in exact_dedup._chains(np.array([0]))([batch]) for r in b.to_pylist()]
    assert [(r["chain"], r["keep_id"], r["group_size"]) for r in out] == [(0, 1, 3), (1, 5, 2)]


# ---- SimHash


def slow_fingerprint(text):
    import xxhash

    words = ascii_lower(text).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    prints = [f for _, f in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    return {i: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()
            for i in [i for i in range(len(rows)) if find(i) == r]}


def test_fingerprints_and_components_of_odd_rows(spark):
    rows = [(doc_id, slow_fingerprint(text)) for doc_id, text in ODD if text is None or len(text) < 10_000]
    docs = odd_docs(spark).filter("text IS NULL OR length(text) < 10000")
    want = slow_components(rows)
    expected = Counter((d, f"{f:016x}", want[i]) for i, (d, f) in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.groups(docs).select("doc_id", "fingerprint", "component_id").collect()) == expected
    assert simhash.groups(no_docs(spark)).count() == 0
    assert simhash.dedup(docs).columns == docs.columns


def near_values(spark, n=400):
    r = random.Random(3)
    centres = [r.getrandbits(64) for _ in range(20)]
    values = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))) for c in centres for _ in range(n // 20)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    return signed, spark.createDataFrame([(v,) for v in signed], "fingerprint long")


@pytest.mark.parametrize("pair_rows", [50_000, 10])
def test_trie_walk_finds_every_component(spark, pair_rows):
    values, df = near_values(spark)
    want = slow_components([(v, v & (1 << 64) - 1) for v in values])
    roots = {r.node: r.root for r in components(simhash.near_links(df, pair_rows=pair_rows)).collect()}
    assert {v: roots.get(v, v) for v in values} == {v: want[i] for i, v in enumerate(values)}


def test_frontier_pieces_change_nothing(monkeypatch):
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    value = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 48, 30, dtype=np.uint64)) for _ in range(12)]))
    one = np.array([[0, len(value)]])
    whole = simhash.walk(value, one, one, np.zeros(1, np.int64), 0, 3)
    monkeypatch.setattr(simhash, "FRONTIER", 50)
    cut = simhash.walk(value, one, one, np.zeros(1, np.int64), 0, 3)
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
    want = slow_components([(i, int(v)) for i, v in enumerate(value)])
    moved = dict(zip(*map(np.ndarray.tolist, whole)))
    assert {i: moved.get(i, i) for i in range(len(value))} == want


def test_components_of_a_long_path(spark):
    links = spark.range(60).selectExpr("id AS a", "id + 1 AS b").union(spark.sql("SELECT 100L, 200L"))
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}


# ---- suffix arrays


def slow_removals(rows, length):
    count = Counter(t[i:i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for doc_id, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("options", [{}, {"anchor_strings": 1}, {"sort_bytes": 1}])
def test_removed_bytes_equal_brute_force(spark, options):
    docs = odd_docs(spark).filter("text IS NULL OR length(text) < 10000")
    rows = [(d, (t or "").encode()) for d, t in ODD if t is None or len(t) < 10_000]
    got = Counter(map(tuple, suffix_dedup.removals(docs, **options).collect()))
    assert got == slow_removals(rows, suffix_dedup.LENGTH)


def test_removed_bytes_of_documents(spark):
    docs = table(spark, "documents").filter("length(text) < 6000")
    rows = [(r.doc_id, r.text.encode()) for r in docs.collect()]
    assert Counter(map(tuple, suffix_dedup.removals(docs).collect())) == slow_removals(rows, suffix_dedup.LENGTH)


def test_very_long_and_empty_inputs(spark):
    docs = odd_docs(spark)
    rows = {r.doc_id: r for r in suffix_dedup.removals(docs.filter("doc_id IN (8, 9)")).collect()}
    assert rows[8].n_bytes == len(ODD[10][1].encode())
    assert suffix_dedup.removals(no_docs(spark)).count() == 0
    assert suffix_dedup.clean(docs).columns == docs.columns


def test_clean_keeps_whole_characters(spark):
    shared = "é" * 120
    docs = spark.createDataFrame([(1, "xx" + shared + "ñ1"), (2, "yy" + shared + "è2"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.clean(docs).collect()}
    assert got == {1: "xxñ1", 2: "yyè2", 3: None}


def test_suffix_array_sorts():
    r = random.Random(2)
    for _ in range(100):
        x = bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 50))) + b"\0"
        order = suffix_dedup.suffix_array(np.frombuffer(x, np.uint8), x, 1000)
        assert [x[i:] for i in order] == sorted(x[i:] for i in range(len(x)))


def test_rows_without_id_keep_one_of_each_text(spark):
    rows = [(None, "aaa"), (5, "aaa"), (None, "bbb"), (None, "BBB"), (6, None), (None, ""), (5, "AAA")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = exact_dedup.dedup(df).collect()
    assert Counter((r.doc_id, (r.text or "").lower()) for r in left) == Counter([(5, "aaa"), (None, "bbb"), (6, "")])


def test_clean_keeps_columns_of_any_name(spark):
    docs = odd_docs(spark).selectExpr("*", *[f"'mine' AS `{c}`" for c in (
        "__t1", "__t2", "__spans", "__copied", "__host", "__text_hash", "__left", "__removed", "__copy", "__text_sha256")])
    for out in (suffix_dedup.clean(docs), quality_rules.clean(docs), exact_dedup.dedup(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in docs.columns if c.startswith("__") and c != "__turn")


def test_direct_sort_equals_sorted_slices():
    r = random.Random(12)
    for alphabet, n in ((b"ab", 400), (b"abcdefgh\0", 3000), (b"a", 50)):
        raw = bytes(r.choice(alphabet) for _ in range(n)) * 2 + b"\0"
        at = np.array(sorted(r.sample(range(len(raw)), len(raw) // 2)), np.int64)
        got = suffix_dedup.directly_sorted(np.frombuffer(raw, np.uint8), at, 200)
        key = lambda i: (raw + b"\0" * 300)[i:i + 200]
        assert sorted(got.tolist()) == at.tolist() and [key(i) for i in got] == sorted(key(i) for i in at)


def letters(r, n):
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=n))


def shuffled_bytes(spark):
    nothing, jvm = spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, nothing, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_repeats_are_not_shuffled(spark):
    r = random.Random(31)
    common, frequent = letters(r, 300), letters(r, 60)
    rows = [(i, letters(r, 10_000) + frequent + letters(r, 10_000)) for i in range(200)]
    rows += [(200, letters(r, 500) + common + letters(r, 300)), (201, common + letters(r, 700))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        before = shuffled_bytes(spark)
        got = Counter(map(tuple, suffix_dedup.removals(docs).collect()))
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == Counter([(d, len(t), 300 * (d >= 200), int(d >= 200), hashlib.sha256(
        t.replace(common, "").encode()).hexdigest()) for d, t in rows])
    assert moved < sum(len(t) for _, t in rows)  # all texts were shuffled twice


@pytest.mark.parametrize("length, gram", [(200, 32), (61, 8), (40, 40)])
def test_repeats_about_the_limit_equal_brute_force(spark, length, gram):
    r = random.Random(length)
    pool, rows = letters(r, 3000), []
    for i in range(240):  # strings of about the limit's length, with other surroundings each time
        text = letters(r, r.randint(0, 90))
        for _ in range(4):
            at, n = r.randrange(2500), length + r.randint(-4, 3)
            text += pool[at:at + n] + letters(r, r.randint(1, 120))
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_removals([(d, t.encode()) for d, t in rows], length)
    for options in ({}, {"anchor_strings": 1}):
        assert Counter(map(tuple, suffix_dedup.removals(docs, length, gram=gram, **options).collect())) == want


def test_wanted_rows_pass_the_bitmap(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    rows = suffix_dedup.identified(docs)
    left = {x.doc_id for x in suffix_dedup.wanted_only(rows, rows.filter("doc_id % 10 = 3")).collect()}
    assert left >= set(range(3, 3000, 10)) and len(left) < 400
    assert suffix_dedup.wanted_only(rows, rows.limit(0)).count() == 0


def test_sorting_takes_few_bytes_for_each_byte():
    r = random.Random(41)
    text = letters(r, 368).encode()
    strings = [text[:i] + b"-" + text[i + 1:] for i in (r.randrange(368) for _ in range(2000))]
    tracemalloc.start()
    suffix_dedup.repeated_windows(strings, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * sum(map(len, strings))


def test_runs_are_found_in_little_memory():
    r = random.Random(42)
    batch = pa.RecordBatch.from_pydict({"text": [letters(r, 100_000) for _ in range(40)], "t1": [*range(40)], "t2": [*range(40)]})
    tracemalloc.start()
    rows = sum(b.num_rows for b in suffix_dedup._run_rows(200, 32)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 40_000 and peak < 48 << 20


def python_calls(plan, above=0):
    """The most calls of Python in one stage of a plan."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return python_calls(plan.initialPlan())
    above = 0 if "Exchange" in plan.nodeName() else above + ("Arrow" in plan.nodeName())
    children = plan.children()
    return max([above] + [python_calls(children.apply(i), above) for i in range(children.size())])


def test_no_stage_calls_python_twice(spark, monkeypatch):
    calls, cut = [], suffix_dedup.cut_lineage

    def watched(df):
        calls.append(python_calls(df._jdf.queryExecution().executedPlan()))
        return cut(df)

    monkeypatch.setattr(suffix_dedup, "cut_lineage", watched)
    out = suffix_dedup.removals(odd_docs(spark), anchor_strings=1)
    assert len(calls) > 4 and max(calls) == 1 == python_calls(out._jdf.queryExecution().executedPlan())


def test_listed_spans_merge():
    r = random.Random(43)
    for n in range(60):
        spans = [(r.randrange(2000), r.randint(1, 169)) for _ in range(n)]
        gone = {i for offset, windows in spans for i in range(offset, offset + windows + 19)}
        ends = [(i, i not in gone) for i in range(2300) if (i in gone) != (i - 1 in gone)]
        got = suffix_dedup.merged(np.array([a << 16 | w for a, w in spans], np.int64), 20)
        assert [x for a, b in got for x in ((a, False), (b, True))] == ends
