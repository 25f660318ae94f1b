import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import best_position, pii_spans, segment_bounds
from assay.llm.queries import QUERIES
from tests.llm.samples import ODD, no_docs, odd_docs, prose, table

# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    docs = [(i, plain_terms(t)) for i, t in docs]
    docs = [(i, len(t), Counter(t)) for i, t in docs if t]
    n_docs, n_terms = len(docs), sum(n for _, n, _ in docs)
    df = Counter(t for _, _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, n, c in docs:
            m = 10 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in set(plain_terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("shard, block", [(1 << 20, 10 ** 6), (200, 30)])
def test_search_equals_brute_force(spark, shard, block):
    docs = odd_docs(spark)
    items = [(1, "Alpha gamma"), (2, None), (3, ""), (4, prose(5, 40)), (4, prose(5, 40)), (None, "words É a b"), (6, prose(1, 3000)),
             (7, "line one absent")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("x"))
    got = rows_of(best_position.search(docs, frame, block_terms=block, shard_postings=shard))
    assert got == plain_search(ODD, items)


def test_search_ends_early_and_keeps_ties(spark):
    r = random.Random(3)
    docs = [(i, " ".join(r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(r.randint(1, 60)))) for i in range(600)]
    docs += [(1000 + i, "ax by cz") for i in range(300)] + [(2000, "ax " * 50)]
    items = [(i, " ".join(r.choice("abcdefghijklmnop") + r.choice("xyz") for _ in range(i))) for i in range(1, 9)] + [(99, "ax by cz")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = rows_of(best_position.search(df, spark.createDataFrame(items, "item_id long, text string"), k=7, shard_postings=900))
    assert got == plain_search(docs, items, 7)


def test_search_stops_before_the_end_of_the_lists():
    import pyarrow as pa

    n = 5000
    times = np.ones(n, np.int64)
    times[:20] = 500
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(n), pa.int64()), pa.array([1000] * n, pa.int64()),
        pa.ListArray.from_arrays(pa.array(range(n + 1), pa.int32()), pa.array([0] * n, pa.int32())),
        pa.ListArray.from_arrays(pa.array(range(n + 1), pa.int32()), pa.array(times))], ["doc_id", "n", "terms", "times"])
    docs, scores = best_position.Shard([batch], np.array([700]), n, 1000 * n).search(np.array([0]), 10, 0)
    assert sorted(docs) == list(range(20)) and len(set(scores.tolist())) == 1


def test_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert best_position.search(no_docs(spark), items).collect() == []
    found = best_position.search(odd_docs(spark), items.limit(0))
    assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_slices(monkeypatch):
    text = prose(9, 3000) + " " + "z" * 300 + " end"
    monkeypatch.setattr(best_position, "SLICE_BYTES", 64)
    assert [w.decode() for part in best_position.terms_of(text.encode()) for w in part] == plain_terms(text)


# ---- hard negatives


def plain_mine(rows):
    good = []
    for at, (i, x, label) in enumerate(rows):
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        v = [math.floor(256 * float(np.float32(c))) for c in x]
        good.append((at, i, (label + 1) % 10 if i % 7 == 0 else label, v))
    out = []
    for at, i, label, v in good:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, b_at, lab) for b_at, j, lab, w in good if b_at != at]
        for ps, p, _, _ in sorted(s for s in scored if s[3] == label)[:5]:
            inside = sorted(s for s in scored if s[3] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps)[:3]
            out += [(i, p, r, j, -ps, -s) for r, (s, j, _, _) in enumerate(inside, 1)]
    return Counter(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("norm", F.lit("x"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows_of(segment_bounds.mine(df, label, F.col("vec_id") % 50 == 0, **options))


@pytest.mark.parametrize("block", [(4096, 32768), (3, 40)])
def test_hard_negatives_equal_brute_force(spark, block):
    r = np.random.default_rng(4)
    centres = r.normal(0, .15, (4, 24))
    rows = [(i, (centres[i % 4] + r.normal(0, .08, 24)).tolist(), int(i % 4)) for i in range(400)]
    rows += [(1000 + i, rows[3][1], int(i % 2)) for i in range(60)] + [rows[50], rows[100]]  # one common vector, repeated rows
    rows += [(2000, None, 1), (2001, [0.1] * 24, None), (None, [0.1] * 24, 1), (2050, [0.1, None] * 12, 1),
             (2002, [float("nan")] * 24, 0), (2100, [float("inf")] * 24, 0), (2150, [0.2, 0.1], 1), (2200, [], 2), (2203, [0.0] * 24, 3)]
    assert mined(spark, rows, block=block) == plain_mine(rows)


def test_no_vectors(spark):
    assert mined(spark, []) == Counter()
    assert mined(spark, [(50, [1.0], 1)]) == Counter()


def test_bounds_hold_and_narrow():
    r = np.random.default_rng(5)
    x = r.integers(-300, 300, (50, 64))
    x[:5] *= 4000
    means, deviations = segment_bounds.summaries(x)
    side = segment_bounds.Block.__new__(segment_bounds.Block)
    side.x, side.means, side.deviations, side.length = x, means, deviations, 64
    side.norm = np.sqrt((x.astype(float) ** 2).sum(axis=1))
    exact, widths = x @ x[7], []
    for level in range(4):
        low, high = segment_bounds.bounds(side, 7, side, np.arange(50), level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).sum())
    assert widths == sorted(widths, reverse=True)


# ---- personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def odd_texts():
    r = random.Random(11)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
             for alphabet in ("a1@. _", "12.3", "4 -19", "+1 ()-.9", "a@b.c-d_e", "0123456789 -.+@a(é漢😀") for _ in range(150)]
    return texts + [t for _, t in ODD] + [
        "a@b.c-d_e@x.y mail x.y@z.example.com", "4111 1111 1111 1111", "4111-1111-1111-1111 and 4111111111111112", "x 1.2.3.4.5.6.7.8",
        "é😀 +1 (717) 555-0202, call", "0000000255.1.1.1 256.1.1.1 " + "9" * 40 + ".1.1.1", "+" + "1 " * 400 + "2"]


def test_base_spans_equal_brute_force(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, None)], "doc_id long, text string").selectExpr("*", "'x' AS base", "1 AS spans")
    found = pii_spans.detect(df)
    got = Counter((r.doc_id, r.b) for r in found.select("doc_id", pii_spans.as_text(F.col("base")).alias("b")).collect())
    assert got == Counter((i, plain_spans(t)) for i, t in enumerate(texts)) + Counter([(None, "")])
    assert found.filter(F.size(F.array_except("base", "spans")) > 0).count() == 0  # base spans stay


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    for r in QUERIES["op11_pii"](spark, "/root/testdata/sf0.001").collect():
        want = plain_spans(texts[r.doc_id])
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in BASE)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(","))


def test_long_texts_are_linear(spark):
    long = ["a" * 2_000_000, "1 " * 300_000, "a@b" + ".c" * 500_000, "1." * 400_000, "+1" + " " * 1_000_000, "4111 1111 1111 1111, " * 20_000]
    found = pii_spans.detect(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string"))
    sizes = {r.doc_id: r.n for r in found.select("doc_id", F.size("base").alias("n")).collect()}
    assert sizes == {0: 0, 1: 0, 2: 1, 3: 100_000, 4: 0, 5: 20_000}


def test_running_sums(spark):
    for n in (0, 1, 2, 3, 4, 9, 10, 50):
        got = spark.range(1).select(pii_spans.running(F.sequence(F.lit(1), F.lit(n)) if n else F.expr("CAST(array() AS array<int>)"))).first()[0]
        assert got == np.cumsum(np.arange(1, n + 1)).tolist()


def labelled(n):
    """Texts with loose forms of personal data, and numbers that only look like it."""
    r = random.Random(8)
    good, bad = [], []
    for _ in range(n):
        number = f"{r.randint(200, 999)}-{r.randint(200, 999)}-{r.randint(1000, 9999)}"
        good.append(r.choice([f"please call ({number[:3]}) {number[4:]} today", f"tel {number} ok", f"my phone is +1 {number}, thanks"]))
        good.append(f"write a mail to jo.{r.randint(1, 99)} (at) mail{r.randint(1, 9)} (dot) example (dot) com now")
        good.append(f"send a mail to jo{r.randint(1, 99)}@example.com now")
        bad.append(f"order id #{r.randint(10 ** 13, 10 ** 14)}0 and version 1.2.3.{r.randint(256, 999)} of it")
    return good, bad


def test_votes_add_loose_forms_only(spark):
    good, bad = labelled(150)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    spans = {r.doc_id: r.n for r in pii_spans.detect(df).select("doc_id", F.size("spans").alias("n")).collect()}
    assert sum(spans[i] > 0 for i in range(len(good))) >= 0.9 * len(good)
    wrong = [i for i in range(len(good), len(spans)) if spans[i] and not plain_spans(bad[i - len(good)])]
    assert len(wrong) == 0


def test_em_finds_the_reliable_labelers(spark):
    r = random.Random(2)
    rows = Counter()
    for _ in range(4000):
        y = r.random() < 0.4
        vote = lambda right: (1 if y else -1) if r.random() < right else (-1 if y else 1)
        rows[(vote(0.95), vote(0.85), r.choice((0, vote(0.8))), vote(0.55))] += 1
    df = spark.createDataFrame([(0, list(v), n) for v, n in rows.items()], "kind int, votes array<int>, n long")
    m = pii_spans.reliabilities(df).first()
    assert abs(m.prior - 0.4) < 0.05
    assert [abs(m.hit[j][2] - p) < 0.06 for j, p in ((0, .95), (1, .85), (3, .55))] == [True] * 3


def test_redacted_texts(spark):
    rows = [(1, "mail é jo@example.com, ip 1.2.3.4!"), (2, None), (None, "nothing"), (1, "mail é jo@example.com, ip 1.2.3.4!")]
    got = Counter(map(tuple, pii_spans.redact(spark.createDataFrame(rows, "doc_id long, text string"), "#").collect()))
    hidden = "mail é " + "#" * 14 + ", ip " + "#" * 7 + "!"
    assert got == Counter([(1, hidden), (1, hidden), (2, ""), (None, "nothing")])


def test_no_rows(spark):
    assert pii_spans.detect(no_docs(spark)).collect() == []
    assert pii_spans.detect(odd_docs(spark)).count() == len(ODD)
