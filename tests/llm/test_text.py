import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import html_text, ordinal_quality, quality_rules, toxicity
from tests.llm.samples import ODD, no_docs, odd_docs, table

# ---- main text


def page(body):
    blocks = html_text.blocks_of(body)
    if not blocks:
        return ""
    tree = html_text.grow(*html_text.labelled_table())
    return "\n".join(b.text for b, k in zip(blocks, tree(html_text.features(blocks)) >= 0.5) if k)


def test_article_without_its_surroundings():
    body = """<!doctype html><head><title>T</title><script>x="<p>no</p>"</script></head><body><nav><a href=/>Home</a></nav>
    <div class="cookie-banner"><p>We use cookies on this site and you accept them.</p></div><article><h1>A &amp; B</h1>
    <p>First <b>bold</b>\n text&nbsp;here, a&lt;b.<br>Second line.<p>Short.</p><!-- <p>gone</p> -->
    <aside>See also this</aside><form><label>Name</label></form></article><div id="comments"><p>I liked this a lot.</p></div>
    <footer>&copy; me</footer>"""
    assert page(body) == "A & B\nFirst bold text here, a<b. Second line.\nShort."


@pytest.mark.parametrize("body, text", [
    ("", ""), ("<", "<"), ("<article><p>a <b c='>'>b</b></p>", "a b"), ("<script>never closed <p>x", ""),
    ("<article><p>x</p><!-- open <p>y", "x"), ("<article><p>&am</p><p>&amp</p></article>", "&am\n&"),
    ("<article></div></nav><p>1 < 2 is fine here</p></article>", "1 < 2 is fine here"),
])
def test_odd_markup(body, text):
    assert page(body) == text


@pytest.mark.parametrize("raw", [
    '<svg class="icon"/>', "<svg/>", "<svg><g><svg><text>in</text></svg></g><text>out</text></svg>", "<iframe src=x>", "<noscript>",
    "<template><template><p>in</p></template><p>out</p></template>", "<svg><svg/><text>in</text></svg>", "<svg viewbox='0 0 1 1'>",
    "<svg><title>never closed</svg>"])
def test_silent_elements_hide_only_themselves(raw):
    assert page(f"<article><p>First line here.</p>{raw}<p>Second line here.</p></article>") == "First line here.\nSecond line here."


@pytest.mark.parametrize("wrap", [
    '<body class="has-sidebar"><article>%s</article></body>', '<div class="layout-no-sidebar"><article>%s</article></div>',
    '<div id="legal-news"><article>%s</article></div>', '<main class="with-footer">%s</main>',
    '<div class="page sidebar"><div role="main">%s</div></div>'])
def test_names_of_wrappers_do_not_hide_the_article(wrap):
    text = " ".join(["word"] * 40) + "."
    assert page(wrap % f"<h1>Some heading here</h1><p>{text}</p><p>{text}</p>") == f"Some heading here\n{text}\n{text}"
    assert page(f"<div class=sidebar><article><p>{text}</p></article></div>") == ""


def test_tree_learns_its_table():
    rows, labels = html_text.labelled_table()
    tree = html_text.grow(rows, labels)
    assert ((tree(rows) >= 0.5) == labels).mean() > 0.98
    even = np.arange(len(labels)) % 2 == 0
    held = html_text.grow(rows[even], labels[even])
    assert ((held(rows[~even]) >= 0.5) == labels[~even]).mean() > 0.95


def test_pages_with_nulls_and_long_text(spark):
    long = "<article>" + "<p>" + "word " * 200_000 + "</p></article>"
    rows = [(1, "u", None), (None, None, ""), (2, "u", long), (2, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = Counter((r.page_id, r.n_chars) for r in html_text.extract(df).collect())
    assert got == Counter({(1, 0): 1, (None, 0): 1, (2, 999_999): 2})
    assert html_text.extract(df.limit(0)).count() == 0


# ---- quality rules


def slow_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {p for i, w in enumerate(windows) if n[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), failed)


def test_base_counts_of_odd_rows(spark):
    rows = ODD + [(20, "a b c a b c x#*<" * 20), (21, "*" * 5 + " |&$%"), (22, "one\ntwo\none\n\n\none")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'h' AS source", "1 AS host", "2 AS b")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
                  for r in quality_rules.judge(df).collect())
    assert got == Counter((d, *slow_counts(t)) for d, t in rows)
    assert quality_rules.judge(no_docs(spark)).count() == 0
    docs = odd_docs(spark)
    assert quality_rules.clean(docs).columns == docs.columns


def test_lines_above_the_limits_deplete(spark):
    own = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    shared = " ".join(f"menu{j}" for j in range(200))
    rows = [(i, own(i) + "\n" + shared, "h") for i in range(30)]
    rows += [(100 + i, own(100 + i), "h") for i in range(30)]
    rows += [(200 + i, own(200) + "\n" + own(201), "h") for i in range(30)]  # copies are one document
    rows += [(300, own(300) + "\n" + shared.upper() + " ", "other"), (301, own(301), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert {i for i, k in got.items() if not k} == set(range(30))
    left = {r.doc_id: r.text for r in quality_rules.clean(df, min_left=0.0).collect()}
    assert left[3] == own(3) and left[300] == rows[-2][1] and left[205] == rows[65][1]


# ---- classifiers


def test_toxicity_on_held_out_rows(spark):
    docs, labels = table(spark, "documents", "sf0.1"), table(spark, "labels", "sf0.1")
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels, "doc_id").filter("held_out")
    rows = scored.select("score", "predicted", "toxic").collect()
    good = [r for r in rows if r.toxic]
    assert sum(r.predicted for r in good) / len(good) > 0.8
    assert sum(r.predicted for r in rows if not r.toxic) / (len(rows) - len(good)) < 0.02


def test_forward_backward_equals_enumeration():
    import itertools

    model = toxicity.Model(weight={"=bad": 3.0, "=worse": 5.0}, rest=-2.0, start=(0.3, -0.4), move=np.array([[0.2, -0.7], [0.1, 0.9]]))
    tokens = "a bad b c worse bad d".split()
    e = [model.evidence(t) for t in tokens]
    places = [i for i, x in enumerate(e) if x is not None]
    total, on = 0.0, Counter()
    for path in itertools.product((0, 1), repeat=len(tokens)):
        s = model.start[path[0]] + sum((model.rest if x is None else x) for x, y in zip(e, path) if y)
        s += sum(model.move[a, b] for a, b in zip(path, path[1:]))
        total += np.exp(s)
        for i, y in enumerate(path):
            on[i] += np.exp(s) * y
    got = model.marginals(places, [e[i] for i in places], len(tokens))
    assert np.allclose(got, [on[i] / total for i in places])


def test_spans_point_at_the_words(spark):
    rows = [(i, f"word{i} and {'nasty' if i % 3 == 0 else 'nice'} things, x{i}") for i in range(1, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    more = docs.union(spark.createDataFrame([(900, "so NASTY, yes"), (901, None), (None, "")], docs.schema))
    got = {r.doc_id: r for r in toxicity.score(more, model).collect()}
    assert [("so NASTY, yes")[s.start:s.end] for s in got[900].spans] == ["NASTY,"]
    assert got[900].predicted == 1 and got[901].predicted == 0 and got[None].predicted == 0 and not got[None].held_out
    assert all(got[i].predicted == (i % 3 == 0) for i, _ in rows)


def test_classifiers_without_labels_or_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).filter("predicted = 0").count() == len(ODD)
    grade = F.when(F.col("quality") == 0, 0).otherwise(F.col("toxic"))
    model = ordinal_quality.fit(docs, labels, grade, 3)
    assert {round(r.expected_grade, 6) for r in ordinal_quality.score(docs, model).collect()} == {1.0}
    assert ordinal_quality.score(no_docs(spark), model).count() == 0


def test_ordinal_grades_on_held_out_rows(spark):
    from assay.llm.queries import op9_ordinal_quality

    labels = table(spark, "labels", "sf0.1")
    rows = op9_ordinal_quality(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    good = [r for r in rows if r.quality]
    bad = [r for r in rows if not r.quality]
    assert sum(r.kept for r in good) / len(good) > 0.97
    assert sum(r.kept for r in bad) / len(bad) < 0.35
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_ordinal_thresholds_are_ordered_and_gradients_right():
    r = np.random.default_rng(0)
    z, grade, cut = r.normal(size=20), r.integers(0, 4, 20), np.array([-1.0, 0.2, 1.5])

    def loss(z, cut):
        edge = np.concatenate(([-np.inf], cut, [np.inf]))
        s = lambda x: 1 / (1 + np.exp(-x))
        return -np.log(s(edge[grade + 1] - z) - s(edge[grade] - z)).sum()

    by_z, by_t = ordinal_quality._likelihood_gradients(z, grade, cut)
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert np.isclose((loss(z, cut + step) - loss(z, cut - step)) / 2e-6, by_t[i], atol=1e-4)
    step = np.eye(20)[4] * 1e-6
    assert np.isclose((loss(z + step, cut) - loss(z - step, cut)) / 2e-6, by_z[4], atol=1e-4)
    texts = [w * 5 for w in ("low ", "mid ", "top ")] * 30
    model = ordinal_quality.fit_rows(texts, [0, 1, 2] * 30, 3, bits=12)
    assert (np.diff(model.thresholds) > 0).all()
