"""Queries on report texts, retrieval, relational basics and supervised tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from assay.functions.order_stats import average_ranks
from assay.functions.text import containment
from assay.operators import domains as D
from assay.operators import grouped as G
from assay.operators import reports as T
from assay.operators import retrieval as I
from assay.operators import supervised as L
from assay.plans.profile import profile
from catalog.checks import _FILES, _files, _findings
from catalog.grouped import _rounded
from catalog.registry import query, table

_DEC = "CAST(round(CAST({x} AS DECIMAL(20, 12)), 4) AS DOUBLE)"


@query(r"""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents),
q AS (SELECT doc_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM p),
k AS (SELECT * FROM q WHERE length(p) > 50 AND NOT starts_with(p, '#') AND NOT starts_with(p, '|')),
g AS (SELECT doc_id, count(CASE WHEN regexp_matches(p, '(^|[^\p{L}\p{N}_])[0-9]+[.,]?[0-9]*($|[^\p{L}\p{N}_])') THEN 1 END) AS hit, count(*) AS n FROM k GROUP BY doc_id)
SELECT d.doc_id, """ + _DEC.format(x="hit / n") + " AS grounding_rate FROM documents d LEFT JOIN g USING (doc_id)")
def grounding_rate(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.grounding_rate(F.col("text"), "\n").alias("grounding_rate"))


_NAMES = ["the", "der", "les", "data", "que", "Article", "email", "license"]


@query("SELECT doc_id, round((" + " + ".join(f"contains(text, '{n}')::INTEGER" for n in _NAMES)
       + ") / 8.0, 4)::DOUBLE AS data_coverage FROM documents")
def data_coverage(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", T.data_coverage(F.col("text"), _NAMES).alias("data_coverage"))


# Reports of orders: text made of the order's own facts.
_REPORTS = """reports AS (SELECT o_orderkey AS doc_id, 'Overview of ' || o_orderstatus || '. Figure ' || (o_custkey % 5) || ' shows total_price = ' || CAST(o_totalprice AS VARCHAR)
  || '. See fig. ' || (o_orderkey % 4) || ' in trend_' || o_custkey || '.png for more! The F = ' || (1 + o_custkey % 3) || '.2 with p < 0.00' || (1 + o_orderkey % 9)
  || ' and R2 = ' || (o_custkey % 3) || '.5 hold. Is price: ' || (o_custkey % 7) || '% fine? p = ' || (o_orderkey % 3) || '.2 here. Figure ' || (o_custkey % 5) || ' again.' AS text FROM orders)"""


def _reports(spark, d):
    o = table(spark, d, "orders")

    def s(e):
        return F.expr(e).cast("string")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(
        F.lit("Overview of "), F.col("o_orderstatus"), F.lit(". Figure "), s("o_custkey % 5"),
        F.lit(" shows total_price = "), s("o_totalprice"), F.lit(". See fig. "), s("o_orderkey % 4"),
        F.lit(" in trend_"), s("o_custkey"), F.lit(".png for more! The F = "), s("1 + o_custkey % 3"),
        F.lit(".2 with p < 0.00"), s("1 + o_orderkey % 9"), F.lit(" and R2 = "), s("o_custkey % 3"),
        F.lit(".5 hold. Is price: "), s("o_custkey % 7"), F.lit("% fine? p = "), s("o_orderkey % 3"),
        F.lit(".2 here. Figure "), s("o_custkey % 5"), F.lit(" again.")).alias("text"))


@query(f"WITH {_REPORTS} SELECT doc_id, " + _DEC.format(
    x="least(len(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\bFig(?:ure)?\\.?\\s*[0-9]+'), lambda x: lower(x)))), 4) / 4.0")
    + " AS rate FROM reports")
def figure_reference_rate(spark, d):
    return _reports(spark, d).select("doc_id", T.figure_reference_rate(
        F.col("text"), F.lit(4)).alias("rate"))


@query(f"""WITH {_REPORTS}, s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM reports),
e AS (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s),
m AS (SELECT doc_id, i, 'Figure ' || regexp_extract(s[i], '(?i)(?:Figure|Fig\\.?)\\s*([0-9]+)', 1) AS figure_ref,
  substr(concat_ws(' ', CASE WHEN i > 1 THEN s[i - 1] END, s[i], s[i + 1]), 1, 600) AS claim_text,
  regexp_extract(s[i], '(?i)(\\w[\\w\\-. ]*\\.png)', 1) AS figure_file FROM e WHERE regexp_matches(s[i], '(?i)(?:Figure|Fig\\.?)\\s*([0-9]+)')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, figure_ref ORDER BY i) AS rn FROM m)
SELECT doc_id, figure_ref, claim_text, figure_file FROM r WHERE rn = 1""")
def figure_claims(spark, d):
    return T.figure_claims(_reports(spark, d), ["doc_id"])


@query(f"""WITH {_REPORTS}, m AS (SELECT avg(o_totalprice) AS mean FROM orders),
r AS (SELECT doc_id, TRY_CAST(regexp_extract(text, 'total_price = ([0-9]+[.,]?[0-9]*)', 1) AS DOUBLE) AS stated FROM reports)
SELECT doc_id, round(stated, 2) AS stated FROM r, m WHERE abs(stated - mean) / mean > 0.05""")
def value_contradictions(spark, d):
    reports = _reports(spark, d).withColumn("all", F.lit(1))
    means = table(spark, d, "orders").agg(F.avg("o_totalprice").alias("mean")).select(
        F.lit(1).alias("all"), F.lit("total_price_mean").alias("metric"), "mean")
    return T.value_contradictions(reports, means, ["all"], keep=["doc_id"]).filter("key = 'total_price'").select(
        "doc_id", F.round("stated", 2).alias("stated"))


@query(f"""WITH {_REPORTS}, e AS (SELECT doc_id, 'f_test' AS kind, TRY_CAST(regexp_extract(text, 'F = ([0-9.]+)', 1) AS DOUBLE) AS value,
   TRY_CAST(regexp_extract(text, 'p < ([0-9.]+)', 1) AS DOUBLE) AS p FROM reports
  UNION ALL SELECT doc_id, 'r_squared', TRY_CAST(regexp_extract(text, 'R2 = ([0-9.]+)', 1) AS DOUBLE), NULL FROM reports
  UNION ALL SELECT doc_id, 'p_value', TRY_CAST(regexp_extract(text, ' p = ([0-9.]+)', 1) AS DOUBLE), NULL FROM reports)
SELECT * FROM e WHERE (kind = 'f_test' AND value BETWEEN 0.5 AND 1.5 AND p < 0.01) OR (kind = 'r_squared' AND value > 1) OR (kind = 'p_value' AND value > 1)""")
def implausible_statistics(spark, d):
    return T.implausible_statistics(_reports(spark, d), ["doc_id"])


@query(f"""WITH {_REPORTS}, c AS (SELECT o_orderkey AS doc_id, 'price' AS metric, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR) ELSE 'no such value' END AS claimed FROM orders)
SELECT c.doc_id, metric, claimed FROM c JOIN reports r ON c.doc_id = r.doc_id AND contains(r.text, claimed)""")
def repeated_claims(spark, d):
    c = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("price").alias("metric"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise(
            "no such value").alias("claimed"))
    return T.repeated_claims(_reports(spark, d), c, ["doc_id"]).select("doc_id", "metric", "claimed")


@query(r"""
WITH s(name) AS (VALUES ('executive summary'), ('data'), ('cleaning'), ('analysis'), ('cross-validation'), ('conclusion'), ('recommendation')),
h AS (SELECT doc_id, lower(regexp_extract(line, '^##\s+[0-9]*\.?\s*(.*)', 1)) AS h FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '^##\s+')),
m AS (SELECT d.doc_id, s.name FROM documents d, s WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc_id = d.doc_id AND contains(h.h, s.name)))
SELECT d.doc_id, count(m.name) AS missing, length(regexp_replace(any_value(text), '^\s+|\s+$', '', 'g')) >= 500 AS long_enough
FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id""")
def report_sections(spark, d):
    return T.report_sections(table(spark, d, "documents"), ["doc_id"]).select(
        "doc_id", F.size("missing_sections").cast("bigint").alias("missing"), "long_enough")


@query(f"""WITH {_FILES}, c AS (SELECT l_suppkey AS run, 'plot_' || (l_linenumber * 9) AS stem, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT f.run, f.path, f.size, coalesce(n, 0) AS citations, row_number() OVER (PARTITION BY f.run ORDER BY coalesce(n, 0) DESC, f.size DESC, f.path) AS position
  FROM files f LEFT JOIN c ON f.run = c.run AND f.path = 'figures/' || c.stem || '.png' WHERE f.size >= 5000)
SELECT run, path, size, citations, position FROM r WHERE position <= 10""")
def ranked_figures(spark, d):
    out = T.ranked_figures(_files(spark, d), _findings(spark, d), ["run"])
    return out.select("run", "path", "size", "citations", F.col("position").cast("bigint").alias("position"))


@query(r"""
SELECT lang, min(doc_id) AS idx FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0
GROUP BY lang, regexp_replace(text, '^\s+|\s+$', '', 'g')""")
def distinct_findings(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "idx")
    return T.distinct_findings(docs, ["lang"]).select("lang", "idx")


@query(r"""
SELECT lang, count(*) AS n, sum(idx)::BIGINT AS idx_sum FROM (
  SELECT lang, min(doc_id) AS idx FROM documents
  GROUP BY lang, substr(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), 1, 200)) GROUP BY lang""")
def distinct_finding_heads(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "idx")
    return T.distinct_findings(docs, ["lang"], 200).groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum("idx").alias("idx_sum"))


@query()
def matched_files(spark, d):
    open_ = _findings(spark, d).withColumn("figure_ref", F.lit(None).cast("string"))
    return T.match_files(open_, _files(spark, d), ["run"])


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def parsed_replies(spark, d):
    raw = table(spark, d, "events").select("event_id", F.concat(
        F.lit("<think>maybe {not this}</think>\nHere:\n```json\n"), F.col("props"), F.lit("\n```")).alias("reply"))
    return T.parse_model_text(raw, "reply", "k bigint").select("event_id", F.col("parsed.k").alias("k"))


@query(f"""WITH {_FILES}, r AS (SELECT l_suppkey AS run, 'figures/plot_' || (l_linenumber * 9) || '.png' AS path FROM lineitem)
SELECT r.run, count(*) AS broken FROM r LEFT JOIN files f ON r.run = f.run AND r.path = f.path WHERE f.run IS NULL GROUP BY r.run""")
def broken_references(spark, d):
    linked = _findings(spark, d).select("run", F.concat(
        F.lit("![p](figures/"), F.col("figure_ref"), F.lit(")")).alias("text"))
    return T.broken_references(linked, _files(spark, d), ["run"]).groupBy("run").agg(
        F.count(F.lit(1)).alias("broken"))


_WORDS = ", ".join(f"('{d_}', '{w}')" for d_, ws in D.DOMAIN_KEYWORDS.items() for w in ws)


@query(f"""
WITH n AS (SELECT DISTINCT l_orderkey AS ds, CASE l_linenumber % 7 WHEN 0 THEN 'retention_time' WHEN 1 THEN 'Peak_Area' WHEN 2 THEN 'charge_state' WHEN 3 THEN 'm/z'
  WHEN 4 THEN 'value' WHEN 5 THEN 'wavelength' ELSE 'Intensity' END AS name FROM lineitem),
w(domain, word) AS (VALUES {_WORDS}),
h AS (SELECT ds, domain, word, bool_or(contains(lower(name), word)) AS hit FROM n, w GROUP BY ALL),
c AS (SELECT ds, domain, count(CASE WHEN hit THEN 1 END) / count(*) AS confidence FROM h GROUP BY ALL)
SELECT ds, domain, round(confidence, 6) AS confidence, confidence >= 0.05 AS detected, confidence >= 0.2 AS strong FROM c""")
def detected_domains(spark, d):
    kind = F.col("l_linenumber") % 7
    names = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ds"), F.when(kind == 0, "retention_time").when(kind == 1, "Peak_Area").when(
            kind == 2, "charge_state").when(kind == 3, "m/z").when(kind == 4, "value").when(
            kind == 5, "wavelength").otherwise("Intensity").alias("name"))
    return _rounded(D.detect_domains(names, ["ds"]), ["confidence"])


# Retrieval -----------------------------------------------------------------------------

@query("""
SELECT c_custkey, concat_ws(' | ', 'c_custkey: ' || c_custkey, 'c_name: ' || c_name, 'c_nationkey: ' || c_nationkey,
  'c_acctbal: ' || c_acctbal, 'c_mktsegment: ' || c_mktsegment) AS text FROM customer""")
def row_texts(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", I.row_text(c).alias("text"))


_UNIT = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"""


@query(f"WITH {_UNIT} SELECT vec_id, unnest(range(1, len(v) + 1)) AS place, round(unnest(v), 6) AS value FROM u")
def unit_vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", I.l2_normalise(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.posexplode("v").alias("place", "value")).select(
        "vec_id", (F.col("place") + 1).cast("long").alias("place"), F.round("value", 6).alias("value"))


def _centroids(spark, d):
    parts = table(spark, d, "embeddings").select(
        "label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).select(
        F.col("label").alias("query_id"), F.transform("s", lambda p: p["m"]).alias("embedding"))


_TOPK = """WITH x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), c AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM m GROUP BY label),
s AS (SELECT query_id, vec_id AS id, list_dot_product(embedding::DOUBLE[], q) AS score FROM embeddings, c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM s)"""


@query(_TOPK + " SELECT query_id, id, round(score, 8) AS score, position FROM r WHERE position <= 5")
def nearest_rows(spark, d):
    out = I.top_k(table(spark, d, "embeddings"), _centroids(spark, d), 5, row_id="vec_id")
    return _rounded(out.withColumn("position", F.col("position").cast("bigint")), ["score"], 8)


@query(r"""
WITH t AS (SELECT doc_id AS source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
s AS (SELECT source, t, unnest(range(0, length(t), 520)) AS start FROM t)
SELECT source || '__' || (start // 520) AS chunk_id, source, substr(t, start + 1, 600) AS text FROM s""")
def document_chunks(spark, d):
    return I.chunks(table(spark, d, "documents"), "doc_id", "text")


@query(_TOPK + r""", p AS (SELECT query_id, position, CASE WHEN length(text) <= 500 THEN text
    ELSE regexp_replace(substr(text, 1, 450), '\s+$', '') || chr(10) || '...[truncated]' END AS t
  FROM r JOIN documents ON id = doc_id WHERE position <= 12),
j AS (SELECT query_id, string_agg(t, chr(10) ORDER BY position) AS w FROM p GROUP BY query_id)
SELECT query_id, CASE WHEN length(w) <= 4000 THEN w ELSE regexp_replace(substr(w, 1, 3950), '\s+$', '') || chr(10) || '...[truncated]' END AS context FROM j""")
def matched_context(spark, d):
    hits = I.top_k(table(spark, d, "embeddings"), _centroids(spark, d), 12, row_id="vec_id")
    return I.matched_context(hits, table(spark, d, "documents"), "doc_id", "text")


# Relational basics -----------------------------------------------------------------------

@query("""
WITH t AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark)
SELECT term, count(*) AS n FROM t JOIN documents ON contains(text, term) WHERE length(term) > 0 GROUP BY term""")
def terms_in_texts(spark, d):
    terms = table(spark, d, "benchmark").select(F.lit(1).alias("all"), F.explode(
        F.split(F.lower("text"), " ", -1)).alias("term")).distinct()
    docs = table(spark, d, "documents").select(F.lit(1).alias("all"), "doc_id", "text")
    return containment(terms, docs, ["all"], "term", "text", keep_text=False).groupBy("term").agg(
        F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'with_lines' AS kind, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def semi_and_anti(spark, d):
    o = table(spark, d, "orders")
    keys = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    n = F.count(F.lit(1)).alias("n")
    return o.join(keys, "o_orderkey", "left_semi").agg(n).select(F.lit("with_lines").alias("kind"), "n").union(
        o.join(keys, "o_orderkey", "left_anti").agg(n).select(F.lit("without_lines"), "n"))


@query("""
SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'customers_beyond', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)""")
def set_operations(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    n = F.count(F.lit(1)).alias("n")
    return c.intersect(s).agg(n).select(F.lit("both").alias("part"), "n").union(
        c.exceptAll(s).agg(n).select(F.lit("customers_beyond"), "n"))


@query("SELECT event_type, key AS name, count(*) AS n, round(avg(CAST(value AS DOUBLE)), 6) AS mean FROM "
       "(SELECT event_type, unnest(json_keys(props)) AS key, json_extract_string(props, '$.k') AS value FROM events) GROUP BY ALL")
def exploded_json(spark, d):
    return table(spark, d, "events").select("event_type", F.explode(F.from_json(
        "props", "map<string,double>")).alias("name", "value")).groupBy("event_type", "name").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 25""")
def top_rows(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").orderBy(
        F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey").limit(25)


@query("""
SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity, rank() OVER (ORDER BY sum(l_quantity) DESC)
  + (count(*) OVER (PARTITION BY sum(l_quantity)) - 1) / 2.0 AS avg_rank FROM lineitem GROUP BY l_suppkey""")
def average_tie_ranks(spark, d):
    q = table(spark, d, "lineitem").groupBy("l_suppkey").agg((-F.sum("l_quantity")).alias("neg"))
    return average_ranks(q, [], "neg").select(
        "l_suppkey", F.round(-F.col("neg"), 2).alias("quantity"), "avg_rank")


@query("""
SELECT o_custkey, count(*) AS n, count(CASE WHEN o_totalprice > prev THEN 1 END) AS rises FROM (
  SELECT o_custkey, o_totalprice, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders)
GROUP BY o_custkey""")
def previous_row(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").withColumn("prev", F.lag("o_totalprice").over(w)).groupBy(
        "o_custkey").agg(F.count(F.lit(1)).alias("n"),
                         F.count_if(F.col("o_totalprice") > F.col("prev")).alias("rises"))


# Supervised tasks ----------------------------------------------------------------------------

def _task(spark, d):
    feats = G.wide_features(table(spark, d, "lineitem"), ["l_suppkey"], ["l_quantity", "l_discount"])
    label = G.cv_label(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", 0.57, "label")
    return feats.join(label.select("l_suppkey", F.col("label").cast("int").alias("label"),
                                   F.col("cv").alias("price_cv")), "l_suppkey")


@query()
def classification_task(spark, d):
    rows = _task(spark, d)
    feats = L.auto_features(rows, ["l_suppkey", "label", "price_cv"])
    preds, weights = L.cross_validate(rows, ["l_suppkey"], feats, "label")
    metrics = L.metric_summary(L.fold_metrics(preds)).select(
        F.lit("metric").alias("part"), F.col("metric").alias("name"), F.col("mean").alias("value"))
    stable = L.feature_stability(weights).select(
        F.lit("stability"), F.col("feature"), F.col("stability"))
    return metrics.union(stable)


@query()
def regression_task(spark, d):
    rows = _task(spark, d)
    feats = L.auto_features(rows, ["l_suppkey", "label", "price_cv"])
    out = None
    for kind in ("regression", "linear", "ridge"):
        preds, _ = L.cross_validate(rows, ["l_suppkey"], feats, "price_cv", kind)
        part = L.metric_summary(L.fold_metrics(preds, kind)).withColumn("model", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS lowest, max(o_totalprice) AS highest,
       count(DISTINCT o_totalprice) AS kinds, true AS moved, true AS unrelated FROM orders""")
def permuted_column(spark, d):
    orders = table(spark, d, "orders")
    out = L.permuted(orders, "o_orderkey", "o_totalprice").join(
        orders.select("o_orderkey", F.col("o_totalprice").alias("was")), "o_orderkey")
    v = F.col("o_totalprice")
    return out.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(v), 2).alias("total"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.count_distinct(v).alias("kinds"), (F.avg((v != F.col("was")).cast("double")) > 0.9).alias("moved"),
        (F.abs(F.corr(v, "was")) < 0.1).alias("unrelated"))


@query()
def full_profile(spark, d):
    """The whole profile of customers with their nations, as one long table."""
    rows = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_acctbal", "c_mktsegment", "n_name", "n_regionkey")
    parts = [t.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
             for name, t in profile(rows, "full").tables(spark).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
