"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.llm import (
    best_position, exact_dedup, html_text, ordinal_quality, packing, pii_spans, quality_rules, segment_bounds,
    sentencepiece_scan, simhash, suffix_dedup, toxicity, warc)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256({LOWER}) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY {LOWER})
""")
def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.groups(table(spark, folder, "documents"))


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the folder is set by the installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d
    FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM q
""")
def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.round_trip(table(spark, folder, "pages")).filter("error IS NULL")
    return records.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), "declared_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "declared_digest").alias("payload_digest"), "record_type", "refers_to")


@query()
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), with_ids=False)


@query(r"""
WITH w AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
    FROM documents),
tri AS (
    SELECT doc_id, i, struct_pack(a := ws[i], b := ws[i + 1], c := ws[i + 2]) AS t
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM tri) WHERE n > 1),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
base AS (
    SELECT doc_id, source, text, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
           (strlen(text) - strlen(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN covered USING (doc_id)),
lines AS (
    SELECT source, text, trim(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
           len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT source, text, unnest(ls) AS l FROM w)),
hosts AS (SELECT source, count(DISTINCT text) AS d FROM lines GROUP BY source),
frequent AS (
    SELECT source, line FROM lines JOIN hosts USING (source) GROUP BY source, line, d
    HAVING count(DISTINCT text) >= 20 AND count(DISTINCT text) > 0.05 * d),
left_over AS (
    SELECT source, text, 1 - sum(CASE WHEN f.line IS NOT NULL THEN n ELSE 0 END) / sum(n) AS share
    FROM lines LEFT JOIN frequent f USING (source, line) GROUP BY source, text)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(share, 1) >= 0.5 AS kept
FROM base LEFT JOIN left_over USING (source, text)
""")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).drop("left")


@query()
def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups(table(spark, folder, "documents"))


@query("""
WITH t AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS i FROM t)),
d AS (SELECT doc_id, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
e AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM d),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM e),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, run),
k AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
r AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
             string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN r USING (doc_id)
""")
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, folder, "documents"))


@query()
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, folder, "labels"))).drop("spans")


def grades() -> Column:
    """Ratings from the labels: 0 low quality, 1 good but toxic, 2 good."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


@query()
def op9_ordinal_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = ordinal_quality.fit(docs, table(spark, folder, "labels"), grades(), 3)
    return ordinal_quality.score(docs, model)


@query()
def op10_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_scan.encode(
        table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"), digests=True)


def _decoded(expression: str) -> str:
    """SQL that decodes the references that occur in the given pages."""
    for pattern, mark in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#x27;|&#39;", "''"), ("&amp;?", "&")):
        expression = f"regexp_replace({expression}, '{pattern}', '{mark}', 'g')"
    return expression


@query(rf"""
WITH a AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
blocks AS (
    SELECT page_id, url, list_transform(
        regexp_split_to_array(x, '</?(h1|p)>'),
        lambda b: trim(regexp_replace({_decoded("regexp_replace(b, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g'))) AS b
    FROM a)
SELECT page_id, url, array_to_string(list_filter(b, lambda t: t <> ''), chr(10)) AS text,
       length(array_to_string(list_filter(b, lambda t: t <> ''), chr(10)))::BIGINT AS n_chars
FROM blocks
""")
def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query(rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
d AS (SELECT *, row_number() OVER () AS row FROM t WHERE len(ts) > 0),
corpus AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d),
tf AS (SELECT row, doc_id, n, term, count(*) AS tf
       FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY row, doc_id, n, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
      FROM tf, corpus GROUP BY term),
q AS (SELECT item, item_id, unnest(list_distinct(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
      FROM (SELECT *, row_number() OVER () AS item FROM benchmark)),
s AS (SELECT item, item_id, row, doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM q JOIN tf USING (term) JOIN w USING (term), corpus GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
""")
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return best_position.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("""
WITH e AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM s WHERE same),
n AS (
    SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
    FROM p JOIN s ON p.place <= 5 AND s.anchor_id = p.anchor_id AND NOT s.same
     AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return segment_bounds.mine(table(spark, folder, "embeddings"), moved, F.col("vec_id") % 50 == 0)


@query()
def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii_spans.detect(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}")
              for k, name in enumerate(pii_spans.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii_spans.as_text(F.col("base")), 256).alias("base_sha256"),
                        pii_spans.as_text(F.col("spans")).alias("spans"))
