"""Text metrics of reports and findings. Texts are always read whole, one row per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import quoted
from assay.functions.text import containment, stem
from assay.session import cut_lineage

# Fixed word lists and patterns.
ANALYSIS_WORDS = ("result", "finding", "data", "analysis", "discussion", "quality", "material",
                  "method")
REQUIRED_SECTIONS = ("executive summary", "data", "cleaning", "analysis", "cross-validation",
                     "conclusion", "recommendation")
NUMBER = r"(^|[^\p{L}\p{N}_])[0-9]+[.,]?[0-9]*($|[^\p{L}\p{N}_])"
FIGURE_PATTERNS = (r"(?i)\bFig(?:ure)?\.?\s*[0-9]+", r"(?i)\bfig[0-9]+", r"!\[.*?\]\(")
KEY_VALUE = r"(?i)(?:([a-z_][a-z0-9_]*)\s*[=:]\s*)([0-9]+[.,]?[0-9]*(?:\s*%)?)"
F_WITH_P = r"(?i)F\s*[=≈]\s*([0-9]+[.,]?[0-9]*)\s*.*?p\s*[<≤]\s*([0-9]+[.,]?[0-9]*)"
R_SQUARED = r"(?i)R[²2]\s*[=≈]\s*(-?[0-9]+[.,]?[0-9]*)"
P_EQUALS = r"(?i)p[\-\s]*(?:value)?\s*[=≈]\s*(-?[0-9]+[.,]?[0-9]*)"
SENTENCE_END = r"(?<=[.!?])\s+"
FIGURE_MENTION = r"(?i)(?:Figure|Fig\.?)\s*([0-9]+)"
PNG_NAME = r"(?i)(\w[\w\-. ]*\.png)"
IMAGE_LINK = r"!\[[^\]]*\]\(([^)]+)\)"
# Fixed limits.
MIN_PARAGRAPH = 50
CLAIM_CHARS = 600
MIN_REPORT_CHARS = 500
VALUE_TOLERANCE = 0.05
MIN_TOKEN = 4


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\r\f\x0b"))


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Longer paragraphs after the first analysis heading, headings and tables left out."""
    lines = F.split(text, "\n")
    opens = F.transform(lines, lambda s: s.startswith("## ") & F.lower(s).rlike(
        "|".join(ANALYSIS_WORDS)))
    first = F.greatest(F.coalesce(F.array_position(opens, True), F.lit(0)), F.lit(1)).cast("int")
    body = F.array_join(F.slice(lines, first, F.size(lines)), "\n")
    return F.filter(F.transform(F.split(body, separator), strip), lambda p: (
        F.length(p) > MIN_PARAGRAPH) & ~p.startswith("#") & ~p.startswith("|"))


def grounding_rate(text: Column, separator: str = "\n\n") -> Column:
    """Share of analytical paragraphs that hold a number; none without paragraphs."""
    # One walk over the paragraphs counts them and the ones with a number.
    counts = F.aggregate(
        paragraphs(text, separator), F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits")),
        lambda acc, p: F.struct((acc["n"] + 1).alias("n"), (acc["hits"] + F.when(
            p.rlike("[0-9]") & p.rlike(NUMBER), 1).otherwise(0)).alias("hits")),
        lambda acc: F.try_divide(acc["hits"].cast("double"), acc["n"]))
    return F.round(counts, 4)


def data_coverage(text: Column, names: Sequence[str]) -> Column:
    """Share of the given column names that the text contains."""
    found = [F.when(F.contains(text, F.lit(n)), 1).otherwise(0) for n in names]
    total = found[0]
    for f in found[1:]:
        total = total + f
    return F.when(F.length(text) > 0, F.round(total / F.lit(float(len(names))), 4))


def figure_reference_rate(text: Column, figures: Column) -> Column:
    """Distinct figure mentions over figures made, at most 1."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.trim(F.lower(m)))
             for p in FIGURE_PATTERNS]
    distinct = F.size(F.array_distinct(F.flatten(F.array(*found))))
    return F.round(F.try_divide(F.least(distinct, figures).cast("double"), figures), 4)


def _number(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(","), F.lit(".")), F.lit("%"), F.lit(""))


def stated_values(docs: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """(by, key, stated): every ``key = value`` in a text, which is searched once."""
    def part(group: int) -> Column:
        return F.regexp_extract("m", KEY_VALUE, group)
    return docs.select(*[quoted(b) for b in by], F.explode(F.regexp_extract_all(
        quoted(text), F.lit(KEY_VALUE), F.lit(0))).alias("m")).select(
        *[quoted(b) for b in by], F.lower(F.trim(part(1))).alias("key"),
        F.trim(_number(part(2))).try_cast("double").alias("stated")).filter("stated is not null")


def value_contradictions(docs: DataFrame, means: DataFrame, by: Sequence[str], text: str = "text",
                         keep: Sequence[str] = ()) -> DataFrame:
    """Stated values more than 5 % off the metric of that name.

    ``means`` holds (by, metric, mean). A name that is no metric falls back to the
    first metric name that contains it or is contained in it. ``keep`` names further
    columns of ``docs`` to return. Names are looked up once each: the values themselves
    meet only the table of the names found.
    """
    keys = [quoted(b) for b in by]
    named = cut_lineage(means.select(*keys, F.lower("metric").alias("metric"), "mean"))
    stated = stated_values(docs, [*by, *keep], text)
    names = named.select(*keys, "metric").distinct()
    asked = cut_lineage(stated.select(*keys, "key").distinct())
    open_ = asked.join(named.select(*keys, F.col("metric").alias("key")), [*by, "key"], "left_anti")
    near = containment(open_, names, by, "key", "metric").select(*keys, "key", "metric").unionByName(
        containment(names, open_, by, "metric", "key").select(*keys, "key", "metric"))
    best = near.groupBy(*keys, "key").agg(F.min("metric").alias("metric"))
    loose = best.join(named, [*by, "metric"]).select(*keys, "key", "mean")
    known = cut_lineage(asked.join(named.withColumnRenamed("metric", "key"), [*by, "key"]).select(
        *keys, "key", "mean").union(loose))
    gap = F.abs(F.try_divide(F.col("stated") - F.col("mean"), F.col("mean")))
    return stated.join(known, [*by, "key"]).select(
        *keys, "key", *[quoted(c) for c in keep], "stated", "mean").filter(F.col("mean") != 0).filter(
        gap > VALUE_TOLERANCE)


def repeated_claims(docs: DataFrame, disproved: DataFrame, by: Sequence[str], text: str = "text"
                    ) -> DataFrame:
    """Disproved claim values (by, metric, claimed text) that a document still contains."""
    return containment(disproved, docs, by, "claimed", text, keep_text=False)


def implausible_statistics(docs: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Statistics in texts that cannot be: F near 1 with tiny p, R squared or p out of range."""
    t = quoted(text)

    def all_of(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(t, F.lit(pattern), F.lit(group))

    def as_number(c: Column) -> Column:
        return _number(c).cast("double")
    f = F.transform(F.arrays_zip(all_of(F_WITH_P, 1).alias("a"), all_of(F_WITH_P, 2).alias("b")),
                    lambda z: F.struct(F.lit("f_test").alias("kind"), as_number(z["a"]).alias("value"),
                                       as_number(z["b"]).alias("p")))
    none = F.lit(None).cast("double")
    r2 = F.transform(all_of(R_SQUARED, 1), lambda v: F.struct(
        F.lit("r_squared").alias("kind"), as_number(v).alias("value"), none.alias("p")))
    p = F.transform(all_of(P_EQUALS, 1), lambda v: F.struct(
        F.lit("p_value").alias("kind"), as_number(v).alias("value"), none.alias("p")))
    out = docs.select(*[quoted(b) for b in by], F.inline(F.concat(f, r2, p)))
    v = F.col("value")
    return out.filter(
        ((F.col("kind") == "f_test") & v.between(0.5, 1.5) & (F.col("p") < 0.01))
        | ((F.col("kind") == "r_squared") & ((v > 1.0) | (v < -0.5)))
        | ((F.col("kind") == "p_value") & ((v < 0) | (v > 1))))


def figure_claims(docs: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """First mention of each figure with one sentence on either side."""
    s = F.split(quoted(text), SENTENCE_END)
    rows = docs.select(*[quoted(b) for b in by], s.alias("__s"))

    def at(i: Column) -> Column:
        return F.coalesce(F.try_element_at("__s", i.cast("int")), F.lit(None))

    def claim(sentence: Column, i: Column) -> Column:
        near = F.concat_ws(" ", F.when(i > 0, at(i)), sentence, at(i + 2))
        return F.struct(
            F.concat(F.lit("Figure "), F.regexp_extract(sentence, FIGURE_MENTION, 1)).alias("figure_ref"),
            F.substring(near, 1, CLAIM_CHARS).alias("claim_text"),
            F.regexp_extract(sentence, PNG_NAME, 1).alias("figure_file"))
    told = F.filter(F.transform("__s", lambda x, i: F.when(x.rlike(FIGURE_MENTION), claim(x, i))),
                    lambda c: c.isNotNull())
    rows = rows.select(*[quoted(b) for b in by], told.alias("__c"))
    rows = rows.withColumn("__refs", F.transform("__c", lambda c: c["figure_ref"]))
    return rows.select(*[quoted(b) for b in by], F.inline(F.filter(
        "__c", lambda c, i: F.array_position("__refs", c["figure_ref"]) == i + 1)))


def report_sections(docs: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """Missing required sections and whether the report is long enough."""
    heads = F.transform(F.regexp_extract_all(quoted(text), F.lit(r"(?m)^##\s+[0-9]*\.?\s*(.*)"), F.lit(1)),
                        lambda h: F.lower(h))
    lost = F.filter(F.array(*[F.lit(s) for s in REQUIRED_SECTIONS]),
                    lambda r: ~F.exists(heads, lambda h: F.contains(h, r)))
    return docs.select(*[quoted(b) for b in by], lost.alias("missing_sections"),
                       (F.length(strip(quoted(text))) >= MIN_REPORT_CHARS).alias("long_enough"))


def broken_references(docs: DataFrame, files: DataFrame, by: Sequence[str], text: str = "text"
                      ) -> DataFrame:
    """Local image links of a text without a file of that path."""
    links = docs.select(*[quoted(b) for b in by], F.explode(F.regexp_extract_all(
        quoted(text), F.lit(IMAGE_LINK), F.lit(1))).alias("path")).filter(
        ~F.col("path").rlike("^(https?://|data:)"))
    return links.withColumn("path", F.url_decode("path")).join(
        files.select(*[quoted(b) for b in by], "path").distinct(), [*by, "path"], "left_anti")


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"),
                                     lambda t: F.length(t) >= MIN_TOKEN))


def match_files(findings: DataFrame, files: DataFrame, by: Sequence[str]) -> DataFrame:
    """File of each finding without a reference: most shared words first, then pairing by length.

    Files left over go to the longest findings left over, one each, in order.
    """
    keys = [quoted(b) for b in by]
    open_ = findings.filter(F.coalesce("figure_ref", F.lit("")) == "")
    names = files.select(*keys, "path", stem(F.col("path")).alias("stem")).distinct()
    f = open_.select(*keys, "idx", F.explode(_tokens(F.col("text"))).alias("token"))
    p = names.select(*keys, "path", F.explode(_tokens(F.col("stem"))).alias("token"))
    shared = f.join(p, [*by, "token"]).groupBy(*keys, "idx", "path").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy(*keys, "idx").agg(F.max_by("path", F.struct("n", "path")).alias("path"))
    free = names.join(best, [*by, "path"], "left_anti").withColumn(
        "__i", F.row_number().over(Window.partitionBy(*keys).orderBy("path")))
    rest = open_.join(best, [*by, "idx"], "left_anti").withColumn("__i", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.length("text").desc(), "idx")))
    pairs = rest.join(free.select(*keys, "__i", "path"), [*by, "__i"]).select(*keys, "idx", "path")
    return best.withColumn("how", F.lit("words")).unionByName(pairs.withColumn("how", F.lit("length")))


def ranked_figures(files: DataFrame, findings: DataFrame, by: Sequence[str], top: int = 10,
                   min_bytes: int = 5000) -> DataFrame:
    """Figures by citations, then size; one per stem, the first ``top`` of each run."""
    keys = [quoted(b) for b in by]
    cited = findings.filter(F.coalesce("figure_ref", F.lit("")) != "").groupBy(
        *keys, stem(F.col("figure_ref")).alias("stem")).agg(F.count(F.lit(1)).alias("citations"))
    big = files.filter(F.col("size") >= min_bytes).select(
        *keys, "path", "size", stem(F.col("path")).alias("stem"))
    one = big.groupBy(*keys, "stem").agg(F.max(F.struct("size", "path")).alias("f"))
    out = one.join(cited, [*by, "stem"], "left").select(
        *keys, "stem", "f.size", "f.path", F.coalesce("citations", F.lit(0)).alias("citations"))
    w = Window.partitionBy(*keys).orderBy(F.col("citations").desc(), F.col("size").desc(), "path")
    return out.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= top)


def distinct_findings(findings: DataFrame, by: Sequence[str], chars: int | None = None) -> DataFrame:
    """First finding of each text, blanks dropped.

    With ``chars`` texts count as equal when their lower-cased beginnings are equal;
    that comparison rule is part of the operator, the texts themselves stay whole.
    """
    key = strip(F.col("text"))
    if chars is not None:
        key = F.substring(F.lower(key), 1, chars)
    rest = [c for c in findings.columns if c not in by]
    # The least index per text is an aggregate: copies fold before the shuffle.
    first = findings.withColumn("__k", key)
    if chars is None:
        first = first.filter(F.length("__k") > 0)
    return first.groupBy(*[quoted(b) for b in by], F.xxhash64("__k").alias("__h"), "__k").agg(
        F.min_by(F.struct(*[quoted(c) for c in rest]), "idx").alias("r")).select(
        *[quoted(b) for b in by], "r.*")


def model_json(text: Column) -> Column:
    """JSON text of a raw model reply: thinking removed, fenced block or outer braces taken."""
    plain = strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    plain = F.when(F.length(plain) > 0, plain).otherwise(text)
    fenced = F.regexp_extract(plain, r"(?s)```(?:json)?\s*([\[{].*?[\]}])\s*```", 1)
    braces = F.regexp_extract(plain, r"(?s)([\[{].*[\]}])", 1)
    return F.when(plain.rlike(r"(?s)^[\[{].*[\]}]$"), plain).when(F.length(fenced) > 0, fenced).when(
        F.length(braces) > 0, braces).otherwise(plain)


def parse_model_text(docs: DataFrame, text: str, schema: str) -> DataFrame:
    """Add ``parsed``: the reply's JSON under the schema, NULL fields where it does not fit."""
    return docs.withColumn("parsed", F.from_json(model_json(quoted(text)), schema))
