"""Quality rules with cross-document line frequency, in DataFrame functions alone.

Base rules look at one text: number of words, and words inside three-word windows that the
text repeats. The line rule looks across documents: lines are normalised (lower case, runs of
white space as one space, trimmed) and hashed; for each host and hash the distinct documents
are counted, where equal texts are one document, so that a copied page does not make its own
lines look like boilerplate. A line is above the limit if at least ``MIN_DOCUMENTS`` documents
of the host have it and they are more than ``MAX_SHARE`` of the host's documents. Such lines
are removed, and a document that keeps less than ``MIN_LEFT`` of its words is rejected.

Rows for lines carry hashes and counts only, summed on the map side first, and are spread by
(host, text, line), so neither a host with a third of all rows nor a line that all documents
share meets in one task.

Results for unusual input: a null text has no words and fails the base rule; a null host is a
host of its own; rows that repeat each get the same verdict; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from assay.llm.common import free_name

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
MIN_DOCUMENTS = 20
MAX_SHARE = 0.05
MIN_LEFT = 0.5
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first included.

    Windows are compared by a 64-bit hash of their words, within one text.
    """
    windows = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(
        w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda e, k: (
            (k > 0) & (F.get(s, k - 1)["h"] == e["h"])) | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False))))
        return F.size(F.array_distinct(F.flatten(F.transform(
            twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def base_columns(text: Column) -> Column:
    """The counts of one text as a struct."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    return let(counts, lambda c: F.struct(
        c["n_words"].alias("n_words"), c["word_chars"].alias("word_chars"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        c["n_repeat_words"].alias("n_repeat_words"),
        ((c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"]))
        .alias("base_failed")))


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")))


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    """host, text_hash and text alone, so that no other column can clash."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")).alias("host"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """host, text_hash, line, words: once for each distinct text and line of a host."""
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(
        line_hash(x).alias("line"), F.size(words_of(x)).alias("words")))
    rows = keyed.select("host", "text_hash", F.explode(each).alias("e")).select("host", "text_hash", "e.*")
    return rows.filter("words > 0").groupBy("host", "text_hash", "line").agg(F.sum("words").alias("words"))


def frequent_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS, max_share: float = MAX_SHARE) -> DataFrame:
    """host, line, n_documents of the lines above the limits."""
    hosts = (lines.select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("documents")))
    counts = (lines.groupBy("host", "line").agg(F.count("*").alias("n_documents"))
              .filter(F.col("n_documents") >= min_documents))
    return (counts.join(hosts, "host").filter(F.col("n_documents") > max_share * F.col("documents"))
            .drop("documents"))


def line_verdicts(docs: DataFrame, host: str = "source", min_documents: int = MIN_DOCUMENTS,
                  max_share: float = MAX_SHARE) -> DataFrame:
    """host, text_hash, left (share of words outside frequent lines) and removed (their hashes).

    Texts without a frequent line are absent.
    """
    lines = _lines(_keyed(docs, host))
    frequent = frequent_lines(lines, min_documents, max_share).withColumn("hit", F.lit(1))
    marked = lines.join(frequent, ["host", "line"], "left")
    return (marked.groupBy("host", "text_hash").agg(
        (1 - F.sum(F.when(F.col("hit") == 1, F.col("words")).otherwise(0)) / F.sum("words")).alias("left"),
        F.collect_list(F.when(F.col("hit") == 1, F.col("line"))).alias("removed")).filter(F.size("removed") > 0))


def judge(docs: DataFrame, host: str = "source", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """One row per input row: doc_id, the base counts, base_failed, left and kept."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        *[F.col(c) for c in ("text",)], F.col(host).alias("host_"))
    base = keyed.select(
        "doc_id", F.coalesce(F.concat(F.lit("h"), F.col("host_").cast("string")), F.lit("")).alias("host"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), base_columns(F.col("text")).alias("b"))
    verdicts = line_verdicts(docs, host, **limits).drop("removed")
    left = F.coalesce("left", F.lit(1.0))
    return base.join(verdicts, ["host", "text_hash"], "left").select(
        "doc_id", "b.*", left.alias("left"), (~F.col("b.base_failed") & (left >= min_left)).alias("kept"))


def clean(docs: DataFrame, host: str = "source", min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """The documents that stay, without their frequent lines; all columns as they are.

    ``n_chars``, if there, follows the new text.
    """
    new = {n: free_name(f"__{n}", docs) for n in ("host", "text_hash", "left", "removed")}
    verdicts = line_verdicts(docs, host, **limits).select(*[F.col(a).alias(b) for a, b in new.items()])
    keyed = docs.withColumns({
        new["host"]: F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")),
        new["text_hash"]: F.xxhash64(F.coalesce("text", F.lit("")))})
    good = keyed.filter(~base_columns(F.col("text"))["base_failed"])
    found = (good.join(verdicts, [new["host"], new["text_hash"]], "left")
             .filter(F.coalesce(F.col(new["left"]), F.lit(1.0)) >= min_left))
    gone = F.col(new["removed"])
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.filter(
        F.split("text", "\n"), lambda x: ~F.array_contains(gone, line_hash(x))), "\n"))
    out = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
