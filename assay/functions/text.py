"""Text helpers: keyword conditions and exact containment of terms in texts.

Containment is a search for many patterns at once: the terms become an Aho-Corasick automaton,
which walks each text one time whatever their number. An automaton holds at most ``SHARD_CHARS``
characters of terms, dealt by the hash of the whole term, so a prefix that many terms share fills
no shard more than others. Up to ``MAX_PASSES`` shards, each shard is one Arrow pass over the
texts where they lie: the driver holds the terms of one shard, texts are not shuffled, and what
leaves a task are the hashes of the term and the columns of the text's row for each match. Beyond
that, a group with few terms is joined with its texts, one row each, and the terms and texts of
other groups meet in a grid of cells, each with one shard and one slice of the group's texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import quoted
from assay.session import cut_lineage

SHARD_CHARS = 1 << 20
MAX_PASSES = 32
SLICE_CHARS = 1 << 26
#: A group with at most this many terms is joined with its texts directly when there are many shards.
DIRECT_TERMS = 16
_FLUSH = 1 << 16


def mentions(text: Column, words: Sequence[str]) -> Column:
    """Whether lower-cased text contains any of the words."""
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def stem(path: Column) -> Column:
    """Lower-case file name without folder and last extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def _hashes(columns: Sequence[Column], names: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of a row that tell NULL from absent values."""
    parts = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(i), *parts).alias(n) for i, n in enumerate(names)]


def _automaton(terms: Sequence[str]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(term, i)
    found.make_automaton()
    return found


class _Pairs:
    """Matches of one batch of texts, as Arrow batches of bounded size."""

    def __init__(self, rows: pa.Array):
        self.rows, self.found = rows, []

    def add(self, automaton, terms: Sequence[tuple[int, int]], text: str, at: int) -> None:
        self.found += [(*terms[i], at) for i in {i for _, i in automaton.iter(text)}]

    def full(self, least: int = _FLUSH):
        if len(self.found) >= least:
            t1, t2, at = zip(*self.found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(t1, pa.int64()), pa.array(t2, pa.int64()), self.rows.take(pa.array(at, pa.int64()))],
                ["t1", "t2", "row"])
            self.found = []


def _one_pass(terms: Sequence[tuple[str, int, int]]) -> Callable:
    """Search the automaton of one shard in the texts that a task reads."""
    def run(batches):
        automaton, keys = _automaton([t for t, _, _ in terms]), [(a, b) for _, a, b in terms]
        for batch in batches:
            out = _Pairs(batch.column("row"))
            for at, text in enumerate(batch.column("body").to_pylist()):
                out.add(automaton, keys, text, at)
                yield from out.full()
            yield from out.full(1)
    return run


def _cells(batches):
    """Rows come sorted by cell, the terms of a cell before its texts."""
    cell, terms, keys, automaton = None, [], [], None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("g1", "g2", "shard", "slice", "is_text", "h1", "h2", "body")]
        out = _Pairs(batch.column("row"))
        for at, (g1, g2, shard, part, is_text, h1, h2, body) in enumerate(zip(*cols)):
            if (g1, g2, shard, part) != cell:
                cell, terms, keys, automaton = (g1, g2, shard, part), [], [], None
            if not is_text:
                terms.append(body)
                keys.append((h1, h2))
            elif terms:
                automaton = automaton or _automaton(terms)
                out.add(automaton, keys, body, at)
                yield from out.full()
        yield from out.full(1)


def _pair_type(texts: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()),
                         T.StructField("row", texts.schema["row"].dataType)])


def _grid_pairs(terms: DataFrame, texts: DataFrame, by: Sequence[Column], shard_chars: int, slice_chars: int) -> DataFrame:
    """Pairs from a grid of (group, shard of its terms, slice of its texts)."""
    own = _hashes(by, ["g1", "g2"])
    t = terms.select(*own, "h1", "h2", "body").distinct().withColumn("row", F.lit(None).cast(texts.schema["row"].dataType))
    d = texts.select(*own, F.col("d1").alias("h1"), F.col("d2").alias("h2"), "body", "row")

    def parts(df: DataFrame, name: str, most: int) -> DataFrame:
        n = F.ceil(F.sum(F.length("body")) / most).cast("int").alias(name)
        return df.groupBy("g1", "g2").agg(n).filter(F.col(name) > 1)  # at most total / most groups
    many = parts(t, "shards", shard_chars).join(parts(d, "slices", slice_chars), ["g1", "g2"], "full")

    def dealt(df: DataFrame, is_text: bool) -> DataFrame:
        own, other = ("slice", "shard") if is_text else ("shard", "slice")
        df = df.join(many, ["g1", "g2"], "left").withColumn(own, F.pmod(
            F.xxhash64("h1", "h2"), F.coalesce(f"{own}s", F.lit(1))).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(f"{other}s", F.lit(1)) - 1))).select(
            "g1", "g2", "shard", "slice", F.lit(is_text).alias("is_text"), "h1", "h2", "body", "row")
    cell = ["g1", "g2", "shard", "slice"]
    return dealt(t, False).union(dealt(d, True)).repartition(*cell).sortWithinPartitions(*cell, "is_text").mapInArrow(
        _cells, _pair_type(texts))


def containment(terms: DataFrame, texts: DataFrame, by: Sequence[str], term: str, text: str,
                shard_chars: int = SHARD_CHARS, max_passes: int = MAX_PASSES, slice_chars: int = SLICE_CHARS,
                direct_terms: int = DIRECT_TERMS, keep_text: bool = True) -> DataFrame:
    """All (term row, text row) pairs of one ``by`` group where the text contains the term.

    Columns are ``by``, the other columns of ``terms``, then those of ``texts``. Empty and NULL
    terms, NULL texts and NULL keys are in no pair; rows that repeat give a pair each. Without
    ``keep_text`` the searched text is left out: a match then carries the other columns of its row,
    and nothing is shuffled for it. With it, pairs are found as hashes of the two rows, so that the
    text is joined only if it is selected.
    """
    keys = [quoted(b) for b in by]
    known = F.lit(True)
    for k in keys:
        known &= k.isNotNull()
    shown = [c for c in texts.columns if keep_text or c != text]
    given = texts.filter(known & quoted(text).isNotNull())
    given = given.select("*", *_hashes([quoted(c) for c in texts.columns], ["__d1", "__d2"]))
    row = [F.col("__d1").alias("d1"), F.col("__d2").alias("d2")] if keep_text else [
        F.lit(0).alias("none"), *[quoted(c).alias(f"c{i}") for i, c in enumerate(shown)]]
    bodies = given.select(*keys, F.col("__d1").alias("d1"), F.col("__d2").alias("d2"), quoted(text).alias("body"),
                          F.struct(*row).alias("row"))
    asked = terms.filter(known & (F.length(quoted(term)) > 0))
    asked = asked.select("*", *_hashes([quoted(term)], ["__t1", "__t2"]))

    def named(side: str, columns: Sequence[str]) -> list[Column]:
        return [F.col(f"{side}.`" + c.replace("`", "``") + "`") for c in columns if c not in by]

    def result(joined: DataFrame) -> DataFrame:
        return joined.select(*keys, *named("t", terms.columns), *named("d", shown))

    def with_rows(pairs: DataFrame) -> DataFrame:
        t = [F.col("t1").alias("__t1"), F.col("t2").alias("__t2")]
        if keep_text:
            pairs = pairs.select(*t, F.col("row.d1").alias("__d1"), F.col("row.d2").alias("__d2")).distinct()
            found = pairs.join(given.alias("d"), ["__d1", "__d2"])
        else:
            found = pairs.select(*t, *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(shown)]).alias("d")
        return result(found.join(asked.alias("t"), ["__t1", "__t2", *by]))

    size = F.length(quoted(term)).alias("__size")
    n_chars = asked.agg(F.sum(size)).first()[0] or 0
    if n_chars > shard_chars:  # equal terms are searched once
        n_chars = asked.select("__t1", "__t2", size).distinct().agg(F.sum("__size")).first()[0]
    n_shards = max(1, -(-n_chars // shard_chars))
    if n_shards > max_passes:
        out = []
        crowded = cut_lineage(asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(
            F.col("__n") > (direct_terms if by else 0)).drop("__n"))
        if by:  # a few terms of a group meet its texts in a plain join, of which Spark can split a hot key
            alone = crowded.isEmpty()
            few = asked if alone else asked.join(crowded, list(by), "left_anti")
            out.append(result(few.alias("t").join(given.alias("d"), list(by)).filter(
                F.contains(named("d", [text])[0], named("t", [term])[0]))))
            if alone:
                return out[0]
            asked, bodies = asked.join(crowded, list(by), "left_semi"), bodies.join(crowded, list(by), "left_semi")
        out.insert(0, with_rows(_grid_pairs(
            asked.select(*keys, F.col("__t1").alias("h1"), F.col("__t2").alias("h2"), quoted(term).alias("body")),
            bodies, keys, shard_chars, slice_chars)))
        return out[0] if len(out) == 1 else out[0].union(out[1])
    if not n_chars:
        return with_rows(terms.sparkSession.createDataFrame([], _pair_type(bodies)))
    asked = cut_lineage(asked)
    patterns = asked.select(F.col("__t1").alias("h1"), F.col("__t2").alias("h2"), quoted(term).alias("body"))
    pairs = None
    for shard in range(n_shards):
        dealt = patterns.filter(F.pmod("h1", F.lit(n_shards)) == shard).distinct()
        some = bodies.select("row", "body").mapInArrow(
            _one_pass([(r["body"], r["h1"], r["h2"]) for r in dealt.collect()]), _pair_type(bodies))
        if n_shards > 1:
            some = cut_lineage(some)  # the driver keeps the terms of one shard
        pairs = some if pairs is None else pairs.union(some)
    return with_rows(pairs)
