"""Row texts, vectors, exact nearest rows and document chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from assay.functions.columns import clean, quoted

# Fixed sizes.
CHUNK, OVERLAP = 600, 80
TEXT_CHARS, CONTEXT_CHARS, TRIM_TAIL = 500, 4000, 50
TRUNCATED = "\n...[truncated]"
#: Queries that are sent to all tasks; queries and rows of a cell of the grid; rows scored at once.
QUERIES_PER_PASS, QUERY_BLOCK, ROW_BLOCK, ROWS_AT_ONCE = 4096, 1024, 32768, 4096


def row_text(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """``column: value`` for each present, non-empty value, joined by bars."""
    parts = []
    for c in columns or df.columns:
        v = F.btrim(clean(df, c).cast("string"), F.lit(" \t\n\r\f\x0b"))
        parts.append(F.when(F.length(v) > 0, F.concat(F.lit(f"{c}: "), v)))
    return F.concat_ws(" | ", *parts)


def l2_normalise(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(norm > 0, x / norm).otherwise(x.cast("double")))


def _best_of_batch(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows, equal scores by id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _cell_best(k: int, arrow: pa.Schema):
    """The best k rows of a block for each query of a block."""
    def scored(queries: pa.Table, rows: pa.Table) -> pa.Table:
        parts = []
        if queries.num_rows and rows.num_rows:
            asked = _matrix(queries)
            for at in range(0, rows.num_rows, ROWS_AT_ONCE):
                some = rows.slice(at, ROWS_AT_ONCE)
                parts.append(_best(queries.column("query_id"), asked, some.column("id"), _matrix(some), k, arrow))
        return pa.concat_tables(parts) if parts else arrow.empty_table()
    return scored


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(table.num_rows, -1)


def _best(query_ids, asked: np.ndarray, row_ids, rows: np.ndarray, k: int, arrow: pa.Schema) -> pa.Table:
    ids, dots = row_ids.to_numpy(zero_copy_only=False) if isinstance(row_ids, pa.Array) else row_ids.to_numpy(), asked @ rows.T
    best = [_best_of_batch(ids, d, k) for d in dots]
    which = np.repeat(np.arange(len(best)), [len(b) for b in best])
    at = np.concatenate(best)
    columns = [query_ids.take(pa.array(which)), row_ids.take(pa.array(at)), pa.array(dots[which, at])]
    return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.chunked_array([c]) for c in columns], schema=arrow)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, *, row_id: str = "id", vector: str = "embedding",
          query_id: str = "query_id", queries_per_pass: int = QUERIES_PER_PASS, block: tuple[int, int] = (QUERY_BLOCK, ROW_BLOCK)
          ) -> DataFrame:
    """Exact top ``k`` rows by dot product for every query.

    Up to ``queries_per_pass`` queries go out to the rows where they lie, and each task keeps its own
    k best of every batch. More queries never reach the driver: both sides are dealt to blocks by
    hash and meet in a grid, each cell keeping k rows for a query. A window merges the cells.
    Vectors that are NULL, empty or hold a NULL match nothing, and vectors match only those of
    their own length.
    """
    whole = lambda c: F.coalesce((F.size(c) > 0) & F.forall(c, lambda x: x.isNotNull()), F.lit(False))
    rows, asked = (df.select(quoted(i).alias(name), quoted(vector).cast("array<double>").alias("v")).filter(whole(F.col("v")))
                   for df, i, name in ((vectors, row_id, "id"), (queries, query_id, "query_id")))
    out_type = T.StructType([T.StructField("query_id", queries.schema[query_id].dataType),
                             T.StructField("id", vectors.schema[row_id].dataType), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(out_type)
    n_queries = asked.count()
    if n_queries <= queries_per_pass:
        passes: dict[int, list] = {}
        for q in asked.collect():  # a counted, bounded number
            passes.setdefault(len(q["v"]), []).append((q["query_id"], q["v"]))
        out = vectors.sparkSession.createDataFrame([], out_type)
        kind = arrow.field("query_id").type
        for length, own in passes.items():
            out = out.union(rows.filter(F.size("v") == length).mapInArrow(_pass(own, kind, k, arrow), out_type))
    else:
        n_rows = rows.count()
        shape = -(-n_queries // block[0]), max(-(-n_rows // block[1]), int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def dealt(df, own, n_own, other, n_other):
            return df.withColumn("length", F.size("v")).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.lit(n_own))).withColumn(
                other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_other - 1).cast("bigint"))))
        cell = ["length", "i", "j"]
        left = dealt(asked.select(F.col("query_id").alias("query_id"), F.col("v").alias("v")), "i", shape[0], "j", shape[1])
        right = dealt(rows.select(F.col("id").alias("id"), F.col("v").alias("v")), "j", shape[1], "i", shape[0])
        out = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell_best(k, arrow), out_type)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= k)


def _pass(own: list[tuple], kind: pa.DataType, k: int, arrow: pa.Schema):
    """Search the queries in the rows that a task reads."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = pa.array([q for q, _ in own], kind), np.array([v for _, v in own], np.float64)
        for b in batches:
            if b.num_rows:
                rows = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield from _best(names, asked, b.column("id"), rows, k, arrow).to_batches()
    return run


def chunks(docs: DataFrame, doc_id: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Sliding chunks of the whole text with ids ``doc__j``."""
    body = F.btrim(quoted(text), F.lit(" \t\n\r\f\x0b"))
    starts = F.when(F.length("__t") > 0, F.sequence(
        F.lit(0), F.length("__t") - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return docs.select(quoted(doc_id).alias("source"), body.alias("__t")).select(
        "source", "__t", F.posexplode(starts).alias("j", "start")).select(
        F.concat_ws("__", F.col("source").cast("string"), F.col("j").cast("string")).alias("chunk_id"),
        "source", F.substring("__t", F.col("start") + 1, F.lit(size)).alias("text"))


def trim_text(text: Column, limit: int) -> Column:
    """Text within the limit, else its beginning with a mark."""
    head = F.regexp_replace(F.substring(text, 1, limit - TRIM_TAIL), r"\s+$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(head, F.lit(TRUNCATED)))


def matched_context(matches: DataFrame, texts: DataFrame, row_id: str, text: str) -> DataFrame:
    """Context of each query: its matched rows' texts in rank order, trimmed singly and in all."""
    joined = matches.join(texts.select(quoted(row_id).alias("id"), quoted(text).alias("__t")), "id")
    # No more than k rows per query reach this list.
    lists = joined.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", trim_text(F.col("__t"), TEXT_CHARS).alias("t")))).alias("m"))
    whole = F.array_join(F.transform("m", lambda x: x["t"]), "\n")
    return lists.select("query_id", trim_text(whole, CONTEXT_CHARS).alias("context"))
