"""Connected components of a table of links, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assay.llm.common import Scratch


def components(links: DataFrame) -> DataFrame:
    """node, root (smallest node reachable) for every node of ``links(a, b)``.

    Large-star and small-star steps in turn: each joins every node to the smallest one it
    knows, until all links point at a root. Each step is an aggregate with map-side minima and
    a join; the links are written to shared files between rounds, so nothing is recomputed
    when an executor is lost, and no node's neighbours are gathered in one place; the files of a
    round go when the next one is written.

    A link of a node with itself or with NULL is none; links that repeat count once; no links give
    no rows; other columns are not read.
    """
    scratch = Scratch(links.sparkSession)
    edges = scratch.cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .filter("a != b").distinct())
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a != b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        old, edges = edges, scratch.cut(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                            .union(low.select("a", F.col("m").alias("b"))).filter("a != b").distinct())
        scratch.free(old)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"),
                        F.sum(F.xxhash64("a", "b") % 1000003).alias("s")).first()
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
