"""Pairwise verdicts: consensus over both orders, strengths, ratings and win rates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import quoted
from assay.session import cut_lineage

# Fixed values of the rating rules.
ELO_START, ELO_K = 1000.0, 32.0
ZERO_LOG_STRENGTH = -10.0


def swap_consensus(games: DataFrame, scope: Sequence[str] = ("dataset", "judge")) -> DataFrame:
    """Winner of each pair when both presentation orders agree, else a tie.

    ``games`` holds one verdict per ordered pair: run_a (shown first), run_b and
    winner, which names a run or is 'tie'.
    """
    lo, hi = F.least("run_a", "run_b"), F.greatest("run_a", "run_b")
    both = games.select("*", lo.alias("lo"), hi.alias("hi")).groupBy(
        *[quoted(s) for s in scope], "lo", "hi").agg(
        F.max(F.when(F.col("run_a") == F.col("lo"), F.col("winner"))).alias("first"),
        F.max(F.when(F.col("run_a") == F.col("hi"), F.col("winner"))).alias("second"))
    same = F.coalesce(F.col("first") == F.col("second"), F.lit(False))
    return both.select(
        *[quoted(s) for s in scope], F.col("lo").alias("run_a"), F.col("hi").alias("run_b"),
        same.alias("consistent"), F.when(same, F.col("first")).otherwise("tie").alias("winner"))


def win_counts(games: DataFrame) -> DataFrame:
    """(player, opponent, wins, games) for every ordered pair; a tie is half a win each."""
    def share(player: str):
        return F.when(F.col("winner") == F.col(player), 1.0).when(
            F.col("winner").isin("tie") | ~F.col("winner").isin(F.col("run_a"), F.col("run_b")),
            0.5).otherwise(0.0)
    sides = F.array(
        F.struct(F.col("run_a").alias("player"), F.col("run_b").alias("opponent"),
                 share("run_a").alias("w")),
        F.struct(F.col("run_b").alias("player"), F.col("run_a").alias("opponent"),
                 share("run_b").alias("w")))
    return games.select(F.inline(sides)).groupBy("player", "opponent").agg(
        F.sum("w").alias("wins"), F.count(F.lit(1)).alias("games"))


def win_matrix(games: DataFrame) -> DataFrame:
    """Share of games won by each player against each opponent."""
    return win_counts(games).select("player", "opponent", "wins", "games",
                                    F.try_divide("wins", "games").alias("win_rate"))


def bradley_terry(games: DataFrame, max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """Log strengths with mean 0, higher is better.

    Games are counted per pair once; each round is a join and an aggregate over
    those pairs. Strengths are written to the checkpoint folder after each round,
    so lineage stays short; only three numbers per round reach the driver.
    """
    pairs = cut_lineage(win_counts(games).filter("player <> opponent"))
    now = cut_lineage(pairs.groupBy("player").agg(F.sum("wins").alias("won"))).withColumn(
        "p", F.lit(1.0))
    for _ in range(max_iter):
        met = pairs.select("player", "opponent", "games").join(
            now.select("player", "p"), "player").join(
            now.select(F.col("player").alias("opponent"), F.col("p").alias("q")), "opponent")
        load = met.groupBy("player").agg(F.sum(F.try_divide(
            F.col("games").cast("double"), F.col("p") + F.col("q"))).alias("load"))
        raw = cut_lineage(now.join(load, "player", "left").select(
            "player", "won", F.col("p").alias("old"),
            F.coalesce(F.try_divide("won", "load"), F.col("p")).alias("raw")))
        middle, least = raw.agg(F.avg(F.log(F.when(F.col("raw") > 0, F.col("raw")))),
                                F.min("raw")).first()
        scale = math.exp(middle) if least is not None and least > 0 else 1.0
        now = raw.select("player", "won", (F.col("raw") / scale).alias("p"))
        change = raw.agg(F.max(F.abs(F.col("raw") / scale - F.col("old")))).first()[0]
        if change is None or change < tol:
            break
    logs = now.select("player", F.when(F.col("p") > 0, F.log(F.when(
        F.col("p") > 0, F.col("p")))).otherwise(ZERO_LOG_STRENGTH).alias("s"))
    centre = logs.agg(F.avg("s").alias("m"))
    # The centre is one row.
    return logs.join(F.broadcast(centre), F.lit(True)).select(
        "player", F.round(F.col("s") - F.col("m"), 4).alias("strength"))


def elo(games: DataFrame, scope: Sequence[str], order: Sequence[str], start: float = ELO_START,
        k: float = ELO_K) -> DataFrame:
    """Elo ratings per scope, games taken in ``order``.

    Ratings depend on all earlier games of their scope, so scopes run in parallel
    and each is read as a sorted stream; only its players' ratings are held.
    """
    names = list(scope)
    schema = T.StructType([games.schema[s] for s in names] + [
        T.StructField("player", games.schema["run_a"].dataType),
        T.StructField("rating", T.DoubleType()), T.StructField("games", T.LongType())])

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, table = None, {}

        def rows():
            return pd.DataFrame([(*key, p, round(r, 1), n) for p, (r, n) in table.items()],
                                columns=[*names, "player", "rating", "games"])
        for batch in batches:
            for row in batch[[*names, "run_a", "run_b", "winner"]].itertuples(
                    index=False, name=None):
                scope_key, (a, b, winner) = row[:-3], row[-3:]
                if scope_key != key:
                    if table:
                        yield rows()
                    key, table = scope_key, {}
                ra, na = table.get(a, (start, 0))
                rb, nb = table.get(b, (start, 0))
                expected = 1.0 / (1.0 + 10.0 ** ((rb - ra) / 400.0))
                got = 1.0 if winner == a else 0.0 if winner == b else 0.5
                table[a] = (ra + k * (got - expected), na + 1)
                table[b] = (rb - k * (got - expected), nb + 1)
        if table:
            yield rows()

    slim = games.select(*[quoted(c) for c in dict.fromkeys(
        [*names, *order, "run_a", "run_b", "winner"])])
    return slim.repartition(*[quoted(s) for s in names]).sortWithinPartitions(
        *[quoted(c) for c in (*names, *order)]).mapInPandas(play, schema)


def config_rankings(rankings: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean strength per configuration label; runs without a label stand for themselves."""
    labelled = rankings.join(runs.select(F.col("run_id").alias("player"), "run_label"), "player",
                             "left")
    return labelled.groupBy(F.coalesce(F.nullif("run_label", F.lit("")), F.col("player")).alias(
        "config")).agg(F.round(F.avg("strength"), 4).alias("strength"),
                       F.count(F.lit(1)).alias("runs"))
