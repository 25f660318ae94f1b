"""Bootstrap intervals and permutation tests by splitting counts over the value axis.

A replicate is a number of draws for every position of a group's sorted values. The axis is cut
into leaves of ``LEAF`` positions. How many draws of a replicate fall into a leaf comes from
splitting its draws from the whole axis down to the leaf, half by half: binomial counts with
replacement (bootstrap), hypergeometric counts without (permutation). Every task derives the
counts on the way to its own leaves from the numbers of the nodes, so no task tells another
anything; inside a leaf, positions are drawn and their values summed for all replicates at once.
What leaves a task is an array of sums, one for each replicate, for ``BUNDLE`` leaves; neither
rows x replicates nor positions are ever shuffled or joined.

Draws inside a leaf come from integer arithmetic on (replicate, position), so every engine and
every recomputed task makes the same ones; counts of the splits come from a counter-based
generator keyed by seed and node. Above 10^9 positions a hypergeometric split is rounded from a
normal variate, which is off by less than a thousandth of its own deviation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import value_positions

MODULUS = 2147483647
LEAF = 1 << 16
BUNDLE = 16
#: Draws that are in memory at once.
AT_ONCE = 1 << 20
_SIDE_SHIFT = 7_000_003


def draws(replicate: np.ndarray, position: np.ndarray, seed: int = 42) -> np.ndarray:
    """Pseudo-random integers below 2^31 - 1; every product stays below 2^63."""
    a = (replicate * 48271 + position * 69621 + seed) % MODULUS
    b = (a * a + position + 1) % MODULUS
    return (b * b + replicate + 1) % MODULUS


def wide_draws(replicate: np.ndarray, position: np.ndarray, seed: int = 42) -> np.ndarray:
    """Pseudo-random integers below 2^62, so that a leaf's positions are equally likely."""
    return draws(replicate, position, seed) * MODULUS + draws(replicate, position, seed + 1)


def hypergeometric(rng: np.random.Generator, left: int, right: int, take: np.ndarray) -> np.ndarray:
    """How many of ``take`` positions without replacement lie among the ``left`` ones."""
    n = left + right
    if n < 1_000_000_000:
        return rng.hypergeometric(left, right, take)
    t = take.astype(np.float64)
    spread = np.sqrt(t * (left / n) * (right / n) * np.maximum(n - t, 0.0) / (n - 1))
    found = np.rint(t * (left / n) + spread * rng.standard_normal(len(take))).astype(np.int64)
    return np.clip(found, np.maximum(take - right, 0), np.minimum(take, left))


def leaf_counts(total: int, take: np.ndarray, leaves: Sequence[int], replace: bool, seed: int,
                leaf_size: int = LEAF) -> dict[int, np.ndarray]:
    """Draws of each replicate in each of ``leaves``; over all leaves they add up to ``take``."""
    out, wanted = {}, sorted(leaves)
    todo = [(0, -(-total // leaf_size), take)]
    while todo:
        lo, hi, m = todo.pop()
        if not any(lo <= leaf < hi for leaf in wanted):
            continue
        if hi - lo == 1:
            out[lo] = m
            continue
        mid = (lo + hi) // 2
        left = (mid - lo) * leaf_size
        right = min(hi * leaf_size, total) - mid * leaf_size
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, int(replace), lo, hi])))
        first = rng.binomial(m, left / (left + right)) if replace else hypergeometric(rng, left, right, m)
        todo += [(lo, mid, first), (mid, hi, m - first)]
    return out


def sums_with_replacement(values: np.ndarray, leaf: int, counts: np.ndarray, shift: int, seed: int
                          ) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares of the drawn values of a leaf for each replicate."""
    one, two = np.zeros(len(counts)), np.zeros(len(counts))
    at = 0
    while at < len(counts):
        ends = np.cumsum(counts[at:at + AT_ONCE])
        to = at + max(1, int(np.searchsorted(ends, AT_ONCE, "right")))
        m = counts[at:to]
        which = np.repeat(np.arange(to - at), m)
        number = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
        place = wide_draws(which + at + 1 + shift, number + (leaf << 22), seed) % len(values)
        drawn = values[place]
        one[at:to] = np.bincount(which, drawn, to - at)
        two[at:to] = np.bincount(which, drawn * drawn, to - at)
        at = to
    return one, two


def sums_without_replacement(values: np.ndarray, leaf: int, counts: np.ndarray, seed: int, leaf_size: int = LEAF
                             ) -> np.ndarray:
    """Sum of the chosen values of a leaf for each replicate: the positions with the smallest draws."""
    out, n = np.zeros(len(counts)), len(values)
    number = np.arange(n)
    step = max(1, AT_ONCE // n)
    for at in range(0, len(counts), step):
        m = counts[at:at + step]
        # The position in the low bits keeps the order free of ties.
        order = draws(np.arange(at + 1, at + 1 + len(m))[:, None], (number + leaf * leaf_size)[None, :], seed) * (1 << 32) + number
        if (m == m[0]).all() and 0 < m[0] < n:
            chosen = np.argpartition(order, m[0] - 1, axis=1)[:, :m[0]]
            out[at:at + step] = values[chosen].sum(axis=1)
            continue
        for i, k in enumerate(m):
            chosen = np.argpartition(order[i], k - 1)[:k] if 0 < k < n else number[:k]
            out[at + i] = values[chosen].sum()
    return out


def _folded(df: DataFrame, keys: Sequence[str], value: str, replicates: int, seed: int, side: str | None,
            taken: DataFrame | None, leaf_size: int, split: dict) -> DataFrame:
    """(keys, replicate, s1, s2, total): sums of the drawn values less the group's middle value.

    With ``taken`` (keys, taken), so many positions of each of its groups are drawn without
    replacement and values stay as they are; otherwise as many as there are, with replacement.
    """
    names = [*keys, *([side] if side else [])]
    by = [quoted(k) for k in names]
    rows = df.select(*by, clean(df, value).cast("double").alias("v"))
    pos = value_positions(rows, names, "v", **split)
    middle = F.floor(F.col("total") / 2)
    facts = pos.groupBy(*by).agg(F.max(F.when((F.col("before") <= middle) & (middle < F.col("before") + F.col("n")), F.col("v"))).alias(
        "middle"))
    if taken is not None:
        facts = facts.join(taken, names)
    last = F.floor((F.col("before") + F.col("n") - 1) / leaf_size)
    cut = pos.join(facts, names).withColumn("leaf", F.explode(F.sequence(F.floor(F.col("before") / leaf_size), last)))
    first = F.greatest(F.col("before"), F.col("leaf") * leaf_size)
    times = F.least(F.col("before") + F.col("n"), (F.col("leaf") + 1) * leaf_size) - first
    cut = cut.select(*by, "leaf", "v", "middle", "total", *(["taken"] if taken is not None else []), times.alias("times"),
                     F.floor(F.col("leaf") / BUNDLE).alias("bundle"))
    kinds = [df.schema[k].dataType for k in names]
    schema = T.StructType([T.StructField(f"k{i}", k) for i, k in enumerate(kinds)] + [
        T.StructField("total", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("s1", "s2")]])

    without = taken is not None

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("leaf", "ascending"), ("v", "ascending")])
        leaf, v, times = (table.column(c).to_numpy() for c in ("leaf", "v", "times"))
        total, middle = table.column("total")[0].as_py(), table.column("middle")[0].as_py()
        take = np.full(replicates, table.column("taken")[0].as_py() if without else total, np.int64)
        shift = _SIDE_SHIFT if side and key[len(keys)].as_py() != "a" else 0
        one, two = np.zeros(replicates), np.zeros(replicates)
        cuts = np.flatnonzero(np.diff(leaf, prepend=leaf[0] - 1))
        counts = leaf_counts(total, take, leaf[cuts].tolist(), not without, seed, leaf_size)
        for a, b in zip(cuts, [*cuts[1:], len(leaf)]):
            at = int(leaf[a])
            values = np.repeat(v[a:b], times[a:b])
            if without:
                one += sums_without_replacement(values, at, counts[at], seed, leaf_size)
            else:
                s1, s2 = sums_with_replacement(values - middle, at, counts[at], shift, seed)
                one, two = one + s1, two + s2
        own = [pa.array([k.as_py()], k.type) for k in key[:len(names)]]
        return pa.table([*own, pa.array([total]), *[pa.array([x], pa.list_(pa.float64())) for x in (one, two)]],
                        [f.name for f in schema])

    sums = cut.groupBy(*by, "bundle").applyInArrow(fold, schema).toDF(*names, "total", "s1", "s2")
    each = sums.select(*by, "total", F.posexplode(F.arrays_zip("s1", "s2")).alias("at", "s"))
    folded = each.groupBy(*by, (F.col("at") + 1).alias("replicate")).agg(
        F.sum("s.s1").alias("s1"), F.sum("s.s2").alias("s2"), F.max("total").alias("total"))
    return folded.join(facts.select(*by, "middle"), names)


def _with_key(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key where there is none, so that every table joins on a key."""
    return (df, list(keys)) if keys else (df.withColumn("__all", F.lit(1)), ["__all"])


def bootstrap_means(df: DataFrame, keys: Sequence[str], value: str, replicates: int = 10_000,
                    seed: int = 42, leaf_size: int = LEAF, **split) -> DataFrame:
    """Mean of each bootstrap replicate per group: (keys, replicate, stat)."""
    keyed, names = _with_key(df, keys)
    sums = _folded(keyed, names, value, replicates, seed, None, None, leaf_size, split)
    return sums.select(*[quoted(k) for k in keys], "replicate", (F.col("middle") + F.col("s1") / F.col("total")).alias("stat"))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], value: str, replicates: int = 10_000,
                 level: float = 0.95, seed: int = 42, leaf_size: int = LEAF, **split) -> DataFrame:
    """Percentile interval of the mean; a group of one value gives that value twice."""
    low = (1.0 - level) / 2.0
    # Exactly ``replicates`` numbers per group: a bounded percentile.
    return bootstrap_means(df, keys, value, replicates, seed, leaf_size, **split).groupBy(
        *[quoted(k) for k in keys]).agg(
        F.percentile("stat", F.lit(low)).alias("ci_lower"),
        F.percentile("stat", F.lit(1.0 - low)).alias("ci_upper"))


def permutation_test(df: DataFrame, keys: Sequence[str], side: str, value: str,
                     permutations: int = 10_000, seed: int = 42, leaf_size: int = LEAF, **split) -> DataFrame:
    """Two-sided p of the mean difference between the two values ('a', 'b') of ``side``.

    A side with fewer than two values gives 1.
    """
    df, names = _with_key(df, keys)
    by = [quoted(k) for k in names]
    rows = df.filter(quoted(side).isin("a", "b") & clean(df, value).isNotNull())
    v = clean(df, value).cast("double")
    facts = rows.groupBy(*by).agg(
        F.count_if(quoted(side) == "a").alias("na"), F.count_if(quoted(side) == "b").alias("nb"),
        F.sum(v).alias("sum_all"),
        F.abs(F.avg(F.when(quoted(side) == "a", v)) - F.avg(F.when(quoted(side) == "b", v))
              ).alias("observed"))
    usable = facts.filter((F.col("na") >= 2) & (F.col("nb") >= 2))
    sums = _folded(rows, names, value, permutations, seed, None, usable.select(*by, F.col("na").alias("taken")), leaf_size, split)
    sums = sums.join(usable, names)
    gap = F.abs(F.col("s1") / F.col("na") - (F.col("sum_all") - F.col("s1")) / F.col("nb"))
    # A hair of slack keeps equal splits equal whatever the order of summation.
    hits = sums.groupBy(*by).agg(F.count_if(
        gap >= F.col("observed") - 1e-12 * F.greatest(F.lit(1.0), F.col("observed"))).alias("hits"))
    return facts.join(hits, names, "left").select(
        *[quoted(k) for k in keys], F.coalesce(F.col("hits") / F.lit(float(permutations)), F.lit(1.0)).alias("p"))


def bootstrap_effect(df: DataFrame, keys: Sequence[str], side: str, value: str,
                     replicates: int = 5_000, level: float = 0.95, seed: int = 42, leaf_size: int = LEAF, **split
                     ) -> DataFrame:
    """Percentile interval of the corrected standardised difference of sides 'a' and 'b'."""
    df, names = _with_key(df, keys)
    by = [quoted(k) for k in names]
    sums = _folded(df.filter(quoted(side).isin("a", "b")), names, value, replicates, seed, side, None, leaf_size, split)
    n, rest = F.col("total"), F.col("s2") - F.col("s1") * F.col("s1") / F.col("total")
    # Sums leave a rounding error where all drawn values are equal.
    spread = F.when(rest <= 1e-13 * F.col("s2"), 0.0).otherwise(rest)
    moments = sums.select(*by, "replicate", quoted(side), F.col("total").alias("n"), (F.col("middle") + F.col("s1") / n).alias("mean"),
                          F.try_divide(spread, (n - 1).cast("double")).alias("var"))

    def only(s: str, c: str) -> Column:
        return F.max(F.when(quoted(side) == s, F.col(c))).alias(f"{c}_{s}")
    wide = moments.groupBy(*by, "replicate").agg(
        *[only(s, c) for s in ("a", "b") for c in ("n", "mean", "var")])
    low = (1.0 - level) / 2.0
    return wide.withColumn("d", hedges_g()).groupBy(*[quoted(k) for k in keys]).agg(
        F.percentile("d", F.lit(low)).alias("d_lower"),
        F.percentile("d", F.lit(1.0 - low)).alias("d_upper"))


def hedges_g() -> Column:
    """Corrected standardised difference from n, mean and var of sides a and b; 0 if undefined."""
    na, nb = F.col("n_a"), F.col("n_b")
    pooled = F.sqrt(F.try_divide((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b"),
                                 (na + nb - 2).cast("double")))
    d = F.try_divide(F.col("mean_a") - F.col("mean_b"), pooled)
    fix = 1.0 - F.try_divide(F.lit(3.0), (4 * (na + nb) - 9).cast("double"))
    return F.when((na < 2) | (nb < 2), 0.0).otherwise(F.coalesce(d * fix, F.lit(0.0)))
