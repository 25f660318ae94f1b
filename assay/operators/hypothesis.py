"""Hypothesis tests over groups. Input is long: (metric keys, group, value).

Each test reduces the rows to counts or moments per group before anything else,
so the statistics and p-values are computed on one row per test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay.functions.columns import clean, quoted
from assay.functions.order_stats import exact_quantiles, value_positions
from assay.functions.tails import chi2_upper, exact_u_two_sided, f_upper, normal_two_sided, t_two_sided
from assay.session import cut_lineage

#: Exact Mann-Whitney p: values of the smaller side, and product of both sizes.
EXACT_SIDE, EXACT_CELLS = 8, 1_000_000


def _rows(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    out = df.select(*[quoted(b) for b in by], quoted(group).alias("grp"),
                    clean(df, value).cast("double").alias("v"))
    for b in by:
        out = out.filter(quoted(b).isNotNull())
    return out.filter(F.col("grp").isNotNull() & F.col("v").isNotNull())


def _moments(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*[quoted(b) for b in by], "grp").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def t_test(df: DataFrame, by: Sequence[str], group: str, value: str, first, second,
           pooled: bool = False) -> DataFrame:
    """Independent t-test of two groups, Welch by default."""
    rows = _rows(df, by, group, value).filter(F.col("grp").isin(first, second))

    def only(g, c: str) -> Column:
        return F.max(F.when(F.col("grp") == F.lit(g), F.col(c)))
    keys = [quoted(b) for b in by]
    wide = _moments(rows, by).groupBy(*keys).agg(
        *[only(g, c).alias(f"{c}_{s}") for g, s in ((first, "a"), (second, "b"))
          for c in ("n", "mean", "var")])
    na, nb = F.col("n_a"), F.col("n_b")
    va, vb = F.col("var_a") / na, F.col("var_b") / nb
    if pooled:
        df_ = (na + nb - 2).cast("double")
        sp = F.try_divide((na - 1) * F.col("var_a") + (nb - 1) * F.col("var_b"), df_)
        se = F.sqrt(sp * (1.0 / na + 1.0 / nb))
    else:
        df_ = F.try_divide((va + vb) * (va + vb), va * va / (na - 1) + vb * vb / (nb - 1))
        se = F.sqrt(va + vb)
    usable = (na >= 2) & (nb >= 2)
    out = wide.filter(usable).withColumn("df", df_).withColumn(
        "t", F.try_divide(F.col("mean_a") - F.col("mean_b"), se))
    return out.withColumn("p", t_two_sided("t", "df")).select(
        *keys, "n_a", "n_b", "mean_a", "mean_b", "t", "df", "p")


def _group_ranks(rows: DataFrame, by: Sequence[str], **split) -> DataFrame:
    """Per (by, grp): n and rank sum, with the tie term and total of the whole ``by``."""
    keys = [quoted(b) for b in by]
    pos = value_positions(rows, by, "v", **split)
    counts = rows.groupBy(*keys, "grp", "v").agg(F.count(F.lit(1)).alias("m"))
    ranked = counts.join(
        pos.select(*keys, "v", (F.col("before") + (F.col("n") + 1) / 2.0).alias("r")),
        [*by, "v"]) if by else counts.join(
        pos.select("v", (F.col("before") + (F.col("n") + 1) / 2.0).alias("r")), "v")
    sums = ranked.groupBy(*keys, "grp").agg(
        F.sum("m").alias("n"), F.sum(F.col("m") * F.col("r")).alias("rank_sum"))
    d = F.col("n").cast("double")
    ties = pos.groupBy(*keys).agg(F.sum(d * d * d - d).alias("ties"), F.sum("n").alias("total"))
    return sums.join(ties, list(by)) if by else sums.join(F.broadcast(ties), F.lit(True))


def mann_whitney(df: DataFrame, by: Sequence[str], group: str, value: str, first, second,
                 **split) -> DataFrame:
    """Two-sided Mann-Whitney U: exact p without ties if a side has at most ``EXACT_SIDE``
    values and the product of both sizes is at most ``EXACT_CELLS``, else the normal one with tie
    and continuity correction.

    A side with fewer than two values gives (0, 1).
    """
    rows = _rows(df, by, group, value).filter(F.col("grp").isin(first, second))
    keys = [quoted(b) for b in by]
    ranks = _group_ranks(rows, by, **split)

    def only(g, c: str) -> Column:
        return F.max(F.when(F.col("grp") == F.lit(g), F.col(c)))
    wide = ranks.groupBy(*keys).agg(
        F.coalesce(only(first, "n"), F.lit(0)).alias("n_a"),
        F.coalesce(only(second, "n"), F.lit(0)).alias("n_b"),
        only(first, "rank_sum").alias("rank_a"), F.max("ties").alias("ties"))
    return with_u_test(wide).select(*keys, "n_a", "n_b", "u", "p")


def with_u_test(wide: DataFrame) -> DataFrame:
    """Add ``u`` and ``p`` to rows holding n_a, n_b, rank_a and the tie term."""
    na, nb = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = na + nb
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    out = wide.withColumn("u", F.when(enough, F.col("rank_a") - na * (na + 1) / 2.0).otherwise(0.0))
    big = F.greatest(F.col("u"), na * nb - F.col("u"))
    sigma = F.sqrt(na * nb / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))))
    out = out.withColumn("__z", F.when(enough, F.try_divide(big - na * nb / 2.0 - 0.5, sigma)))
    rough = F.coalesce(F.when(F.col("__z") < 0, 1.0).otherwise(normal_two_sided("__z")), F.lit(1.0))
    small = (F.least("n_a", "n_b") <= EXACT_SIDE) & (na * nb <= EXACT_CELLS) & (F.col("ties") == 0) & enough
    return out.withColumn("p", rough).withColumn("p", F.when(
        small, exact_u_two_sided("n_a", "n_b", F.when(small, F.col("u")))).otherwise(F.col("p"))).drop("__z")


def anova(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """One-way analysis of variance from group moments: F, p, eta squared."""
    return _anova_from_moments(_moments(_rows(df, by, group, value), by), by)


def _anova_from_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [quoted(b) for b in by]
    n, m = F.col("n").cast("double"), F.col("mean")
    # Weighted centre first: squared sums of raw means would lose digits.
    centre = moments.groupBy(*keys).agg((F.sum(n * m) / F.sum(n)).alias("centre"))
    joined = moments.join(centre, list(by)) if by else moments.join(
        F.broadcast(centre), F.lit(True))
    gap = m - F.col("centre")
    out = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"),
        F.sum(n * gap * gap).alias("ss_between"),
        F.sum(F.coalesce(F.col("var"), F.lit(0.0)) * (n - 1)).alias("ss_within"))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    out = out.withColumn("f", F.try_divide(
        F.try_divide(F.col("ss_between"), d1), F.try_divide(F.col("ss_within"), d2))).withColumn(
        "df_between", F.col("k") - 1).withColumn("df_within", F.col("total") - F.col("k"))
    return out.filter(F.col("k") >= 2).withColumn(
        "p", f_upper("f", F.col("df_between").cast("double"), F.col("df_within").cast("double"))
    ).withColumn("eta_squared", F.try_divide(
        F.col("ss_between"), F.col("ss_between") + F.col("ss_within"))).select(
        *keys, "k", "total", "ss_between", "ss_within", "df_between", "df_within", "f", "p",
        "eta_squared")


def kruskal_wallis(df: DataFrame, by: Sequence[str], group: str, value: str, **split) -> DataFrame:
    """Kruskal-Wallis H with tie correction and eta squared."""
    keys = [quoted(b) for b in by]
    ranks = _group_ranks(_rows(df, by, group, value), by, **split)
    out = ranks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.max("total").alias("total"), F.max("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"))
    n = F.col("total").cast("double")
    raw = 12.0 / (n * (n + 1)) * F.col("s") - 3.0 * (n + 1)
    fix = 1.0 - F.try_divide(F.col("ties"), n * n * n - n)
    out = out.filter(F.col("k") >= 2).withColumn("h", F.try_divide(raw, fix))
    return out.withColumn("p", chi2_upper("h", (F.col("k") - 1).cast("double"))).withColumn(
        "eta_squared", F.try_divide(F.col("h") - F.col("k") + 1, n - F.col("k"))).select(
        *keys, "k", "total", "h", "p", "eta_squared")


def _pairs_of(groups: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Unordered pairs of the levels of one factor within ``by``.

    Pairs are the result asked for here: one row per compared pair of group
    summaries, never pairs of data rows.
    """
    keys = [quoted(b) for b in by]
    left = groups.select(*keys, *[F.col(c).alias(f"{c}_a") for c in cols])
    right = groups.select(*[quoted(b).alias(f"__{b}") for b in by],
                          *[F.col(c).alias(f"{c}_b") for c in cols])
    cond = F.col("grp_a") < F.col("grp_b")
    for b in by:
        cond = cond & (quoted(b) == quoted(f"__{b}"))
    return left.join(right, cond).drop(*[f"__{b}" for b in by])


def dunn(df: DataFrame, by: Sequence[str], group: str, value: str, **split) -> DataFrame:
    """Dunn's pairwise test on mean ranks with Bonferroni correction."""
    keys = [quoted(b) for b in by]
    ranks = _group_ranks(_rows(df, by, group, value), by, **split)
    counts = ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    cols = ["grp", "n", "rank_sum"]
    common = ranks.groupBy(*keys).agg(F.max("ties").alias("ties"), F.max("total").alias("total"))
    pairs = _pairs_of(ranks, by, cols)
    for side in (counts, common):
        pairs = pairs.join(side, list(by)) if by else pairs.join(F.broadcast(side), F.lit(True))
    n = F.col("total").cast("double")
    sigma = F.sqrt((n * (n + 1) / 12.0 - F.try_divide(F.col("ties"), 12.0 * (n - 1)))
                   * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    gap = F.col("rank_sum_a") / F.col("n_a") - F.col("rank_sum_b") / F.col("n_b")
    m = F.col("k") * (F.col("k") - 1) / 2.0
    return pairs.withColumn("z", F.try_divide(gap, sigma)).withColumn(
        "p", normal_two_sided("z")).withColumn(
        "p_adjusted", F.least(F.lit(1.0), F.col("p") * m)).select(
        *keys, F.col("grp_a").alias("group_a"), F.col("grp_b").alias("group_b"), "z", "p",
        "p_adjusted")


def tukey_q(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Studentised range statistic of each pair (Tukey-Kramer)."""
    keys = [quoted(b) for b in by]
    moments = _moments(_rows(df, by, group, value), by)
    within = _anova_from_moments(moments, by).select(
        *keys, (F.col("ss_within") / F.col("df_within")).alias("ms_within"), "k", "df_within")
    pairs = _pairs_of(moments, by, ["grp", "n", "mean"])
    pairs = pairs.join(within, list(by)) if by else pairs.join(F.broadcast(within), F.lit(True))
    se = F.sqrt(F.col("ms_within") / 2.0 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    return pairs.select(
        *keys, F.col("grp_a").alias("group_a"), F.col("grp_b").alias("group_b"),
        (F.col("mean_a") - F.col("mean_b")).alias("mean_diff"),
        F.abs(F.try_divide(F.col("mean_a") - F.col("mean_b"), se)).alias("q"), "k", "df_within")


def _adjusted_square(cells: DataFrame) -> float:
    """Sum of squares of ``b`` given ``a``, for any number of levels.

    Conjugate gradients on the normal equations of the levels of ``b``, scaled by their sizes.
    A step sums the cells by ``a``, then by ``b``, each time with one value per level; the sum
    of squares grows by a known share in every step.
    """
    cells = cut_lineage(cells.select("a", "b", F.col("n").cast("double").alias("n"), "s"))

    def centred(values: DataFrame, c: str) -> DataFrame:
        """Per level of b: the sum of ``c`` over its rows less the mean of each row's level of a."""
        of_a = values.groupBy("a").agg((F.sum(c) / F.sum("n")).alias("m"))
        return values.join(of_a, "a").groupBy("b").agg(
            F.sum("n").alias("size"), F.sum(F.col(c) - F.col("n") * F.col("m")).alias("r"))

    z = F.col("r") / F.col("size")
    state = cut_lineage(centred(cells, "s").withColumn("p", z))
    rz = first = state.agg(F.sum(F.col("r") * z)).first()[0] or 0.0
    total = 0.0
    while rz > 1e-22 * first:
        moved = cells.join(state.select("b", "p"), "b").withColumn("np", F.col("n") * F.col("p"))
        step = cut_lineage(state.join(centred(moved, "np").select("b", F.col("r").alias("q")), "b"))
        pq = step.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        if not pq > 0:
            break
        alpha = rz / pq
        total += alpha * rz
        state = cut_lineage(step.withColumn("r", F.col("r") - alpha * F.col("q")).drop("q"))
        last, rz = rz, state.agg(F.sum(F.col("r") * z)).first()[0]
        state = state.withColumn("p", z + rz / last * F.col("p"))
    return total


def two_way_anova(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Two-way analysis of variance with interaction from cell sums.

    Sums of squares are sequential: ``a``, then ``b`` given ``a``, then the interaction
    given both. For cells of equal size they are the usual ones. ``b`` given ``a`` has an
    equation per level of ``b``, solved by steps in Spark for any number of levels.
    """
    v = clean(df, value).cast("double")
    rows = df.select(quoted(a).alias("a"), quoted(b).alias("b"), v.alias("v")).dropna()
    centre = rows.agg(F.avg("v").alias("centre"))
    cells = rows.join(F.broadcast(centre), F.lit(True)).withColumn(
        "d", F.col("v") - F.col("centre")).groupBy("a", "b").agg(
        F.count("d").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("q"))
    given = _adjusted_square(cells)
    sets = cells.groupingSets([["a", "b"], ["a"], ["b"], []], "a", "b").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.grouping_id().alias("gid"))
    part = F.col("s") * F.col("s") / F.col("n")

    def at(gid: int, c: Column) -> Column:
        return F.sum(F.when(F.col("gid") == gid, c))
    one = sets.agg(
        at(0, part).alias("cell"), at(1, part).alias("pa"), at(3, part).alias("all"), at(3, F.col("q")).alias("q"), at(3, F.col("n")).alias("n"),
        at(0, F.lit(1)).alias("kc"), at(1, F.lit(1)).alias("ka"), at(2, F.lit(1)).alias("kb"))
    ss_a, ss_b = F.col("pa") - F.col("all"), F.lit(given).cast("double")
    left = F.col("cell") - F.col("all") - ss_a - ss_b
    ss_ab = F.when(left < 0, 0.0).otherwise(left)  # NULL stays NULL
    ss_e = F.col("q") - F.col("cell")
    df_a, df_b = F.col("ka") - 1, F.col("kb") - 1
    df_ab, df_e = F.col("kc") - F.col("ka") - F.col("kb") + 1, F.col("n") - F.col("kc")
    out = one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("source"), ss.alias("ss"), d.cast("bigint").alias("df"),
                 ss_e.alias("ss_error"), df_e.alias("df_error"),
                 (F.col("q") - F.col("all")).alias("ss_total"))
        for name, ss, d in ((a, ss_a, df_a), (b, ss_b, df_b), (f"{a}:{b}", ss_ab, df_ab))])))
    out = out.withColumn("f", F.try_divide(
        F.try_divide(F.col("ss"), F.col("df").cast("double")),
        F.try_divide(F.col("ss_error"), F.col("df_error").cast("double"))))
    return out.withColumn("p", f_upper(
        "f", F.col("df").cast("double"), F.col("df_error").cast("double"))).withColumn(
        "eta_squared", F.try_divide(F.col("ss"), F.col("ss_total"))).select(
        "source", "ss", "df", "f", "p", "eta_squared")


def friedman(df: DataFrame, unit: str, stage: str, value: str) -> DataFrame:
    """Friedman test over stages repeated within units; only complete units count."""
    cells = df.select(quoted(unit).alias("unit"), quoted(stage).alias("stage"),
                      clean(df, value).cast("double").alias("v")).dropna().groupBy(
        "unit", "stage").agg(F.avg("v").alias("v"))
    stages = cells.agg(F.count_distinct("stage").alias("k"))
    # One row per stage in each window: as wide as the design, not as the data.
    w = Window.partitionBy("unit")
    tied = Window.partitionBy("unit", "v")
    ranked = (
        cells.withColumn("have", F.count(F.lit(1)).over(w))
        .join(F.broadcast(stages), F.lit(True)).filter(F.col("have") == F.col("k"))
        .withColumn("peers", F.count(F.lit(1)).over(tied))
        .withColumn("r", F.rank().over(w.orderBy("v")) + (F.col("peers") - 1) / 2.0))
    sums = ranked.groupBy("stage").agg(
        F.sum("r").alias("r"), F.count(F.lit(1)).alias("n"), F.max("k").alias("k"),
        F.sum(F.col("peers") * F.col("peers") - 1).alias("ties"))
    out = sums.agg(F.max("n").alias("n"), F.max("k").alias("k"),
                   F.sum(F.col("r") * F.col("r")).alias("s"), F.sum("ties").alias("ties"))
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12.0 / (n * k * (k + 1)) * F.col("s") - 3.0 * n * (k + 1)
    fix = 1.0 - F.col("ties") / (n * k * (k * k - 1))
    out = out.filter(k >= 2).withColumn("chi2", F.try_divide(raw, fix))
    return out.withColumn("p", chi2_upper("chi2", k - 1)).select("n", "k", "chi2", "p")


def variance_components(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Between and within variance and intraclass correlation from mean squares."""
    keys = [quoted(b) for b in by]
    moments = _moments(_rows(df, by, group, value), by)
    sizes = moments.groupBy(*keys).agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"))
    base = _anova_from_moments(moments, by)
    out = base.join(sizes, list(by)) if by else base.join(F.broadcast(sizes), F.lit(True))
    n0 = F.try_divide(F.col("total") - F.col("n2") / F.col("total"), (F.col("k") - 1).cast("double"))
    msb = F.col("ss_between") / F.col("df_between")
    msw = F.try_divide(F.col("ss_within"), F.col("df_within").cast("double"))
    between = F.greatest(F.lit(0.0), F.try_divide(msb - msw, n0))
    return out.withColumn("var_within", msw).withColumn("var_between", between).withColumn(
        "icc", F.try_divide(F.col("var_between"), F.col("var_between") + F.col("var_within"))
    ).select(*keys, "k", "total", "var_between", "var_within", "icc")


def levene(df: DataFrame, by: Sequence[str], group: str, value: str, **split) -> DataFrame:
    """Median-centred Levene test: analysis of variance of the absolute deviations."""
    rows = _rows(df, by, group, value)
    mids = exact_quantiles(rows, [*by, "grp"], "v", {"mid": 0.5}, **split)
    dev = rows.join(mids, [*by, "grp"]).withColumn("d", F.abs(F.col("v") - F.col("mid")))
    return anova(dev, by, "grp", "d")
