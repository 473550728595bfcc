"""Equal-cluster estimates and resampling intervals.

Every interval is computed from cluster summaries, never from rows: rows fold
into one number per cluster first, with map-side combine. A draw is a function
of (replicate, draw number, seed) in integer arithmetic, so a result depends on
neither partitioning, row order nor task retries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankloom.functions.vectors import finite
from rankloom.operators.ordering import ROWS_PER_SPLIT, ordinals, value_ranks
from rankloom.operators.resampling import FEW_CLUSTERS, LEVELS, MULTIPLIER, PRIME, RANGE_ROWS, ROUND_CONSTANTS, RankTerms, array_bounds, level_sweeps, rank_sweeps, replicate_means, tensor_sweeps
from rankloom.session import settle


def mix_value(b: Column, j: Column, seed: int) -> Column:
    """Integer in [0, 2^31 - 1) for replicate ``b`` and item ``j``."""
    b, j = b.cast("long"), j.cast("long")
    start = F.pmod(b * 1000003 + j * 7919 + F.lit(seed).cast("long"), F.lit(PRIME).cast("long"))
    rounds = F.array(*[F.lit(k).cast("long") for k in ROUND_CONSTANTS])
    return F.aggregate(
        rounds, start, lambda a, k: (((a * a + k) % PRIME) * MULTIPLIER + j * 31 + b * 17) % PRIME
    )


def _mixed(df: DataFrame, name: str, b: str, j: str, seed: int) -> DataFrame:
    return df.withColumn(name, mix_value(F.col(b), F.col(j), seed))


def _bounds(value: Column | str, level: float) -> list[Column]:
    a = (1.0 - level) / 2.0
    q = F.percentile(value, F.array(F.lit(a), F.lit(1.0 - a)))
    return [q[0].alias("ci_low"), q[1].alias("ci_high")]


def _group(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn("_all", F.lit(0)), ["_all"]


def cluster_means(df: DataFrame, by: Sequence[str], value: str, cl: Sequence[str]) -> DataFrame:
    """Mean of ``value`` per cluster; NaN and infinite values are missing."""
    return (
        df.select(*by, *cl, finite(value).alias("_v"))
        .where(F.col("_v").isNotNull())
        .groupBy(*by, *cl)
        .agg(F.avg("_v").alias("value"), F.count(F.lit(1)).alias("n_rows"))
    )


def cluster_mean(df: DataFrame, by: Sequence[str], value: str, cl: str) -> DataFrame:
    """Mean of cluster means, so each cluster counts once."""
    df, keys = _group(df, by)
    return (
        cluster_means(df, keys, value, [cl])
        .groupBy(*keys)
        .agg(
            F.avg("value").alias("estimate"),
            F.sum("n_rows").alias("n_rows"),
            F.count(F.lit(1)).alias("n_clusters"),
        )
        .drop("_all")
    )


def _resampled_means(items: DataFrame, keys: list[str], strata: list[str], cl: list[str], replicates: int, seed: int, **kw) -> DataFrame:
    """Replicate means of ``items`` (one row per cluster) by drawing within strata."""
    parts = [*keys, *strata]
    o = ordinals(items, parts, cl, pos="_j", total="_n", **kw)
    draws = _mixed(
        o.select(*parts, "_j", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_r")),
        "_x", "_r", "_j", seed,
    ).select(*parts, "_r", (F.col("_x") % F.col("_n") + 1).alias("_j"))
    # Draws of one cluster collapse to a count before the values join.
    counted = draws.groupBy(*parts, "_r", "_j").agg(F.count(F.lit(1)).alias("_w"))
    return (
        counted.join(o.select(*parts, "_j", "value"), [*parts, "_j"])
        .groupBy(*keys, "_r")
        .agg((F.sum(F.col("value") * F.col("_w")) / F.sum("_w")).alias("_mean"))
    )


def _largest(items: DataFrame, parts: Sequence[str]) -> int:
    return items.groupBy(*parts).count().agg(F.max("count")).first()[0] or 0


def _interval(items: DataFrame, keys: list[str], strata: list[str], cl: list[str], kind: str, replicates: int, level: float, seed: int, rows_per_split: int = ROWS_PER_SPLIT, **kw) -> DataFrame:
    """(keys, ci_low, ci_high) of the replicate means.

    Replicates are arrays while every stratum's values fit a task; beyond
    ``rows_per_split`` clusters each draw is a row. Both give the same draws.
    """
    if _largest(items, [*keys, *strata]) <= rows_per_split:
        return replicate_means(items, keys, strata, cl, kind, replicates, seed).select(*keys, *array_bounds("means", level))
    means = _resampled_means if kind == "drawn" else _flipped_means
    return means(items, keys, strata, cl, replicates, seed, rows_per_split=rows_per_split, **kw).groupBy(*keys).agg(*_bounds("_mean", level))


def _flipped_means(items: DataFrame, keys: list[str], strata: list[str], cl: list[str], replicates: int, seed: int, **kw) -> DataFrame:
    """Replicate means of deviations from the group's mean, with random signs."""
    o = ordinals(items, keys, cl, pos="_j", total="_n", **kw)
    centred = o.join(items.groupBy(*keys).agg(F.avg("value").alias("_m")), keys)
    flips = _mixed(centred.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))), "_x", "_r", "_j", seed)
    sign = F.when(F.col("_x") % 2 == 0, 1.0).otherwise(-1.0)
    return flips.groupBy(*keys, "_r").agg(F.avg(sign * (F.col("value") - F.col("_m"))).alias("_mean"))


def cluster_bootstrap(
    df: DataFrame, by: Sequence[str], value: str, cl: str, replicates: int = 500, level: float = 0.95, seed: int = 0, **kw
) -> DataFrame:
    """Equal-cluster mean with a percentile interval over resampled clusters.

    A single cluster, or fewer than two replicates, gives no interval.
    """
    df, keys = _group(df, by)
    items = settle(cluster_means(df, keys, value, [cl]))
    point = items.groupBy(*keys).agg(
        F.avg("value").alias("estimate"),
        F.sum("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
    if replicates < 2:
        return point.withColumn("ci_low", F.lit(None).cast("double")).withColumn(
            "ci_high", F.lit(None).cast("double")
        ).drop("_all")
    ci = _interval(items, keys, [], [cl], "drawn", replicates, level, seed, **kw)
    known = F.col("n_clusters") > 1
    return (
        point.join(ci, keys, "left")
        .withColumn("ci_low", F.when(known, F.col("ci_low")))
        .withColumn("ci_high", F.when(known, F.col("ci_high")))
        .drop("_all")
    )


def sign_counts(value: str = "value") -> list[Column]:
    return [
        F.count_if(F.col(value) > 0).alias("positive_clusters"),
        F.count_if(F.col(value) < 0).alias("negative_clusters"),
        F.count_if(F.col(value) == 0).alias("zero_clusters"),
    ]


def _leave_one_out() -> list[Column]:
    """Range of the means with one cluster left out, from sum, min and max."""
    n, s = F.count(F.lit(1)), F.sum("value")
    return [
        F.when(n > 1, (s - F.max("value")) / F.nullif(n - 1, F.lit(0))).alias("loo_min"),
        F.when(n > 1, (s - F.min("value")) / F.nullif(n - 1, F.lit(0))).alias("loo_max"),
    ]


def stratified_bootstrap(
    df: DataFrame, by: Sequence[str], value: str, cl: str, st: str, replicates: int = 500, level: float = 0.95, seed: int = 0, **kw
) -> DataFrame:
    """Equal-cluster mean; clusters are redrawn inside their stratum, keeping its count."""
    df, keys = _group(df, by)
    items = settle(cluster_means(df, keys, value, [cl, st]))
    point = items.groupBy(*keys).agg(
        F.avg("value").alias("estimate"),
        F.avg((F.col("value") > 0).cast("double")).alias("positive_fraction"),
        *sign_counts(),
        F.count(F.lit(1)).alias("n_clusters"),
        *_leave_one_out(),
    )
    ci = _interval(items, keys, [st], [cl], "drawn", replicates, level, seed, **kw)
    return point.join(ci, keys, "left").drop("_all")


def wild_cluster(
    df: DataFrame, by: Sequence[str], value: str, cl: str, replicates: int = 500, level: float = 0.95, seed: int = 0, **kw
) -> DataFrame:
    """Jackknife error, sign-flip interval of the deviations, and sign counts."""
    df, keys = _group(df, by)
    items = settle(cluster_means(df, keys, value, [cl]))
    n = F.count(F.lit(1))
    point = items.groupBy(*keys).agg(
        F.avg("value").alias("estimate"),
        # (n-1)/n * sum((loo - mean)^2) is var_samp / n.
        F.when(n > 1, F.sqrt(F.var_samp("value") / n)).otherwise(F.lit(None)).alias("jackknife_se"),
        *_leave_one_out(),
        *sign_counts(),
        n.alias("n_clusters"),
        F.sum("n_rows").alias("n_rows"),
    )
    ci = _interval(items, keys, [], [cl], "signed", replicates, level, seed, **kw)
    return (
        point.join(ci, keys, "left")
        .withColumns({c: F.col("estimate") + F.col(c) for c in ("ci_low", "ci_high")})
        .withColumnsRenamed({"ci_low": "wild_ci_low", "ci_high": "wild_ci_high"})
        .drop("_all")
    )


def _numbered(df: DataFrame, keys: list[str], cl: str, **kw) -> DataFrame:
    """(keys, cluster, _j, _n): clusters numbered by their key."""
    names = settle(df.select(*keys, cl).where(F.col(cl).isNotNull()).distinct())
    return ordinals(names, keys, [cl], pos="_j", total="_n", **kw)


def _swept(folded: DataFrame, keys: list[str], cl: str, terms: RankTerms) -> tuple[str | None, int] | None:
    """How large groups are swept: none and the most clusters of a group, if these are few;
    or a column in every term whose partners have few distinct values in each group."""
    clusters = _largest(folded.select(*keys, cl).where(F.col(cl).isNotNull()).distinct(), keys)
    if 0 < clusters <= FEW_CLUSTERS:
        return None, clusters
    most = folded.groupBy(*keys).agg(*[F.approx_count_distinct(c).alias(c) for c in terms.columns]).agg(*[F.max(c).alias(c) for c in terms.columns]).first()
    for column in terms.columns:
        others = [y if x == column else x if y == column else None for _, x, y in terms.terms]
        if all(o is not None and (most[o] or 0) <= LEVELS for o in others):
            return column, clusters
    return None


def cluster_draws(df: DataFrame, by: Sequence[str], cl: str, replicates: int, seed: int, **kw) -> DataFrame:
    """(by, replicate, cluster, weight): how often a cluster is drawn.

    Replicate 0 is the data as it is. Clusters are numbered by their key.
    """
    keys = list(by)
    o = _numbered(df, keys, cl, **kw)
    drawn = _mixed(
        o.select(*keys, "_j", "_n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")),
        "_x", "replicate", "_j", seed,
    ).select(*keys, "replicate", (F.col("_x") % F.col("_n") + 1).alias("_j"))
    counted = drawn.groupBy(*keys, "replicate", "_j").agg(F.count(F.lit(1)).alias("weight"))
    real = o.select(*keys, F.lit(0).alias("replicate"), cl, F.lit(1).cast("long").alias("weight"))
    return counted.join(o.select(*keys, "_j", cl), [*keys, "_j"]).select(*keys, "replicate", cl, "weight").unionByName(real)


#: Distinct rows of a group that one task sorts for all replicates.
SWEEP_ROWS = 2_000_000

Statistic = Callable[[DataFrame, list[str], str], DataFrame]


def cluster_bootstrap_stat(
    df: DataFrame, by: Sequence[str], cl: str, stat: Statistic | RankTerms, replicates: int = 500, level: float = 0.95, seed: int = 0, **kw
) -> DataFrame:
    """Interval of any pooled statistic over resampled clusters.

    Rank correlations (``spearman_stat``) sort each group once for all replicates
    while its distinct rows are at most ``SWEEP_ROWS``; NaN counts as missing there.
    Larger groups are swept in ranges, where clusters are few or one column meets
    columns of few levels.

    ``stat(rows, keys, weight)`` returns one row per ``keys`` with a column
    ``stat``; ``weight`` counts the copies of a row. Rows that agree in all
    columns are folded into one before they meet the replicates.
    """
    df, keys = _group(df, by)
    if isinstance(stat, RankTerms):
        value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        df = df.select(*keys, cl, *[value(c).alias(c) for c in stat.columns])
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if isinstance(stat, RankTerms):
        folded = settle(folded)
    largest = _largest(folded, keys) if isinstance(stat, RankTerms) else None
    if largest is not None and largest <= kw.get("rows_per_split", SWEEP_ROWS):
        swept = rank_sweeps(folded, keys, cl, stat, "_copies", replicates, seed, largest)
        out = swept.select(*keys, "estimate", *array_bounds("stats", level))
    elif largest is not None and (wide := _swept(folded, keys, cl, stat)):
        rows = folded.join(_numbered(folded, keys, cl, **kw), [*keys, cl])
        column, clusters = wide
        size = kw.get("rows_per_split", RANGE_ROWS)
        if column is None:
            swept = tensor_sweeps(rows, keys, stat, "_copies", clusters, replicates, seed, size)
        else:
            swept = level_sweeps(rows, keys, stat, column, "_copies", replicates, seed, size)
        out = swept.select(*keys, "estimate", *array_bounds("stats", level))
    else:
        draws = cluster_draws(df, keys, cl, replicates, seed, **kw)
        rows = folded.join(draws, [*keys, cl]).withColumn("_w", F.col("_copies") * F.col("weight")).drop("weight", "_copies")
        values = (rank_terms_stat(stat) if isinstance(stat, RankTerms) else stat)(rows, [*keys, "replicate"], "_w")
        resampled = F.when(F.col("replicate") > 0, finite("stat"))
        out = values.groupBy(*keys).agg(F.max(F.when(F.col("replicate") == 0, finite("stat"))).alias("estimate"), *_bounds(resampled, level))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(cl).alias("n_clusters"))
    known = F.col("n_clusters") > 1
    return (
        out.join(counts, keys)
        .withColumn("ci_low", F.when(known, F.col("ci_low")))
        .withColumn("ci_high", F.when(known, F.col("ci_high")))
        .drop("_all")
    )


def weighted_mean_stat(value: str) -> Statistic:
    def stat(rows: DataFrame, keys: list[str], w: str) -> DataFrame:
        return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(w)) / F.sum(w)).alias("stat"))

    return stat


def weighted_spearman(rows: DataFrame, keys: list[str], x: str, y: str, w: str, rows_per_split: int = ROWS_PER_SPLIT, **kw) -> DataFrame:
    """Rank correlation where a row counts ``w`` times (column ``stat``).

    Groups of up to ``rows_per_split`` rows meet in one shuffle and are sorted twice
    where they are. For larger ones ranks of ``x`` come from its folded values, rows
    fold by ``y`` with the sums of these ranks, and only what is folded is sorted.
    """
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).dropna(subset=keys).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"), F.col(w).alias("_w"))
    if _largest(known, keys) <= rows_per_split:
        group = W.partitionBy(*keys)
        mid = lambda c: F.sum("_w").over(group.orderBy(c)) - F.sum("_w").over(W.partitionBy(*keys, c)) / 2 - F.sum("_w").over(group) / 2
        ranked = known.withColumn("_rx", mid("_x")).withColumn("_ry", mid("_y"))
        sums = ranked.groupBy(*keys).agg(
            F.sum(F.col("_w") * F.col("_rx") * F.col("_ry")).alias("_xy"),
            F.sum(F.col("_w") * F.col("_rx") * F.col("_rx")).alias("_xx"),
            F.sum(F.col("_w") * F.col("_ry") * F.col("_ry")).alias("_yy"),
            F.sum("_w").alias("n_rows"),
        )
    else:
        met = ranked_columns(known, keys, ["_x"], "_w", rows_per_split=rows_per_split, **kw)
        sums = rank_sums(met, keys, ["_x"], "_y", "_w", rows_per_split=rows_per_split, **kw).withColumnsRenamed({"_xy0": "_xy", "_xx0": "_xx"})
    return sums.select(*keys, "n_rows", rank_ratio("_xy", "_xx", "_yy").alias("stat"))


def rank_ratio(xy: str, xx: str, yy: str) -> Column:
    return F.when((F.col(xx) > 0) & (F.col(yy) > 0), F.col(xy) / F.sqrt(F.nullif(F.col(xx) * F.col(yy), F.lit(0.0))))


def ranked_columns(rows: DataFrame, keys: list[str], xs: Sequence[str], w: str, **kw) -> DataFrame:
    """Rows with ``_r0``, ``_r1``, ...: the centred average rank of each column in its group."""
    for i, x in enumerate(xs):
        ranks = settle(value_ranks(rows.select(*keys, x, w), keys, x, weight=w, **kw).select(*keys, x, F.col("_rank_centred").alias(f"_r{i}")))
        rows = rows.join(ranks, [*keys, x])
    return rows


def rank_sums(rows: DataFrame, keys: list[str], xs: Sequence[str], y: str, w: str, **kw) -> DataFrame:
    """(keys, n_rows, _yy, _xy0, _xx0, ...): sums of products of the ranks of every ``xs``
    with those of ``y``, from rows of ``ranked_columns``; only rows folded by ``y`` are sorted."""
    r = [F.col(f"_r{i}") for i in range(len(xs))]
    folded = rows.groupBy(*keys, y).agg(
        F.sum(w).alias("_m"),
        *[F.sum(F.col(w) * c).alias(f"_s{i}") for i, c in enumerate(r)],
        *[F.sum(F.col(w) * c * c).alias(f"_q{i}") for i, c in enumerate(r)],
    )
    placed = ordinals(settle(folded), keys, [y], pos="_before", total="_n", weight="_m", **kw)
    ry = F.col("_before") + F.col("_m") / 2 - F.col("_n") / 2
    return placed.withColumn("_ry", ry).groupBy(*keys).agg(
        F.sum("_m").alias("n_rows"),
        F.sum(F.col("_m") * F.col("_ry") * F.col("_ry")).alias("_yy"),
        *[F.sum(F.col("_ry") * F.col(f"_s{i}")).alias(f"_xy{i}") for i in range(len(xs))],
        *[F.sum(f"_q{i}").alias(f"_xx{i}") for i in range(len(xs))],
    )


def spearman_stat(x: str, y: str) -> RankTerms:
    return RankTerms(((1.0, x, y),))


def rank_terms_stat(terms: RankTerms) -> Statistic:
    """The same statistic over rows that meet their replicates, for groups of any size."""

    def stat(rows: DataFrame, keys: list[str], w: str) -> DataFrame:
        out = None
        for i, (factor, x, y) in enumerate(terms.terms):
            one = weighted_spearman(rows, keys, x, y, w).select(*keys, (F.lit(factor) * F.col("stat")).alias(f"_s{i}"))
            out = one if out is None else out.join(one, keys)
        return out.select(*keys, sum((F.col(f"_s{i}") for i in range(len(terms.terms))), F.lit(0.0)).alias("stat"))

    return stat


def group_bootstrap_diff(
    df: DataFrame, by: Sequence[str], group: str, method: str, comparator: str, observed: str,
    replicates: int = 500, level: float = 0.95, seed: int = 0, **kw,
) -> DataFrame:
    """Interval of the rank-correlation gain of ``method`` over ``comparator``,
    resampling the groups (positions) of each entity."""
    terms = RankTerms(((1.0, method, observed), (-1.0, comparator, observed)))
    return cluster_bootstrap_stat(df.select(*by, group, method, comparator, observed), by, group, terms, replicates, level, seed, **kw)


def with_scopes(df: DataFrame, st: str, *, scope: str = "scope", everything: str = "all") -> DataFrame:
    """Each row once under ``all`` and once under its stratum."""
    return df.withColumn(scope, F.explode(F.array(F.lit(everything), F.col(st).cast("string"))))


def summarize(
    df: DataFrame, labels: Sequence[str], metrics: Sequence[str], cl: str, *, method: str = "cluster", st: str | None = None, **kw
) -> DataFrame:
    """One interval row per label combination and metric, in a single grouped job."""
    keep = [*labels, cl] + ([st] if st else [])
    long = df.select(*keep, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(keep, list(metrics), "metric", "value_")
    by = [*labels, "metric"]
    if method == "cluster":
        return cluster_bootstrap(long, by, "value_", cl, **kw)
    if method == "stratified":
        return stratified_bootstrap(long, by, "value_", cl, st, **kw)
    if method == "wild":
        return wild_cluster(long, by, "value_", cl, **kw)
    raise ValueError(f"unknown method: {method}")
