"""Numbering and ranking rows inside groups of any size.

A plain ``row_number`` window sorts one group in one task. Here a group larger
than ``rows_per_split`` is first cut at sampled key values into ranges that
sort in different tasks; range offsets come from small per-range counts. The
sample is taken by hash, so a re-run of any task cuts at the same values.
Rows with a NULL group key are left out, as in a pandas groupby.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankloom.session import settle

ROWS_PER_SPLIT = 1_000_000
MAX_SPLITS = 512


def desc(name: str) -> Column:
    """Descending key of a numeric column."""
    return (-F.col(name)).alias("neg_" + name)


def hash_unit(*cols: Column | str) -> Column:
    """Uniform [0, 1) number that depends on the values only."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / float(1 << 30)


def ordinals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column | str],
    *,
    pos: str = "pos",
    total: str = "n_group",
    weight: str | None = None,
    rows_per_split: int = ROWS_PER_SPLIT,
    max_splits: int = MAX_SPLITS,
) -> DataFrame:
    """Add the 1-based position of each row in its group and the group total.

    ``order`` must be a total order. With ``weight``, ``pos`` is the sum of the
    weights of the earlier rows and ``total`` the sum over the group. Counts the
    groups first: only if one is too large for a task does the plan split.
    """
    base = df
    keys = list(by)
    if not keys:
        keys = ["_all"]
        base = base.withColumn("_all", F.lit(0))
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    base = base.withColumn("_key", key)
    large = (
        base.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > rows_per_split)
    )
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    if large.isEmpty():
        group = W.partitionBy(*keys)
        if weight:
            place = F.coalesce(F.sum(weight).over(group.orderBy("_key").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        else:
            place = F.row_number().over(group.orderBy("_key")).cast("long")
        return base.withColumns({pos: place, total: amount.over(group)}).select(*df.columns, pos, total)
    cuts = (
        base.select(*keys, "_key")
        .join(large, keys)
        .where(
            hash_unit("_key", *keys)
            < F.least(F.lit(float(max_splits)), F.ceil(F.col("_n") / rows_per_split)) / F.col("_n")
        )
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set("_key")).alias("_cuts"))
    )
    part = (
        base.join(cuts, keys, "left")
        .withColumn(
            "_b",
            F.when(F.col("_cuts").isNull(), 0).otherwise(
                F.size(F.filter("_cuts", lambda c: c < F.col("_key")))
            ),
        )
        .drop("_cuts")
    )
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        part.groupBy(*keys, "_b")
        .agg(amount.alias("_amount"))
        .select(
            *keys,
            "_b",
            F.coalesce(F.sum("_amount").over(earlier), F.lit(0)).alias("_start"),
            F.sum("_amount").over(W.partitionBy(*keys)).alias(total),
        )
    )
    inside = W.partitionBy(*keys, "_b").orderBy("_key")
    if weight:
        step = F.coalesce(F.sum(weight).over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    else:
        step = F.row_number().over(inside).cast("long")
    out = (
        part.repartition(*keys, "_b")
        .withColumn("_step", step)
        .join(starts, [*keys, "_b"])
        .withColumn(pos, F.col("_start") + F.col("_step"))
    )
    return out.select(*df.columns, pos, total)


def value_ranks(df: DataFrame, by: Sequence[str], value: str, *, weight: str | None = None, **kw) -> DataFrame:
    """One row per distinct value of a group: its average rank, centred on zero.

    Equal rows collapse before the ranking, so a value shared by a third of
    the table costs one row. Gives (by, value, _rank, _rank_centred, _n_equal, _n_total).
    """
    amount = F.sum(weight) if weight else F.count(F.lit(1))
    v = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(amount.alias("_n_equal"))
    o = ordinals(v, by, [value], pos="_before", total="_n_total", weight="_n_equal", **kw)
    return o.withColumn("_rank", F.col("_before") + (F.col("_n_equal") + 1) / 2).withColumn(
        "_rank_centred", F.col("_rank") - (F.col("_n_total") + 1) / 2
    ).drop("_before")


def quantiles(df: DataFrame, by: Sequence[str], value: str, qs: Mapping[str, float], *, count: str | None = None, **kw) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per name, and the
    number of values as ``count``.

    The ``percentile`` aggregate holds all distinct values of a group in one
    task; here values are folded with their counts, placed by ``ordinals`` and
    only the two neighbours of each quantile reach the final aggregate.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_q")).agg(F.count(F.lit(1)).alias("_w"))
    o = ordinals(settle(v), by, ["_q"], pos="_before", total="_tot", weight="_w", **kw)
    aggs = []
    for i, q in enumerate(qs.values()):
        if q in (0, 1):
            aggs.append((F.max if q else F.min)("_q").alias(f"_end{i}"))
            continue
        at = (F.col("_tot") - 1) * q
        for side, pos in (("lo", F.floor(at)), ("hi", F.least(F.floor(at) + 1, F.col("_tot") - 1))):
            hit = (F.col("_before") <= pos) & (pos < F.col("_before") + F.col("_w"))
            aggs.append(F.max(F.when(hit, F.col("_q"))).alias(f"_{side}{i}"))
    out = o.groupBy(*by).agg(F.max("_tot").alias("_tot"), *aggs)
    cols = []
    for i, (name, q) in enumerate(qs.items()):
        if q in (0, 1):
            cols.append(F.col(f"_end{i}").alias(name))
            continue
        part = (F.col("_tot") - 1) * q - F.floor((F.col("_tot") - 1) * q)
        cols.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * part).alias(name))
    if count:
        cols.append(F.col("_tot").cast("long").alias(count))
    return out.select(*by, *cols)


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each group; an aggregate with map-side combine, not a sort."""
    key = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])
    rest = [c for c in df.columns if c not in by]
    picked = df.groupBy(*by).agg(F.min_by(F.struct(*rest), key).alias("_row"))
    return picked.select(*[F.col(c) if c in by else F.col("_row")[c].alias(c) for c in df.columns])


def quota_head(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, *, strict: bool = False) -> DataFrame:
    """First ``n`` rows per group. ``strict`` fails a group that has fewer rows."""
    keys = [(F.col(c) if isinstance(c, str) else c) for c in order]
    out = df.withColumn("pos", F.row_number().over(W.partitionBy(*by).orderBy(*keys))).where(F.col("pos") <= n)
    if strict:
        met = F.count(F.lit(1)).over(W.partitionBy(*by)) >= n
        out = out.withColumn("_met", met).where(
            F.when(F.col("_met"), True).otherwise(
                F.raise_error(F.concat(F.lit(f"quota of {n} not met for "), F.to_json(F.struct(*by)))).cast("boolean")
            )
        ).drop("_met")
    return out


def tertiles(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], *, name: str = "tertile", **kw) -> DataFrame:
    """Low / middle / high thirds by position under a total order."""
    o = ordinals(df, by, order, pos="_pos", total="_tot", **kw)
    third = (F.col("_tot") - 1) / 3
    return o.withColumn(
        name,
        F.when(F.col("_pos") <= 1 + third, "low").when(F.col("_pos") <= 1 + 2 * third, "middle").otherwise("high"),
    ).drop("_pos", "_tot")


def equal_width_sample(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], count: int, **kw) -> DataFrame:
    """Rows at the centres of ``count`` equal-width bins of the group's order.

    Row i (0-based) is kept when i = floor((k + 0.5) n / count) for some k.
    """
    o = ordinals(df, by, order, pos="_pos", total="_tot", **kw)
    k = F.ceil(((F.col("_pos") - 1) * count) / F.col("_tot") - 0.5)
    for_k = [k - 1, k, k + 1]
    hit = F.lit(False)
    for c in for_k:
        hit = hit | (
            (c >= 0) & (c < count)
            & (F.floor((c + F.lit(0.5)) * F.col("_tot") / count) == F.col("_pos") - 1)
        )
    return o.where(hit).withColumn("sample_pos", F.col("_pos") - 1).drop("_pos", "_tot")


def interleave_split(
    df: DataFrame, cls: str, order: Sequence[Column | str], sizes: Sequence[tuple[str, int]], *, label: str = "split", **kw
) -> DataFrame:
    """Deal the classes round-robin, then cut the deal into named runs.

    Rows past the last run are left out, as the run sizes fix the panel.
    """
    inner = ordinals(df, [cls], order, pos="_turn", total="_c", **kw)
    dealt = ordinals(inner, [], ["_turn", cls], pos="deal", total="_t", **kw)
    edge, name = 0, F.lit(None).cast("string")
    for text, size in reversed(_edges(sizes)):
        name = F.when(F.col("deal") <= size, text).otherwise(name)
    return dealt.withColumn(label, name).where(F.col(label).isNotNull()).drop("_turn", "_c", "_t")


def _edges(sizes: Sequence[tuple[str, int]]) -> list[tuple[str, int]]:
    out, edge = [], 0
    for text, size in sizes:
        edge += size
        out.append((text, edge))
    return out


def shuffle_within(df: DataFrame, by: Sequence[str], key: Sequence[str], cols: Sequence[str], mixed: Column, **kw) -> DataFrame:
    """Permute ``cols`` between the rows of a group.

    The row at key position i gets the columns of the row at position i under
    the ``mixed`` order. Adds ``moved``: the donor is another row.
    """
    here = ordinals(df, by, list(key), pos="_i", total="_n", **kw).drop(*cols, "_n")
    there = ordinals(df.withColumn("_mix", mixed), by, ["_mix", *key], pos="_i", total="_n", **kw)
    donor = there.select(*by, "_i", F.struct(*key).alias("_donor"), *cols)
    return (
        here.join(donor, [*by, "_i"])
        .withColumn("moved", F.struct(*key) != F.col("_donor"))
        .drop("_i", "_donor")
    )


def rolling_mean(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], radius: int, *, block: int = 100_000) -> DataFrame:
    """Centred rolling mean over a contiguous 0-based integer position.

    Groups are cut into blocks of positions; each block also receives the
    ``radius`` rows on either side, so a long group spreads over many tasks.
    """
    b = F.floor(F.col(order) / block).cast("long")
    lo = F.floor((F.col(order) - radius) / block).cast("long")
    hi = F.floor((F.col(order) + radius) / block).cast("long")
    copies = df.withColumn("_b", F.explode(F.sequence(lo, hi))).repartition(*by, "_b")
    w = W.partitionBy(*by, "_b").orderBy(order).rowsBetween(-radius, radius)
    out = copies.withColumns({f"{c}_mean": F.avg(F.col(c).cast("double")).over(w) for c in cols})
    return out.where(F.col("_b") == b).drop("_b")
