"""Summaries over scored rows: native metrics, consensus, shifts, coverage, maps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import vectors as V
from rankloom.operators import inference as I
from rankloom.operators.ordering import first_per, quantiles
from rankloom.session import settle

SCHEMES = ("unscaled_equal", "action_rms_matched", "joint_temperature_native_nll", "rowwise_rank_normalized")


def native_metrics(df: DataFrame, by: Sequence[str], logp: str, idx: str) -> DataFrame:
    """Native negative log-likelihood, top-1 recovery and mean reciprocal rank."""
    return df.groupBy(*by).agg(
        F.avg(-F.element_at(logp, F.col(idx))).alias("nll"),
        F.avg((V.argmax(logp) == F.col(idx)).cast("double")).alias("top1_recovery"),
        F.avg(F.lit(1.0) / V.entry_rank(logp, idx)).alias("mean_reciprocal_rank"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def melt(df: DataFrame, ids: Sequence[str], axes: Sequence[str], axis: str = "environment_axis", label: str = "environment") -> DataFrame:
    return df.select(*ids, *[F.col(a).cast("string").alias(a) for a in axes]).unpivot(list(ids), list(axes), axis, label)


def pivot_first(df: DataFrame, keys: Sequence[str], col: str, value: str, levels: Sequence[str]) -> DataFrame:
    """Long to wide; with repeated keys the smallest value is kept, so the choice is stable."""
    return df.groupBy(*keys).agg(*[F.min(F.when(F.col(col) == l, F.col(value))).alias(l) for l in levels])


def environment_summary(df: DataFrame, ids: Sequence[str], axes: Sequence[str], value: str, cl: str, **kw) -> DataFrame:
    """Interval per id combination, environment axis and environment."""
    long = melt(df, [*ids, value, cl], axes)
    return I.cluster_bootstrap(long, [*ids, "environment_axis", "environment"], value, cl, **kw)


def _by_entry(df: DataFrame, keys: Sequence[str], vec: str, entry: Column) -> DataFrame:
    """Aggregate vectors entry by entry, then pack them again."""
    long = df.select(*keys, F.posexplode(vec).alias("_i", "_x"))
    agg = long.groupBy(*keys, "_i").agg(entry.alias("_y"))
    packed = agg.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_y"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda s: s["_y"]).alias(vec))


def mean_vector(df: DataFrame, keys: Sequence[str], vec: str, n: int) -> DataFrame:
    """Mean of fixed-length vectors, without exploding them."""
    out = df.groupBy(*keys) if keys else df.groupBy()
    return out.agg(
        F.array(*[F.avg(F.get(vec, F.lit(i))) for i in range(n)]).alias(vec)
    )


def consensus(df: DataFrame, keys: Sequence[str], vec: str, how: str = "mean", temperature: str | None = None, n: int = 20) -> DataFrame:
    """Mean, temperature-scaled mean or median of the scorers' vectors of a key."""
    at = lambda i: F.get(vec, F.lit(i))
    if how == "mean":
        cols = [F.avg(at(i)) for i in range(n)]
    elif how == "temperature":
        cols = [F.avg(at(i) / F.col(temperature)) for i in range(n)]
    elif how == "median":
        cols = [F.percentile(at(i), 0.5) for i in range(n)]
    else:
        raise ValueError(f"unknown consensus: {how}")
    return df.groupBy(*keys).agg(F.array(*cols).alias(vec))


def leave_one_out_consensus(df: DataFrame, keys: Sequence[str], id: str, vec: str, n: int = 20) -> DataFrame:
    """Mean of the other scorers for every scorer of a key, from one sum per key."""
    sums = df.groupBy(*keys).agg(
        F.array(*[F.sum(F.get(vec, F.lit(i))) for i in range(n)]).alias("_sum"), F.count(F.lit(1)).alias("_n")
    ).where("_n > 1")
    out = df.join(sums, list(keys))
    rest = F.zip_with("_sum", vec, lambda s, x: (s - x) / (F.col("_n") - 1))
    return out.select(*keys, F.col(id).alias("left_out"), rest.alias(vec))


def log_mean_exp(df: DataFrame, keys: Sequence[str], vec: str, n: int = 20) -> DataFrame:
    """Average of probability draws in log space, and the largest spread of an entry."""
    at = lambda i: F.get(vec, F.lit(i))
    # Log-probabilities are at most 0, so exp cannot overflow; a common shift per
    # key keeps very small draws from vanishing.
    top = df.groupBy(*keys).agg(F.array(*[F.max(at(i)) for i in range(n)]).alias("_top"))
    out = df.join(top, list(keys)).groupBy(*keys).agg(
        F.array(*[F.max(F.get("_top", F.lit(i))) + F.log(F.avg(F.exp(at(i) - F.get("_top", F.lit(i))))) for i in range(n)]).alias(vec),
        F.greatest(*[F.max(at(i)) - F.min(at(i)) for i in range(n)]).alias("order_spread"),
    )
    return out.withColumn(vec, V.log_normalize(vec))


def apply_calibration(scheme: str, params: Sequence[tuple[str, float]], idx: str | None = None, n: int = 20) -> Column:
    """Equal mean of calibrated action vectors.

    ``params`` pairs a vector column with its scale, temperature or rank scale.
    """
    out = None
    for name, p in params:
        if scheme == "unscaled_equal":
            v = F.col(name)
        elif scheme == "action_rms_matched":
            v = V.scale(name, p)
        elif scheme == "joint_temperature_native_nll":
            v = V.scale(name, 1.0 / p)
        elif scheme == "rowwise_rank_normalized":
            v = V.scale(V.rank_normal(name, n), p)
        else:
            raise ValueError(f"unknown calibration scheme: {scheme}")
        out = v if out is None else V.add(out, v)
    return V.scale(out, 1.0 / len(params))


def agreement_gate(df: DataFrame, vecs: Sequence[str], mut: Column, t: float = 0.30) -> DataFrame:
    """Gate: all scorers give the mutation one sign and rank alike enough."""
    values = [F.element_at(v, mut) for v in vecs]
    return df.withColumns({"rank_agreement": V.agreement(vecs), "signs_agree": V.same_sign(values)}).withColumn(
        "gate", F.col("signs_agree") & F.coalesce(F.col("rank_agreement") >= t, F.lit(False))
    )


def conditional_mean_vector(train: DataFrame, df: DataFrame, by: str, vec: str, n: int = 20) -> DataFrame:
    """Attach the training mean vector of the row's class, or the overall mean."""
    per = mean_vector(train, [by], vec, n).withColumnRenamed(vec, "_class_mean")
    # The overall mean is one row and the classes are the symbols.
    overall = mean_vector(train, [], vec, n).withColumnRenamed(vec, "_all_mean")
    return (
        df.join(per, by, "left")
        .join(F.broadcast(overall))
        .withColumn("mean_vec", F.coalesce("_class_mean", "_all_mean"))
        .drop("_class_mean", "_all_mean")
    )


def anchored_fit(df: DataFrame, by: Sequence[str], pred: str, obs: str, idx: str) -> DataFrame:
    """RMS sizes, error and R2 of anchored vectors over their off-anchor entries."""
    rows = df.select(*by, V.off_index(pred, idx).alias("p"), V.off_index(obs, idx).alias("o")).select(
        *by,
        V.vsumsq("p").alias("pp"),
        V.vsumsq("o").alias("oo"),
        V.vsum("o").alias("so"),
        V.vsumsq(V.subtract("p", "o")).alias("ee"),
        F.size("p").alias("n"),
    )
    s = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("pp", "oo", "so", "ee", "n")])
    tss = F.col("oo") - F.col("so") * F.col("so") / F.col("n")
    a, b = F.sqrt(F.col("pp") / F.col("n")), F.sqrt(F.col("oo") / F.col("n"))
    return s.select(
        *by,
        a.alias("action_rms"),
        b.alias("observed_rms"),
        (b / F.when(a > 0, a)).alias("scale_ratio"),
        F.sqrt(F.col("ee") / F.col("n")).alias("anchored_rmse"),
        (1 - F.col("ee") / F.when(tss > 0, tss)).alias("anchored_r2"),
    )


SHIFT_METRICS = (
    "jsd", "entropy", "entropy_change", "entropy_shift", "max_probability", "top3_mass", "l2", "min_logp", "extreme_fraction",
)


def distribution_shift(df: DataFrame, paired: str, other: str, by: Sequence[str], entity: str, limit: float = 10.0) -> DataFrame:
    """Shift of ``other`` from ``paired``: position values, entity means, then
    mean, median and spread over entities, long by metric."""
    change = V.entropy(other) - V.entropy(paired)
    rows = df.select(
        *by, entity,
        V.jsd(paired, other).alias("jsd"), V.entropy(other).alias("entropy"), change.alias("entropy_change"),
        F.abs(change).alias("entropy_shift"), V.max_probability(other).alias("max_probability"),
        V.top_mass(other).alias("top3_mass"), V.l2_distance(paired, other).alias("l2"),
        F.array_min(other).alias("min_logp"), V.extreme_fraction(other, limit).alias("extreme_fraction"),
    )
    ent = rows.groupBy(*by, entity).agg(*[F.avg(m).alias(m) for m in SHIFT_METRICS])
    long = settle(ent.unpivot([*by, entity], list(SHIFT_METRICS), "metric", "_v"))
    moments = long.groupBy(*by, "metric").agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count(F.lit(1)).alias("n_entities")
    )
    return moments.join(quantiles(long, [*by, "metric"], "_v", {"median": 0.5}), [*by, "metric"])


def condition_validity(
    dist: DataFrame, by: Sequence[str], entity: str, reliability: str,
    max_jsd: float = 0.10, max_entropy: float = 0.25, min_fraction: float = 0.80, min_rho: float = 0.50,
) -> DataFrame:
    """Whether a condition stays in range: median shifts, passing entities, seed reliability.

    ``dist`` holds one row per condition and entity with jsd, entropy_shift and
    the reliability column.
    """
    ok = (F.col("jsd") <= max_jsd) & (F.col("entropy_shift") <= max_entropy)
    dist = settle(dist.select(*by, entity, "jsd", "entropy_shift", F.col(reliability).alias("_rel")))
    s = dist.groupBy(*by).agg(F.avg(ok.cast("double")).alias("passing_fraction"), F.count_distinct(entity).alias("n_entities"))
    for col, name in (("jsd", "median_jsd"), ("entropy_shift", "median_entropy_shift"), ("_rel", "median_reliability")):
        s = s.join(quantiles(dist, by, col, {name: 0.5}), list(by), "left")
    valid = (
        (F.col("median_jsd") <= max_jsd)
        & (F.col("median_entropy_shift") <= max_entropy)
        & (F.col("passing_fraction") >= min_fraction)
        & (F.col("median_reliability") >= min_rho)
    )
    return s.withColumn("valid", F.coalesce(valid, F.lit(False)))


def smd_table(left: DataFrame, right: DataFrame, by: Sequence[str], cols: Sequence[str], limit: float = 0.10) -> DataFrame:
    """Standardised mean difference per column, pooled sample variance, pass flag."""
    long = lambda d, side: d.select(
        *by, F.lit(side).alias("_side"), *[V.finite(c).alias(c) for c in cols]
    ).unpivot([*by, "_side"], list(cols), "covariate", "_v")
    both = long(left, 1).unionByName(long(right, 0)).groupBy(*by, "covariate")
    on, off = F.when(F.col("_side") == 1, F.col("_v")), F.when(F.col("_side") == 0, F.col("_v"))
    s = both.agg(
        F.avg(on).alias("m1"), F.avg(off).alias("m0"), F.var_samp(on).alias("v1"), F.var_samp(off).alias("v0")
    )
    sd, gap = F.sqrt((F.col("v1") + F.col("v0")) / 2), F.col("m1") - F.col("m0")
    smd = F.when(sd > 0, gap / F.when(sd > 0, sd)).when(gap == 0, 0.0).when(gap.isNull(), None).otherwise(
        F.when(gap > 0, float("inf")).otherwise(float("-inf"))
    )
    return s.select(*by, "covariate", F.col("m1").alias("mean_left"), F.col("m0").alias("mean_right"), smd.alias("smd")).withColumn(
        "passed", F.coalesce(F.abs("smd") <= limit, F.lit(False))
    )


def matched_effects(
    matches: DataFrame, by: Sequence[str], value: str, cl: str, targets: DataFrame, balance: DataFrame,
    min_fraction: float = 0.70, max_smd: float = 0.10, **kw,
) -> DataFrame:
    """Effect interval with match fraction, worst balance and a quality flag."""
    effect = I.cluster_bootstrap(matches, by, value, cl, **kw)
    n = targets.groupBy(*by).agg(F.count(F.lit(1)).alias("n_targets"))
    worst = balance.groupBy(*by).agg(F.max(F.abs("smd")).alias("maximum_absolute_smd"))
    out = effect.join(n, list(by), "full").join(worst, list(by), "left")
    fraction = F.coalesce("n_rows", F.lit(0)) / F.col("n_targets")
    return out.withColumn("match_fraction", fraction).withColumn(
        "matching_quality_pass",
        F.coalesce((F.col("match_fraction") >= min_fraction) & (F.col("maximum_absolute_smd") <= max_smd), F.lit(False)),
    )


def state_metrics(pos: DataFrame, keys: Sequence[str], edited: Column, value: str, gap: str, confident: float = 0.50) -> DataFrame:
    """Per state: mean value at edited positions, share of confident errors, count."""
    return pos.where(edited).groupBy(*keys).agg(
        F.avg(value).alias("mean_value"),
        F.avg((F.col(gap) >= confident).cast("double")).alias("confident_error_fraction"),
        F.count(F.lit(1)).alias("n_edited"),
    )


def cost_summary(scores: DataFrame, request: Sequence[str], entity: str, by: Sequence[str], seconds: str, calls: str, residues: str) -> DataFrame:
    """Cost per condition. A request's cost is repeated on its rows: take it once."""
    once = scores.groupBy(*by, entity, *request).agg(
        F.max(seconds).alias("s"), F.max(calls).alias("c"), F.max(residues).alias("r")
    )
    per = once.groupBy(*by, entity).agg(
        F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("k")
    )
    per = settle(per)
    totals = per.groupBy(*by).agg(
        F.sum("k").alias("n_requests"), F.count(F.lit(1)).alias("n_entities"), F.sum("c").alias("calls"),
        F.sum("s").alias("seconds_total"), (F.sum("s") / F.nullif(F.sum("r"), F.lit(0))).alias("seconds_per_residue"),
    )
    return totals.join(quantiles(per, by, "s", {"median_seconds_per_entity": 0.5}), list(by))


def variant_coverage(variants: DataFrame, known: DataFrame, scored: DataFrame, by: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Per group: all variants, those at known positions, those scored, and a status."""
    k = known.select(*key).distinct().withColumn("_known", F.lit(1))
    s = scored.select(*key).distinct().withColumn("_scored", F.lit(1))
    out = variants.join(k, list(key), "left").join(s, list(key), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_variants"),
        F.count("_known").alias("known_position_variants"),
        F.count(F.when(F.col("_known").isNotNull(), F.col("_scored"))).alias("scored_variants"),
    )
    return out.withColumn("coverage_fraction", F.col("scored_variants") / F.col("total_variants")).withColumn(
        "status",
        F.when(F.col("scored_variants") == F.col("total_variants"), "complete")
        .when(F.col("scored_variants") == 0, "missing")
        .otherwise("partial"),
    )


def collapse_measurements(df: DataFrame, keys: Sequence[str], value: str, flip: bool = True) -> DataFrame:
    """Median of repeated measurements with count and range; sign flipped first."""
    v = V.finite(value)
    v = -v if flip else v
    rows = df.select(*keys, v.alias("_v")).where("_v IS NOT NULL")
    # The ends are quantiles too, so nothing is grouped twice or joined.
    out = quantiles(rows, keys, "_v", {"effect_min": 0.0, "effect_max": 1.0, "effect": 0.5}, count="n_measurements")
    known = out.dropna(subset=list(keys))
    return known.select(*keys, "n_measurements", "effect_min", "effect_max", "effect")


def shapley(subset_means: DataFrame, players: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Shapley value of each scorer from one value per subset.

    ``subset_means`` has (by, mask, value); bit i of ``mask`` is players[i] and
    mask 0 is the empty set. Each subset joins the one without the player.
    """
    from math import factorial

    n = len(players)
    weights = F.array(*[F.lit(factorial(k) * factorial(n - 1 - k) / factorial(n)) for k in range(n)])
    bits = F.array(*[F.lit(1 << i) for i in range(n)])
    sides = subset_means.select("*", F.posexplode(bits).alias("_i", "_bit"))
    having = F.col("mask").bitwiseAND(F.col("_bit")) != 0
    # Both sides of a pair share the mask without the player's bit.
    paired = sides.withColumn("_rest", F.col("mask").bitwiseAND(F.bitwise_not(F.col("_bit")))).groupBy(*by, "_i", "_rest").agg(
        F.max(F.when(having, F.col("value"))).alias("_with"), F.max(F.when(~having, F.col("value"))).alias("_without")
    )
    names = F.array(*[F.lit(p) for p in players])
    gain = F.element_at(weights, F.bit_count("_rest") + 1) * (F.col("_with") - F.col("_without"))
    return paired.groupBy(*by, F.element_at(names, F.col("_i") + 1).alias("scorer")).agg(F.sum(gain).alias("shapley"))


MAP_KEYS = ["analysis_role", "state_kind", "level", "environment_axis", "environment"]


def distillability_map(
    value: DataFrame, spec: DataFrame, obs: DataFrame, rel: DataFrame, keys: Sequence[str] = MAP_KEYS,
    min_value: float = 0.02, min_lift: float = 0.02, min_jsd: float = 0.01, min_cosine: float = 0.10,
) -> DataFrame:
    """Join value (estimate, ci_low), specificity (lift), observability (jsd_reduction,
    residual_cosine) and reliability, then class each environment."""
    k = list(keys)
    out = value.join(spec, k, "left").join(obs, k, "left").join(rel, k, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({
        "high_action_value": yes((F.col("estimate") >= min_value) & (F.col("ci_low") > 0)),
        "target_specific": yes(F.col("lift") >= min_lift),
        "sequence_observable": yes((F.col("jsd_reduction") >= min_jsd) & (F.col("residual_cosine") >= min_cosine)),
    })
    hv, ts, so = F.col("high_action_value"), F.col("target_specific"), F.col("sequence_observable")
    return out.withColumn("distillable", hv & ts & so).withColumn(
        "map_class",
        F.when(F.col("distillable"), "distillable").when(hv & ~so, "valuable_but_unobservable").when(~ts, "nonspecific").otherwise("low_value"),
    )


def valid_radius(table: DataFrame, by: Sequence[str], level: str = "level", min_value: float = 0.02) -> DataFrame:
    """Largest level whose mean passes with a positive lower bound; 0 if none."""
    per = table.groupBy(*by, level).agg(F.avg("estimate").alias("_m"), F.min("ci_low").alias("_lo"))
    ok = F.coalesce((F.col("_m") >= min_value) & (F.col("_lo") > 0), F.lit(False))
    return per.groupBy(*by).agg(
        F.coalesce(F.max(F.when(ok, F.col(level))), F.lit(0.0)).alias("valid_radius"),
        F.max(level).alias("tested_maximum"),
        F.count_if(ok).alias("passing_levels"),
        F.count(F.lit(1)).alias("tested_levels"),
    )


def control_gaps(df: DataFrame, by: Sequence[str], entity: str, control: str, observed: str, value: str, repeat: str) -> DataFrame:
    """Observed value minus the one control (and repeat) with the highest mean over entities."""
    obs = df.where(F.col(control) == observed).select(*by, entity, F.col(value).alias("observed_value"))
    means = df.where(F.col(control) != observed).groupBy(*by, control, repeat).agg(F.avg(value).alias("_m"))
    best = first_per(means, by, [(-F.col("_m")).alias("neg"), control, repeat]).drop("_m")
    ctrl = df.join(best, [*by, control, repeat]).select(*by, entity, F.col(control).alias("strongest_control"), F.col(value).alias("control_value"))
    return obs.join(ctrl, [*by, entity]).withColumn("gap", F.col("observed_value") - F.col("control_value"))


def geometry_summary(df: DataFrame, by: Sequence[str], entity: str, metrics: Sequence[str], **kw) -> DataFrame:
    """Entity means with an interval, and pooled median and 90th percentile, per metric."""
    long = df.select(*by, entity, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([*by, entity], list(metrics), "metric", "_v")
    pooled = quantiles(long, [*by, "metric"], "_v", {"pooled_p50": 0.5, "pooled_p90": 0.9})
    ent = I.cluster_bootstrap(long, [*by, "metric"], "_v", entity, **kw)
    return ent.join(pooled, [*by, "metric"])


def role_availability(df: DataFrame, by: Sequence[str], entity: str, min_entities: int) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities")).withColumn(
        "available", F.col("n_entities") >= min_entities
    )


def figure_source(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    q = quantiles(df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return q.join(df.groupBy(*by).agg(F.count(value).alias("n_rows")), list(by))
