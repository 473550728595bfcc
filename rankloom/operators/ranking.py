"""Ranking metrics per entity, exact under ties and for entities of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from rankloom.functions.vectors import finite
from rankloom.operators.inference import rank_ratio, rank_sums, ranked_columns, weighted_spearman
from rankloom.operators.ordering import ROWS_PER_SPLIT, desc, ordinals
from rankloom.operators.resampling import rank_correlations
from rankloom.session import settle

METRICS = ("spearman", "full_ndcg", "top_ndcg", "top_recall")


def corr_column(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation, NULL when a side is constant."""
    d = F.stddev_pop(x) * F.stddev_pop(y)
    return F.covar_pop(x, y) / F.when(d > 0, d)


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, **kw) -> DataFrame:
    rows = df.select(*by, finite(x).alias(x), finite(y).alias(y), F.lit(1).cast("long").alias("_one"))
    return weighted_spearman(rows, list(by), x, y, "_one", **kw).withColumnRenamed("stat", "spearman")


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    rows = df.select(*by, finite(x).alias("x"), finite(y).alias("y")).dropna(subset=["x", "y"])
    return rows.groupBy(*by).agg(corr_column("x", "y").alias("pearson"), F.count(F.lit(1)).alias("n_rows"))


def sign_agreement(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg((F.signum(x) == F.signum(y)).cast("double")).alias("sign_agreement")
    )


def calibration_slope(df: DataFrame, by: Sequence[str], score: str, y: str) -> DataFrame:
    """Slope of the outcome on the score, raw and after standardising both."""
    var = F.var_pop(score)
    return df.dropna(subset=[score, y]).groupBy(*by).agg(
        (F.covar_pop(score, y) / F.when(var > 0, var)).alias("slope"),
        corr_column(score, y).alias("standardized_slope"),
    )


def slope_error_reduction(base: Column, other: Column) -> Column:
    """How much nearer to one the slope of ``other`` is."""
    return F.abs(base - 1) - F.abs(other - 1)


def _cut(n: Column, fraction: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * fraction))


def _discount(pos: str) -> Column:
    return F.lit(1.0) / F.log2(F.col(pos) + 1)


def ndcg(df: DataFrame, by: Sequence[str], score: str, y: str, key: Sequence[str], k: int | None = None, fraction: float | None = None, **kw) -> DataFrame:
    """Discounted gain over the ideal one; gain is y minus the entity's lowest y.

    Rows with equal scores share the mean of their discounts. ``k`` or
    ``fraction`` cuts both lists; NULL when all gains are zero.
    """
    by = list(by)
    rows = df.dropna(subset=[score, y]).select(*by, *key, score, y)
    low = rows.groupBy(*by).agg(F.min(y).alias("_low"))
    sorted_s = ordinals(rows, by, [desc(score), *key], pos="_p", total="_n", **kw)
    sorted_y = ordinals(rows, by, [desc(y), *key], pos="_p", total="_n", **kw)
    cut = F.lit(k) if k else (_cut(F.col("_n"), fraction) if fraction else F.col("_n"))
    disc = F.when(F.col("_p") <= cut, _discount("_p")).otherwise(0.0)
    ties = sorted_s.groupBy(*by, score).agg(F.sum(disc).alias("_d"), F.avg(y).alias("_g"))
    got = (
        ties.join(low, by)
        .groupBy(*by)
        .agg(F.sum(F.col("_d") * (F.col("_g") - F.col("_low"))).alias("_dcg"))
    )
    best = (
        sorted_y.where(F.col("_p") <= cut)
        .join(low, by)
        .groupBy(*by)
        .agg(F.sum(_discount("_p") * (F.col(y) - F.col("_low"))).alias("_ideal"))
    )
    return got.join(best, by).select(
        *by, (F.col("_dcg") / F.when(F.col("_ideal") > 0, F.col("_ideal"))).alias("ndcg")
    )


def topk_recall(df: DataFrame, by: Sequence[str], score: str, y: str, key: Sequence[str], fraction: float = 0.1, **kw) -> DataFrame:
    """Positives among the top fraction over the most that could be there."""
    by = list(by)
    rows = df.dropna(subset=[score, y]).select(*by, *key, score, y)
    o = ordinals(rows, by, [desc(score), *key], pos="_p", total="_n", **kw)
    top = F.col("_p") <= _cut(F.col("_n"), fraction)
    pos = F.col(y) > 0
    agg = o.groupBy(*by).agg(
        F.count_if(top & pos).alias("_hits"),
        F.least(F.max(_cut(F.col("_n"), fraction)), F.count_if(pos)).alias("_most"),
    )
    return agg.select(*by, (F.col("_hits") / F.when(F.col("_most") > 0, F.col("_most"))).alias("topk_recall"))


def entity_metrics(
    df: DataFrame, entity: Sequence[str], methods: Sequence[str], y: str, key: Sequence[str], fraction: float = 0.1, min_rows: int = 0, settled: bool = False, **kw
) -> DataFrame:
    """Long table (entity, method): rank correlation, full and top gain, recall, slope.

    A method is measured on the rows that have its score and the outcome: ranks,
    lowest outcome, ideal gain and cut all come from these, so a missing score
    counts for that method alone. Methods with fewer than ``min_rows`` such rows are
    left out; an entity that has no more outcomes is not measured. ``settled`` rows are cheap to read again. ``key`` orders rows of equal value. Entities
    of up to ``rows_per_split`` rows are measured by one task each, with one sort
    per method; larger ones are ranked over many tasks.
    """
    entity, key, methods = list(entity), list(key), list(methods)
    known = df.select(*entity, *key, finite(y).alias("_y"), *[finite(m).alias(m) for m in methods]).dropna(subset=["_y", *entity])
    rows = known if settled else settle(known)
    largest = rows.groupBy(*entity).count().agg(F.max("count")).first()[0] or 0
    if largest > kw.get("rows_per_split", ROWS_PER_SPLIT):
        return _ranked_metrics(rows, entity, methods, key, fraction, **kw).where(F.col("n_rows") >= min_rows)
    schema = T.StructType([*[rows.schema[e] for e in entity], T.StructField("method", T.StringType(), False), T.StructField("n_rows", T.LongType(), False), *[T.StructField(m, T.DoubleType()) for m in (*METRICS, "slope")]])

    types = [to_arrow_type(f.dataType) for f in schema]

    def measure(group: pa.Table) -> pa.Table:
        if group.num_rows < min_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=schema.names)
        order = pc.sort_indices(group, sort_keys=[(k, "ascending") for k in key], null_placement="at_start").to_numpy() if key else np.arange(group.num_rows)
        outcome = group.column("_y").to_numpy()[order]
        out = []
        for m in methods:
            score = group.column(m).to_numpy().astype(float)[order]
            there = ~np.isnan(score)
            if there.any() and there.sum() >= min_rows:
                out.append((m, int(there.sum()), *measures(score[there], outcome[there], fraction)))
        columns = [pa.array([group.column(e)[0].as_py()] * len(out), group.schema.field(e).type) for e in entity]
        values = list(zip(*out)) or [()] * (len(METRICS) + 3)
        kinds = [pa.string(), pa.int64(), *[pa.float64()] * (len(METRICS) + 1)]
        return pa.Table.from_arrays([*columns, *(pa.array(v, k) for v, k in zip(values, kinds))], names=schema.names)

    return rows.groupBy(*entity).applyInArrow(measure, schema)


def measures(score: np.ndarray, outcome: np.ndarray, fraction: float) -> tuple[float | None, ...]:
    """The metrics of one method in one entity, then its slope; rows come in key order."""
    n = len(score)
    place = np.empty(n, np.int64)
    order = np.argsort(-score, kind="stable")
    place[order] = np.arange(1, n + 1)
    cut = max(1, int(np.ceil(n * fraction)))
    top = place <= cut
    discount = 1.0 / np.log2(place + 1)
    low = outcome.min()
    # Rows of equal score share their discounts and their gains.
    _, which = np.unique(score, return_inverse=True)
    share = np.bincount(which)
    gain = np.bincount(which, outcome - low) / share
    ordered = 1.0 / np.log2(np.arange(2, n + 2)) * (np.sort(outcome)[::-1] - low)

    def part(gained: float, most: float) -> float | None:
        return float(gained / most) if most > 0 else None

    positive = outcome > 0
    varies = score.max() > score.min()
    rho = rank_correlations(score, outcome, np.ones((1, n)))[0]
    return (
        None if np.isnan(rho) else float(rho),
        part((np.bincount(which, discount) * gain).sum(), ordered.sum()),
        part((np.bincount(which, np.where(top, discount, 0.0)) * gain).sum(), ordered[:cut].sum()),
        part((top & positive).sum(), min(cut, positive.sum())),
        float(((score - score.mean()) * (outcome - outcome.mean())).mean() / score.var()) if varies else None,
    )


def _ranked_metrics(rows: DataFrame, entity: list[str], methods: list[str], key: list[str], fraction: float, **kw) -> DataFrame:
    """The same metrics for entities of any size: every method's rows are ranked by
    score and by outcome over many tasks."""
    by = [*entity, "method"]
    long = settle(rows.unpivot([*entity, *key, "_y"], methods, "method", "_s").dropna(subset=["_s"]))
    low = long.groupBy(*by).agg(F.min("_y").alias("_low"))
    ranked = settle(ordinals(long, by, [desc("_y"), *key], pos="_py", total="_ny", **kw))
    # Equal outcomes share a rank.
    shared = ranked.groupBy(*by, "_y").agg((F.max("_ny") / 2 + 0.5 - F.avg("_py")).alias("_ry"))
    o = ordinals(long.join(shared, [*by, "_y"]), by, [desc("_s"), *key], pos="_p", total="_n", **kw)
    top = F.col("_p") <= _cut(F.col("_n"), fraction)
    disc = _discount("_p")
    # One row per distinct score keeps every sum the metrics need.
    ties = o.groupBy(*by, "_s").agg(
        F.count(F.lit(1)).alias("_w"),
        F.max("_n").alias("_n"),
        (F.max("_n") / 2 + 0.5 - F.avg("_p")).alias("_rs"),
        F.sum(disc).alias("_d"),
        F.sum(F.when(top, disc).otherwise(0.0)).alias("_dk"),
        F.avg("_y").alias("_g"),
        F.sum("_ry").alias("_sry"),
        F.sum(F.col("_ry") * F.col("_ry")).alias("_sryy"),
        F.count_if(top & (F.col("_y") > 0)).alias("_hits"),
        F.count_if(F.col("_y") > 0).alias("_pos"),
    )
    gain = _discount("_py") * (F.col("_y") - F.col("_low"))
    ideal = ranked.join(low, by).groupBy(*by).agg(F.sum(gain).alias("_ideal"), F.sum(F.when(F.col("_py") <= _cut(F.col("_ny"), fraction), gain)).alias("_ideal_k"))
    slopes = long.groupBy(*by).agg((F.covar_pop("_s", "_y") / F.when(F.var_pop("_s") > 0, F.var_pop("_s"))).alias("slope"))
    sums = ties.join(low, by).groupBy(*by).agg(
        F.sum("_w").alias("n_rows"),
        F.sum(F.col("_rs") * F.col("_sry")).alias("_xy"),
        F.sum(F.col("_w") * F.col("_rs") * F.col("_rs")).alias("_xx"),
        F.sum("_sryy").alias("_yy"),
        F.sum(F.col("_d") * (F.col("_g") - F.col("_low"))).alias("_dcg"),
        F.sum(F.col("_dk") * (F.col("_g") - F.col("_low"))).alias("_dcg_k"),
        F.sum("_hits").alias("_hits"),
        F.least(F.max(_cut(F.col("_n"), fraction)), F.sum("_pos")).alias("_most"),
    )
    norm = F.sqrt(F.col("_xx") * F.col("_yy"))
    return sums.join(ideal, by).join(slopes, by).select(
        *by,
        "n_rows",
        (F.col("_xy") / F.when(norm > 0, norm)).alias("spearman"),
        (F.col("_dcg") / F.when(F.col("_ideal") > 0, F.col("_ideal"))).alias("full_ndcg"),
        (F.col("_dcg_k") / F.when(F.col("_ideal_k") > 0, F.col("_ideal_k"))).alias("top_ndcg"),
        (F.col("_hits") / F.when(F.col("_most") > 0, F.col("_most"))).alias("top_recall"),
        "slope",
    )


def metric_increments(metrics: DataFrame, keys: Sequence[str], baseline: str, cols: Sequence[str] = METRICS) -> DataFrame:
    """Every method minus the baseline method of the same entity."""
    base = metrics.where(F.col("method") == baseline).select(*keys, *[F.col(c).alias("_b_" + c) for c in cols])
    return (
        metrics.where(F.col("method") != baseline)
        .join(base, list(keys))
        .select(*keys, "method", *[(F.col(c) - F.col("_b_" + c)).alias(c) for c in cols])
    )


def subgroup_metrics(
    df: DataFrame, entity: Sequence[str], dims: Sequence[str], methods: Sequence[str], y: str, key: Sequence[str],
    min_rows: int = 10, fraction: float = 0.1, **kw,
) -> DataFrame:
    """Entity metrics inside every level of every dimension that has enough rows."""
    # Written before each row stands once per dimension.
    wide = settle(df.select(*entity, *key, y, *methods, *[F.col(d).cast("string").alias(d) for d in dims]))
    long = wide.unpivot(
        [*entity, *key, y, *methods], list(dims), "dimension", "level"
    ).dropna(subset=["level"])
    return entity_metrics(long, [*entity, "dimension", "level"], methods, y, key, fraction, min_rows, settled=True, **kw)


def concordance(df: DataFrame, entity: Sequence[str], role: str, ref: str, key: Sequence[str], value: str, **kw) -> DataFrame:
    """Rank correlation and mean absolute difference of each role to the reference role."""
    base = df.where(F.col(role) == ref).select(*entity, *key, F.col(value).alias("_ref"))
    pairs = df.where(F.col(role) != ref).join(base, [*entity, *key])
    by = [*entity, role]
    mae = pairs.groupBy(*by).agg(F.avg(F.abs(F.col(value) - F.col("_ref"))).alias("mae"))
    return spearman(pairs, by, value, "_ref", **kw).join(mae, by)


def assay_spearman(df: DataFrame, by: Sequence[str], score: str, y: str, min_n: int = 20, **kw) -> DataFrame:
    """Per-assay rank correlation for assays with at least ``min_n`` scored variants."""
    return spearman(df, by, score, y, **kw).where(F.col("n_rows") >= min_n)


def correlation_table(df: DataFrame, by: Sequence[str], xs: Sequence[str], ys: Sequence[str], min_rows: int = 3, **kw) -> DataFrame:
    """Rank correlation of every x column with every y column.

    Where no value is missing and groups are large, each column is ranked once for
    all its pairs; otherwise a pair is ranked on the rows that have both.
    """
    keys, columns = list(by), list(dict.fromkeys([*xs, *ys]))
    wide = df.select(*keys, *[finite(F.col(c).cast("double")).alias(c) for c in columns]).dropna(subset=keys)
    limit = kw.get("rows_per_split", ROWS_PER_SPLIT)
    sizes = wide.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.greatest(*[F.col(c).isNull() for c in columns], F.lit(False))).alias("gaps"))
    largest, gaps = sizes.agg(F.max("n"), F.sum("gaps")).first()
    if (largest or 0) > limit and not gaps:
        named = wide.select(*keys, *[F.col(c).alias(f"_x{i}") for i, c in enumerate(xs)], *[F.col(c).alias(f"_y{j}") for j, c in enumerate(ys)], F.lit(1).cast("long").alias("_w"))
        inner = [f"_x{i}" for i in range(len(xs))]
        met = ranked_columns(named, keys, inner, "_w", **kw)
        out = None
        for j, y in enumerate(ys):
            sums = settle(rank_sums(met, keys, inner, f"_y{j}", "_w", **kw))
            for i, x in enumerate(xs):
                one = sums.select(*keys, F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), "n_rows", rank_ratio(f"_xy{i}", f"_xx{i}", "_yy").alias("spearman"))
                out = one if out is None else out.unionByName(one)
    else:
        pairs = F.explode(F.array(*[F.struct(F.lit(x).alias("x_name"), F.lit(y).alias("y_name"), F.col(x).alias("x"), F.col(y).alias("y")) for x in xs for y in ys]))
        out = spearman(wide.select(*keys, pairs.alias("_p")).select(*keys, "_p.*"), [*keys, "x_name", "y_name"], "x", "y", **kw)
    return out.where(F.col("n_rows") >= min_rows)
