"""Joins with declared cardinality and the comparisons built on them.

Which physical join runs is left to Spark: sizes measured at run time decide
whether a side is broadcast, and skewed partitions are split.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import vectors as V
from rankloom.operators.contracts import guard, unique_by
from rankloom.operators.ordering import first_per


def join_checked(l: DataFrame, r: DataFrame, on: Sequence[str], how: str = "inner", card: str = "m:1") -> DataFrame:
    """Equi-join that fails when a side declared as 1 repeats a key."""
    left, right = card.split(":")
    if left == "1":
        l = unique_by(l, on, "left side")
    if right == "1":
        r = unique_by(r, on, "right side")
    return l.join(r, list(on), how)


def assemble(scores: DataFrame, dims: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Attach dimension tables m:1; columns already present are not repeated."""
    out = scores
    for dim, on in dims:
        new = [c for c in dim.columns if c in on or c not in out.columns]
        out = join_checked(out, dim.select(*new), on, "inner", "m:1")
    return out


def with_baseline(df: DataFrame, keys: Sequence[str], pred: Column, cols: Sequence[str]) -> DataFrame:
    """Attach the baseline row's values as ``baseline_*``; a missing one is an error."""
    base = unique_by(df.where(pred).select(*keys, *[F.col(c).alias("baseline_" + c) for c in cols]), keys, "baseline")
    out = df.join(base.withColumn("_hit", F.lit(True)), list(keys), "left")
    return guard(out, F.col("_hit"), F.concat(F.lit("no baseline for "), F.to_json(F.struct(*keys)))).drop("_hit")


def paired_lift(df: DataFrame, keys: Sequence[str], role: str, paired: str, decoys: Sequence[str], col: str) -> DataFrame:
    """Paired value minus each decoy's value on the same key."""
    base = unique_by(df.where(F.col(role) == paired).select(*keys, F.col(col).alias("paired_value")), keys, "paired")
    return (
        df.where(F.col(role).isin(*decoys))
        .withColumnRenamed(role, "decoy_role")
        .join(base, list(keys))
        .withColumn("lift", F.col("paired_value") - F.col(col))
    )


def pairwise(df: DataFrame, id: str, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """All unordered scorer pairs of one key. The scorers of a key are few by
    contract (their number does not grow with the data)."""
    l = df.select(*keys, F.col(id).alias("left_" + id), *[F.col(c).alias("left_" + c) for c in cols])
    r = df.select(*keys, F.col(id).alias("right_" + id), *[F.col(c).alias("right_" + c) for c in cols])
    return l.join(r, list(keys)).where(F.col("left_" + id) < F.col("right_" + id))


def contrast_gaps(metrics: DataFrame, registry: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Metric of the method minus that of its comparator, per registered contrast."""
    m = metrics.select(*keys, "method", *[F.col(c).alias("_m_" + c) for c in cols])
    c = metrics.select(*keys, F.col("method").alias("comparator"), *[F.col(x).alias("_c_" + x) for x in cols])
    return (
        m.join(registry, "method")
        .join(c, [*keys, "comparator"])
        .select(*registry.columns, *keys, *[(F.col("_m_" + x) - F.col("_c_" + x)).alias(x) for x in cols])
    )


def role_deltas(df: DataFrame, role: str, ref: str, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    base = unique_by(df.where(F.col(role) == ref).select(*keys, *[F.col(c).alias("_r_" + c) for c in cols]), keys, "reference role")
    return (
        df.where(F.col(role) != ref)
        .join(base, list(keys))
        .select(*keys, role, *[(F.col(c) - F.col("_r_" + c)).alias("delta_" + c) for c in cols])
    )


def split_overlap(df: DataFrame, splits: DataFrame, key: str, split: str = "split") -> DataFrame:
    return join_checked(df, splits.select(key, split), [key], "left").withColumn(
        split, F.coalesce(split, F.lit("not_listed"))
    )


def opened_registry(tables: Mapping[str, DataFrame], sequence: str) -> DataFrame:
    """Sequences used before, each with the first source (by name) that used it."""
    out = None
    for name, t in tables.items():
        part = t.select(F.upper(sequence).alias(sequence), F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(sequence).agg(F.min("source").alias("source"), F.count_distinct("source").alias("n_sources"))


def build_requests(states: DataFrame, structures: DataFrame, entity: str) -> DataFrame:
    """One request per state and structure of its entity (paired and decoys)."""
    out = states.join(structures, entity)
    return out.withColumn("request_id", F.concat_ws("__", "state_id", "structure_role", "structure_id"))


def variant_action(variants: DataFrame, vectors: DataFrame, on: Sequence[str], col: str, mut: str, wild: str, name: str = "action") -> DataFrame:
    """Vector entry at the mutant symbol minus the wild-type entry."""
    out = join_checked(variants, vectors.select(*on, F.col(col).alias("_vec")), on)
    at = lambda c: F.element_at("_vec", F.col(c).cast("int"))
    return out.withColumn(name, at(mut) - at(wild)).drop("_vec")


def attach_conservation(res: DataFrame, cons: DataFrame, on: Sequence[str], lo: float = 0.30, hi: float = 0.80) -> DataFrame:
    """One bounded score per residue is required; it is then classed."""
    out = join_checked(res, cons.select(*on, "conservation_score"), on, "left", "1:1")
    s = F.col("conservation_score")
    out = guard(out, s.between(0.0, 1.0), F.concat(F.lit("no valid conservation for "), F.to_json(F.struct(*on))))
    return out.withColumn(
        "conservation_class", F.when(s >= hi, "conserved").when(s <= lo, "variable").otherwise("intermediate")
    )


def routing_diagnostic(metrics: DataFrame, routes: Mapping[str, str], keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Base, gated and full routes side by side, with gated-base and gated-full
    differences. ``routes`` maps base / gated / full to method names."""
    aggs = [
        F.max(F.when(F.col("method") == m, F.col(c))).alias(f"{r}_{c}") for r, m in routes.items() for c in cols
    ]
    wide = metrics.where(F.col("method").isin(*routes.values())).groupBy(*keys).agg(
        F.count_distinct("method").alias("_n"), *aggs
    ).where(F.col("_n") == len(routes)).drop("_n")
    diffs = {}
    for c in cols:
        diffs[f"gated_minus_base_{c}"] = F.col(f"gated_{c}") - F.col(f"base_{c}")
        diffs[f"gated_minus_full_{c}"] = F.col(f"gated_{c}") - F.col(f"full_{c}")
    return wide.withColumns(diffs)


def align_vectors(keys: DataFrame, store: DataFrame, on: Sequence[str], vec: str) -> DataFrame:
    """Vectors for every requested key; a missing or non-finite one is an error."""
    out = join_checked(keys, store.select(*on, vec), on, "left")
    ok = F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return guard(out, ok, F.concat(F.lit("no usable vector for "), F.to_json(F.struct(*on))))


def remap_positions(df: DataFrame, numbering: DataFrame, on: Sequence[str], position: str, effect: str, flip: bool = True) -> DataFrame:
    """Source numbering to position through a lookup; the effect's sign is flipped."""
    out = join_checked(df, numbering.select(*on, position), on)
    return out.withColumn(effect, -F.col(effect)) if flip else out
