"""Methods as data: linear score combinations, registries and lookup actions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def subsets(base: str, components: Sequence[str], weight: float | None = None) -> dict[str, dict[str, float]]:
    """One method per non-empty set of scorers: base plus the set's mean
    (or plus ``weight`` times each)."""
    out: dict[str, dict[str, float]] = {base: {base: 1.0}}
    for k in range(1, len(components) + 1):
        for combo in combinations(components, k):
            w = weight if weight is not None else 1.0 / k
            out["+".join((base, *combo))] = {base: 1.0, **{c: w for c in combo}}
    return out


def method_predictions(df: DataFrame, methods: Mapping[str, Mapping[str, float]], keep: Sequence[str]) -> DataFrame:
    """One column per method: the weighted sum of its components, in one projection."""

    def combine(parts: Mapping[str, float]) -> Column:
        out = None
        for name, w in parts.items():
            term = F.col(name).cast("double") * F.lit(float(w))
            out = term if out is None else out + term
        return out

    return df.select(*keep, *[combine(parts).alias(name) for name, parts in methods.items()])


def long_predictions(df: DataFrame, keep: Sequence[str], methods: Sequence[str]) -> DataFrame:
    return df.unpivot(list(keep), list(methods), "method", "score")


def registry(spark: SparkSession, rows: Sequence[tuple], cols: Sequence[str]) -> DataFrame:
    """A method or contrast registry as a table."""
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in cols))


def method_registry(spark: SparkSession, methods: Mapping[str, Mapping[str, float]], family: str) -> DataFrame:
    return registry(spark, [(m, family, "+".join(sorted(p))) for m, p in methods.items()], ["method", "family", "components"])


def matrix_action(df: DataFrame, matrix: DataFrame, wild: str, mut: str, score: str = "score") -> DataFrame:
    """Substitution score of the mutant minus that of keeping the wild type.

    ``matrix`` has one row per ordered symbol pair (wild, mut, score).
    """
    m = matrix.select(F.col("wild").alias(wild), F.col("mut").alias(mut), F.col(score).alias("_to"))
    self_ = matrix.where("wild = mut").select(F.col("wild").alias(wild), F.col(score).alias("_own"))
    return df.join(m, [wild, mut], "left").join(self_, wild, "left").withColumn(
        "matrix_action", F.col("_to") - F.col("_own")
    ).drop("_to", "_own")


def profile_action(profile: Column | str, wild: Column, mut: Column, floor: float = 1e-12) -> Column:
    """Log-odds of mutant over wild type in a symbol profile."""
    p = lambda i: F.log(F.greatest(F.element_at(profile, i), F.lit(floor)))
    return p(mut) - p(wild)
