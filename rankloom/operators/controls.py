"""Shuffled controls: what remains of a score when positions are permuted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import vectors as V
from rankloom.operators.inference import mix_value
from rankloom.operators.ordering import shuffle_within
from rankloom.operators.ranking import spearman
from rankloom.session import settle

LEVELS = ("global", "entity", "wild_type", "environment", "corruption", "fully_conditioned")


def condition_columns(level: str, entity: str, wild: str, environment: Sequence[str], corruption: Sequence[str]) -> list[str]:
    """Columns that must agree between a row and the row it swaps with."""
    return {
        "global": [],
        "entity": [entity],
        "wild_type": [wild],
        "environment": list(environment),
        "corruption": list(corruption),
        "fully_conditioned": [wild, *environment, *corruption],
    }[level]


def shuffle_targets(df: DataFrame, by: Sequence[str], key: Sequence[str], cols: Sequence[str], numeric: Column, repeats: int, seed: int, **kw) -> DataFrame:
    """Permuted copies of the table, one per repeat, with ``repeat`` and ``moved``."""
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    return shuffle_within(rows, [*by, "repeat"], key, cols, mix_value(numeric, F.col("repeat"), seed), **kw)


def moved_fraction(shuffled: DataFrame, by: Sequence[str]) -> DataFrame:
    return shuffled.groupBy(*by).agg(F.avg(F.col("moved").cast("double")).alias("moved_fraction"), F.count(F.lit(1)).alias("n_rows"))


def position_shuffle_control(
    variants: DataFrame, vectors: DataFrame, entity: str, position: str, vec: str, *, wild: str, mut: str, observed: str,
    numeric: Column, repeats: int = 20, seed: int = 0,
) -> DataFrame:
    """Actual rank correlation per entity against vectors permuted within the entity.

    A permuted vector is anchored again at the wild type of its new position.
    Gives actual, mean over repeats and the gap.
    """
    def scored(v: DataFrame, keys: list[str]) -> DataFrame:
        rows = variants.join(v, [entity, position])
        at = lambda c: F.element_at(vec, F.col(c).cast("int"))
        rows = rows.select(*keys, (at(mut) - at(wild)).alias("_s"), observed)
        return spearman(rows, keys, "_s", observed)

    v = settle(vectors.select(entity, position, vec))
    actual = scored(v, [entity]).select(entity, F.col("spearman").alias("actual"))
    mixed = shuffle_targets(v, [entity], [position], [vec], numeric, repeats, seed).drop("moved")
    shuffled = scored(mixed, [entity, "repeat"]).groupBy(entity).agg(
        F.avg("spearman").alias("shuffled"), F.count("spearman").alias("n_repeats")
    )
    return actual.join(shuffled, entity).withColumn("gap", F.col("actual") - F.col("shuffled"))
