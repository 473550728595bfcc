"""Overlap of a training table with benchmarks: exact relations, class codes and
sequence similarity, and the eligibility that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.operators.ordering import first_per
from rankloom.operators.similarity import similarity_join

__all__ = ["best_hits", "leakage_eligibility", "leakage_relations", "leakage_summary", "near_duplicates", "similarity_join"]


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & (F.trim(c) != "")


def leakage_relations(
    train: DataFrame, bench: DataFrame, hits: DataFrame | None = None, *, train_id: str, bench_id: str,
    exact: Sequence[tuple[str, Sequence[str]]] = (), classes: Sequence[tuple[str, str]] = (), threshold: float = 0.30, caseless: Sequence[str] = (),
    every: bool = False,
) -> DataFrame:
    """Distinct (train id, benchmark id, reason, similarity) relations.

    ``exact`` pairs a reason with the columns that must agree, those in ``caseless``
    in either case; ``classes`` pairs a reason with a class column, reported once
    against ``*``. Rows of one key are named by the least id among the benchmark's,
    so neither a common text nor a common class multiplies rows; with ``every``,
    an exact key gives one row for each benchmark row that holds it.
    """
    none = F.lit(None).cast("double")
    tail = lambda i, q, t: [i.alias("sequence_identity"), q.alias("query_coverage"), t.alias("target_coverage")]
    parts = []
    for reason, cols in exact:
        keys = [(F.lower(c) if c in caseless else F.col(c)).alias(f"_k{i}") for i, c in enumerate(cols)]
        names = [f"_k{i}" for i in range(len(cols))]
        ok_t = train.where(_all([_known(c) for c in cols])).select(train_id, *keys)
        ok_b = bench.where(_all([_known(c) for c in cols])).select(bench_id, *keys)
        if not every:
            ok_b = ok_b.groupBy(*names).agg(F.min(bench_id).alias(bench_id))
        one = F.lit(1.0)
        cover = one if "sequence" in reason else none
        parts.append(ok_t.join(ok_b, names).select(
            train_id, F.col(bench_id).cast("string").alias(bench_id), F.lit(reason).alias("reason"), *tail(one, cover, cover)))
    for reason, col in classes:
        seen = bench.where(_known(col)).select(col).distinct()
        parts.append(train.join(seen, col, "left_semi").select(
            train_id, F.lit("*").alias(bench_id), F.lit(reason).alias("reason"), *tail(none, none, none)))
    if hits is not None:
        parts.append(hits.where(F.col("sequence_identity") >= threshold).select(
            train_id, F.col(bench_id).cast("string").alias(bench_id), F.lit("sequence_identity").alias("reason"),
            "sequence_identity", "query_coverage", "target_coverage"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _all(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def leakage_eligibility(train: DataFrame, relations: DataFrame, train_id: str) -> DataFrame:
    """Every training row with its sorted distinct reasons; eligible iff none."""
    # Reasons are few, so the set per id is bounded.
    reasons = relations.groupBy(train_id).agg(F.array_sort(F.collect_set("reason")).alias("exclusion_reasons"))
    out = train.join(reasons, train_id, "left")
    return out.withColumn("eligible_for_training", F.col("exclusion_reasons").isNull()).withColumn(
        "exclusion_reasons", F.coalesce("exclusion_reasons", F.array().cast("array<string>"))
    )


def leakage_summary(train: DataFrame, relations: DataFrame, train_id: str) -> DataFrame:
    """Long table (measure, n): totals and relations per reason."""
    e = leakage_eligibility(train.select(train_id), relations, train_id)
    totals = e.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("eligible_for_training").alias("eligible"),
        F.count_if(~F.col("eligible_for_training")).alias("excluded"),
    ).unpivot([], ["total", "eligible", "excluded"], "measure", "n")
    per = relations.groupBy(F.concat(F.lit("relations_"), F.col("reason")).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    return totals.unionByName(per)


def best_hits(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Best hit per pair: identity first, then the smaller coverage."""
    low = F.least("query_coverage", "target_coverage")
    return first_per(hits, keys, [(-F.col("sequence_identity")).alias("a"), (-low).alias("b"), (-F.col("query_coverage")).alias("c")])


def near_duplicates(hits: DataFrame, t: float = 0.80, c: float = 0.90) -> DataFrame:
    return hits.where((F.col("sequence_identity") >= t) & (F.least("query_coverage", "target_coverage") >= c))
