"""Importance resampling: hashed n-gram weights and Gumbel top-k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.llm.ngrams import LABELLED, UNIT, fit_ratio, labelled_ids, labelled_sample
from rankloom.llm.texts import gram_sums, map_texts, text_bytes
from rankloom.session import settle

#: Gumbel keys are compared as integers in this unit.
KEY_UNIT = 1 << 20


def gumbel(seed: int, *values: Column | str) -> Column:
    """Standard Gumbel noise that depends on the values and the seed only."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *values), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, key: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a long column, and how many rows equal to it are
    among the k largest. Sixteen bits at a time are settled by a count per value,
    so at most 65,536 rows reach the driver and nothing is sorted."""
    head: int | None = None
    for shift in (48, 32, 16, 0):
        part = df if head is None else df.where(F.shiftright(key, shift + 16) == head)
        rows = part.groupBy(F.shiftright(key, shift).alias("h")).count().collect()
        for r in sorted(rows, key=lambda r: -r["h"]):
            if r["count"] >= k:
                head = r["h"]
                break
            k -= r["count"]
    return head, k


def top_k_mark(df: DataFrame, key: str, tie: str, k: int, name: str) -> DataFrame:
    """Mark the k rows with the largest keys; ties go to the smaller ``tie``, null last.

    Rows equal in both stand or fall together, so repeated rows at the cut may
    exceed k by their number.
    """
    n = df.count()
    if k >= n or k <= 0:
        return df.withColumn(name, F.lit(k > 0))
    cut, among = kth_largest(df, key, k)
    ties = df.where(F.col(key) == cut)
    chosen = F.col(key) > cut
    if ties.count() == among:
        return df.withColumn(name, chosen | (F.col(key) == cut))
    ties = ties.where(F.col(tie).isNotNull())
    if ties.count() <= among:
        return df.withColumn(name, chosen | (F.col(key) == cut) & (F.col(tie).isNotNull()))
    last, _ = kth_largest(ties.withColumn("_down", -F.col(tie)), "_down", among)
    return df.withColumn(name, chosen | (F.col(key) == cut) & F.coalesce(-F.col(tie) >= last, F.lit(False)))


def importance_sample(docs: DataFrame, labels: DataFrame, *, k: int | None = None, seed: int = 0, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str | None = None, most_labelled: int = LABELLED) -> DataFrame:
    """(doc_id, log_weight, gumbel_key, selected) for every document.

    ``log_weight`` is the log ratio of the whole text under the target and the
    raw model; the ``k`` largest sums with Gumbel noise are a sample without
    replacement by weight. By default k is the trusted share of all labelled
    ids, of all documents; only the target is fitted on a sample of them. A null or empty text has weight 0. Rows with
    null ids share the noise of null and go last among ties.
    """
    sample = labelled_sample(labels, doc_id, quality, toxic, most_labelled)
    ratio = fit_ratio(docs, sample, doc_id, text)
    shared, bits = docs.sparkSession.sparkContext.broadcast(ratio.table), ratio.bits

    def make():
        def fn(column):
            data, offsets = text_bytes(column)
            return [pa.array(gram_sums(data, offsets, bits, [shared.value])[0] / UNIT)]

        return fn

    scored = map_texts(docs.select(doc_id, text), text, make, [T.StructField("log_weight", T.DoubleType(), False)])
    keyed = settle(
        scored.select(doc_id, "log_weight", (F.col("log_weight") + gumbel(seed, doc_id, F.xxhash64(text))).alias("gumbel_key"))
        .withColumn("_key", F.round(F.col("gumbel_key") * KEY_UNIT).cast("long"))
    )
    if k is None:
        share = labelled_ids(labels, doc_id, quality, toxic).agg(F.avg("_trusted")).first()[0]
        k = round(keyed.count() * (1.0 if share is None else share))
    tie = doc_id if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else "_tie"
    if tie == "_tie":
        keyed = keyed.withColumn("_tie", F.xxhash64(doc_id))
    return top_k_mark(keyed, "_key", tie, k, "selected").select(doc_id, "log_weight", "gumbel_key", "selected")
