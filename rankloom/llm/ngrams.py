"""Hashed n-gram multinomials of a trusted target and of the raw corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.texts import add_grams, dense, sparse_counts, text_bytes, text_slices

#: Buckets (as a power of two) of four-byte windows.
BITS = 16
#: Ratios are kept as integers in this unit, so that sums are exact.
UNIT = 1 << 16
#: Bound of the labelled sample, in documents.
LABELLED = 40_000


def labelled_ids(labels: DataFrame, doc_id: str, quality: str, toxic: str | None) -> DataFrame:
    """All labelled ids: (_id, _trusted). Trusted are ids whose every label says quality 1 and not toxic."""
    good = F.col(quality) == 1
    if toxic:
        good = good & (F.coalesce(F.col(toxic), F.lit(0)) == 0)
    return labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.min(good.cast("int")).alias("_trusted"))


def labelled_sample(labels: DataFrame, doc_id: str, quality: str, toxic: str | None, most: int) -> DataFrame:
    """At most ``most`` labelled ids, chosen by hash: (_id, _trusted)."""
    return labelled_ids(labels, doc_id, quality, toxic).orderBy(F.xxhash64("_id"), "_id").limit(most)


@dataclass
class Ratio:
    """``table``: log-likelihood ratio of each bucket in ``UNIT``; ``bits``: its size."""

    table: np.ndarray
    bits: int


def fit_ratio(docs: DataFrame, sample: DataFrame, doc_id: str, text: str, *, bits: int = BITS, prior: float = 1.0) -> Ratio:
    """Count windows over all documents and over the trusted ones of the sample.

    Both models have ``prior`` added to each bucket at the size of the target, so
    a window too rare to be expected in the target counts for nothing.
    """
    size = 1 << bits
    marked = docs.select(doc_id, text).join(F.broadcast(sample), F.col(doc_id) == F.col("_id"), "left").select(text, F.coalesce("_trusted", F.lit(0)).alias("_trusted"))

    def make():
        counts = np.zeros((2, size), np.int64)

        def add(batch):
            trusted = batch.column("_trusted").to_numpy() > 0
            for part, own in ((batch, 0), (batch.filter(trusted), 1)):
                for rows in text_slices(part, text):
                    add_grams(counts[own], *text_bytes(rows.column(text)), bits)

        return add, lambda: counts.ravel()

    raw, target = dense(sparse_counts(marked, [text, "_trusted"], make), 2 * size).reshape(2, size)
    if not target.sum():
        return Ratio(np.zeros(size, np.int64), bits)
    expected = raw * (target.sum() / raw.sum())
    return Ratio(np.round(np.log((target + prior) / (expected + prior)) * UNIT).astype(np.int64), bits)
