"""Quality rules: countable rules, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from rankloom.llm.ngrams import LABELLED, UNIT, Ratio, fit_ratio, labelled_ids, labelled_sample
from rankloom.llm.texts import SPACE, bound_batches, gram_counts, gram_sums, map_texts, text_bytes, text_slices

_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_SOLID = re.compile(r"[^\x20\x09-\x0D]").search
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Share of the trusted documents that the threshold must let pass.
PASS = 0.998
#: Scores are compared in steps of this size where the threshold is set.
STEP = 1 / 512


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, their characters, symbols, repeated lines, words in repeated windows."""
    words = _WORDS(text)
    lines = [line for line in text.split("\n") if _SOLID(line)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        seen = Counter(windows)
        end = 0  # words before this are counted already
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def ratio_bins(docs: DataFrame, ratio: Ratio, doc_id: str, text: str) -> DataFrame:
    """(_doc, b): the step that the mean log-likelihood ratio per window of each text
    lies in, without the texts too short for the rules."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio.table)
    bits = ratio.bits

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "_text"):
                data, offsets = text_bytes(part.column("_text"))
                solid = ~SPACE[data]
                begins = solid.copy()
                begins[1:] &= ~solid[:-1]
                edges = offsets[:-1][offsets[:-1] < len(data)]
                begins[edges] = solid[edges]
                words = np.diff(np.concatenate(([0], np.cumsum(begins)))[offsets])
                llr = gram_sums(data, offsets, bits, [shared.value])[0] / np.maximum(gram_counts(offsets), 1) / UNIT
                steps = pa.array(np.floor(np.clip(llr, -20, 20) / STEP).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("_doc"), steps], names=["_doc", "b"]).filter(pa.array(words >= LEAST_WORDS))

    some = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    return bound_batches(some).mapInArrow(run, T.StructType([T.StructField("_doc", docs.schema[doc_id].dataType), T.StructField("b", T.IntegerType())]))


def threshold(docs: DataFrame, labelled: DataFrame, ratio: Ratio, doc_id: str, text: str) -> float:
    """The ratio below which documents fail, set on all labelled documents.

    The largest value that ``PASS`` of the trusted documents reach; where the
    other documents lie clear below it, half-way to all but their highest 5 per
    cent. Documents too short for the rules say nothing about the ratio. Without
    trusted documents nothing fails. Ids and steps alone are shuffled.
    """
    each = ratio_bins(docs, ratio, doc_id, text).groupBy("_doc", "b").agg(F.count(F.lit(1)).alias("n"))
    bins = each.join(labelled, F.col("_doc") == F.col("_id")).groupBy("_trusted", "b").agg(F.sum("n").alias("count")).toPandas()

    def quantile(own: int, q: float) -> float | None:
        part = bins[bins["_trusted"] == own].sort_values("b")
        if part.empty:
            return None
        at = np.searchsorted(np.cumsum(part["count"].to_numpy()), q * part["count"].sum(), side="right")
        return float(part["b"].to_numpy()[min(at, len(part) - 1)] * STEP)

    low, high = quantile(1, 1 - PASS), quantile(0, 0.95)
    if low is None:
        return float("-inf")
    return low if high is None or high >= low else (low + high) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", quality: str = "quality", toxic: str | None = "toxic", most_labelled: int = LABELLED) -> DataFrame:
    """Add rule counts, base_failed, llr and kept to every document.

    A null text reads as empty and fails the rules. Every row is judged on its
    own text, so ties and repeated rows fare alike; null ids are only never
    labelled. The target is fitted on at most ``most_labelled`` labelled ids, the
    threshold on all. Without documents there are no rows, without trusted labels the
    ratio fails none. Input columns with the names of new ones give way.
    """
    sample = labelled_sample(labels, doc_id, quality, toxic, most_labelled)
    ratio = fit_ratio(docs, sample, doc_id, text)
    least = threshold(docs, labelled_ids(labels, doc_id, quality, toxic), ratio, doc_id, text)
    shared = docs.sparkSession.sparkContext.broadcast(ratio.table)
    bits = ratio.bits
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [T.StructField(n, T.LongType(), False) for n in counts] + [T.StructField("llr", T.DoubleType(), False), T.StructField("base_failed", T.BooleanType(), False), T.StructField("kept", T.BooleanType(), False)]

    def make():
        def fn(column):
            table = np.array([rule_counts(t or "") for t in column.to_pylist()], np.int64)
            data, offsets = text_bytes(column)
            llr = gram_sums(data, offsets, bits, [shared.value])[0] / np.maximum(gram_counts(offsets), 1) / UNIT
            failed = (table[:, 0] < LEAST_WORDS) | (100 * table[:, 4] > 50 * table[:, 0])
            return [*(pa.array(c) for c in table.T), pa.array(llr), pa.array(failed), pa.array(~failed & (llr >= least))]

        return fn

    return map_texts(docs, text, make, fields)
