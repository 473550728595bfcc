"""URL filters: host and path rules, and a character language-model ratio.

URLs that a rule decides train two Markov models of variable order. All others
are judged by the difference of log-likelihoods per character, against a
threshold calibrated on held-out URLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.session import settle

#: Longest context, in bytes; with the next byte it fills the six low bytes of a long.
ORDER = 5
#: Weight of the next shorter context, in observations.
BACKOFF = 4.0
#: Differences of log-likelihoods are kept as integers in this unit, so that sums are exact.
UNIT = 1 << 30
#: Sequences that are more than one in so many of all are scored from a broadcast, so no task of the join is large.
COMMON = 1 << 18
_COUNTS = ["c0", "c1", "c2", "c3"]
_SUMS = ["both", "held0", "held1"]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index of the longest rule that fits, else null; of equal ones the first."""
    out = F.lit(None).cast("int")
    for i, r in sorted(enumerate(rules), key=lambda x: (len(x[1].name), -x[0])):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), i).otherwise(out)
    return out


def sequences(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each byte behind the ``ORDER`` bytes before it, as one number, and the URLs'
    offsets in them. An end mark is a byte."""
    pad = b"\2" * ORDER
    data = np.frombuffer(b"".join(pad + u + b"\3" for u in urls), np.uint8).astype(np.int64)
    sizes = np.array([len(u) + 1 for u in urls], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(offsets[-1]) + np.repeat((np.arange(len(urls)) + 1) * ORDER, sizes)
    return sum(data[at - k] << (8 * k) for k in range(ORDER + 1)), offsets


def _pieces(batches, rows: int = 4096):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, *sequences([(u or "").encode() for u in part.column("url").to_pylist()])


def sequence_counts(urls: DataFrame) -> DataFrame:
    """(seq, c0 .. c3, n): how often each sequence occurs in the labelled URLs, by
    2 * fold + accept, and in all. A row per sequence, whatever their number."""
    columns = [*_COUNTS, "n"]

    def run(batches):
        for part, codes, offsets in _pieces(batches):
            group = np.repeat(part.column("fold").to_numpy() * 2 + pc.fill_null(part.column("accept"), -8).to_numpy(), np.diff(offsets))
            found, inverse = np.unique(codes, return_inverse=True)
            counts = [np.bincount(inverse[group == g], minlength=len(found)) for g in range(4)] + [np.bincount(inverse)]
            yield pa.RecordBatch.from_arrays([pa.array(found), *(pa.array(c.astype(np.int64)) for c in counts)], names=["seq", *columns])

    each = urls.select("url", "fold", "accept").mapInArrow(run, ", ".join(f"{c} long" for c in ["seq", *columns]))
    return each.groupBy("seq").agg(*[F.sum(c).alias(c) for c in columns])


def differences(codes: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Differences of log probability of the last byte of each sequence, accepted less
    blocked, under models of all folds, of fold 1 and of fold 0.

    Each order's counts are smoothed by the next shorter one, so a context never
    seen leaves the shorter one's estimate. ``codes`` must hold all sequences that
    share the two bytes before the last; ``low`` counts the pairs of bytes.
    """
    low = low.reshape(256, 256, 4)
    last, before = codes & 255, (codes >> 8) & 255
    known = [(low.sum((0, 1))[None, :], low.sum(0)[last]), (low.sum(1)[before], low[before, last])]

    def sums(key: np.ndarray) -> np.ndarray:
        found, inverse = np.unique(key, return_inverse=True)
        return np.stack([np.bincount(inverse, c, len(found)) for c in counts.T], 1)[inverse]

    for k in range(2, ORDER + 1):
        pair = codes & ((1 << (8 * (k + 1))) - 1)
        known.append((sums(pair >> 8), sums(pair)))
    out = []
    for folds in ((0, 1), (1,), (0,)):
        logs = []
        for accept in (0, 1):
            p = np.full(len(codes), 1 / 256)
            for total, hits in known:
                total, hits = (sum(x[:, 2 * f + accept] for f in folds) for x in (total, hits))
                p = (hits + BACKOFF * p) / (total + BACKOFF)
            logs.append(np.log(p))
        out.append(np.round((logs[1] - logs[0]) * UNIT).astype(np.int64))
    return np.array(out)


def sequence_values(counts: DataFrame, low: np.ndarray) -> DataFrame:
    """(seq, n, both, held0, held1): the differences in ``UNIT``. A task holds the
    distinct sequences of its contexts of two bytes."""
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts)
        codes = whole.column("seq").to_numpy()
        values = differences(codes, np.stack([whole.column(c).to_numpy() for c in _COUNTS], 1), shared.value)
        out = pa.table([whole.column("seq"), whole.column("n"), *(pa.array(v) for v in values)], names=["seq", "n", *_SUMS])
        yield from out.to_batches(max_chunksize=1 << 16)

    dealt = counts.repartition(F.shiftright("seq", 8).bitwiseAND(0xFFFF))
    return dealt.mapInArrow(run, ", ".join(f"{c} long" for c in ["seq", "n", *_SUMS]))


def score_urls(urls: DataFrame, values: DataFrame) -> DataFrame:
    """Add both, held0 and held1, the sums over the URL's sequences, and _size, their number.

    Common sequences are summed from a broadcast; the others meet their values in
    a join by sequence, once per distinct URL.
    """
    total = values.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = values.where(F.col("n") * COMMON > total).select("seq", *_SUMS).toArrow().combine_chunks()
    order = np.argsort(common.column("seq").to_numpy())
    shared = urls.sparkSession.sparkContext.broadcast([common.column(c).to_numpy()[order] for c in ["seq", *_SUMS]])
    fields = [*urls.schema.fields, *(T.StructField(c, T.LongType(), False) for c in [*_SUMS, "_size"]), T.StructField("_rare", T.ArrayType(T.LongType(), False), False)]

    def run(batches):
        known, *sums = shared.value
        for part, codes, offsets in _pieces(batches):
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            seen = known[at] == codes if len(known) else np.zeros(len(codes), bool)
            each = [np.add.reduceat(np.where(seen, v[at], 0) if len(known) else np.zeros(len(codes), np.int64), offsets[:-1]) for v in sums]
            rare = np.concatenate(([0], np.cumsum(~seen)))[offsets]
            lists = pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(codes[~seen]))
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(e) for e in each), pa.array(np.diff(offsets)), lists], names=[f.name for f in fields])

    some = settle(urls.mapInArrow(run, T.StructType(fields)).withColumn("_key", F.struct(F.xxhash64("url"), F.xxhash64(F.lit(1), "url"))))
    rest = some.where(F.size("_rare") > 0)
    each = rest.groupBy("_key").agg(F.first("_rare").alias("_rare")).select("_key", F.explode("_rare").alias("seq"))
    more = each.join(values, "seq").groupBy("_key").agg(*[F.sum(c).alias(f"_{c}") for c in _SUMS])
    added = rest.join(more, "_key").select(*urls.columns, *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in _SUMS], "_size")
    return some.where(F.size("_rare") == 0).select(*urls.columns, *_SUMS, "_size").unionByName(added)


def calibrate(scores: np.ndarray, accept: np.ndarray, weight: np.ndarray) -> float:
    """Score at which a logistic fit on held-out scores gives even odds, classes weighing alike."""
    total = [weight[accept == c].sum() for c in (0, 1)]
    w = weight / np.where(accept == 1, total[1], total[0])
    goal = np.where(accept == 1, (total[1] + 1) / (total[1] + 2), 1 / (total[0] + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -30, 30)))
        g = np.array([np.sum(w * (goal - p) * scores), np.sum(w * (goal - p))])
        v = w * p * (1 - p)
        h = np.array([[np.sum(v * scores**2), np.sum(v * scores)], [np.sum(v * scores), np.sum(v)]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return -b / a if a > 1e-6 else 0.0


def filter_urls(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, url_score, verdict) for every page.

    The longest rule that fits decides; else the score does, allow from the
    threshold on. A null URL, or one without ``://``, has an empty host and path
    and is judged by its characters, none if null. Ties at the threshold allow.
    If the rules decide no URL for one of the verdicts there is nothing to tell
    apart: scores are 0 and allow. Rows are judged alone, so repeated rows agree.
    """
    base = pages.select(F.col(page_id), F.col(url).alias("url"))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = base.select(F.col(page_id), "url", host.alias("host"), path.alias("path")).withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules))
    named = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
    says = F.array(*[F.lit(r.verdict) for r in rules]) if rules else F.array().cast("array<string>")
    base = base.withColumn("rule", F.get(named, "_rule")).withColumn("_says", F.get(says, "_rule"))
    base = base.withColumn("accept", (F.col("_says") == "allow").cast("int")).withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int"))
    counts = settle(sequence_counts(base))
    # One row per pair of bytes.
    pairs = counts.groupBy(F.col("seq").bitwiseAND(0xFFFF).alias("pair")).agg(*[F.sum(c).alias(c) for c in _COUNTS]).toArrow()
    low = np.zeros((1 << 16, 4), np.int64)
    low[pairs.column("pair").to_numpy()] = np.stack([pairs.column(c).to_numpy() for c in _COUNTS], 1)
    least = 0.0
    if low[:, 0::2].sum() and low[:, 1::2].sum():
        scored = settle(score_urls(base, settle(sequence_values(counts, low))))
        held = F.when(F.col("fold") == 1, F.col("held1")).otherwise(F.col("held0")) / UNIT / F.col("_size")
        bins = scored.where(F.col("accept").isNotNull()).groupBy("accept", F.round(F.greatest(F.lit(-16.0), F.least(F.lit(16.0), held)) * 64).cast("int").alias("b")).count().toPandas()
        least = calibrate(bins["b"].to_numpy() / 64, bins["accept"].to_numpy(), bins["count"].to_numpy().astype(float))
        scored = scored.withColumn("url_score", F.col("both") / UNIT / F.col("_size"))
    else:
        scored = base.withColumn("url_score", F.lit(0.0))
    verdict = F.coalesce("_says", F.when(F.col("url_score") >= least, "allow").otherwise("block"))
    return scored.select(page_id, "host", "path", "rule", "url_score", verdict.alias("verdict"))
