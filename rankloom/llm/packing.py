"""Packing token sequences by length patterns fitted to the length histogram.

Only the histogram of lengths, as long as a sequence at most, reaches the
driver. There non-negative least squares fits repeat counts of patterns of up
to four lengths that fill a sequence; counts are rounded down, and what is left
is packed best-fit over the histogram. The resulting plan gives runs of ranks,
longest pieces first, to the places of a pattern. Tasks then find the place of
each piece from its rank alone, so packing itself moves no data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from rankloom.llm.bpe import TABLE_BYTES, LibraryBpe, unpack, word_bpe
from rankloom.llm.texts import bound_batches, give_back, text_slices
from rankloom.session import settle

#: Patterns are fitted on lengths rounded up to so many steps of a sequence.
STEPS = 256


def patterns(steps: int, most: int = 4) -> np.ndarray:
    """All multisets of up to ``most`` step counts that fill ``steps`` exactly, and
    each step count alone; zeros pad short ones."""
    rows = []
    for a in range(1, steps + 1):
        rows.append(np.array([[a, 0, 0, 0]]))
    a = np.arange(1, steps // 2 + 1)
    rows.append(np.stack([a, steps - a, 0 * a, 0 * a], 1))
    for first in range(1, steps // 3 + 1):
        b = np.arange(first, (steps - first) // 2 + 1)
        rows.append(np.stack([0 * b + first, b, steps - first - b, 0 * b], 1))
        if most > 3:
            for second in range(first, (steps - first) // 3 + 1):
                c = np.arange(second, (steps - first - second) // 2 + 1)
                if len(c):
                    rows.append(np.stack([0 * c + first, 0 * c + second, c, steps - first - second - c], 1))
    return np.unique(np.concatenate(rows), axis=0)


def nnls(parts: np.ndarray, target: np.ndarray, *, rounds: int = 400, batch: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares over sparse columns by an active set.

    ``parts`` lists each column's entries, zeros mean none. Gives the indices of
    the columns in use and their weights.
    """
    size = len(target)
    residual = target.astype(float)
    active = np.zeros(0, int)
    weight = np.zeros(0)
    stop = 1e-6 * max(1.0, target.max(initial=0))
    for _ in range(rounds):
        gain = np.append(residual, 0.0)[parts - 1].sum(1) if len(parts) else np.zeros(0)
        gain[active] = -1
        best = np.argpartition(gain, -batch)[-batch:] if len(gain) > batch else np.arange(len(gain))
        best = best[gain[best] > stop]
        if not len(best):
            break
        active, weight = np.append(active, best), np.append(weight, np.zeros(len(best)))
        while len(active):
            a = np.zeros((size + 1, len(active)))
            np.add.at(a, (np.where(parts[active] > 0, parts[active] - 1, size), np.arange(len(active))[:, None]), 1.0)
            a = a[:size]
            want = np.linalg.solve(a.T @ a + 1e-9 * np.eye(len(active)), a.T @ target)
            if (want > 0).all():
                weight = want
                break
            falling = want <= 0
            drop = weight[falling] - want[falling]
            step = np.min(np.where(drop > 0, weight[falling] / np.where(drop > 0, drop, 1), 0.0), initial=1.0)
            weight = weight + step * (want - weight)
            keep = weight > 1e-9
            if keep.all():
                keep[np.argmin(want)] = False
            active, weight = active[keep], weight[keep]
        residual = target - (a @ weight if len(active) else 0)
    return active, weight


@dataclass
class Plan:
    """Runs of ranks and their places, sorted by first rank.

    ``first``: first rank of each run. ``base``: sequence of its first piece; the
    others follow one by one. ``before``: first ranks of the runs that stand
    earlier in the same sequences, -1 pads. ``ends``: number of pieces of each
    length or longer, by length from the longest down.
    """

    first: np.ndarray
    base: np.ndarray
    before: np.ndarray
    ends: np.ndarray
    capacity: int
    sequences: int

    def length_at(self, rank: np.ndarray) -> np.ndarray:
        return self.capacity - np.searchsorted(self.ends, rank, side="right")

    def place(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of the given ranks."""
        run = np.searchsorted(self.first, rank, side="right") - 1
        within = rank - self.first[run]
        offset = np.zeros(len(rank), np.int64)
        for column in self.before.T:
            prior = column[run]
            has = prior >= 0
            if not has.any():
                break
            offset[has] += self.length_at(prior[has] + within[has])
        return self.base[run] + within, offset


def make_plan(histogram: np.ndarray, *, steps: int = STEPS) -> Plan:
    """Plan for ``histogram[length]`` pieces; its length less one is the capacity."""
    capacity = len(histogram) - 1
    counts = histogram[:0:-1].astype(np.int64)  # longest first
    ends = np.cumsum(counts)
    unit = -(-capacity // steps)
    bins = -(-np.arange(capacity, 0, -1) // unit)
    fitted = np.zeros(steps + 1, np.int64)
    np.add.at(fitted, bins, counts)
    start = {int(b): int(ends[i - 1]) if i else 0 for b, i in zip(*np.unique(bins, return_index=True))}
    left = fitted.copy()
    used = np.zeros(steps + 1, np.int64)
    groups: list[tuple[int, list[int]]] = []  # sequences alike, first ranks of their runs
    gaps: list[int] = []
    parts = patterns(capacity // unit)
    active, weight = nnls(parts, fitted[1:].astype(float))
    for k in np.argsort(-weight, kind="stable"):
        slots = parts[active[k]][parts[active[k]] > 0]
        sort, times = np.unique(slots, return_counts=True)
        n = min(int(weight[k] + 1e-6), int((left[sort] // times).min()))
        if n <= 0 or slots.sum() != capacity // unit:
            continue  # what leaves room is packed with the residuals
        runs = []
        for b in slots[::-1]:
            runs.append(start[int(b)] + int(used[b]))
            used[b] += n
        left[sort] -= n * times
        groups.append((n, runs))
    # Residuals: the shortest pieces of each bin, as runs of one length.
    rest: list[tuple[int, int, int]] = []
    for i, length in enumerate(range(capacity, 0, -1)):
        lo, hi = int(ends[i] - counts[i]), int(ends[i])
        b = int(bins[i])
        lo = max(lo, start[b] + int(used[b]))
        if hi > lo:
            rest.append((length, lo, hi - lo))
    open_groups: dict[int, list[tuple[int, list[int]]]] = {}
    for length, lo, n in rest:
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, more = divmod(n, each)
                for times, size in ((full, each), (1 if more else 0, more)):
                    if times:
                        runs = [lo + j * times for j in range(size)]
                        lo += times * size
                        _open(open_groups, gaps, capacity - size * length, (times, runs))
                break
            gap = gaps[at]
            m, runs = open_groups[gap].pop()
            if not open_groups[gap]:
                del gaps[at], open_groups[gap]
            take = min(n, m)
            each = max(1, min(gap // length, n // take))
            if m > take:
                _open(open_groups, gaps, gap, (m - take, [r + take for r in runs]))
            _open(open_groups, gaps, gap - each * length, (take, runs + [lo + j * take for j in range(each)]))
            lo, n = lo + take * each, n - take * each
    groups += [g for gap in gaps for g in open_groups[gap]]
    first, base, before, at = [], [], [], 0
    for n, runs in groups:
        for j, r in enumerate(runs):
            first.append(r)
            base.append(at)
            before.append(runs[:j])
        at += n
    order = np.argsort(np.array(first, np.int64), kind="stable")
    wide = np.full((len(first), max(map(len, before), default=0)), -1, np.int64)
    for i, b in enumerate(before):
        wide[i, : len(b)] = b
    return Plan(np.array(first, np.int64)[order], np.array(base, np.int64)[order], wide[order], ends, capacity, at)


def _open(groups: dict, gaps: list[int], gap: int, group: tuple[int, list[int]]) -> None:
    if gap not in groups:
        groups[gap] = []
        insort(gaps, gap)
    groups[gap].append(group)


def token_pieces(df: DataFrame, doc_id: str, text: str, encoder: Callable[[], Callable[[list[str]], list[bytes]]], capacity: int, end_id: int, *, ids: bool = True) -> DataFrame:
    """Cut each text's ids, with ``end_id`` appended, into pieces of ``capacity``.

    Gives ``doc_id``, piece, start, length, ids_crc32, and ids if wanted, besides
    the place (part, pos) of each piece in the output of its task.
    """
    schema = T.StructType([
        df.schema[doc_id], *(T.StructField(n, T.LongType(), False) for n in ("piece", "start", "length", "ids_crc32", "part", "pos")),
    ] + [T.StructField("ids", T.ArrayType(T.LongType(), False), False)] * ids)
    tail = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        encode, part, pos = encoder(), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in text_slices(batch, text):
                doc, table = [], []
                pieces = []
                for i, packed in enumerate(encode([t or "" for t in rows.column(text).to_pylist()])):
                    packed += tail
                    for k in range(0, len(packed), 4 * capacity):
                        piece = packed[k : k + 4 * capacity]
                        doc.append(i)
                        table.append((k // (4 * capacity), k // 4, len(piece) // 4, zlib.crc32(piece), part, pos))
                        pos += 1
                        if ids:
                            pieces.append(unpack(piece))
                columns = [rows.column(doc_id).take(pa.array(doc, pa.int64()))]
                columns += [pa.array(c, pa.int64()) for c in zip(*table)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.list_(pa.int64()))] * ids, names=schema.names)
        give_back()

    return bound_batches(df).select(doc_id, text).mapInArrow(run, schema)


def pack_pieces(pieces: DataFrame, capacity: int, *, steps: int = STEPS) -> DataFrame:
    """Add sequence_id and offset to settled pieces with length, part and pos.

    Pieces must be of 1 to ``capacity`` tokens. Ties in length take ranks by
    (part, pos); repeated rows are pieces of their own. No rows give no rows.
    """
    counts = pieces.groupBy("length").count().toArrow()  # a row for each length at most
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counts.column("length").to_numpy()] = counts.column("count").to_numpy()
    plan = pieces.sparkSession.sparkContext.broadcast(make_plan(histogram, steps=steps))
    longer = np.cumsum(histogram[::-1])[::-1] - histogram  # ranks of longer pieces come first
    # One row per task and length, so even the most common length is numbered in many tasks.
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    runs = pieces.groupBy("part", "length").count().select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(runs, ["part", "length"]).withColumn("_rank", F.col("_before") + F.row_number().over(W.partitionBy("part", "length").orderBy("pos")) - 1)
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "part", "pos")]
    schema = T.StructType([pieces.schema[c] for c in kept] + [T.StructField("sequence_id", T.LongType(), False), T.StructField("offset", T.LongType(), False)])
    first = pieces.sparkSession.sparkContext.broadcast(longer)

    def run(batches):
        for batch in batches:
            rank = batch.column("_rank").to_numpy() + first.value[batch.column("length").to_numpy()]
            sequence, offset = plan.value.place(rank)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def pack_texts(df: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0, ids: bool = True, steps: int = STEPS, tables: int = TABLE_BYTES) -> DataFrame:
    """Tokenise texts, cut what is longer than ``capacity`` and pack the pieces.

    A null or empty text is ``end_id`` alone. Null ids stay null. Other columns
    of the input are left out. The tokenizers library encodes each distinct word that a worker meets; ``tables`` bounds
    a worker's word tables in bytes. ``sequences`` puts the packed ids together.
    """
    pieces = settle(token_pieces(df, doc_id, text, lambda: word_bpe(vocabulary, tables, LibraryBpe).encode, capacity, end_id, ids=ids))
    return pack_pieces(pieces, capacity, steps=steps)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids, and the (start, length) span of each piece."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"), F.transform("_p", lambda p: F.struct(p["offset"].alias("start"), p["length"])).alias("spans")
    )
