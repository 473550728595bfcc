"""Periodic runs of words, found as maximal pairs of an LCP-interval tree.

A run with smallest period q that starts at word s and has n words is a pair of
suffixes, at s and s + q, whose common prefix has n - q words, whose left words
differ and whose next words differ: a maximal pair. So the suffixes of a text
are sorted, the intervals of equal prefixes are climbed bottom-up, and each
interval keeps its suffixes in lists by left word. Where children of an interval
with prefix length l meet, pairs from lists of unlike left word at a distance q
with (exponent - 1) * q <= l are the runs; nothing is extended or tried.

Suffixes whose first few words occur once in their text lie below every interval
of a run, and are left out before sorting. All texts of a slice are sorted at
once: a seed counts its text, so no interval holds suffixes of two texts.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from rankloom.llm.texts import map_texts, mix, text_bytes, word_hashes

#: A run has at least so many words, and at least so many periods.
MIN_WORDS = 6
MIN_PERIODS = 4

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def seed_words(min_words: int, min_periods: int) -> int:
    """Least common prefix of the pair of a run, over all periods."""
    return min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks, in the order of the first, then of the second."""
    return _dense(first * (second.max(initial=0) + 2) + second + 1)


def seed_ranks(words: np.ndarray, text: np.ndarray, seed: int) -> np.ndarray:
    """Rank of the ``seed`` words at each position; words of two texts are unlike."""

    def later(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.full(len(rank), -1, np.int64)
        out[: len(rank) - by] = rank[by:] if by < len(rank) else 0
        return out

    rank, size = _dense(words ^ mix(text.astype(np.uint64) + np.uint64(1))), 1
    while 2 * size <= seed:
        rank, size = _pairs(rank, later(rank, size)), 2 * size
    return _pairs(rank, later(rank, seed - size)) if size < seed else rank


class SuffixOrder:
    """Sorted suffixes of texts, of those that share their first ``seed`` words."""

    def __init__(self, words: np.ndarray, rows: np.ndarray, seed: int):
        n = len(words)
        self.words, self.ends, self.seed = words, rows[1:], seed
        self.text = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        rank = seed_ranks(words, self.text, seed)
        count = np.bincount(rank, minlength=1)
        #: Suffixes by their first words alone: how many are less.
        self.base = np.append((np.cumsum(count) - count)[rank], -1)
        self.at = np.flatnonzero(count[rank] > 1)
        #: Place of a position among the shared ones, or -1.
        self.place = np.full(n + 1, -1, np.int32)
        self.place[self.at] = np.arange(len(self.at), dtype=np.int32)
        #: Ranks by the first seed, 2 seed, 4 seed, ... words, on the scale of ``base``.
        self.ranks = [self.base[self.at]]
        while len(self.at):
            own = self.ranks[-1]
            then = self._ranks_at(self.at + (seed << (len(self.ranks) - 1)), len(self.ranks) - 1)
            order = np.lexsort((then, own))
            new = np.ones(len(order), bool)
            new[1:] = (own[order][1:] != own[order][:-1]) | (then[order][1:] != then[order][:-1])
            group = np.ones(len(order), bool)
            group[1:] = own[order][1:] != own[order][:-1]
            at = np.arange(len(order))
            rank = np.empty(len(order), np.int64)
            rank[order] = own[order] + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
            self.ranks.append(rank)
            if new.all():
                break

    def _ranks_at(self, position: np.ndarray, level: int) -> np.ndarray:
        position = np.minimum(position, len(self.words))
        place = self.place[position]
        return np.where(place >= 0, self.ranks[level][place], self.base[position])

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the order of their suffixes, and each one's common prefix
        with the one before it (0 where they do not share a seed)."""
        if not len(self.at):
            return self.at, self.at
        order = self.at[np.argsort(self.ranks[-1])]
        i, j = order[:-1].copy(), order[1:].copy()
        last = len(self.words)
        for level in range(len(self.ranks) - 1, -1, -1):
            same = (self._ranks_at(i, level) == self._ranks_at(j, level)) & (i < last) & (j < last)
            step = np.where(same, self.seed << level, 0)
            i += step
            j += step
        end = self.ends[self.text[order[:-1]]], self.ends[self.text[order[1:]]]
        going = i > order[:-1]
        for _ in range(self.seed - 1):
            going &= (i < end[0]) & (j < end[1])
            going[going] = self.words[i[going]] == self.words[j[going]]
            i += going
            j += going
        return order, np.concatenate(([0], i - order[:-1]))


class _Interval:
    """Suffixes of an interval: all positions, and those of each left word, sorted."""

    __slots__ = ("positions", "lists")

    def __init__(self, position: int, left: int):
        self.positions = [position]
        self.lists = {left: [position]}


def _meet(a: _Interval, b: _Interval, prefix: int, reach: int, left: list[int], found: dict) -> _Interval:
    """Pairs between two children of an interval, which then become one."""
    if len(a.positions) < len(b.positions):
        a, b = b, a
    positions = a.positions
    for own, members in b.lists.items():
        like = a.lists.get(own, ())
        for p in members:
            lo, hi = bisect_left(positions, p - reach), bisect_right(positions, p + reach)
            unlike = hi - lo
            if unlike and like:
                unlike -= bisect_right(like, p + reach) - bisect_left(like, p - reach)
            # Those of unlike left word are the first of a periodic stretch: few, and at its front.
            while unlike:
                x = positions[lo]
                lo += 1
                if left[x] != own:
                    unlike -= 1
                    start, period = (x, p - x) if x < p else (p, x - p)
                    key = (start, prefix + period)
                    if period < found.get(key, period + 1):
                        found[key] = period
    for own, members in b.lists.items():
        into = a.lists.setdefault(own, members)
        if into is not members:
            _merge(into, members)
    _merge(positions, b.positions)
    return a


def _merge(into: list[int], more: list[int]) -> None:
    if len(more) * 8 < len(into):
        for p in more:
            insort(into, p)
    else:
        into += more
        into.sort()


def maximal_pairs(order: list[int], prefixes: list[int], left: list[int], min_words: int, min_periods: int) -> dict[tuple[int, int], int]:
    """Runs as {(start, length): period}, from sorted suffixes and common prefixes."""
    found: dict[tuple[int, int], int] = {}
    stack: list[tuple[int, _Interval]] = []
    last = None

    def meet(prefix: int, a: _Interval, b: _Interval) -> _Interval:
        return _meet(a, b, prefix, prefix // (min_periods - 1), left, found)

    for position, prefix in zip([*order, 0], [*prefixes, 0]):
        while stack and stack[-1][0] > prefix:
            last = meet(stack[-1][0], stack.pop()[1], last)
        if prefix:
            if stack and stack[-1][0] == prefix:
                stack[-1] = (prefix, meet(prefix, stack[-1][1], last))
            else:
                stack.append((prefix, last))
        last = _Interval(position, left[position])
    return {k: q for k, q in found.items() if k[1] >= max(min_words, min_periods * q)}


def word_runs(words: np.ndarray, rows: np.ndarray, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> Iterator[list[tuple[int, int, int]]]:
    """For each text of a slice its runs (start, length, period), by start, then period."""
    suffixes = SuffixOrder(words, rows, seed_words(min_words, min_periods))
    order, prefixes = suffixes.sorted()
    out: list[list[tuple[int, int, int]]] = [[] for _ in rows[1:]]
    if len(order):
        # Left words as numbers; the first word of a text has none like it.
        left = np.zeros(len(words), np.int64)
        left[1:] = words[:-1].view(np.int64) >> 1
        firsts = rows[:-1][np.diff(rows) > 0]
        left[firsts] = np.iinfo(np.int64).max - firsts
        for (start, length), period in maximal_pairs(order.tolist(), prefixes.tolist(), left.tolist(), min_words, min_periods).items():
            t = int(suffixes.text[start])
            out[t].append((start - int(rows[t]), length, period))
    for runs in out:
        yield sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that repeat a run's first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    over = np.cumsum(drop)
    return b" ".join([w for w, d in zip(words, over) if not d])


def periodic_runs(docs: DataFrame, *, text: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Add n_words, runs (start, length, period in words) and collapsed to each row.

    Words are separated by space and tab to carriage return. A run is a stretch
    with a smallest period, of at least ``min_words`` words and ``min_periods``
    periods, that no neighbouring word extends. ``collapsed`` keeps of each run
    its first period. Null and empty texts have no words, no runs and an empty
    ``collapsed``. Repeated rows are worked on one by one; input columns with the
    names of the new ones give way to them, others pass through. Texts are whole:
    memory follows the slice of a batch or its longest text (about 100 bytes per
    word, and 4 per word and doubling of the longest repeated stretch for words in
    such). Words are told apart by 64-bit hashes.
    """
    if min_periods < 2 or min_words < 2:
        raise ValueError("a run repeats at least once")

    def make():
        def fn(column):
            data, offsets = text_bytes(column)
            words, rows = word_hashes(data, offsets)
            raw = data.tobytes()
            sizes, starts, lengths, periods, texts = [], [], [], [], []
            for i, runs in enumerate(word_runs(words, rows, min_words, min_periods)):
                sizes.append(len(runs))
                for values, value in zip((starts, lengths, periods), zip(*runs)):
                    values += value
                texts.append(collapsed(raw[offsets[i] : offsets[i + 1]].split(), runs))
            spans = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (starts, lengths, periods)], fields=[pa.field(f.name, pa.int64(), False) for f in RUNS.elementType.fields])
            runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), spans, type=pa.list_(pa.field("element", spans.type, False)))
            return [pa.array(np.diff(rows), pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())]

        return fn

    fields = [T.StructField("n_words", T.LongType(), False), T.StructField("runs", RUNS, False), T.StructField("collapsed", T.StringType(), False)]
    return map_texts(docs, text, make, fields)
