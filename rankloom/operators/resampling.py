"""Replicates of a resampling held as arrays, not as rows.

A draw is a function of (replicate, draw number, seed), so whoever holds the
values of a group can sum any part of its draws for all replicates at once.
Groups travel as one array of values each; tasks add up arrays with one entry
per replicate, and these merge by addition. What is shuffled does not grow with
the number of replicates. Rank correlations sort a group's values once; each
replicate only changes the weights, and average ranks are running sums of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from rankloom.functions.vectors import let
from rankloom.session import settle

# Fixed values of the integer mixing function.
PRIME = 2147483647
ROUND_CONSTANTS = (374761393, 668265263, 1274126177)
MULTIPLIER = 48271

#: Draws of one group that a task sums at once, in numbers of clusters.
SLOTS = 1 << 16
#: Draws of all replicates in one step of a task.
STEP_CELLS = 1 << 21
#: Draws per task that pay for one.
TASK_DRAWS = 5_000_000
#: Rows times replicates of one task of a rank sweep.
SWEEP_CELLS = 200_000_000
#: Keys whose sums a task holds before it passes them on.
HELD_KEYS = 4096


def mixed(replicates: np.ndarray, items: np.ndarray, seed: int) -> np.ndarray:
    """The mixing function for each replicate and item: replicates x items."""
    b, j = replicates.astype(np.int64)[:, None], items.astype(np.int64)[None, :]
    a = (b * 1000003 + j * 7919 + seed) % PRIME
    for k in ROUND_CONSTANTS:
        a = ((a * a + k) % PRIME * MULTIPLIER + j * 31 + b * 17) % PRIME
    return a


def _steps(replicates: int, items: int):
    width = max(1, STEP_CELLS // max(items, 1))
    for lo in range(1, replicates + 1, width):
        yield np.arange(lo, min(lo + width, replicates + 1))


def drawn_sums(values: np.ndarray, first: int, last: int, replicates: int, seed: int) -> np.ndarray:
    """For each replicate, the sum of the values that draws ``first`` to ``last`` take."""
    items = np.arange(first, last + 1)
    return np.concatenate([values[mixed(r, items, seed) % len(values)].sum(1) for r in _steps(replicates, len(items))])


def signed_sums(values: np.ndarray, first: int, last: int, replicates: int, seed: int) -> np.ndarray:
    """For each replicate, the sum of deviations from the mean under random signs."""
    items = np.arange(first, last + 1)
    off = (values - values.mean())[first - 1 : last]
    return np.concatenate([np.where(mixed(r, items, seed) % 2 == 0, off, -off).sum(1) for r in _steps(replicates, len(items))])


SUMS = {"drawn": drawn_sums, "signed": signed_sums}


def replicate_means(items: DataFrame, keys: Sequence[str], strata: Sequence[str], cl: Sequence[str], kind: str, replicates: int, seed: int) -> DataFrame:
    """(keys, means): the mean of each replicate, an array, for groups of bounded size.

    ``items`` has one row per cluster with its value; clusters are numbered by
    ``cl`` in each stratum. Kind "drawn" draws as many clusters as a stratum has;
    "signed" flips the deviations from the mean.
    """
    parts = [*keys, *strata]
    known = items.dropna(subset=parts)
    order = F.array_sort(F.collect_list(F.struct(*cl, F.col("value").cast("double").alias("value"))))
    groups = known.groupBy(*parts).agg(order["value"].alias("values"), F.count(F.lit(1)).alias("n"))
    starts = groups.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(SLOTS))))
    total = known.count() * replicates
    # Sums take time, not room: tasks are counted by draws.
    tasks = max(1, min(4 * items.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_DRAWS)))
    dealt = starts.select(*keys, "values", "n", "first").repartition(tasks, *keys, "first")
    fields = [dealt.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("sums", T.ArrayType(T.DoubleType(), False), False), T.StructField("n", T.LongType(), False)])
    add = SUMS[kind]

    def run(batches):
        held: dict[tuple, list] = {}

        def passed_on():
            rows = list(held.items())
            held.clear()
            columns = [pa.array([k[i] for k, _ in rows], f_type) for i, f_type in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([v[0] for _, v in rows], pa.list_(pa.field("element", pa.float64(), False))), pa.array([v[1] for _, v in rows], pa.int64())], names=schema.names)

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            values, ends = batch.column("values").values.to_numpy(), batch.column("values").offsets.to_numpy()
            columns = [batch.column(k).to_pylist() for k in keys]
            for i, (n, first) in enumerate(zip(batch.column("n").to_pylist(), batch.column("first").to_pylist())):
                last = min(first + SLOTS - 1, n)
                sums = add(values[ends[i] : ends[i + 1]], first, last, replicates, seed)
                into = held.setdefault(tuple(c[i] for c in columns), [np.zeros(replicates), 0])
                into[0] += sums
                into[1] += last - first + 1
                if len(held) >= HELD_KEYS:
                    yield passed_on()
        if held:
            yield passed_on()

    parted = dealt.mapInArrow(run, schema)
    zero = F.array_repeat(F.lit(0.0), replicates)
    whole = parted.groupBy(*keys).agg(F.collect_list("sums").alias("all"), F.sum("n").alias("n"))
    added = F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(F.aggregate("all", zero, lambda a, s: F.zip_with(a, s, lambda x, y: x + y)))
    return whole.select(*keys, let(added, lambda a: F.transform(a, lambda s: s / F.col("n"))).alias("means"))


def array_bounds(values: Column | str, level: float) -> list[Column]:
    """Interpolated quantiles of an array's known entries: ci_low and ci_high."""
    a = (1.0 - level) / 2.0

    def at(q: float) -> Column:
        def of(s: Column) -> Column:
            place = (F.size(s) - 1) * F.lit(q)
            low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
            return F.when(low == high, F.get(s, low)).otherwise((high - place) * F.get(s, low) + (place - low) * F.get(s, high))

        return F.when(F.size(known) > 0, let(known, of))

    known = F.array_sort(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v)))
    return [at(a).alias("ci_low"), at(1.0 - a).alias("ci_high")]


def _ranks(weights: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Centred average rank of each row under each row of weights."""
    order = np.argsort(value, kind="stable")
    new = np.ones(len(value), bool)
    new[1:] = value[order][1:] != value[order][:-1]
    which = np.empty(len(value), np.int64)
    which[order] = np.cumsum(new) - 1
    own = np.add.reduceat(weights[:, order], np.flatnonzero(new), axis=1)
    upto = np.cumsum(own, axis=1)
    return (upto - own / 2 - upto[:, -1:] / 2)[:, which]


def rank_correlations(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Rank correlation under each row of weights; NaN where a side does not vary."""
    if not len(x):
        return np.full(len(weights), np.nan)
    rx, ry = _ranks(weights, x), _ranks(weights, y)
    xx, yy, xy = ((weights * a * b).sum(1) for a, b in ((rx, rx), (ry, ry), (rx, ry)))
    fits = (xx > 1e-9) & (yy > 1e-9)
    return np.where(fits, xy / np.sqrt(np.where(fits, xx * yy, 1.0)), np.nan)


@dataclass(frozen=True)
class RankTerms:
    """A sum of rank correlations, each with its factor: (factor, x, y)."""

    terms: tuple[tuple[float, str, str], ...]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for _, x, y in self.terms for c in (x, y)))

    def of(self, table: dict[str, np.ndarray], weights: np.ndarray) -> np.ndarray:
        out = np.zeros(len(weights))
        for factor, x, y in self.terms:
            known = ~(np.isnan(table[x]) | np.isnan(table[y]))
            out += factor * rank_correlations(table[x][known], table[y][known], weights[:, known])
        return out


def rank_sweeps(folded: DataFrame, keys: Sequence[str], cl: str, terms: RankTerms, copies: str, replicates: int, seed: int, largest: int) -> DataFrame:
    """(keys, estimate, stats): the statistic of the data and of each replicate, an
    array, for groups of bounded size. ``largest`` is the size of the largest group;
    replicates of large ones are dealt over several tasks."""
    blocks = max(1, min(replicates, -(-largest * replicates // SWEEP_CELLS)))
    columns = terms.columns
    base = folded.dropna(subset=[*keys, cl]).withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    fields = [folded.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("block_", T.IntegerType(), False), T.StructField("estimate", T.DoubleType()), T.StructField("stats", T.ArrayType(T.DoubleType()), False)])

    def sweep(group: pa.Table) -> pa.Table:
        block = group.column("block_")[0].as_py()
        names, owner = np.unique(np.array(group.column(cl).to_pylist(), object), return_inverse=True)
        table = {c: group.column(c).to_numpy().astype(float) for c in columns}
        times = group.column(copies).to_numpy().astype(float)
        own = np.array_split(np.arange(1, replicates + 1), blocks)[block]
        stats = []
        width = max(1, STEP_CELLS // max(len(owner), 1))
        for lo in range(0, len(own), width):
            r = own[lo : lo + width]
            drawn = mixed(r, np.arange(1, len(names) + 1), seed) % len(names)
            counts = np.stack([np.bincount(d, minlength=len(names)) for d in drawn])
            stats.append(terms.of(table, counts[:, owner] * times))
        values = np.concatenate(stats) if stats else np.zeros(0)
        estimate = float(terms.of(table, times[None, :])[0])
        none = lambda v: None if np.isnan(v) else float(v)
        row = [pa.array([group.column(k)[0].as_py()], group.schema.field(k).type) for k in keys]
        row += [pa.array([block], pa.int32()), pa.array([none(estimate)], pa.float64()), pa.array([[none(v) for v in values]], pa.list_(pa.float64()))]
        return pa.Table.from_arrays(row, names=schema.names)

    swept = base.select(*keys, "block_", cl, *columns, copies).groupBy(*keys, "block_").applyInArrow(sweep, schema)
    return swept.groupBy(*keys).agg(F.max("estimate").alias("estimate"), F.flatten(F.collect_list("stats")).alias("stats"))


#: Distinct values up to which a side of a rank correlation counts as levels.
LEVELS = 128
#: Rows of a range of swept values, which one task sorts.
RANGE_ROWS = 1_000_000
#: Ranges of one group, and sampled values for each cut between them.
RANGES, CUT_SAMPLE = 512, 16


def value_ranges(rows: DataFrame, keys: Sequence[str], column: str, rows_per_range: int) -> DataFrame:
    """Rows with ``_b``, the range of their value; equal values share one.

    Cuts come from a sample by hash, so a task that runs again cuts alike.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    pieces = F.least(F.lit(RANGES), F.ceil(F.col("_rows") / rows_per_range))
    unit = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) / float(1 << 30)
    sampled = rows.withColumn("_u", unit).join(F.broadcast(sizes), list(keys)).where(F.col("_u") < CUT_SAMPLE * pieces / F.col("_rows"))
    sample = F.array_sort(F.collect_list(column))
    cuts = sampled.groupBy(*keys).agg(F.filter(sample, lambda _, i: i % CUT_SAMPLE == CUT_SAMPLE - 1).alias("_cuts"))
    met = rows.join(F.broadcast(cuts), list(keys), "left")
    return met.withColumn("_b", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col(column))), F.lit(0))).drop("_cuts")


def replicate_counts(r: int, n: int, seed: int) -> np.ndarray:
    """How often replicate ``r`` draws each of ``n`` clusters; once each in replicate 0."""
    if r == 0:
        return np.ones(n)
    return np.bincount(mixed(np.array([r]), np.arange(1, n + 1), seed)[0] % n, minlength=n).astype(float)


def _mid(weights: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Weight before each row of a sorted range, with half of its equals'."""
    if len(starts) == len(weights):
        return np.cumsum(weights) - weights / 2
    own = np.add.reduceat(weights, starts)
    return (np.cumsum(own) - own / 2)[which]


def level_sweeps(rows: DataFrame, keys: Sequence[str], terms: RankTerms, swept: str, copies: str, replicates: int, seed: int, rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """(keys, estimate, stats) as of ``rank_sweeps`` for groups of any size, where
    every term pairs ``swept`` with a column of few levels.

    ``rows`` have their cluster's number ``_j`` of ``_n``. A task sorts one range of
    swept values. Its ranks are those inside the range and the weight of earlier
    ranges, so per level and replicate the sums of weights and of weights times
    inner ranks are all that leaves it.
    """
    sides = [(factor, y if x == swept else x) for factor, x, y in terms.terms]
    keys = list(keys)
    known = rows.where(F.col(swept).isNotNull()).dropna(subset=keys)
    levels = known.groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(f"_v{i}") for i, (_, c) in enumerate(sides)])
    ranged = value_ranges(known, keys, swept, rows_per_range).join(F.broadcast(levels), keys)
    place = lambda i, c: F.coalesce(F.array_position(f"_v{i}", F.col(c)), F.lit(0)).cast("int").alias(f"_i{i}")
    base = ranged.select(*keys, "_b", "_j", "_n", swept, copies, *[place(i, c) for i, (_, c) in enumerate(sides)], *[F.size(f"_v{i}").alias(f"_k{i}") for i in range(len(sides))])
    fields = [base.schema[k] for k in keys]
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("_b", T.IntegerType()), T.StructField("term", T.IntegerType()), *[T.StructField(c, numbers) for c in ("u", "v", "q")]])

    def sweep(group: pa.Table) -> pa.Table:
        get = lambda c: group.column(c).to_numpy()
        order = np.argsort(get(swept), kind="stable")
        value, owner, times = get(swept)[order], (get("_j") - 1)[order], get(copies)[order].astype(float)
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        starts, which = np.flatnonzero(new), np.cumsum(new) - 1
        n = int(get("_n")[0])
        at = [get(f"_i{i}")[order] for i in range(len(sides))]
        size = [int(get(f"_k{i}")[0]) + 1 for i in range(len(sides))]
        out = [([], [], []) for _ in sides]
        for r in range(replicates + 1):
            weights = replicate_counts(r, n, seed)[owner] * times
            whole = None
            for i, (u, v, q) in enumerate(out):
                if at[i].all():
                    w = weights
                    inner = whole = _mid(w, starts, which) if whole is None else whole
                else:
                    w = weights * (at[i] > 0)
                    inner = _mid(w, starts, which)
                both = w * inner
                u.append(np.bincount(at[i], w, size[i])[1:])
                v.append(np.bincount(at[i], both, size[i])[1:])
                q.append(both @ inner)
        columns = [pa.array([group.column(k)[0].as_py()] * len(sides), group.schema.field(k).type) for k in keys]
        columns += [pa.array([group.column("_b")[0].as_py()] * len(sides), pa.int32()), pa.array(range(len(sides)), pa.int32())]
        columns += [pa.array([np.ravel(o[k]) for o in out], pa.list_(pa.float64())) for k in range(3)]
        return pa.Table.from_arrays(columns, names=schema.names)

    def joined(group: pa.Table) -> pa.Table:
        stats = np.zeros(replicates + 1)
        group = group.sort_by([("term", "ascending"), ("_b", "ascending")])
        term = group.column("term").to_numpy()
        for i, (factor, _) in enumerate(sides):
            parts = [[np.array(group.column(c)[int(k)].values.to_numpy()) for c in ("u", "v", "q")] for k in np.flatnonzero(term == i)]
            parts = [(u.reshape(replicates + 1, -1), v.reshape(replicates + 1, -1), q) for u, v, q in parts]
            level = sum(u for u, _, _ in parts)
            total = level.sum(1)
            rx = np.cumsum(level, 1) - level / 2 - total[:, None] / 2
            xx, xy, yy, before = (level * rx * rx).sum(1), 0.0, 0.0, -total / 2
            for u, v, q in parts:
                xy = xy + (rx * (before[:, None] * u + v)).sum(1)
                yy = yy + before * before * u.sum(1) + 2 * before * v.sum(1) + q
                before = before + u.sum(1)
            fits = (xx > 1e-9) & (yy > 1e-9)
            stats += factor * np.where(fits, xy / np.sqrt(np.where(fits, xx * yy, 1.0)), np.nan)
        return _stats_row(group, fields, stats)

    swept_ranges = base.groupBy(*keys, "_b").applyInArrow(sweep, schema)
    return swept_ranges.groupBy(*keys).applyInArrow(joined, T.StructType([*fields, *STATS]))


STATS = [T.StructField("estimate", T.DoubleType()), T.StructField("stats", T.ArrayType(T.DoubleType()))]


def _stats_row(group: pa.Table, fields: Sequence[T.StructField], stats: np.ndarray) -> pa.Table:
    """One row of a group's keys, its statistic (replicate 0) and those of the replicates."""
    none = lambda v: None if np.isnan(v) else float(v)
    row = [pa.array([group.column(f.name)[0].as_py()], group.schema.field(f.name).type) for f in fields]
    row += [pa.array([none(stats[0])], pa.float64()), pa.array([[none(v) for v in stats[1:]]], pa.list_(pa.float64()))]
    return pa.Table.from_arrays(row, names=[*[f.name for f in fields], "estimate", "stats"])


#: Clusters of a group up to which ranks are kept as counts per cluster.
FEW_CLUSTERS = 32
#: Rows of a range there, each with a number per cluster.
CUBE_ROWS = 200_000


def cluster_ranks(rows: DataFrame, keys: Sequence[str], column: str, copies: str, clusters: int, carried: Sequence[str], name: str, rows_per_range: int) -> DataFrame:
    """(keys, carried, ``name``): per cluster, the weight of smaller values with half of the
    equal ones, less half of its total; a rank under any weights of clusters is their sum."""
    keys = list(keys)
    ranged = value_ranges(rows, keys, column, rows_per_range)
    held = ranged.groupBy(*keys, "_b", "_j").agg(F.sum(copies).cast("double").alias("_w"))
    parts = held.groupBy(*keys, "_b").agg(*[F.coalesce(F.sum(F.when(F.col("_j") == j + 1, F.col("_w"))), F.lit(0.0)).alias(f"_{j}") for j in range(clusters)])
    inside = W.partitionBy(*keys)
    before = inside.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(*keys, "_b", F.array(*[F.coalesce(F.sum(f"_{j}").over(before), F.lit(0.0)) - F.sum(f"_{j}").over(inside) / 2 for j in range(clusters)]).alias("_start"))
    base = ranged.join(F.broadcast(starts), [*keys, "_b"])
    taken = list(dict.fromkeys([*keys, *carried]))
    schema = T.StructType([*[base.schema[c] for c in taken], T.StructField(name, T.ArrayType(T.DoubleType()))])

    def ranks(group: pa.Table) -> pa.Table:
        group = group.sort_by(column)
        value, owner = group.column(column).to_numpy(), group.column("_j").to_numpy() - 1
        own = np.zeros((len(value), clusters))
        own[np.arange(len(value)), owner] = group.column(copies).to_numpy()
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        equal = np.add.reduceat(own, np.flatnonzero(new), axis=0)
        rank = (np.cumsum(equal, 0) - equal / 2)[np.cumsum(new) - 1] + np.array(group.column("_start")[0].as_py())
        out = pa.ListArray.from_arrays(np.arange(0, rank.size + 1, clusters, dtype=np.int32), rank.ravel())
        return pa.Table.from_arrays([*[group.column(c) for c in taken], out], names=schema.names)

    return base.groupBy(*keys, "_b").applyInArrow(ranks, schema)


def tensor_sweeps(rows: DataFrame, keys: Sequence[str], terms: RankTerms, copies: str, clusters: int, replicates: int, seed: int, rows_per_range: int) -> DataFrame:
    """(keys, estimate, stats) as of ``rank_sweeps`` for groups of any size with few clusters.

    Ranks under a replicate's weights are sums over clusters, so products of ranks
    summed per cluster, a cube of numbers, hold all replicates. ``rows`` have their
    cluster's number ``_j`` of ``_n``.
    """
    keys, cube = list(keys), clusters**3
    rows_per_range = min(rows_per_range, CUBE_ROWS)
    fields = [rows.schema[k] for k in keys]
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([*fields, T.StructField("term", T.IntegerType()), T.StructField("_n", T.LongType()), T.StructField("cubes", numbers)])
    parts = None
    for i, (_, x, y) in enumerate(terms.terms):
        known = rows.dropna(subset=[*keys, x, y])
        rx = cluster_ranks(known, keys, x, copies, clusters, [y, "_j", "_n", copies], "_rx", rows_per_range)
        both = cluster_ranks(settle(rx), keys, y, copies, clusters, ["_j", "_n", copies, "_rx"], "_ry", rows_per_range)

        def summed(batches, i=i):
            held: dict[tuple, list] = {}
            for batch in batches:
                owner, times = batch.column("_j").to_numpy(), batch.column(copies).to_numpy()
                rx, ry = (batch.column(c).flatten().to_numpy().reshape(-1, clusters) for c in ("_rx", "_ry"))
                group = list(zip(*[batch.column(k).to_pylist() for k in keys]))
                places: dict[tuple, list] = {}
                for at, (g, o) in enumerate(zip(group, owner)):
                    places.setdefault((g, int(o)), []).append(at)
                for (g, o), at in places.items():
                    into = held.setdefault(g, [int(batch.column("_n")[at[0]].as_py()), np.zeros((3, clusters, clusters, clusters))])[1]
                    a, b, w = rx[at], ry[at], times[at][:, None]
                    for k, (p, q) in enumerate(((a, b), (a, a), (b, b))):
                        into[k, o - 1] += (p * w).T @ q
            if held:
                columns = [pa.array([g[k] for g in held], types[k]) for k in range(len(keys))]
                columns += [pa.array([i] * len(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([c.ravel() for _, c in held.values()], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        types = [to_arrow_type(f.dataType) for f in fields]
        part = both.mapInArrow(summed, schema)
        parts = part if parts is None else parts.unionByName(part)

    def joined(group: pa.Table) -> pa.Table:
        term, n = group.column("term").to_numpy(), int(group.column("_n")[0].as_py())
        weights = np.zeros((replicates + 1, clusters))
        for r in range(replicates + 1):
            weights[r, :n] = replicate_counts(r, n, seed)
        stats = np.zeros(replicates + 1)
        for i, (factor, _, _) in enumerate(terms.terms):
            cubes = sum(group.column("cubes")[int(k)].values.to_numpy() for k in np.flatnonzero(term == i)) + np.zeros(3 * cube)
            xy, xx, yy = (np.einsum("re,rc,rd,ecd->r", weights, weights, weights, c, optimize=True) for c in cubes.reshape(3, clusters, clusters, clusters))
            fits = (xx > 1e-9) & (yy > 1e-9)
            stats += factor * np.where(fits, xy / np.sqrt(np.where(fits, xx * yy, 1.0)), np.nan)
        return _stats_row(group, fields, stats)

    return parts.groupBy(*keys).applyInArrow(joined, T.StructType([*fields, *STATS]))
