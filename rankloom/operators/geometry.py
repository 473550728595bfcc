"""Contact edges, mappings and structure measures over coordinate tables.

Coordinates are columns x, y, z (one row per position) or ``array<double>``
atoms. Neighbours meet as blocks of points on grid cells; pairs become rows only
where a query returns them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from rankloom.functions import vectors as V
from rankloom.functions.classes import edge_signature
from rankloom.operators.inference import mix_value
from rankloom.operators.ordering import ordinals, shuffle_within
from rankloom.operators.resampling import MULTIPLIER, PRIME, ROUND_CONSTANTS
from rankloom.session import settle

AXES = ("x", "y", "z")


#: Points of one cell that travel as one row of arrays.
BLOCK = 1024
#: Pairs of points that a task compares in one step.
STEP_PAIRS = 1 << 18
#: Points whose sums a task holds before it passes them on.
HELD_POINTS = 1 << 20
#: The same for contacts, whose steps stay in a core's own memory.
CONTACT_PAIRS = 1 << 16
#: Contacts that a task orders at once before it passes them on, and those of a batch of them.
HELD_EDGES = 1 << 21
BATCH_EDGES = 1 << 17

_PART = ["_px", "_py", "_pz", "_part"]
_QPART = ["_q_px", "_q_py", "_q_pz", "_q_part"]


def _near_blocks(res: DataFrame, by: Sequence[str], position: str, cutoff: float, carried: Sequence[str] = (), entities: DataFrame | None = None) -> DataFrame:
    """(by, block, p, q, columns of ``entities``): the points of a block, and those of a block in the same or a
    next cell. Points without coordinates have no neighbours. All rows of a block are
    in one partition."""
    extra = [c for c in entities.columns if c not in by] if entities is not None else []
    pairs = _met(_point_blocks(res, by, position, cutoff, carried, entities), by)
    return pairs.select(*by, *_PART, "p", "q", *extra).repartition(_tasks(res), *by, *_PART)


def _tasks(df: DataFrame) -> int:
    # The work is in the pairs, not in the bytes by which partitions are coalesced.
    spark = df.sparkSession
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _point_blocks(res: DataFrame, by: Sequence[str], position: str, cutoff: float, carried: Sequence[str] = (), entities: DataFrame | None = None) -> DataFrame:
    """(by, block, p, columns of ``entities``): the points of each block."""
    by = list(by)
    clean = res.select(*by, F.col(position).cast("long").alias("at"), *[V.finite(a).alias(a) for a in AXES], *carried).dropna(subset=[*by, "at", *AXES])
    cells = _PART[:3]
    clean = clean.withColumns({c: F.floor(F.col(a) / cutoff).cast("long") for c, a in zip(cells, AXES)})
    parts = clean.groupBy(*by, *cells).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("_parts"))
    dealt = clean.join(parts, [*by, *cells]).withColumn("_part", F.pmod(F.xxhash64("at", *AXES), F.col("_parts")))
    blocks = dealt.groupBy(*by, *_PART).agg(F.collect_list(F.struct("at", *AXES, *carried)).alias("p"))
    return settle(blocks.join(entities, by) if entities is not None and len(entities.columns) > len(by) else blocks)


def _met(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Blocks with each block of the same or a next cell: its points q and its name."""
    near = blocks
    for c in _PART[:3]:
        near = near.withColumn("_q" + c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    own = blocks.select(*by, *[F.col(c).alias("_q" + c) for c in _PART], F.col("p").alias("q"))
    return near.join(own, [*by, *_QPART[:3]])


def _blocks_once(blocks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Near blocks, each two of them once, dealt over tasks whatever their entity; rows of an entity follow one another."""
    pairs = _met(blocks, by)
    own, other = F.struct(*_PART), F.struct(*[F.col(q).alias(c) for c, q in zip(_PART, _QPART)])
    once = pairs.where(own <= other).withColumn("_same", own == other)
    return once.repartition(_tasks(blocks), *by, *_PART, *_QPART).sortWithinPartitions(*by).drop(*_PART, *_QPART)


def _contacts(batch: pa.RecordBatch, i: int, cutoff: float, sep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, target, distance) of the contacts of two blocks that meet once."""
    p, q = _points_of(batch.column("p"), i), _points_of(batch.column("q"), i)
    same, n = batch.column("_same")[i].as_py(), len(q["at"])
    step = max(1, CONTACT_PAIRS // max(n, 1))
    limit = cutoff * cutoff * (1 + 1e-9)
    for lo in range(0, len(p["at"]), step):
        d2 = 0.0
        for a in AXES:
            gap = p[a][lo : lo + step, None] - q[a][None, :]
            gap *= gap
            d2 = np.add(d2, gap, out=gap)
        d2 = d2.ravel()
        at = np.flatnonzero(d2 <= limit)
        d = np.sqrt(d2[at])
        row = at // n
        source, target = p["at"][lo + row], q["at"][at - row * n]
        gap = target - source
        held = ((gap if same else np.abs(gap)) >= max(sep, 1)) & (d <= cutoff)
        source, target, d = source[held], target[held], d[held]
        yield (source, target, d) if same else (np.minimum(source, target), np.maximum(source, target), d)


def decimal_steps(x: np.ndarray, digits: int) -> np.ndarray:
    """Numbers from zero on in units of the last digit, rounded by their decimal form, half up, as Spark's ``round`` does."""
    whole = x * 10.0**digits
    out = np.floor(whole + 0.5)
    for i in np.flatnonzero(np.abs(whole - np.floor(whole) - 0.5) <= 1e-9 + 1e-15 * whole):
        out[i] = int(Decimal(repr(float(x[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def by_step(step: np.ndarray, source: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their steps. They are sorted as one number each, or if 64 bits don't hold them, by places."""
    low = min(int(source.min()), int(target.min()))
    bits = (max(int(source.max()), int(target.max())) - low).bit_length()
    if int(step.max()).bit_length() + 2 * bits > 63:
        order = np.argsort(step, kind="stable")
        return step[order], source[order], target[order]
    whole = step.astype(np.int64)
    for end in (source, target):
        whole <<= bits
        whole |= end - low
    whole.sort()
    mask = (1 << bits) - 1
    return whole >> 2 * bits, (whole >> bits & mask) + low, (whole & mask) + low


def _points_of(column: pa.Array, i: int) -> dict[str, np.ndarray]:
    points = column.slice(i, 1).flatten()
    return {f.name: points.field(f.name).to_numpy(zero_copy_only=False) for f in points.type}


def _strips(batch: pa.RecordBatch, i: int, cutoff: float):
    """(first point, some points of block p, those of q, distances, which are near) for row ``i``."""
    p, q = _points_of(batch.column("p"), i), _points_of(batch.column("q"), i)
    step = max(1, STEP_PAIRS // max(len(q["at"]), 1))
    for lo in range(0, len(p["at"]), step):
        some = {c: v[lo : lo + step] for c, v in p.items()}
        d = distances(some, q, AXES)
        yield lo, some, q, d, (d <= cutoff) & (some["at"][:, None] != q["at"][None, :])


def distances(p: dict[str, np.ndarray], q: dict[str, np.ndarray], axes: Sequence[str]) -> np.ndarray:
    d2 = 0.0
    for a in axes:
        gap = p[a][:, None] - q[a][None, :]
        d2 = d2 + gap * gap
    return np.sqrt(d2)


def near_sums(
    res: DataFrame, by: Sequence[str], position: str, cutoff: float, fold: Callable[..., dict[str, np.ndarray]], names: Sequence[str], carried: Sequence[str] = ()
) -> DataFrame:
    """(by, position, sums): what ``fold`` makes of each point and its neighbours, added up.

    ``fold`` takes some points, the points of a block near them, the distances and
    which pairs are near, and gives a number per point. No pair leaves its task.
    """
    by = list(by)
    schema = T.StructType([*[res.schema[c] for c in by], T.StructField("_at", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        held: dict[tuple, tuple] = {}
        points = 0

        def passed_on():
            for keys, at, sums in held.values():
                yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(at)) for k in keys), pa.array(at), *(pa.array(sums[n]) for n in names)], names=schema.names)
            held.clear()

        for batch in batches:
            block = list(zip(*(batch.column(c).to_pylist() for c in [*by, *_PART])))
            for i in range(batch.num_rows):
                if block[i] not in held:
                    at = _points_of(batch.column("p"), i)["at"]
                    held[block[i]] = (tuple(batch.column(c)[i] for c in by), at, {n: np.zeros(len(at)) for n in names})
                    points += len(at)
                sums = held[block[i]][2]
                for lo, p, q, d, near in _strips(batch, i, cutoff):
                    for n, v in fold(p, q, d, near).items():
                        sums[n][lo : lo + len(v)] += v
                if points >= HELD_POINTS:
                    yield from passed_on()
                    points = 0
        yield from passed_on()

    parted = _near_blocks(res, by, position, cutoff, carried).mapInArrow(run, schema)
    whole = parted.groupBy(*by, "_at").agg(*[F.sum(n).alias(n) for n in names])
    return whole.withColumn("_at", F.col("_at").cast(res.schema[position].dataType)).withColumnRenamed("_at", position)


def contact_edges(res: DataFrame, by: Sequence[str], position: str, cutoff: float = 8.0, sep: int = 3, digits: int | None = None) -> DataFrame:
    """Undirected contacts (source < target) at least ``sep`` positions apart.

    With ``digits``, distances are rounded where points meet, and contacts of one
    distance follow one another: rows then take about half the room in files.
    """
    by = list(by)
    kind = res.schema[position].dataType
    ends = pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
    schema = T.StructType([*[res.schema[c] for c in by], *(T.StructField(c, T.IntegerType() if ends == pa.int32() else T.LongType()) for c in ("source", "target")), T.StructField("distance", T.DoubleType())])

    def rows(keys, source, target, distance):
        for lo in range(0, len(source), BATCH_EDGES):
            part = slice(lo, lo + BATCH_EDGES)
            n = len(source[part])
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, n) for k in keys), pa.array(source[part], ends), pa.array(target[part], ends), pa.array(distance[part])], names=schema.names)

    def passed_on(keys, held):
        step, source, target = by_step(*(np.concatenate(c) for c in zip(*held)))
        yield from rows(keys, source, target, step / 10.0**digits)

    def run(batches):
        entity, keys, held, n = None, (), [], 0
        for batch in batches:
            block = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            for i in range(batch.num_rows):
                if held and (block[i] != entity or n >= HELD_EDGES):
                    yield from passed_on(keys, held)
                    held, n = [], 0
                entity, keys = block[i], tuple(batch.column(c)[i] for c in by)
                for found in _contacts(batch, i, cutoff, sep):
                    if digits is None:
                        yield from rows(keys, *found)
                    elif len(found[0]):
                        held.append((decimal_steps(found[2], digits), *found[:2]))
                        n += len(found[0])
        if held:
            yield from passed_on(keys, held)

    edges = _blocks_once(_point_blocks(res, by, position, cutoff), by).mapInArrow(run, schema)
    return edges if schema["source"].dataType == kind else edges.withColumns({c: F.col(c).cast(kind) for c in ("source", "target")})


def degrees_within(res: DataFrame, by: Sequence[str], position: str, cutoff: float = 8.0, sep: int = 3) -> DataFrame:
    """``contact_degrees`` of the contacts of a table, counted where points meet."""

    def fold(p, q, d, near):
        return {"contact_degree": (near & (np.abs(q["at"][None, :] - p["at"][:, None]) >= sep)).sum(1)}

    out = near_sums(res, by, position, cutoff, fold, ["contact_degree"])
    return out.withColumn("contact_degree", F.col("contact_degree").cast("long")).where("contact_degree > 0")


def contact_totals(res: DataFrame, by: Sequence[str], position: str, cutoff: float = 8.0, sep: int = 3) -> DataFrame:
    """(by, mean separation, number) of the contacts of each entity, added up where points meet."""

    def fold(p, q, d, near):
        gap = q["at"][None, :] - p["at"][:, None]
        held = near & (gap >= sep)
        return {"gap_": np.where(held, gap, 0).sum(1), "edges_": held.sum(1)}

    out = near_sums(res, by, position, cutoff, fold, ["gap_", "edges_"]).groupBy(*by).agg(F.sum("gap_").alias("_g"), F.sum("edges_").cast("long").alias("_e"))
    return out.where("_e > 0").select(*by, (F.col("_g") / F.col("_e")).alias("_gap"), "_e")


def contact_degrees(edges: DataFrame, by: Sequence[str]) -> DataFrame:
    ends = edges.select(*by, F.explode(F.array("source", "target")).alias("position"))
    return ends.groupBy(*by, "position").agg(F.count(F.lit(1)).alias("contact_degree"))


def structure_descriptors(
    res: DataFrame, edges: DataFrame | None, by: Sequence[str], position: str, ss: str | None = None, totals: DataFrame | None = None
) -> DataFrame:
    """Contact order, radius of gyration, mean degree and class fractions per entity,
    from its contacts or from their ``contact_totals``."""
    shape = res.groupBy(*by).agg(
        F.count(F.lit(1)).alias("length"),
        F.sqrt(sum((F.var_pop(a) for a in AXES), F.lit(0.0))).alias("radius_of_gyration"),
        *([F.avg((F.col(ss) == c).cast("double")).alias(f"{c}_fraction") for c in ("helix", "strand")] if ss else []),
    )
    e = totals if totals is not None else edges.groupBy(*by).agg(F.avg(F.col("target") - F.col("source")).alias("_gap"), F.count(F.lit(1)).alias("_e"))
    out = shape.join(e, list(by), "left")
    return out.withColumns({
        "mean_contact_order": F.coalesce(F.col("_gap") / F.col("length"), F.lit(0.0)),
        "mean_contact_degree": F.coalesce(2 * F.col("_e") / F.col("length"), F.lit(0.0)),
    }).drop("_gap", "_e")


def crop_table(position: np.ndarray, points: np.ndarray, codes: np.ndarray, steps: np.ndarray, size: int, length: int) -> tuple[np.ndarray, ...]:
    """(start, radius, helix, strand, contact order, degree) of all crops of a length.

    Rows add to running sums along the entity, so a crop is a difference of two
    look-ups; ``steps`` are the changes of the contacts held (see ``crop_steps``).
    NaN stands for a value that is not known.
    """
    starts = size - length + 1

    def window(values: np.ndarray) -> np.ndarray:
        sums = np.zeros(size + 1)
        np.add.at(sums, position + 1, values)
        sums = np.cumsum(sums)
        return sums[length:] - sums[:starts]

    def share(total: np.ndarray, count: np.ndarray) -> np.ndarray:
        return np.divide(total, count, out=np.full(starts, np.nan), where=count > 0)

    rows = window(np.ones(len(position)))
    spread = np.zeros(starts)
    for axis in points:
        known = ~np.isnan(axis)
        # Sums about the entity's centre lose no digits.
        value = np.where(known, axis - (axis[known].mean() if known.any() else 0.0), 0.0)
        count = window(known.astype(float))
        spread += np.maximum(share(window(value * value), count) - share(window(value), count) ** 2, 0.0)
    coded = window((codes >= 0).astype(float))
    fractions = [share(window((codes == c).astype(float)), coded) for c in (0, 1)]
    n, apart = np.cumsum(steps, axis=1)[:, :starts]
    order = np.divide(apart, n, out=np.zeros(starts), where=n > 0.5) / length
    there = rows > 0
    return tuple(c[there] for c in (np.arange(starts), np.sqrt(spread), *fractions, order, 2 * n / length))


def crop_steps(source: np.ndarray, target: np.ndarray, size: int, length: int) -> np.ndarray:
    """Changes, from one start to the next, of the number and of the summed separation
    of the contacts that crops of a length hold with both ends."""
    starts = size - length + 1
    first, last = np.maximum(target - length + 1, 0), np.minimum(source, starts - 1)
    held = first <= last
    first, last, apart = first[held], last[held], (target - source)[held]
    come = [np.bincount(first, w, starts + 1) for w in (None, apart)]
    gone = [np.bincount(last + 1, w, starts + 1) for w in (None, apart)]
    return np.array(come, float) - np.array(gone, float)


def add_crop_steps(steps: dict[int, np.ndarray], source: np.ndarray, target: np.ndarray, size: int) -> None:
    """Add contacts to the changes of each length. Those that every crop of every
    length holds are counted at the first start alone."""
    shortest = min(steps)
    inner = (source >= size - shortest) & (target < shortest)
    whole = int(inner.sum()), int((target - source)[inner].sum())
    source, target = source[~inner], target[~inner]
    for length, sums in steps.items():
        sums[:, 0] += whole
        sums[:, -1] -= whole
        if len(source):
            sums += crop_steps(source, target, size, length)


def _step_rows(pairs: DataFrame, by: Sequence[str], found: Callable) -> DataFrame:
    """(by, steps): per entity the changes of all its crops, added up over its contacts,
    which ``found`` yields for a row of a batch; rows have ``size`` and ``lengths``."""
    by = list(by)
    schema = T.StructType([*[pairs.schema[c] for c in by], T.StructField("crop_length", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "n", "apart")]])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        values: dict[tuple, tuple] = {}

        def passed_on():
            for (keys, length), steps in held.items():
                at = np.flatnonzero(steps.any(0))
                n, apart = steps[:, at].astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(at)) for k in values[keys]), pa.array(np.full(len(at), length, np.int32)), pa.array(at), pa.array(n), pa.array(apart)], names=schema.names)
            held.clear()

        for batch in batches:
            entity = list(zip(*(batch.column(c).to_pylist() for c in by)))
            sizes, lengths = batch.column("size").to_pylist(), batch.column("lengths").to_pylist()
            for i in range(batch.num_rows):
                values.setdefault(entity[i], tuple(batch.column(c)[i] for c in by))
                for length in lengths[i]:
                    if (entity[i], length) not in held:
                        held[entity[i], length] = np.zeros((2, sizes[i] - length + 2))
                steps = {length: held[entity[i], length] for length in lengths[i]}
                for source, target in found(batch, i):
                    add_crop_steps(steps, source, target, sizes[i])
                if sum(v.shape[1] for v in held.values()) >= 4 * HELD_POINTS:
                    yield from passed_on()
        yield from passed_on()

    sums = pairs.mapInArrow(run, schema).groupBy(*by, "crop_length", "start").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"))
    return sums.groupBy(*by).agg(F.collect_list(F.struct("crop_length", "start", "n", "apart")).alias("steps"))


def window_descriptors(
    res: DataFrame, edges: DataFrame | None, by: Sequence[str], position: str, lengths: DataFrame, ss: str, max_excess: int | None = None,
    cutoff: float = 8.0, sep: int = 3,
) -> DataFrame:
    """Descriptors of every crop of the wanted ``lengths`` (column ``crop_length``).

    An entity is cropped to lengths not above its own, and at most ``max_excess``
    below. Its rows travel as one row of arrays, whose running sums give each crop,
    with the sums of its contacts: the ``edges``, or without them what lies within
    ``cutoff``, added up where points meet. Crops without any row are left out.
    """
    by = list(by)
    size = F.max(position).cast("int") + 1
    code = F.when(F.col(ss) == "helix", 0).when(F.col(ss) == "strand", 1).when(F.col(ss).isNotNull(), 2).otherwise(-1)
    point = F.struct(F.col(position).cast("int").alias("at"), *[F.col(a).cast("double").alias(a) for a in AXES], code.alias("code"))
    shape = res.dropna(subset=by).groupBy(*by).agg(F.collect_list(point).alias("rows"), size.alias("size"))
    shortest = F.lit(1) if max_excess is None else F.greatest(F.lit(1), F.col("size") - max_excess)
    wanted = lengths.select(F.col("crop_length").cast("int").alias("crop_length")).distinct()
    crops = shape.select(*by, F.explode(F.sequence(shortest, F.col("size"))).alias("crop_length")).join(wanted, "crop_length", "left_semi")
    crops = crops.groupBy(*by).agg(F.array_sort(F.collect_list("crop_length")).alias("lengths"))
    sized = settle(shape.select(*by, "size").join(crops, by))
    if edges is None:
        def met(batch, i):
            for source, target, _ in _contacts(batch, i, cutoff, sep):
                yield source, target

        contacts = _step_rows(_blocks_once(_point_blocks(res, by, position, cutoff, entities=sized), by), by, met)
    else:
        def met(batch, i):
            yield tuple(np.array([batch.column(c)[i].as_py()], np.int64) for c in ("source", "target"))

        contacts = _step_rows(edges.select(*by, "source", "target").join(sized, by), by, met)
    whole = shape.drop("size").join(sized, by).join(contacts, by, "left")
    names = ("radius_of_gyration", "helix_fraction", "strand_fraction", "mean_contact_order", "mean_contact_degree")
    schema = T.StructType([*[res.schema[c] for c in by], T.StructField("crop_length", T.IntegerType()), T.StructField("crop_start", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = lambda c, i=i: batch.column(c).slice(i, 1).flatten()
                rows, changes = one("rows"), one("steps")
                at, *axes, codes = (rows.field(f).to_numpy(zero_copy_only=False) for f in ("at", *AXES, "code"))
                of, start, n_, apart = (changes.field(f).to_numpy(zero_copy_only=False) for f in ("crop_length", "start", "n", "apart"))
                size = batch.column("size")[i].as_py()
                for length in one("lengths").to_pylist():
                    steps, own = np.zeros((2, size - length + 2)), of == length
                    steps[:, start[own]] = n_[own], apart[own]
                    first, *values = crop_table(at, np.array(axes, float), codes, steps, size, length)
                    n = len(first)
                    keys = [pa.array([batch.column(c)[i].as_py()] * n, batch.schema.field(c).type) for c in by]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(n, length, np.int32)), pa.array(first.astype(np.int32)), *(pa.array(v, pa.float64(), from_pandas=True) for v in values)], names=schema.names)

    return whole.mapInArrow(run, schema)


def edge_signatures(edges: DataFrame, nodes: DataFrame, by: Sequence[str], length: DataFrame, cls: str) -> DataFrame:
    a = nodes.select(*by, F.col("position").alias("source"), F.col(cls).alias("_a"))
    b = nodes.select(*by, F.col("position").alias("target"), F.col(cls).alias("_b"))
    out = edges.join(a, [*by, "source"]).join(b, [*by, "target"]).join(length, list(by))
    sig = edge_signature(F.col("source"), F.col("target"), F.col("length"), F.col("_a"), F.col("_b"))
    return out.withColumn("_s", sig).select(*edges.columns, "_s.*")


def signature_counts(res: DataFrame, by: Sequence[str], position: str, length: DataFrame, cls: str, cutoff: float = 8.0, sep: int = 3) -> DataFrame:
    """Number and mean distance of the contacts of each signature, from sums by
    separation and classes that tasks make where points meet."""
    by = list(by)
    names = ["_gap", "_a", "_b", "_n", "_d"]
    kinds = [T.LongType(), T.StringType(), T.StringType(), T.LongType(), T.DoubleType()]
    schema = T.StructType([*[res.schema[c] for c in by], *[T.StructField(n, t) for n, t in zip(names, kinds)]])

    def run(batches):
        held: dict[tuple, np.ndarray] = {}
        values: dict[tuple, tuple] = {}

        def rows(keys, a, b, gap, n, d):
            return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(gap)) for k in values[keys]), pa.array(gap.astype(np.int64)), pa.array([a] * len(gap), pa.string()), pa.array([b] * len(gap), pa.string()), pa.array(n.astype(np.int64)), pa.array(d)], names=schema.names)

        def passed_on():
            for (keys, a, b), (n, d) in held.items():
                gap = np.flatnonzero(n)
                yield rows(keys, a, b, gap, n[gap], d[gap])
            held.clear()

        for batch in batches:
            entity = list(zip(*(batch.column(c).to_pylist() for c in by)))
            for i in range(batch.num_rows):
                values.setdefault(entity[i], tuple(batch.column(c)[i] for c in by))
                for _, p, q, d, near in _strips(batch, i, cutoff):
                    gap = q["at"][None, :] - p["at"][:, None]
                    near &= gap >= sep
                    for a in set(p["_cls"]):
                        for b in set(q["_cls"]):
                            at = np.ix_(p["_cls"] == a, q["_cls"] == b)
                            one = near[at]
                            gaps, far = gap[at][one], d[at][one]
                            if not len(gaps):
                                continue
                            size = int(gaps.max()) + 1
                            if size > HELD_POINTS:
                                own, which = np.unique(gaps, return_inverse=True)
                                yield rows(entity[i], a, b, own, np.bincount(which), np.bincount(which, far))
                                continue
                            sums = held.get((entity[i], a, b), np.zeros((2, 0)))
                            if sums.shape[1] < size:
                                sums = np.pad(sums, ((0, 0), (0, 2 * size - sums.shape[1])))
                            sums[0, :size] += np.bincount(gaps, minlength=size)
                            sums[1, :size] += np.bincount(gaps, far, minlength=size)
                            held[entity[i], a, b] = sums
                if sum(v.shape[1] for v in held.values()) >= 4 * HELD_POINTS:
                    yield from passed_on()
        yield from passed_on()

    found = _near_blocks(res.withColumn("_cls", F.col(cls)), by, position, cutoff, ["_cls"]).mapInArrow(run, schema)
    sums = found.groupBy(*by, "_gap", "_a", "_b").agg(F.sum("_n").alias("_n"), F.sum("_d").alias("_d")).join(length, by)
    sig = edge_signature(F.lit(0), F.col("_gap"), F.col("length"), F.col("_a"), F.col("_b"))
    return sums.withColumn("_s", sig).groupBy(*by, "_s.separation", "_s.classes", "_s.contact_order").agg(
        F.sum("_n").alias("n_edges"), (F.sum("_d") / F.sum("_n")).alias("mean_distance"))


def residue_summary(res: DataFrame, by: Sequence[str], has: str, ss: str) -> DataFrame:
    """Missing count and share, and helix / strand shares of the resolved rows."""
    ok = F.col(has)
    return res.groupBy(*by).agg(
        F.count_if(~ok).alias("missing_count"),
        F.avg((~ok).cast("double")).alias("missing_fraction"),
        *[F.coalesce(F.avg(F.when(ok, (F.col(ss) == c).cast("double"))), F.lit(0.0)).alias(f"{c}_fraction") for c in ("helix", "strand")],
    )


def circular_map(df: DataFrame, by: str, position: str, length: str, key: Column, frac: float = 0.25, seed: int = 0) -> DataFrame:
    """Source position after rolling the entity by a hashed shift.

    The shift keeps at least ``frac`` of the length between old and new place.
    """
    n = F.col(length)
    least = F.greatest(F.lit(1), F.ceil(n * frac)).cast("long")
    free = n - 2 * least + 1  # shifts least .. n - least
    x = mix_value(key, F.lit(0), seed)
    shift = F.when(free > 0, least + x % F.greatest(free, F.lit(1))).otherwise(1 + x % F.greatest(n - 1, F.lit(1)))
    return df.withColumn("shift", shift).withColumn("source_position", F.pmod(F.col(position) - F.col("shift"), n))


def length_map(df: DataFrame, position: str, target_length: str, source_length: str) -> DataFrame:
    """Nearest source position when the source is stretched to the target length."""
    t, s = F.col(target_length), F.col(source_length)
    step = F.when(t > 1, (s - 1) / F.nullif(t - 1, F.lit(0))).otherwise(0.0)
    return df.withColumn("source_position", F.rint(F.col(position) * step).cast("int"))


def shuffled_map(df: DataFrame, by: Sequence[str], position: str, mixed: Column) -> DataFrame:
    """Random residue mapping: every position takes another row's place."""
    rows = df.withColumn("source_position", F.col(position))
    return shuffle_within(rows, by, [position], ["source_position"], mixed)


def apply_map(mapping: DataFrame, rows: DataFrame, entity: str, position: str = "position") -> DataFrame:
    """Rows of the source entity placed at the mapped target positions."""
    src = rows.withColumnsRenamed({entity: "source_id", position: "source_position"})
    return mapping.join(src, ["source_id", "source_position"])


def sample_edges(edges: DataFrame, by: Sequence[str], frac: float, seeds: Sequence[int]) -> DataFrame:
    """Drop a fixed share of the edges of each entity, once per seed; keeps the rest."""
    by = list(by)
    x = mix_value(F.col("source") * 100003 + F.col("target"), F.col("seed"), 17)
    e = edges.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn("_x", x).withColumn("_bucket", F.shiftright("_x", 15))
    # Counts of buckets of the hash tell where the cut lies; only its bucket is sorted.
    counts = settle(e.groupBy(*by, "seed", "_bucket").agg(F.count(F.lit(1)).alias("_k")).dropna(subset=by))
    cut = settle(_cut_buckets(counts, by, frac))
    met = e.join(cut, [*by, "seed"])
    kept = met.where("_bucket > cut").select(*edges.columns, "seed")
    o = ordinals(settle(met.where("_bucket = cut")), [*by, "seed"], ["_x", "source", "target"], pos="_p", total="_n")
    return kept.unionByName(o.where("_p > left").select(*edges.columns, "seed"))


def _cut_buckets(counts: DataFrame, by: Sequence[str], frac: float) -> DataFrame:
    """(by, seed, cut, left): the bucket in which the dropped share ends, and how many of its edges are dropped."""
    group = W.partitionBy(*by, "seed")
    drop = F.rint(F.sum("_k").over(group) * frac)
    upto = F.sum("_k").over(group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0))
    placed = counts.withColumns({"_drop": drop, "_upto": upto}).where("_upto >= _drop")
    first = F.min(F.struct(F.col("_bucket").alias("cut"), (F.col("_drop") - F.col("_upto") + F.col("_k")).alias("left")))
    return placed.groupBy(*by, "seed").agg(first.alias("_c")).select(*by, "seed", "_c.*")


def edge_mix(source: np.ndarray, target: np.ndarray, seed: int) -> np.ndarray:
    """``mix_value`` of an edge under a seed, as ``sample_edges`` orders them."""
    b, j = source * 100003 + target, int(seed)

    def rest(x):
        # Division by a number known beforehand is faster than the remainder.
        return x - x // PRIME * PRIME

    fixed = b * 17 + j * 31
    a = rest(b * 1000003 + (j * 7919 + 17))
    for k in ROUND_CONSTANTS:
        a = rest(rest(a * a + k) * MULTIPLIER + fixed)
    return a


def sample_contacts(res: DataFrame, by: Sequence[str], position: str, cutoff: float, sep: int, frac: float, seeds: Sequence[int]) -> DataFrame:
    """``sample_edges`` of the contacts of a table: (by, source, target, seed), drawn where points meet.

    Tasks make the contacts three times: to count the buckets of their hash, for the
    bucket in which the cut lies, and for those behind the last one dropped. Only
    the last ones and those of one bucket become rows.
    """
    by = list(by)
    keys = [res.schema[c] for c in by]
    ends = [T.StructField(c, T.LongType()) for c in ("source", "target")]
    seed = T.StructField("seed", T.IntegerType())
    blocks = _point_blocks(res, by, position, cutoff)
    size = 1 << 16

    def table(names, fixed, *columns):
        return pa.RecordBatch.from_arrays([*(pa.repeat(k, len(columns[0])) for k in fixed), *(pa.array(c) for c in columns)], names=names)

    counted = T.StructType([*keys, seed, T.StructField("_bucket", T.LongType()), T.StructField("_k", T.LongType())])

    def count(batches):
        held: dict[tuple, tuple] = {}

        def passed_on():
            for fixed, sums in held.values():
                for at, n in zip(seeds, sums):
                    bucket = np.flatnonzero(n)
                    yield table(counted.names, fixed, np.full(len(bucket), at, np.int32), bucket, n[bucket])
            held.clear()

        for batch in batches:
            entity = list(zip(*(batch.column(c).to_pylist() for c in by))) if by else [()] * batch.num_rows
            for i in range(batch.num_rows):
                # Rows of an entity follow one another.
                if entity[i] not in held:
                    yield from passed_on()
                    held[entity[i]] = tuple(batch.column(c)[i] for c in by), np.zeros((len(seeds), size), np.int64)
                for source, target, _ in _contacts(batch, i, cutoff, sep):
                    for at, n in zip(seeds, held[entity[i]][1]):
                        n += np.bincount(edge_mix(source, target, at) >> 15, minlength=size)
        yield from passed_on()

    def chosen(schema, keep):
        """Contacts of each seed that ``keep`` takes by their hash and the seed's cut."""

        def run(batches):
            for batch in batches:
                cuts = batch.column("_cuts").to_pylist()
                for i in range(batch.num_rows):
                    fixed = tuple(batch.column(c)[i] for c in by)
                    for source, target, _ in _contacts(batch, i, cutoff, sep):
                        for cut in cuts[i]:
                            x = edge_mix(source, target, cut["seed"])
                            held = keep(x, source, target, cut)
                            n = int(held.sum())
                            columns = {"_x": x, "source": source, "target": target}
                            if n:
                                yield table(schema.names, fixed, *(np.full(n, cut["seed"], np.int32) if c == "seed" else columns[c][held] for c in schema.names[len(by):]))

        return run

    def met(cuts):
        one = cuts.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in cuts.columns if c not in by])).alias("_cuts"))
        return _blocks_once(blocks, by).join(F.broadcast(one), by) if by else _blocks_once(blocks, by).crossJoin(one)

    counts = settle(_blocks_once(blocks, by).mapInArrow(count, counted).groupBy(*by, "seed", "_bucket").agg(F.sum("_k").alias("_k")))
    cut = settle(_cut_buckets(counts, by, frac))
    tied = T.StructType([*keys, seed, T.StructField("_x", T.LongType()), *ends])
    bucket = met(cut).mapInArrow(chosen(tied, lambda x, s, t, cut: x >> 15 == cut["cut"]), tied)
    placed = ordinals(settle(bucket), [*by, "seed"], ["_x", "source", "target"], pos="_p", total="_n")
    last = placed.join(cut, [*by, "seed"]).where("_p = left").select(*by, "seed", F.struct("_x", "source", "target").alias("last"))
    # Where nothing is dropped there is no last one.
    behind = settle(cut.select(*by, "seed").join(last, [*by, "seed"], "left"))

    def later(x, source, target, cut):
        last = cut["last"]
        if last is None:
            return np.ones(len(x), bool)
        held = x > last["_x"]
        for i in np.flatnonzero(x == last["_x"]):
            held[i] = (source[i], target[i]) > (last["source"], last["target"])
        return held

    out = T.StructType([*keys, *ends, seed])
    kind = res.schema[position].dataType
    kept = met(behind).mapInArrow(chosen(out, later), out)
    return kept if kind == T.LongType() else kept.withColumns({c: F.col(c).cast(kind) for c in ("source", "target")})


def superpose(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rotation, centres and RMSD that best lay set b on set a (columns ax..bz).

    Spark folds each entity to means and nine cross-moments; only those 3 x 3
    matrices meet NumPy, in Arrow batches.
    """
    m = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(s + a).alias(f"c{s}{a}") for s in "ab" for a in AXES],
        (sum((F.var_pop("a" + a) + F.var_pop("b" + a) for a in AXES), F.lit(0.0))).alias("_e0"),
        F.array(*[F.covar_pop("b" + r, "a" + c) for r in AXES for c in AXES]).alias("_h"),
    )

    @F.pandas_udf("rotation array<double>, trace double")
    def rotate(h: pd.Series) -> pd.DataFrame:
        u, s, vt = np.linalg.svd(np.stack(h.to_numpy()).reshape(-1, 3, 3))
        d = np.sign(np.linalg.det(u @ vt))
        d[d == 0] = 1.0
        fix = np.tile(np.eye(3), (len(d), 1, 1))
        fix[:, 2, 2] = d
        rot = u @ fix @ vt
        return pd.DataFrame({"rotation": list(rot.reshape(-1, 9)), "trace": s[:, 0] + s[:, 1] + d * s[:, 2]})

    out = m.withColumn("_r", rotate("_h"))
    return out.select(
        *by, "n", *[f"c{s}{a}" for s in "ab" for a in AXES], F.col("_r.rotation").alias("rotation"),
        F.sqrt(F.greatest(F.col("_e0") - 2 * F.col("_r.trace"), F.lit(0.0))).alias("rmsd"),
    )


def transform_back(pairs: DataFrame, fit: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add the moved b coordinates mx, my, mz."""
    p = pairs.join(fit.select(*by, "rotation", *[f"c{s}{a}" for s in "ab" for a in AXES]), list(by))
    cols = {}
    for j, a in enumerate(AXES):
        cols["m" + a] = sum(
            ((F.col("b" + r) - F.col("cb" + r)) * F.element_at("rotation", 3 * i + j + 1) for i, r in enumerate(AXES)), F.lit(0.0)
        ) + F.col("ca" + a)
    return p.withColumns(cols).drop("rotation", *[f"c{s}{a}" for s in "ab" for a in AXES])


def local_geometry(
    pairs: DataFrame, by: Sequence[str], position: str, *, local: float = 10.0, lddt: float = 15.0,
    thresholds: Sequence[float] = (0.5, 1.0, 2.0, 4.0), contact: float = 8.0, sep: int = 3,
) -> DataFrame:
    """Per position: local RMSD, distance-difference score, contact retention, displacement.

    ``pairs`` holds the reference (ax, ay, az) and the laid-on set (mx, my, mz).
    """
    by = list(by)
    disp2 = sum(((F.col("a" + a) - F.col("m" + a)) * (F.col("a" + a) - F.col("m" + a)) for a in AXES), F.lit(0.0))
    info = pairs.select(*by, position, *[F.col("a" + a).alias(a) for a in AXES], *[F.col("m" + a).cast("double").alias("_" + a) for a in AXES], disp2.cast("double").alias("_d2"))
    moved_axes = ["_" + a for a in AXES]

    def fold(p, q, d, near):
        moved = distances(p, q, moved_axes)
        known = near & ~np.isnan(moved)
        err = np.abs(moved - d)
        scored = known & (d > 0) & (d <= lddt)
        touch = known & (d <= contact) & (np.abs(q["at"][None, :] - p["at"][:, None]) >= sep)
        close = near & (d <= local)
        hits = sum(((err < t) & scored).sum(1) for t in thresholds)
        return {"_s": close @ np.nan_to_num(q["_d2"]), "_k": close.sum(1), "_hits": hits, "_scored": scored.sum(1), "_kept": (touch & (moved <= contact)).sum(1), "_touch": touch.sum(1)}

    sums = near_sums(info, by, position, max(local, lddt, contact), fold, ["_s", "_k", "_hits", "_scored", "_kept", "_touch"], [*moved_axes, "_d2"])
    agg = sums.select(
        *by, position, "_s", F.col("_k").cast("long").alias("_k"),
        (F.col("_hits") / float(len(thresholds)) / F.nullif("_scored", F.lit(0.0))).alias("lddt"),
        (F.col("_kept") / F.nullif("_touch", F.lit(0.0))).alias("contact_retention"),
    )
    info = info.drop(*AXES)
    out = info.join(agg, [*by, position], "left").fillna(0, ["_s", "_k"])
    # The position itself belongs to its own neighbourhood.
    return out.select(
        *by, position,
        F.sqrt((F.col("_s") + F.col("_d2")) / (F.col("_k") + 1)).alias("local_rmsd"),
        "lddt", "contact_retention", F.sqrt("_d2").alias("displacement"), (F.col("_k") + 1).alias("local_count"),
    )


def cross(a: Column, b: Column) -> Column:
    g = lambda v, i: F.element_at(v, i)
    return F.array(
        g(a, 2) * g(b, 3) - g(a, 3) * g(b, 2), g(a, 3) * g(b, 1) - g(a, 1) * g(b, 3), g(a, 1) * g(b, 2) - g(a, 2) * g(b, 1)
    )


def _unit(v: Column) -> Column:
    return V.let(v, lambda u: V.let(V.l2_norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n))))


def _unit_cos(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0))


def angle(left: Column, center: Column, right: Column) -> Column:
    return F.degrees(F.acos(_unit_cos(V.cosine(V.subtract(left, center), V.subtract(right, center)))))


def dihedral(p1: Column, p2: Column, p3: Column, p4: Column) -> Column:
    """Signed torsion in degrees about the axis p2-p3."""

    def torsion(b0: Column, b1: Column, b2: Column) -> Column:
        reject = lambda w: V.subtract(w, V.scale(b1, V.dot(w, b1)))
        return V.let(reject(b0), lambda v: V.let(reject(b2), lambda w: F.atan2(V.dot(cross(b1, v), w), V.dot(v, w))))

    return F.degrees(
        V.let(V.subtract(p1, p2), lambda b0: V.let(_unit(V.subtract(p3, p2)), lambda b1: V.let(V.subtract(p4, p3), lambda b2: torsion(b0, b1, b2))))
    )


def frame_axes(n: Column, ca: Column, c: Column) -> Column:
    """Orthonormal frame (three axes) of a residue."""

    def axes(x: Column, w: Column) -> Column:
        y = _unit(V.subtract(w, V.scale(x, V.dot(w, x))))
        return V.let(y, lambda yy: F.array(x, yy, cross(x, yy)))

    return V.let(_unit(V.subtract(c, ca)), lambda x: V.let(V.subtract(n, ca), lambda w: axes(x, w)))


def frame_angle(a: Column, b: Column) -> Column:
    """Rotation angle in degrees between two frames."""
    trace = sum((V.dot(F.element_at(a, i), F.element_at(b, i)) for i in (1, 2, 3)), F.lit(0.0))
    return F.degrees(F.acos(_unit_cos((trace - 1.0) / 2.0)))


def backbone_geometry(res: DataFrame, by: Sequence[str], position: str, broken: float = 2.0) -> DataFrame:
    """Bond lengths, angle, peptide distance, omega, pseudo-chirality and breaks.

    Atoms n, ca, c, o are coordinate arrays. The next residue comes by an
    equi-join on position + 1, so a long chain is not sorted in one task.
    """
    nxt = res.select(*by, (F.col(position) - 1).alias(position), F.col("n").alias("_n"), F.col("ca").alias("_ca"))
    c = F.col
    out = res.join(nxt, [*by, position], "left")
    return out.select(
        *by, position,
        V.l2_distance("n", "ca").alias("n_ca"), V.l2_distance("ca", "c").alias("ca_c"), V.l2_distance("c", "o").alias("c_o"),
        angle(c("n"), c("ca"), c("c")).alias("n_ca_c_angle"),
        V.l2_distance("c", "_n").alias("peptide_cn"),
        dihedral(c("ca"), c("c"), c("_n"), c("_ca")).alias("omega"),
        V.dot(cross(V.subtract("n", "ca"), V.subtract("c", "ca")), V.subtract("o", "ca")).alias("pseudochirality"),
        (V.l2_distance("c", "_n") > broken).alias("chain_break"),
    )


def backbone_deltas(role: DataFrame, ref: DataFrame, by: Sequence[str], position: str) -> DataFrame:
    """Per-entity errors of one role's backbone measures against the reference."""
    names = ["n_ca", "ca_c", "c_o", "n_ca_c_angle", "peptide_cn", "omega", "pseudochirality"]
    r = ref.select(*by, position, *[F.col(n).alias("_" + n) for n in names])
    b = role.join(r, [*by, position])
    d = lambda n: F.abs(F.col(n) - F.col("_" + n))
    turn = F.abs(F.pmod(F.col("omega") - F.col("_omega") + 180.0, F.lit(360.0)) - 180.0)
    return b.groupBy(*by).agg(
        F.avg((d("n_ca") + d("ca_c") + d("c_o")) / 3).alias("bond_mae"),
        F.avg(d("n_ca_c_angle")).alias("angle_mae"),
        F.avg("peptide_cn").alias("peptide_mean"), F.max("peptide_cn").alias("peptide_max"), F.avg(d("peptide_cn")).alias("peptide_mae"),
        F.avg(F.col("chain_break").cast("double")).alias("chain_break_fraction"),
        F.avg(turn).alias("omega_mae"),
        F.avg((F.signum("pseudochirality") != F.signum("_pseudochirality")).cast("double")).alias("chirality_flip_fraction"),
    )
