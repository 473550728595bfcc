"""Corrupted states of sequences, chosen by integer hash.

A state is built inside its own row, from its letters alone, so a bank needs no
shuffle. Draws depend only on (key, position, seed).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.functions.classes import MASK, SYMBOLS
from rankloom.functions.sequences import letters
from rankloom.functions.vectors import _col, let
from rankloom.operators.inference import PRIME, mix_value
from rankloom.operators.ordering import ordinals
from rankloom.operators.resampling import MULTIPLIER, ROUND_CONSTANTS
from rankloom.session import spread

#: Letters that a task draws for at once, or those of one text.
LETTERS_AT_ONCE = 1 << 19


def edit_count(length: Column, ratio: Column | float, least: int = 1) -> Column:
    r = ratio if isinstance(ratio, Column) else F.lit(float(ratio))
    return F.least(length, F.greatest(F.lit(least), F.rint(length * r).cast("int")))


def _edited(seq: Column | str, key: Column, seed: int, count: Callable[[Column], Column], edit: Callable[[Column, Column], Column], eligible: Column | None = None) -> Column:
    """Apply ``edit(letter, position)`` at the ``count`` positions of lowest hash.

    The highest chosen hash is found once; each letter then compares with it.
    """

    def build(cs: Column, may: Column | None) -> Column:
        allowed = lambda i: F.coalesce(F.get(may, i), F.lit(False))
        draws = F.transform(F.sequence(F.lit(0), F.size(cs) - 1), lambda i: F.struct(mix_value(key, i, seed).alias("h"), i.alias("i")))

        def letter(d: Column, c: Column, lim: Column) -> Column:
            ok = d <= lim if may is None else (d <= lim) & allowed(d["i"])
            return F.when(ok, edit(c, d["i"])).otherwise(c)

        def placed(ds: Column) -> Column:
            pool = ds if may is None else F.filter(ds, lambda s: allowed(s["i"]))
            limit = F.get(F.array_sort(pool), count(F.size(cs)) - 1)
            return let(limit, lambda lim: F.array_join(F.zip_with(ds, cs, lambda d, c: letter(d, c, lim)), ""))

        return let(draws, placed)

    s = _col(seq)
    if eligible is None:
        built = let(letters(s), lambda cs: build(cs, None))
    else:
        built = let(letters(s), lambda cs: let(eligible, lambda may: build(cs, may)))
    return F.when(F.length(s) > 0, built).otherwise(s)


def _mixed(key: np.ndarray, at: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    """``mix_value`` for keys, positions and seeds side by side."""
    a = np.mod(key * 1000003 + at * 7919 + seed, PRIME)
    for k in ROUND_CONSTANTS:
        a = np.fmod(np.fmod(a * a + k, PRIME) * MULTIPLIER + at * 31 + key * 17, PRIME)
    return a


def _runs(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows of at most ``LETTERS_AT_ONCE`` letters, or one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LETTERS_AT_ONCE, side="right")))
        yield slice(start, stop)
        start = stop


def _longs(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def _edited_texts(texts: list[str], key: np.ndarray, count: np.ndarray, seed: int, mask: str | None, symbols: str) -> list[str]:
    """Each text with its ``count`` letters of lowest hash masked, or replaced by
    another symbol if there is no mask, as ``_edited`` does for one row."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).copy()
    start = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(codes)) - start[row]
    # A stable sort leaves equal hashes in the order of their positions.
    order = np.argsort(_mixed(key[row], at, seed) + row * 2 * PRIME, kind="stable")
    hit = order[at < count[row]]
    if mask is not None:
        codes[hit] = ord(mask)
    else:
        alphabet = np.frombuffer(symbols.encode("utf-32-le"), np.uint32)
        same = codes[hit][:, None] == alphabet
        known = same.any(1)
        pick = _mixed(key[row[hit]], at[hit], seed + 1) % (len(alphabet) - known)
        codes[hit] = alphabet[pick + (known & (pick >= same.argmax(1)))]
    whole = codes.tobytes().decode("utf-32-le")
    return [whole[a : a + n] for a, n in zip(start.tolist(), sizes.tolist())]


def mask_random(seq: Column | str, key: Column, ratio: Column | float, seed: int = 0, mask: str = MASK) -> Column:
    return _edited(seq, key, seed, lambda n: edit_count(n, ratio), lambda c, i: F.lit(mask))


def other_symbol(c: Column, pick: Column, symbols: str) -> Column:
    """A symbol other than ``c``, chosen by the integer ``pick``."""
    own = F.instr(F.lit(symbols), c)  # 0 when foreign
    size = F.when(own > 0, len(symbols) - 1).otherwise(len(symbols))
    return let((pick % size).cast("int") + 1, lambda k: F.substring(F.lit(symbols), k + F.when((own > 0) & (k >= own), 1).otherwise(0), F.lit(1)))


def substitute_uniform(seq: Column | str, key: Column, ratio: Column | float, seed: int = 0, symbols: str = SYMBOLS) -> Column:
    return _edited(seq, key, seed, lambda n: edit_count(n, ratio), lambda c, i: other_symbol(c, mix_value(key, i, seed + 1), symbols))


def mask_targeted(seq: Column | str, key: Column, ratio: Column | float, eligible: Column, seed: int = 0, mask: str = MASK) -> Column:
    """Mask only eligible positions (array<boolean>); NULL if there are too few."""
    s = _col(seq)
    enough = F.size(F.filter(eligible, lambda e: e)) >= edit_count(F.length(s), ratio)
    return F.when(enough, _edited(s, key, seed, lambda n: edit_count(n, ratio), lambda c, i: F.lit(mask), eligible))


def substitute_targeted(seq: Column | str, key: Column, ratio: Column | float, eligible: Column, seed: int = 0, symbols: str = SYMBOLS) -> Column:
    s = _col(seq)
    enough = F.size(F.filter(eligible, lambda e: e)) >= edit_count(F.length(s), ratio)
    pick = lambda c, i: other_symbol(c, mix_value(key, i, seed + 1), symbols)
    return F.when(enough, _edited(s, key, seed, lambda n: edit_count(n, ratio), pick, eligible))


def cumulative_matrix(matrix: DataFrame, temperature: float = 1.0) -> DataFrame:
    """One row holding, per symbol, its substitutes with cumulative probability.

    ``matrix`` has (wild, mut, score); the native symbol itself is left out.
    """
    p = matrix.where("wild <> mut").withColumn("_w", F.exp(F.col("score") / temperature))
    # One row per symbol of the alphabet, so the arrays are bounded by it.
    per = p.groupBy("wild").agg(F.array_sort(F.collect_list(F.struct("mut", "_w"))).alias("_l"))
    total = F.aggregate("_l", F.lit(0.0), lambda a, s: a + s["_w"])
    run = F.transform(
        F.sequence(F.lit(1), F.size("_l")),
        lambda k: F.struct(
            F.get("_l", k - 1)["mut"].alias("mut"),
            (F.aggregate(F.slice("_l", 1, k), F.lit(0.0), lambda a, s: a + s["_w"]) / total).alias("upto"),
        ),
    )
    return per.select("wild", run.alias("cum")).agg(F.map_from_entries(F.collect_list(F.struct("wild", "cum"))).alias("cumulative"))


def draw_cumulative(cum: Column, u: Column) -> Column:
    """First entry whose cumulative probability reaches ``u``."""
    return F.coalesce(
        F.get(F.filter(cum, lambda s: s["upto"] >= u), F.lit(0))["mut"], F.element_at(cum, -1)["mut"]
    )


def substitute_matrix(df: DataFrame, seq: str, key: Column, ratio: Column | float, matrix: DataFrame, temperature: float = 1.0, seed: int = 0, name: str = "state_sequence") -> DataFrame:
    """Substitutes drawn in proportion to exp(score / temperature)."""
    one = F.broadcast(cumulative_matrix(matrix, temperature))  # one row, alphabet-sized
    joined = df.withColumn("_k", key).join(one)

    def pick(c: Column, i: Column) -> Column:
        u = mix_value(F.col("_k"), i, seed + 1) / float(PRIME)
        return F.coalesce(draw_cumulative(F.try_element_at("cumulative", c), u), c)

    return joined.withColumn(name, _edited(seq, F.col("_k"), seed, lambda n: edit_count(n, ratio), pick)).drop("_k", "cumulative")


def substitute_policy(positions: DataFrame, by: Sequence[str], position: str, native: str, logp: str, key: Column, ratio: float, temperature: float = 1.0, seed: int = 0, symbols: str = SYMBOLS) -> DataFrame:
    """Long form: the chosen positions of an entity draw from their own distribution.

    Adds ``current``; positions not chosen keep their native symbol.
    """
    rows = positions.withColumn("_k", key).withColumn("_h", mix_value(F.col("_k"), F.col(position), seed))
    o = ordinals(rows, by, ["_h", position], pos="_p", total="_n")
    own = F.instr(F.lit(symbols), F.col(native))
    w = F.transform(logp, lambda x, i: F.when(i + 1 == own, F.lit(0.0)).otherwise(F.exp(x / temperature)))
    u = mix_value(F.col("_k"), F.col(position), seed + 1) / float(PRIME)

    def draw(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        goal = u * total
        # Position of the first running sum that reaches the goal.
        walk = F.aggregate(
            v, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k")),
            lambda a, x: F.struct(
                (a["s"] + x).alias("s"), F.when(a["s"] >= goal, a["k"]).otherwise(a["k"] + 1).alias("k")
            ),
        )
        return F.substring(F.lit(symbols), F.greatest(walk["k"], F.lit(1)), F.lit(1))

    chosen = F.col("_p") <= edit_count(F.col("_n").cast("int"), ratio)
    return o.withColumn("current", F.when(chosen, let(w, draw)).otherwise(F.col(native))).drop("_k", "_h", "_p", "_n")


def _poisson_steps(mean: float, top: int = 64) -> list[float]:
    cdf, term, acc = [], exp(-mean), 0.0
    for k in range(top):
        acc += term
        cdf.append(acc)
        term *= mean / (k + 1)
    return cdf


def poisson_length(u: Column, mean: float, top: int = 64) -> Column:
    """Inverse of the Poisson distribution at ``u``, at least 1."""
    steps = F.array(*[F.lit(c) for c in _poisson_steps(mean, top)])
    return F.greatest(F.lit(1), F.size(F.filter(steps, lambda c: c < u)))


def _span_rows(n: np.ndarray, key: np.ndarray, count: np.ndarray, mean_length: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the positions that ``span_positions`` keeps."""
    most = 2 * count + 1
    span_row = np.repeat(np.arange(len(n)), most)
    s = np.arange(len(span_row)) - (np.cumsum(most) - most)[span_row]
    from_ = _mixed(key[span_row], s, seed) % n[span_row]
    width = np.maximum(1, np.searchsorted(_poisson_steps(mean_length), _mixed(key[span_row], s, seed + 1) / float(PRIME), side="left"))
    width = np.minimum(width, n[span_row] - from_)
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - start[row]
    # First span that reaches a position; those that none reaches follow after all spans.
    first = most[row]
    inside = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
    np.minimum.at(first, np.repeat(start[span_row] + from_, width) + inside, np.repeat(s, width))
    order = np.argsort(row * (int(most.max(initial=0)) + 1) + first, kind="stable")
    last = first[order[start + count - 1]]
    covered = first <= last[row]
    turn = np.cumsum(covered)
    kept = covered & (turn - (turn[start] - covered[start])[row] <= count[row])
    return row[kept], at[kept]


def span_positions(df: DataFrame, id: str, length: str, key: Column, ratio: float, mean_length: float = 4.0, seed: int = 0) -> DataFrame:
    """(id, position): spans are added in draw order until enough positions are
    covered; the lowest ``count`` of the covered positions are kept.

    Positions no drawn span reaches follow after all spans, so the count is met.
    A text's spans are drawn and laid out where its row is: only ids, lengths and
    keys move, and rows alike count once.
    """
    n = F.col(length)
    base = df.select(id, n.cast("long").alias("_n"), key.cast("long").alias("_k"), edit_count(n, ratio).cast("long").alias("_count"))
    base = base.where((F.col("_n") > 0) & F.col(id).isNotNull()).distinct()
    schema = T.StructType([df.schema[id], T.StructField("position", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, counts = (_longs(batch.column(c)) for c in ("_n", "_k", "_count"))
            for rows in _runs(sizes):
                row, at = _span_rows(sizes[rows], keys[rows], counts[rows], mean_length, seed)
                yield pa.RecordBatch.from_arrays([batch.column(id).take(pa.array(row + rows.start)), pa.array(at.astype(np.int32))], names=schema.names)

    return base.mapInArrow(run, schema)


def build_bank(entities: DataFrame, id: str, seq: str, numeric: Column, levels: Sequence[float], replicates: int, seed: int = 0, symbols: str = SYMBOLS, mask: str = MASK) -> DataFrame:
    """Native state plus masked and substituted states for every level and replicate.

    All states of a text are made where its row is, so none are shuffled; the
    draws are those of ``mask_random`` and ``substitute_uniform``, for many texts at once.
    ``mask`` is one letter.
    """
    plan = [("native", 0.0, 0)] + [
        (kind, lv, r) for kind in ("random_mask", "random_substitution") for lv in levels for r in range(replicates)
    ]
    schema = T.StructType([
        entities.schema[id], T.StructField("reference_sequence", T.StringType()), T.StructField("state_kind", T.StringType(), False),
        T.StructField("level", T.DoubleType(), False), T.StructField("replicate", T.IntegerType(), False), T.StructField("state_sequence", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _longs(batch.column("_k"))
            for rows in _runs(_longs(batch.column("_n"))):
                part = batch.slice(rows.start, rows.stop - rows.start)
                given = part.column("reference_sequence").to_pylist()
                texts = [t or "" for t in given]
                sizes = np.array([len(t) for t in texts], np.int64)
                for kind, level, replicate in plan:
                    made = given
                    if kind != "native":
                        # As ``edit_count``; an empty or null text stays.
                        count = np.minimum(sizes, np.maximum(1, np.rint(sizes * level).astype(np.int64)))
                        draw = keys[rows] * 97 + int(np.rint(level * 1000)) * 7 + replicate
                        how = (seed, mask) if kind == "random_mask" else (seed + 10, None)
                        new = _edited_texts(texts, draw, count, *how, symbols)
                        made = [t if g else g for g, t in zip(given, new)]
                    fixed = [pa.array([v] * len(texts), k) for v, k in ((kind, pa.string()), (level, pa.float64()), (replicate, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([part.column(id), part.column("reference_sequence"), *fixed, pa.array(made, pa.string())], names=schema.names)

    own = spread(entities, id).select(id, F.col(seq).alias("reference_sequence"), numeric.cast("long").alias("_k"), F.coalesce(F.length(seq), F.lit(0)).alias("_n"))
    return own.mapInArrow(run, schema)


def describe_states(states: DataFrame, core: Column | None = None, mask: str = MASK, decay: float = 3.0, penalty: float = 2.0) -> DataFrame:
    """Edit distance, masks, error positions, core share and scaffold score.

    ``core`` marks core positions (array<boolean>) of the state's entity.
    """
    pairs = F.zip_with(
        letters("reference_sequence"), letters("state_sequence"),
        lambda a, b: F.struct((a != b).alias("e"), (b == mask).alias("m")),
    )
    wrong = F.filter(F.transform("_z", lambda s, i: F.when(s["e"], i)), lambda i: i.isNotNull())
    out = states.withColumn("_z", pairs).withColumns({
        "error_positions": wrong,
        "mask_count": F.size(F.filter("_z", lambda s: s["m"])),
    })
    out = out.withColumn("edit_distance", F.size("error_positions")).withColumn(
        "edit_fraction", F.col("edit_distance") / F.greatest(F.length("reference_sequence"), F.lit(1))
    )
    if core is None:
        share = F.lit(0.0)
    else:
        hit = F.size(F.filter("error_positions", lambda i: F.coalesce(F.get(core, i), F.lit(False))))
        share = hit / F.greatest(F.size(F.filter(core, lambda c: c)), F.lit(1))
    return out.withColumn("core_fraction", share.cast("double")).withColumn(
        "scaffold", F.exp(-decay * F.col("edit_fraction")) * F.exp(-penalty * F.col("core_fraction"))
    ).drop("_z")


def describe_scores(positions: DataFrame, by: Sequence[str], logp: str) -> DataFrame:
    """Mean entropy and mean top-two probability gap of a state's positions."""
    from rankloom.functions import vectors as V

    gap = V.top_gap(F.transform(logp, lambda x: F.exp(x)))
    return positions.groupBy(*by).agg(F.avg(V.entropy(logp)).alias("student_entropy"), F.avg(gap).alias("student_top1_gap"))


Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score_requests(req: DataFrame, fn: Scorer, schema: T.StructType | str) -> DataFrame:
    """Run a user's scorer over request batches.

    ``fn`` maps a batch of requests to raw score rows; batches follow Arrow's
    record size, and only the user's code runs in Python.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield fn(pdf)

    return req.mapInPandas(run, schema)
