"""Helpers that tasks use on Arrow batches of texts.

Everything works on the UTF-8 bytes of a slice of a batch, so that a task's
memory follows ``SLICE_BYTES`` and the longest single text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

SLICE_BYTES = 1 << 20
#: Bytes whose words are hashed at once.
BLOCK = 1 << 16
#: Bytes of an Arrow batch, where the session does not say.
BATCH_BYTES = 4 << 20
#: What Spark gives for a bound that nobody set.
_DEFAULT_BATCH = f"{64 << 20}b"
#: The white space that bounds a word: space, and tab to carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The same words as a pattern.
WORDS = r"[^\x20\x09-\x0D]+"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def give_back() -> None:
    """Return memory that nothing uses to the system: workers outlive their tasks, and
    stages would add up what each kept."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bound_batches(df: DataFrame) -> DataFrame:
    """Have Spark cut Arrow batches at ``BATCH_BYTES`` too, not at a number of rows
    alone; a bound that the session sets itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(name) == _DEFAULT_BATCH:
        conf.set(name, str(BATCH_BYTES))
    return df


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` text bytes, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a column and the row offsets in them; null reads as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, marks, data = column.buffers()
    offsets = np.frombuffer(marks, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP)


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 to the 64th, up to a block's length."""
    out = []
    for b in (int(_STEP), pow(int(_STEP), -1, 1 << 64)):
        steps = np.full(BLOCK + 1, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def _long_word(word: np.ndarray) -> np.ndarray:
    """The polynomial of one word that is longer than a block, block by block."""
    up, down = _powers()
    value = np.zeros(1, np.uint64)
    for lo in range(0, len(word), BLOCK):
        part = word[lo : lo + BLOCK].astype(np.uint64) + np.uint64(1)
        n = len(part)
        value = (value + (part * down[:n]).sum(keepdims=True)) * up[n]
    return value


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of each text, and the rows' offsets in the words.

    A word is a run of bytes other than white space inside one text. Prefix sums
    of a polynomial give the hashes of a block of words at once; a longer word is a
    block of its own, so that memory beside the text follows ``BLOCK``.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    up, down = _powers()
    value = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = int(np.searchsorted(ends, lo + BLOCK, side="right"))
        if j == i:
            value[i : i + 1] = _long_word(data[lo : ends[i]])
            i += 1
            continue
        part = data[lo : ends[j - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * down[: len(part)], out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        value[i:j] = (sums[b] - sums[a]) * up[b]
        i = j
    return mix(value ^ (ends - starts).astype(np.uint64) * _STEP), np.searchsorted(starts, offsets)


def gram_codes(data: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each four-byte window."""
    x = data.astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    code ^= code >> np.uint32(15)
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


def gram_blocks(data: np.ndarray, offsets: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Walk the four-byte windows of a slice in blocks of bounded memory.

    Gives the block's first position, the buckets, and the positions in the
    block whose window runs over the end of its text.
    """
    over = np.unique((offsets[1:, None] - np.arange(1, 4)).ravel())
    for lo in range(0, max(len(data) - 3, 0), SLICE_BYTES):
        hi = min(lo + SLICE_BYTES, len(data) - 3)
        yield lo, gram_codes(data[lo : hi + 3], bits), over[(over >= lo) & (over < hi)] - lo


def gram_counts(offsets: np.ndarray) -> np.ndarray:
    """Number of four-byte windows of each text."""
    return np.maximum(np.diff(offsets) - 3, 0)


def gram_sums(data: np.ndarray, offsets: np.ndarray, bits: int, tables: Sequence[np.ndarray]) -> np.ndarray:
    """Sum of each table over the windows of each text, one row per table.

    Tables hold integers, so sums do not depend on how texts meet in a batch.
    """
    out = np.zeros((len(tables), len(offsets) - 1), np.int64)
    for lo, code, over in gram_blocks(data, offsets, bits):
        a = np.clip(offsets[:-1] - lo, 0, len(code))
        b = np.clip(offsets[1:] - lo, 0, len(code))
        for row, table in zip(out, tables, strict=True):
            value = table[code]
            value[over] = 0
            sums = np.concatenate(([0], np.cumsum(value, dtype=np.int64)))
            row += sums[b] - sums[a]
    return out


def add_grams(counts: np.ndarray, data: np.ndarray, offsets: np.ndarray, bits: int) -> None:
    """Add the windows of a slice to counts."""
    for _, code, over in gram_blocks(data, offsets, bits):
        keep = np.ones(len(code), bool)
        keep[over] = False
        counts += np.bincount(code[keep], minlength=len(counts))


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable], fields: Sequence[T.StructField]) -> DataFrame:
    """Add columns computed from a text column, slice by slice.

    ``make`` runs once per task and gives a function from the text column of a
    slice to the arrays of the new columns. Input columns pass through; one with
    the name of a new column gives way to it.
    """
    new = [f.name for f in fields]
    kept = [c for c in df.columns if c not in new]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches):
        fn = make()
        for batch in batches:
            for part in text_slices(batch, text):
                columns = [part.column(c) for c in kept] + list(fn(part.column(text)))
                yield pa.RecordBatch.from_arrays(columns, names=kept + new)
        give_back()

    return bound_batches(df).mapInArrow(run, schema)


def sparse_counts(df: DataFrame, columns: Sequence[str], make: Callable[[], tuple[Callable, Callable]]) -> DataFrame:
    """Sum integer tables over all rows: gives (slot, n) with one row per slot.

    ``make`` runs once per task and gives (add, table): ``add`` takes a record
    batch, ``table`` gives the flat table of the task, of a size fixed by the
    caller. Only filled slots leave the task.
    """

    def run(batches):
        add, table = make()
        for batch in batches:
            add(batch)
        flat = table()
        slots = np.flatnonzero(flat)
        for at in range(0, len(slots), 1 << 16):
            s = slots[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(flat[s].astype(np.int64))], names=["slot", "n"])
        give_back()

    return bound_batches(df).select(*columns).mapInArrow(run, "slot long, n long").groupBy("slot").sum("n").withColumnRenamed("sum(n)", "n")


def dense(counts: DataFrame, size: int) -> np.ndarray:
    """Gather summed counts; the caller's table size bounds what reaches the driver."""
    t = counts.toArrow()
    out = np.zeros(size, np.int64)
    out[t.column("slot").to_numpy()] = t.column("n").to_numpy()
    return out
