"""Benchmark passages in training text, in DataFrame functions alone.

The word windows of all benchmark items are one set. A bitmap of that set goes
to every task; each text hashes its own windows by doubling (one word, two,
four, ...) and keeps those that the bitmap may hold. Only these become rows and
meet the set itself, as texts, so a hit is exact. The set is broadcast while
its counted size allows; beyond that the rows meet it in a salted join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.vectors import let
from rankloom.session import settle, spread

#: Words of a window. An item of fewer words is one window.
WINDOW = 10
#: Windows, with the items named for them, that are broadcast at most.
BROADCAST = 500_000
#: Bits of the bitmap for each window, and its greatest size as a power of two.
BITS = 256
MOST_BITS = 26
#: Parts of a window's rows in the join without broadcast.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of lower-cased text, and a word with what stands before it in text as written.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Names of the columns that are added; input columns of these names give way.
ADDED = ("n_words", "n_hit", "hits", "items")

_HITS = "array<struct<start:int,end:int>>"


def words_of(text: Column) -> Column:
    """The normalised words of a text; null has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def window_codes(words: Column, size: int, body: Callable[[Column], Column]) -> Column:
    """``body`` of a hash for each window of ``size`` words; that of an array without entries if there is none.

    Blocks of one, two, four, ... words are hashed from two of half their size,
    and a window from the blocks that its size is made of.
    """

    def joined(left: Column, right: Column, by: int) -> Column:
        n = F.greatest(F.size(right) - by, F.lit(0))
        return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b))

    def grown(block: Column, length: int, done: Column | None, size_done: int) -> Column:
        own, own_size = done, size_done
        if size & length:
            own, own_size = (block, length) if done is None else (joined(done, block, size_done), size_done + length)
        if own_size == size:
            return body(own)
        if own is done:
            return let(joined(block, block, length), lambda b: grown(b, 2 * length, own, own_size))
        return let(own, lambda o: let(joined(block, block, length), lambda b: grown(b, 2 * length, o, own_size)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: grown(h, 1, None, 0))


def window_set(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(window, size, items) for each distinct window, written; items are sorted ids without null."""
    words = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    size = F.least(F.lit(window), F.size("words"))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    cut = words.where(F.size("words") > 0).select("item", size.alias("size"), let(F.col("words"), lambda w: F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " "))).alias("windows"))
    rows = cut.select("item", "size", F.explode("windows").alias("window")).distinct()
    return settle(rows.groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("items")))


def _slots(code: Column, bits: int) -> tuple[Column, Column]:
    """Two places of a window's hash in the bitmap."""
    return code.bitwiseAND(F.lit((1 << bits) - 1)), F.shiftrightunsigned(code, 64 - bits)


def bitmap_of(windows: DataFrame, sizes: Sequence[int], bits: int) -> DataFrame:
    """One row with an array of longs: the bitmap of the windows' hashes."""
    words = F.split("window", " ")
    code = F.coalesce(*[F.when(F.col("size") == s, window_codes(words, s, lambda c: F.get(c, F.lit(0)))) for s in sizes])
    slots = windows.select(code.alias("code")).select(F.explode(F.array(*_slots(F.col("code"), bits))).alias("slot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))
    filled = slots.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(one).alias("bits"))
    every = windows.sparkSession.range(1 << (bits - 6)).join(filled, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("b"))
    return every.agg(F.array_sort(F.collect_list("b"))["bits"].alias("bitmap"))


def _held(bitmap: Column, slot: Column) -> Column:
    word = F.get(bitmap, F.shiftright(slot, 6).cast("int"))
    return F.call_function("shiftright", word, (slot % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _place(pos: Column, n_words: Column, sizes: Sequence[int]) -> tuple[Column, Column]:
    """Start and size of the window that stands at ``pos`` after the sentinel, sizes one after another."""
    start, size, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(1)
    for s in sizes:
        after = before + F.greatest(n_words - (s - 1), F.lit(0))
        here = (pos >= before) & (pos < after)
        start, size, before = F.when(here, pos - before).otherwise(start), F.when(here, F.lit(s)).otherwise(size), after
    return start, size


def _scanned(words: DataFrame, bitmap: Column, sizes: Sequence[int], bits: int) -> DataFrame:
    """(id, row, n, start, size, window), written: a row for each document, where
    start is null, and one for each window that the bitmap may hold, where row is
    null. Written rows keep their number, whatever is computed again later."""
    codes = F.concat(F.array(F.lit(None).cast("long")), *[window_codes(F.col("words"), s, lambda c: c) for s in sizes])
    each = words.select("row", "words", F.size("words").alias("n"), codes.alias("codes"), F.monotonically_increasing_id().alias("id"))
    each = each.select("id", "row", "words", "n", F.posexplode("codes").alias("pos", "code"))
    one, two = _slots(F.col("code"), bits)
    some = each.where((F.col("pos") == 0) | (_held(bitmap, one) & _held(bitmap, two)))
    start, size = _place(F.col("pos"), F.col("n"), sizes)
    window = F.array_join(F.slice("words", start + 1, size), " ")
    first = F.col("pos") == 0
    return settle(some.select("id", F.when(first, F.col("row")).alias("row"), "n", start.alias("start"), size.alias("size"), F.when(~first, window).alias("window")))


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast: int = BROADCAST, keep: Sequence[str] | None = None) -> DataFrame:
    """Add n_words, n_hit, hits (word spans, end exclusive) and items to each row.

    A document word is hit if it lies in any occurrence of ``window`` consecutive
    words of an item, or of all words of a shorter item. ``items`` are the ids of
    items with such a window, as strings, sorted; an item without id marks words
    but is not listed, one whose id is repeated is listed once. Null and empty
    texts have no words. Repeated rows are judged one by one; input columns named
    as the new ones give way. No items or no documents give no hits. One text's
    words and hashes are held at once (some 200 bytes a word). With ``keep``, only these input columns
    are written and returned.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(text).alias("t"))
    windows = window_set(items, item_id, item_text, window)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ``window`` numbers
    words = spread(rows).select("row", words_of(F.col("t")).alias("words"))
    none = F.array().cast(_HITS), F.array().cast("array<string>")
    if not sizes:
        return words.select("row.*", F.size("words").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), none[0].alias("hits"), none[1].alias("items"))
    total = windows.agg(F.count(F.lit(1)), F.sum(F.size("items"))).first()
    bits = min(MOST_BITS, max(12, (BITS * total[0] - 1).bit_length()))
    bitmap = bitmap_of(windows, sizes, bits).scalar()
    scanned = _scanned(words, bitmap, sizes, bits)
    hit = scanned.where(F.col("start").isNotNull()).select("id", "start", "size", "window").join(*_meeting(windows, sum(total) <= broadcast))
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("start", F.col("start") + F.col("size") - 1)))))
    marked = hit.groupBy("id").agg(spans.alias("at"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    next_ = lambda at: F.transform(at, lambda i: i + 1)
    hits = F.arrays_zip(F.array_except("at", next_(F.col("at"))).alias("start"), F.array_except(next_(F.col("at")), F.col("at")).alias("end"))
    marked = marked.select("id", F.size("at").cast("long").alias("n_hit"), hits.cast(_HITS).alias("hits"), "items")
    own = scanned.where(F.col("start").isNull()).select("id", "row", F.col("n").cast("long").alias("n_words"))
    found = own.join(marked, "id", "left")
    return found.select("row.*", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("hits", none[0]).alias("hits"), F.coalesce("items", none[1]).alias("items"))


def _meeting(windows: DataFrame, small: bool) -> tuple[DataFrame, Column | list[str]]:
    """The set and the condition to join it by: broadcast, or salted."""
    if small:
        return F.broadcast(windows.select("window", "items")), ["window"]
    salted = windows.select(F.col("window").alias("w"), "items", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return salted, (F.col("window") == F.col("w")) & (F.pmod(F.xxhash64("id", "start"), F.lit(SALTS)) == F.col("salt"))


def decontaminate(docs: DataFrame, items: DataFrame, *, text: str = "text", remove: str = "spans", **options) -> DataFrame:
    """The documents, in their own columns, without hit words or without hit documents.

    ``remove="spans"`` takes hit words out, each with what stands before it;
    ``remove="documents"`` takes out documents with a hit. All others stay as they are.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    keep = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("t"))
    found = contamination(keep, items, text="t", **options)
    if remove == "documents":
        return found.where("n_hit = 0").select("row.*")
    out = F.sequence(F.lit(0), F.col("n_words").cast("int") - 1)
    at = F.flatten(F.transform("hits", lambda s: F.sequence(s["start"], s["end"] - 1)))
    left = let(F.regexp_extract_all("t", F.lit(PIECE), F.lit(0)), lambda p: F.array_join(F.transform(F.array_except(out, at), lambda i: F.get(p, i)), ""))
    tail = F.regexp_extract("t", r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    cut = F.when(F.col("n_hit") > 0, F.concat(left, tail)).otherwise(F.col("t"))
    return found.select(*[(cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns])
