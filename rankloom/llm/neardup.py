"""Near-duplicates by Order MinHash, verified by banded alignment.

A sketch entry takes the few smallest hashes among a text's occurrence-labelled
word shingles and keeps these shingles in text order: two texts share an entry
only if they sample the same shingles in the same order, which favours texts
that are few edits apart. Candidates are verified by aligning the shingle
sequences inside a band that cannot cut off an alignment of the wanted length.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from rankloom.llm.graphs import labels, settle_rows, stars
from rankloom.llm.texts import bound_batches, dense, give_back, map_texts, mix, seeds, text_bytes, text_slices, word_hashes
from rankloom.session import settle

SHINGLE = 5
SIMILARITY = 0.8
#: Sketch entries per text, and shingles in each. A pair of similarity 0.8 shares
#: an entry with probability 0.51, and none of sixteen with probability 1e-5.
SKETCHES = 16
SAMPLED = 3
#: Buckets up to this size are compared pair by pair.
SMALL = 8
#: Centres of a larger bucket in the third round, the next, and the growth after it.
HUBS, CENTRES, GROWTH = 4, 256, 16
#: Sketch entries whose buckets the first round looks at.
FIRST_ENTRIES = 4
#: A shingle is rare if at most so many texts of the unmerged buckets hold it.
RARE = 16
#: Words of 64 bits that show which slots a text's shingles fill.
FILLS = tuple(f"f{i}" for i in range(16))
#: Pairs that one task aligns.
TASK_PAIRS = 5_000
#: Bytes of words and shingles that a task keeps for further pairs of a batch.
HELD_BYTES = 16 << 20
#: Bytes of the bitmap of texts that have candidates.
BITMAP = 1 << 18

MARKS = ("m0", "m1", "m2", "m3")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = seeds(SKETCHES) | np.uint64(1)


def labelled_shingles(words: np.ndarray) -> np.ndarray:
    """One hash per word shingle, distinct for each occurrence of a shingle. Fewer
    words than a shingle has are one shingle; no words have none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(n, SHINGLE)
    words = words.astype(np.uint64)
    h = words[: n - size + 1]
    for j in range(1, size):
        h = h * _ODD + words[j : n - size + 1 + j]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.ones(len(h), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return h
    at = np.arange(len(h))
    occurrence = np.empty(len(h), np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(occurrence > 0, mix(h ^ occurrence * _ODD), h)


def order_minhash(shingles: np.ndarray) -> np.ndarray:
    """Sketch of a text: for each hash function its smallest shingles in text order."""
    n = len(shingles)
    out = np.empty(SKETCHES, np.uint64)
    take = min(SAMPLED, n)
    step = max(1, (1 << 17) // max(n, 1))  # bounds the table of hashes of a long text
    for lo in range(0, SKETCHES, step):
        v = shingles[None, :] * _SEEDS[lo : lo + step, None]
        v ^= v >> np.uint64(32)
        at = np.argpartition(v, take - 1, axis=1)[:, :take] if take < n else np.tile(np.arange(n), (len(v), 1))
        at.sort(axis=1)
        h = _SEEDS[lo : lo + step].copy()
        for j in range(take):
            h = h * _ODD + shingles[at[:, j]]
        out[lo : lo + step] = mix(h)
    return out


def marks(shingles: np.ndarray) -> np.ndarray:
    """64 nibbles in four words: of the hashes with equal first six bits, the
    least one's trace from 1 to 15, or 0 if there is none."""
    ranked = np.sort(shingles)
    bins = np.arange(64, dtype=np.uint64) << np.uint64(58)
    at = np.searchsorted(ranked, bins)
    least = ranked[np.minimum(at, len(ranked) - 1)] if len(ranked) else bins
    there = (at < len(ranked)) & (least >> np.uint64(58) == np.arange(64, dtype=np.uint64))
    nibble = np.where(there, (least >> np.uint64(8)) % np.uint64(15) + np.uint64(1), np.uint64(0))
    return (nibble.reshape(4, 16) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(1, dtype=np.uint64).astype(np.int64)


def rising(values: list[int]) -> int:
    """Length of the longest strictly rising subsequence."""
    tails: list[int] = []
    for v in values:
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Shared part of two shingle sequences that one alignment keeps in order.

    Labelled shingles are distinct in a text, so the best alignment is the
    longest rising run of matched positions. Matches further off the diagonal
    than the unmatched shingles of a similar pair allow lie outside the band.
    """
    if not len(a) or not len(b):
        return 0.0
    needed = least / (1 + least) * (len(a) + len(b))
    if min(len(a), len(b)) < needed - 1e-9:
        return 0.0
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    band = max(len(a), len(b)) - needed + 1e-9
    inside = np.abs(i - j) <= band
    i, j = i[inside], j[inside]
    if len(i) < needed - 1e-9:
        return 0.0
    j = j[np.argsort(i)]
    c = len(j) if (np.diff(j) > 0).all() else rising(j.tolist())
    return c / (len(a) + len(b) - c)


def sketch_texts(docs: DataFrame, text: str) -> DataFrame:
    """Add content (a digest of the words), n (shingles), sketch and marks."""
    fields = [T.StructField("content", T.BinaryType(), False), T.StructField("n", T.LongType(), False), T.StructField("sketch", T.ArrayType(T.LongType(), False), False)]
    fields += [T.StructField(m, T.LongType(), False) for m in MARKS]

    def make():
        def fn(column):
            hashes, rows = word_hashes(*text_bytes(column))
            content, sizes, sketch, traces = [], [], [], []
            for a, b in zip(rows[:-1], rows[1:]):
                shingles = labelled_shingles(hashes[a:b].astype(np.uint32))
                content.append(_digest(hashes[a:b]))
                sizes.append(len(shingles))
                traces.append(marks(shingles))
                sketch.append(order_minhash(shingles).astype(np.int64) if b > a else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, sketch)], dtype=np.int32)
            return [pa.array(content, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketch))), *(pa.array(c) for c in np.array(traces).T)]

        return fn

    return map_texts(docs, text, make, fields)


def _digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def packed_words(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(content, words as packed hashes) of the wanted contents, once each.

    A bitmap of fixed size over the digests keeps most other texts from being
    shuffled; the join decides.
    """
    slot = F.conv(F.substring(F.hex("content"), 1, 8), 16, 10).cast("long") % (8 * BITMAP)
    filled = wanted.select(F.floor(slot / 8).cast("long").alias("slot"), F.call_function("shiftleft", F.lit(1), (slot % 8).cast("int")).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("n"))
    bitmap = docs.sparkSession.sparkContext.broadcast(dense(filled, BITMAP).astype(np.uint8).tobytes())

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            for part in text_slices(batch, text):
                hashes, rows = word_hashes(*text_bytes(part.column(text)))
                content, words = [], []
                for a, b in zip(rows[:-1], rows[1:]):
                    d = _digest(hashes[a:b])
                    at = int.from_bytes(d[:4], "big") % (8 * BITMAP)
                    if bits[at >> 3] >> (at & 7) & 1:
                        content.append(d)
                        words.append(hashes[a:b].astype(np.uint32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(words, pa.binary())], names=["content", "words"])
        give_back()

    some = bound_batches(docs).select(text).mapInArrow(run, "content binary, words binary")
    return some.join(wanted, "content", "left_semi").groupBy("content").agg(F.first("words").alias("words"))


def similar_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the similarity, written."""
    n = pairs.count()

    def run(batches):
        for batch in batches:
            shingles: dict[bytes, np.ndarray] = {}
            held = 0

            def of(packed: bytes) -> np.ndarray:
                nonlocal held
                if packed not in shingles:
                    if held + 3 * len(packed) > HELD_BYTES:
                        shingles.clear()
                        held = 0
                    shingles[packed] = labelled_shingles(np.frombuffer(packed, np.uint32))
                    held += 3 * len(packed)
                return shingles[packed]

            good = [aligned_similarity(of(x.as_py()), of(y.as_py())) >= SIMILARITY - 1e-12 for x, y in zip(batch.column("wa"), batch.column("wb"))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
        shingles = {}
        give_back()

    joined = pairs.join(words.select(F.col("content").alias("a"), F.col("words").alias("wa")), "a").join(words.select(F.col("content").alias("b"), F.col("words").alias("wb")), "b")
    few = joined.select("a", "b", "wa", "wb").coalesce(max(pairs.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_PAIRS)))
    return settle(bound_batches(few).mapInArrow(run, "a binary, b binary"))


def _pair(left, right):
    return F.struct(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))


def _promising(x, y):
    """Can two texts of unlike content be similar, and do their marks allow it?

    Fewer shingles than ``SIMILARITY`` of the other text's rule a pair out. So do
    marks that agree less often than four standard deviations below what that
    similarity makes them: of pairs just similar, 3 in 100,000 do.
    """
    ones = F.lit(0x1111111111111111)

    def filled(v):
        any_bit = v
        for k in (1, 2, 3):
            any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(v, k))
        return F.bit_count(any_bit.bitwiseAND(ones))

    used = sum((filled(x[m].bitwiseOR(y[m])) for m in MARKS), F.lit(0))
    unlike = sum((filled(x[m].bitwiseXOR(y[m])) for m in MARKS), F.lit(0))
    spread = 4 * (SIMILARITY * (1 - SIMILARITY)) ** 0.5
    n, m = x["n"], y["n"]
    return (F.least(n, m) >= F.greatest(n, m) * (SIMILARITY - 1e-9)) & (used - unlike >= SIMILARITY * used - spread * F.sqrt(used))


def filled_slots(shingles: np.ndarray) -> np.ndarray:
    """The slots of hash values that the shingles fill, as bits of ``FILLS`` words."""
    bits = np.zeros(64 * len(FILLS), np.uint8)
    bits[(shingles >> np.uint64(16)) % np.uint64(len(bits))] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def shingle_bounds(open_: DataFrame, words: DataFrame) -> DataFrame:
    """(content, common, rarest, slots) of each (content, n) in ``open_``.

    ``common`` counts the shingles that more than ``RARE`` of these texts hold.
    ``rarest`` holds the shingles that 2 to ``RARE`` texts hold, of those among the
    rarest fifth of the text's shingles and one more. Similar texts share a
    shingle among these, by rareness: a listed one, or a common one, which is
    among them only if at least ``SIMILARITY`` of the text's shingles are common.
    """
    mine = words.join(open_.select("content"), "content", "left_semi")

    def spread_out(batches):
        for batch in batches:
            for content, packed in zip(batch.column("content"), batch.column("words")):
                held = labelled_shingles(np.frombuffer(packed.as_py(), np.uint32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([content.as_py()] * len(held), pa.binary()), pa.array(held)], names=["content", "shingle"])

    def fill(batches):
        for batch in batches:
            slots = [filled_slots(labelled_shingles(np.frombuffer(packed.as_py(), np.uint32))) for packed in batch.column("words")]
            if slots:
                yield pa.RecordBatch.from_arrays([batch.column("content"), *(pa.array(c) for c in np.array(slots).T)], names=["content", *FILLS])

    held = mine.mapInArrow(spread_out, "content binary, shingle long")
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("k"), F.min("content").alias("content")).where(F.col("k") <= RARE)
    # Per text the number of shingles that it alone holds, and per other rare shingle its count.
    counts = settle(counts.groupBy(F.when(F.col("k") == 1, F.col("content")).alias("of"), F.when(F.col("k") > 1, F.col("shingle")).alias("shingle"), "k").agg(F.count(F.lit(1)).alias("single")))
    rare = held.join(counts.where("k > 1").select("shingle", "k"), "shingle").groupBy("content").agg(F.sort_array(F.collect_list(F.struct("k", "shingle"))).alias("rare"))
    single = counts.where("k = 1").select(F.col("of").alias("content"), "single")
    least = F.ceil(F.col("n") * SIMILARITY - 1e-6)
    out = open_.join(mine.mapInArrow(fill, "content binary, " + ", ".join(f"{f} long" for f in FILLS)), "content").join(single, "content", "left").join(rare, "content", "left")
    out = out.withColumn("single", F.coalesce("single", F.lit(0))).withColumn("rare", F.coalesce("rare", F.expr("cast(array() as array<struct<k: bigint, shingle: bigint>>)")))
    taken = F.greatest(F.col("n") - least + 1 - F.col("single"), F.lit(0)).cast("int")
    return out.select("content", (F.col("n") - F.col("single") - F.size("rare")).alias("common"), F.slice("rare", F.lit(1), taken)["shingle"].alias("rarest"), *FILLS)


def _alike_slots(x, y):
    """Each slot that only one of two texts fills is a shingle the other lacks; similar
    texts lack at most a ninth of both together."""
    unlike = sum((F.bit_count(x[f].bitwiseXOR(y[f])) for f in FILLS), F.lit(0))
    return (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * (SIMILARITY - 1e-9)) & (unlike <= (x["n"] + y["n"]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + 1e-6)


def _overlapping(x, y):
    """Can the common shingles of two texts be as many as a similar pair shares?"""
    return (F.least(x["common"], y["common"]) >= (x["n"] + y["n"]) * (SIMILARITY / (1 + SIMILARITY)) - 1e-6) & _alike_slots(x, y)


def _at_home(x: str, y: str):
    """Is this bucket the least of those that two texts share? Only there do they meet."""
    return F.col("bucket") == F.array_min(F.array_intersect(x, y))


def rare_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of texts of unlike class that list one rare shingle; at most ``RARE`` list one."""
    fields = ["content", "comp", "n", *FILLS]
    listed = texts.select(F.explode("rarest").alias("shingle"), "content", "comp")
    other = listed.select("shingle", F.col("content").alias("b"), F.col("comp").alias("other"))
    pairs = listed.join(other, "shingle").where((F.col("content") < F.col("b")) & (F.col("comp") != F.col("other"))).select(F.col("content").alias("a"), "b").distinct()
    x, y = texts.select(F.struct(*fields).alias("x")), texts.select(F.struct(*fields).alias("y"))
    met = pairs.join(x, F.col("a") == F.col("x.content")).join(y, F.col("b") == F.col("y.content"))
    return met.where(_alike_slots({f: F.col(f"x.{f}") for f in fields}, {f: F.col(f"y.{f}") for f in fields})).select("a", "b")


def linked_contents(sketched: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(node, comp): contents that share a class with another content.

    Texts meet in the buckets of their sketch entries. Buckets of any size are
    compared in rounds, each of which joins the classes that its links connect:

    1. Buckets of the first entries take one text as centre for all others.
       This joins the bulk of a large group of copies.
    2. In every bucket that still holds several classes, the text with most
       links is the centre for the texts of other classes.
    3. Small buckets compare all pairs of unlike class. Texts of larger buckets
       meet by the rare shingles that they list. What is left of these buckets are
       texts of mostly common shingles, and pairs that share common ones alone;
       those with most are centres, and leave.
    4. Further texts, not of the largest class, are centres and leave; there are
       more in each round.

    So in the end each pair of a bucket is compared unless links put it into one
    class, and no bucket is one task's work. Pairs that lengths and marks rule
    out are not aligned. Nor are, from the third round on, pairs of larger buckets
    whose common shingles or filled slots show that they share too few.
    """
    traits = ["n", *MARKS]
    texts = sketched.groupBy("content").agg(*[F.first(c).alias(c) for c in ("sketch", *traits)])
    entries = settle(texts.select(F.posexplode("sketch").alias("entry", "bucket"), "content"))
    shared = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    shared = settle(entries.join(shared, "bucket"))
    rows = shared.count()
    wanted = settle_rows(shared.select("content").distinct(), rows)
    members = settle_rows(shared.join(sketched.select("content", *traits).join(wanted, "content", "left_semi").dropDuplicates(["content"]), "content"), rows)
    words = settle(packed_words(docs, text, wanted))
    edges = tested = links = linked = bounds = None
    turn, centres = 1, HUBS
    seat = ("content", "comp", *traits)
    while True:
        held = members if turn > 1 else members.where(F.col("entry") < FIRST_ENTRIES)
        held = held.withColumn("comp", F.col("content")) if linked is None else held.join(linked, held["content"] == linked["node"], "left").withColumn("comp", F.coalesce("comp", "content")).drop("node")
        sizes = held.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
        open_ = sizes.groupBy("bucket").agg(F.sum("k").alias("total"), F.count(F.lit(1)).alias("classes"), F.max_by("comp", F.struct("k", "comp")).alias("largest")).where("classes > 1")
        held = settle_rows(held.join(open_.drop("classes"), "bucket"), rows)
        if held.isEmpty() and turn > 2:
            break
        if turn <= 2:
            rank = F.struct(F.lit(0).alias("d"), F.xxhash64("bucket", "content").alias("h"), *seat)
            if edges is not None:
                degree = edges.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count(F.lit(1)).alias("d"))
                held = held.join(degree, held["content"] == degree["of"], "left").drop("of")
                rank = F.struct(F.coalesce("d", F.lit(0)).alias("d"), *[rank[c].alias(c) for c in ("h", *seat)])
            seats = held.groupBy("bucket").agg(F.max(rank).alias("c"))
            by_pair, large = None, held
        else:
            small = held.where(F.col("total") <= SMALL).groupBy("bucket").agg(F.collect_list(F.struct(*seat)).alias("m"))
            unlike = lambda x, y: (y["content"] > x["content"]) & (y["comp"] != x["comp"]) & _promising(x, y)
            by_pair = small.select(F.explode(F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: unlike(x, y)), lambda y: _pair(x["content"], y["content"]))))).alias("p"))
            large = held.where(F.col("total") > SMALL)
            if bounds is None:
                texts = settle_rows(large.select("content", "comp", "n").distinct(), rows)
                sketches = sketched.select("content", "sketch").join(texts.select("content"), "content", "left_semi").dropDuplicates(["content"])
                bounds = settle(shingle_bounds(texts.select("content", "n"), words).join(sketches, "content"))
                by_pair = by_pair.select("p.*").unionByName(rare_pairs(texts.join(bounds, "content"))).select(F.struct("a", "b").alias("p"))
            large = large.join(bounds.drop("rarest"), "content").where(F.col("common") >= SIMILARITY * F.col("n") - 1e-6)
            rivals = large if turn == 3 else large.where(F.col("comp") != F.col("largest"))
            first = (F.col("n") - 2 * F.col("common")).alias("first")
            seats = _few(rivals.select("bucket", F.struct(first, F.xxhash64("bucket", "content").alias("h"), *seat, "common", *FILLS, "sketch").alias("c")), centres)
            centres = CENTRES if turn == 3 else centres * GROWTH
        seats = settle_rows(seats, rows)
        fields = traits if turn <= 2 else ["n", "common", *FILLS]
        own, centre = {m: F.col(m) for m in fields}, {m: F.col(f"c.{m}") for m in fields}
        fits = _promising(own, centre) if turn <= 2 else _overlapping(own, centre) & _at_home("sketch", "c.sketch")
        pairs = large.join(seats, "bucket").where((F.col("comp") != F.col("c.comp")) & fits).select(_pair(F.col("content"), F.col("c.content")).alias("p"))
        pairs = (pairs if by_pair is None else pairs.unionByName(by_pair)).select("p.*").distinct()
        pairs = settle_rows(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), rows)
        found = similar_pairs(pairs, words)
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        # A part of the merging may wait for the last round: unlike labels only cost further pairs.
        both = found if links is None else found.unionByName(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
        links = stars(both, rows, rounds=1)
        linked = settle_rows(labels(links), rows)
        if turn > 2:
            members = settle_rows(large.join(seats.select("bucket", F.col("c.content").alias("content")), ["bucket", "content"], "left_anti").select("entry", "bucket", "content", *traits), rows)
        turn += 1
    return labels(stars(links.select(F.col("u").alias("a"), F.col("v").alias("b")), rows))


def _few(df: DataFrame, most: int) -> DataFrame:
    """Up to ``most`` rows of each bucket, those with the least c; a bucket is first
    cut down in parts."""
    some = df.withColumn("_part", F.pmod(F.xxhash64("c"), F.lit(64)))
    for by in (["bucket", "_part"], ["bucket"]):
        some = some.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy("c"))).where(F.col("_r") <= most).drop("_r")
    return some.drop("_part")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_class): every row with the least id of its class.

    A class holds the texts that a chain of similar pairs links. Words alone
    count, so texts that differ in white space only are copies; so are texts
    without words, null among them. Null ids take part and name a class only if
    it has no other id. Repeated rows stay and count. No rows give no rows.
    """
    sketched = settle(sketch_texts(docs.select(doc_id, text), text).drop(text))
    return sketched.select(doc_id, "content").join(classes(sketched, docs, doc_id, text), "content").select(doc_id, "class_id", "n_class")


def classes(sketched: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(content, comp, class_id, n_class) for each distinct content of settled sketches."""
    contents = sketched.groupBy("content").agg(F.min(doc_id).alias("least"), F.count(F.lit(1)).alias("n"))
    linked = linked_contents(sketched, docs, text)
    comps = settle(contents.join(linked, contents["content"] == linked["node"], "left").select("content", F.coalesce("comp", "content").alias("comp"), "least", "n"))
    whole = comps.groupBy("comp").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_class"))
    return comps.select("content", "comp").join(whole, "comp")


def drop_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class with all its columns: the one of least id, null
    last, and of rows with that id the one of least content; of rows alike in
    both, one stays. Texts without words are one class."""
    sketched = settle(sketch_texts(docs.select(doc_id, text), text).drop(text))
    own = sketched.groupBy("content").agg(F.min(doc_id).alias("_id"))
    ranked = own.join(classes(sketched, docs, doc_id, text), "content").groupBy("comp").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "content")).alias("best"))
    chosen = settle(ranked.select(F.col("best._id").alias("_id"), F.col("best.content").alias("_content")))
    single = sketched.groupBy(doc_id, "content").count().where("count > 1").isEmpty()
    marked = content_digests(docs, text)
    kept = marked.join(chosen, (marked["_own"] == chosen["_content"]) & marked[doc_id].eqNullSafe(chosen["_id"]), "left_semi")
    return (kept if single else kept.dropDuplicates(["_own"])).drop("_own")


def content_digests(docs: DataFrame, text: str) -> DataFrame:
    """Add the content digest alone, as ``_own``."""

    def make():
        def fn(column):
            hashes, rows = word_hashes(*text_bytes(column))
            return [pa.array([_digest(hashes[a:b]) for a, b in zip(rows[:-1], rows[1:])], pa.binary())]

        return fn

    return map_texts(docs, text, make, [T.StructField("_own", T.BinaryType(), False)])
