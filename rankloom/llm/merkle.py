"""Merkle manifest of a table: stored levels, and a recursive query that climbs them.

Rows are leaves. The leaves of each group, in order, are the ground of a tree in
which every two neighbours become one node; the trees' tops, in order of the
groups, are the ground of one more tree. Levels are built in blocks of
consecutive nodes, so a task holds one block. Stored node rows name their parent
row and the siblings on the way to it: a parent row stands ``stride`` levels up.
A recursive query then ascends for each leaf, appends the siblings and folds the
leaf's digest into what the root would be.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from rankloom.session import settle, spread

#: Levels between a node row and its parent row, at least and at most.
STRIDE, MOST_STRIDE = 10, 20
#: Node rows above the leaves' that are broadcast; the stride grows to keep to it.
UPPER = 100_000
#: Rows that one task puts in order.
RANGE_ROWS = 50_000
#: Leaves whose paths are written at once.
SLICE = 1024

#: Trees of groups start with one of these; the tree over them has a name of its own.
_NULL, _GROUP, _TOP = "", "=", "*"

PATH = T.ArrayType(T.StructType([T.StructField("left", T.BinaryType(), False), T.StructField("right", T.BinaryType(), False)]), False)


def digest(*parts: Column | str) -> Column:
    """Lower-case hex SHA-256 of the parts, one after another."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column | str) -> Column:
    """A value as byte count, colon and text; null as a hyphen."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Add idx, the place from 0 in its tree by ``order``, and total, the tree's size.

    Rows are dealt into ranges of trees and order, whose counts give each range's
    first place; a tree of any size is so put in order by many tasks. ``rows``
    must be a written table.
    """
    n = max(1, -(-rows.count() // RANGE_ROWS))
    dealt = settle(rows.repartitionByRange(n, tree, *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("n"))
    # A row for each tree and range: ranges follow each other, so few trees have more than one.
    own = W.partitionBy(tree)
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select(tree, "part", before.alias("first"), F.sum("n").over(own).alias("total"))
    placed = dealt.withColumn("place", F.row_number().over(W.partitionBy(tree, "part").orderBy(*order)).cast("long") - 1)
    return placed.join(firsts, [tree, "part"]).withColumn("idx", F.col("first") + F.col("place")).drop("part", "first", "place")


def _levels(leaves: np.ndarray, height: int) -> list[np.ndarray]:
    """Digests (n x 32 bytes) of the levels from the leaves' up, ``height`` above them."""
    out = [leaves]
    for _ in range(height):
        below = out[-1].tobytes().hex()
        out.append(np.frombuffer(b"".join(hashlib.sha256(below[i : i + 128].encode()).digest() for i in range(0, len(below), 128)), np.uint8).reshape(-1, 32))
    return out


def _paths(levels: list[np.ndarray], lo: int, hi: int) -> pa.Array:
    """For each leaf from lo to hi, its left and right sibling at every level, empty where there is none."""
    height = len(levels) - 1
    node = np.arange(lo, hi)[:, None] >> np.arange(height)[None, :]
    sizes = np.array([len(x) for x in levels[:-1]], np.int64)[None, :]
    sibling = node ^ 1
    sides = []
    for there in ((node & 1).astype(bool), ~(node & 1).astype(bool) & (sibling < sizes)):
        data = [levels[k][sibling[i, k]] for i, k in zip(*np.nonzero(there))]
        ends = np.concatenate(([0], np.cumsum(there.ravel() * 32))).astype(np.int32)
        raw = np.concatenate(data) if data else np.zeros(0, np.uint8)
        sides.append(pa.Array.from_buffers(pa.binary(), there.size, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))]))
    entries = pa.StructArray.from_arrays(sides, fields=[pa.field(f.name, pa.binary(), False) for f in PATH.elementType.fields])
    return pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * height, pa.int32()), entries, type=pa.list_(pa.field("element", entries.type, False)))


def _build(nodes: DataFrame, stride: int, carried: Sequence[str]) -> DataFrame:
    """Written rows of nodes with path and, on the first of each block, the block's top.

    ``nodes`` has tree, idx, total, node (32 bytes) and the carried columns. A
    tree that is one block rises until one node is left; others by ``stride``.
    """
    block = 1 << stride
    own = ["tree", "idx", "total", "node"]
    ordered = nodes.select(*own, *carried).repartition("tree", F.shiftright("idx", stride)).sortWithinPartitions("tree", "idx")
    schema = T.StructType([ordered.schema[c] for c in ("tree", "idx", "total", *carried)] + [T.StructField("path", PATH, False), T.StructField("top", T.BinaryType())])

    def of_block(rows: pa.Table):
        total = rows.column("total")[0].as_py()
        leaves = np.frombuffer(b"".join(rows.column("node").to_pylist()), np.uint8).reshape(-1, 32)
        levels = _levels(leaves, stride if total > block else (len(leaves) - 1).bit_length())
        for lo in range(0, len(leaves), SLICE):
            hi = min(lo + SLICE, len(leaves))
            part = rows.slice(lo, hi - lo).combine_chunks()
            top = pa.array([levels[-1][0].tobytes() if lo == i == 0 else None for i in range(hi - lo)], pa.binary())
            columns = [part.column(c).combine_chunks() for c in ("tree", "idx", "total", *carried)]
            yield pa.RecordBatch.from_arrays([*columns, _paths(levels, lo, hi), top], names=schema.names)

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            trees, numbers = batch.column("tree").to_pylist(), batch.column("idx").to_numpy() >> stride
            start = 0
            for i in range(batch.num_rows):
                if (trees[i], numbers[i]) != key:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    if held:
                        yield from of_block(pa.Table.from_batches(held))
                    held, start, key = [], i, (trees[i], numbers[i])
            if batch.num_rows > start:
                held.append(batch.slice(start))
        if held:
            yield from of_block(pa.Table.from_batches(held))

    return settle(ordered.mapInArrow(run, schema))


@dataclass
class Manifest:
    """A built manifest: leaves with their first path, node rows above, one row with the root."""

    leaves: DataFrame
    nodes: DataFrame
    root: DataFrame
    stride: int


def _rise(ground: DataFrame, stride: int, carried: Sequence[str], up: Column) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(rows of the ground, node rows above or None, tops (tree, digest)) of all trees over a ground.

    Every pass builds ``stride`` levels; there are as many as the tallest tree has
    strides. ``up`` is the parent of a tree's top.
    """
    level, first, above, tops = 0, None, None, None
    while True:
        built = _build(ground, stride, carried if level == 0 else [])
        last = F.col("total") <= (1 << stride)
        parent = F.when(last, up).otherwise(F.struct(F.col("tree"), F.lit(level + stride).alias("level"), F.shiftright("idx", stride).alias("idx")))
        rows = built.select("tree", F.lit(level).alias("level"), "idx", "path", parent.alias("up"), *(carried if level == 0 else []))
        if level == 0:
            first = rows
        else:
            above = rows if above is None else above.unionByName(rows)
        ends = built.where(F.col("top").isNotNull())
        done = ends.where(last).select("tree", F.col("top").alias("digest"))
        tops = done if tops is None else tops.unionByName(done)
        ground = ends.where(~last).select("tree", F.shiftright("idx", stride).alias("idx"), F.shiftright(F.col("total") + (1 << stride) - 1, stride).alias("total"), F.col("top").alias("node"))
        level += stride
        if ground.isEmpty():
            return first, above, tops


_PLACE = "struct<tree:string,level:int,idx:bigint>"


def build_manifest(leaves: DataFrame, *, carried: Sequence[str] = (), stride: int | None = None) -> Manifest:
    """Trees over ``leaves`` (tree, sort, leaf, and the carried columns), and the tree over these.

    ``tree`` names the group, ``sort`` is the order inside it (null first), ties go
    by ``leaf``, a hex digest. ``leaves`` must be a written table, of any size: the
    stride grows from ``STRIDE`` so that at most ``UPPER`` rows stand above the
    leaves', up to 100 billion leaves. No leaves give no rows and no root.
    """
    n = leaves.count()
    while stride is None or (stride < MOST_STRIDE and n >> stride > UPPER):
        stride = STRIDE if stride is None else stride + 1
    ground = numbered(leaves, "tree", ["sort", "leaf"]).withColumn("node", F.unhex("leaf"))
    own = F.struct(F.col("tree"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx")).cast(_PLACE)
    first, above, subroots = _rise(ground, stride, ["leaf", *carried], own)
    subroots = settle(subroots)
    # The trees' tops in order of their trees, as one more tree.
    top = numbered(subroots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("of"), "digest", F.col("digest").alias("node")), "tree", ["of"])
    ground, over, root = _rise(top, stride, ["of", "digest"], F.lit(None).cast(_PLACE))
    # A top's row there is the parent row of its tree.
    nodes = ground.select(F.col("of").alias("tree"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("idx"), "path", "up", F.lower(F.hex("digest")).alias("subroot"))
    for more in (above, over):
        if more is not None:
            nodes = nodes.unionByName(more.select("tree", "level", "idx", "path", "up", F.lit(None).cast("string").alias("subroot")))
    return Manifest(first, settle(nodes), settle(root.select(F.lower(F.hex("digest")).alias("root"))), stride)


_CLIMB = """
WITH RECURSIVE climb ({names}, up, proof, folded, subroot) AS (
    SELECT {names}, up, {proof}, {folded}, CAST(NULL AS STRING) FROM {leaves}
    UNION ALL
    SELECT {own}, n.up, {next_proof}, {next_folded}, coalesce(c.subroot, n.subroot)
    FROM climb c JOIN {nodes} n ON c.up.tree = n.tree AND c.up.level = n.level AND c.up.idx = n.idx
)
SELECT {names}, proof, folded, subroot FROM climb WHERE up IS NULL
"""


def climb(manifest: Manifest, carried: Sequence[str], start: str) -> DataFrame:
    """For each leaf row the carried columns, proof (all siblings, bytes), folded and subroot.

    ``start`` names the column with the hex digest that is folded. The node rows
    above the leaves' are broadcast while they are at most ``UPPER``.
    """
    spark = manifest.nodes.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # rows of a step are as many as leaves
    tag = uuid.uuid4().hex
    leaves, nodes = f"merkle_leaves_{tag}", f"merkle_nodes_{tag}"
    small = manifest.nodes.count() <= UPPER
    manifest.leaves.select(*carried, F.col(start).alias("start"), "path", "up").createOrReplaceTempView(leaves)
    (F.broadcast(manifest.nodes) if small else manifest.nodes).createOrReplaceTempView(nodes)
    fold = "aggregate({path}, {start}, (a, e) -> sha2(concat(lower(hex(e.left)), a, lower(hex(e.right))), 256))"
    joined = "aggregate({path}, {start}, (a, e) -> concat(a, e.left, e.right))"
    query = _CLIMB.format(
        names=", ".join(carried), own=", ".join(f"c.{c}" for c in carried), leaves=leaves, nodes=nodes,
        proof=joined.format(path="path", start="X''"), folded=fold.format(path="path", start="start"),
        next_proof=joined.format(path="n.path", start="c.proof"), next_folded=fold.format(path="n.path", start="c.folded"),
    )
    out = spark.sql(query)
    for view in (leaves, nodes):
        spark.catalog.dropTempView(view)
    return out


def audit(docs: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None, stride: int | None = None) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified) for each row.

    A leaf is the digest of ``fields``. Where ``where`` holds, the row as presented
    has the ``changed`` values, and its digest is folded along the siblings of the
    manifest: it is verified if that gives the root. A null group is a tree of its
    own, before the others; null in ``order`` comes first; rows alike in it follow
    by leaf, and repeated rows are leaves of their own. Null values count as null,
    empty texts as empty. No rows give no rows. Only ``fields``, ``group`` and
    ``order`` are read: other columns take no part, whatever their names.
    """
    leaf = digest(*[field(f) for f in fields])
    other = digest(*[field((changed or {}).get(f, F.col(f))) for f in fields])
    other = F.when(where, other) if where is not None and changed else F.lit(None).cast("string")
    tree = F.when(F.col(group).isNull(), _NULL).otherwise(F.concat(F.lit(_GROUP), F.col(group).cast("string")))
    rows = spread(docs.select(*dict.fromkeys([*fields, group, order])))
    leaves = settle(rows.select(F.col(order).alias("sort"), tree.alias("tree"), leaf.alias("leaf"), other.alias("other")).withColumn("start", F.coalesce("other", "leaf")).drop("other"))
    manifest = build_manifest(leaves, carried=["sort", "start"], stride=stride)
    climbed = climb(manifest, ["sort", "leaf"], "start").crossJoin(F.broadcast(manifest.root))
    return climbed.select(F.col("sort").alias(order), "leaf", "subroot", "root", F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
