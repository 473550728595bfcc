"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors stand in blocks with a sorted list per dimension. For a query, sorted
access goes down all lists at once, from the end that the sign of the query's
component favours; vectors met for the first time are scored in full. The sum
of the components at the current depth bounds every vector not met yet, and the
search of a block stops when that bound cannot beat the k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rankloom.session import settle

#: Vectors in a candidate block, and queries in a query block.
BLOCK = 8192
QUERIES = 1024
#: Depth of the first access to the sorted lists; it doubles from round to round.
FIRST_DEPTH = 32


def sorted_lists(vectors: np.ndarray) -> np.ndarray:
    """Positions by ascending component, one column per dimension."""
    return np.argsort(vectors, axis=0, kind="stable")


def threshold_search(query: np.ndarray, vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, own: int | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best vectors but those of id ``own``, ties to smaller
    ids; and how many vectors were scored. Numbers must be exact in their type."""
    n = len(vectors)
    axes = np.flatnonzero(query)
    best_ids, best = np.zeros(0, np.int64), np.zeros(0, query.dtype)
    met = np.zeros(n, bool)
    depth = 0
    falls = query[axes] > 0
    while depth < n and not met.all():
        to = n if not len(axes) else min(n, max(FIRST_DEPTH, 2 * depth))
        before = met.copy()
        if len(axes):
            met[lists[n - to : n - depth][:, axes[falls]]] = True
            met[lists[depth:to][:, axes[~falls]]] = True
        else:
            met[:] = True
        fresh = np.flatnonzero(met & ~before)
        depth = to
        if own is not None:
            fresh = fresh[ids[fresh] != own]
        best = np.concatenate([best, vectors[fresh] @ query])
        best_ids = np.concatenate([best_ids, ids[fresh]])
        if len(best) > k:
            edge = np.partition(best, len(best) - k)[len(best) - k]
            near = best >= edge
            best, best_ids = best[near], best_ids[near]
            order = np.lexsort((best_ids, -best))[:k]
            best, best_ids = best[order], best_ids[order]
        if len(best) >= k and depth < n:
            reach = np.where(falls, vectors[lists[n - depth, axes], axes], vectors[lists[depth - 1, axes], axes])
            if best.min() > reach @ query[axes]:
                break
    return best_ids, best, int(met.sum())


def vector_blocks(df: DataFrame, vec_id: str, vector: str, size: int, tag: str) -> DataFrame:
    """Pack rows (id, array of longs) into blocks as they lie, without a shuffle."""

    def run(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        ids, rows = [], []

        def block():
            nonlocal at
            wide = max(map(len, rows), default=0)
            m = np.zeros((len(rows), wide), np.int64)
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            at += 1
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + at - 1]), pa.array([wide]), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=[tag, f"{tag}_dim", f"{tag}_ids", f"{tag}_rows"])

        for batch in batches:
            for i, r in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                rows.append(r.values.to_numpy(zero_copy_only=False))
                if len(ids) == size:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    return df.select(vec_id, vector).mapInArrow(run, f"{tag} long, {tag}_dim long, {tag}_ids binary, {tag}_rows binary")


def _matrix(ids: bytes, rows: bytes, wide: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(rows, np.int64).reshape(len(i), wide)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int, *, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row.

    Components are floor(scale * x) as integers, scores their inner products;
    candidates are all rows of another id. Rows with a null id or vector, or with
    a null or non-finite component, take no part; shorter vectors count as ended
    with zeros. Ties go to smaller ids. Repeated rows are candidates each, and
    each repeated query row gets its k ranks. Fewer candidates give fewer ranks.
    Scores beyond 64 bits are clipped to them.

    Query blocks meet candidate blocks by the candidates' block numbers; a task
    holds one block of each.
    """
    whole = F.col(embedding).isNotNull() & F.col(vec_id).isNotNull()
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(whole & F.coalesce(finite, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"), is_query.alias("q"))
    candidates = settle(vector_blocks(rows, "vec_id", "v", BLOCK, "c"))
    queries = settle(vector_blocks(rows.where("q"), "vec_id", "v", QUERIES, "q"))
    numbers = candidates.select("c").groupBy().agg(F.collect_list("c").alias("all"))  # a number per block

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, m = _matrix(row["c_ids"], row["c_rows"], row["c_dim"])
                q_ids, qs = _matrix(row["q_ids"], row["q_rows"], row["q_dim"])
                wide = max(m.shape[1], qs.shape[1])
                m, qs = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (m, qs))
                bound = float(np.abs(m.astype(float)).max(initial=0)) * float(np.abs(qs.astype(float)).max(initial=0)) * max(1, wide)
                kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object
                m, qs = m.astype(kind), qs.astype(kind)
                lists = sorted_lists(m)
                out: list[list] = [[], [], [], []]
                for at, (own, q) in enumerate(zip(q_ids.tolist(), qs)):
                    found, scores, _ = threshold_search(q, m, ids, lists, k, own)
                    n = len(found)
                    out[0] += [own] * n
                    out[1] += [(row["q"] << 11) + at] * n
                    out[2] += found.tolist()
                    out[3] += [max(-(2**63), min(2**63 - 1, int(s))) for s in scores.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "q_row", "vec_id", "score"])

    paired = queries.crossJoin(F.broadcast(numbers)).select("q", "q_dim", "q_ids", "q_rows", F.explode("all").alias("c")).join(candidates, "c")
    local = paired.mapInArrow(run, "query_id long, q_row long, vec_id long, score long")
    order = W.partitionBy("q_row", "query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
