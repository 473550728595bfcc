"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.session import settle

#: Rows per task of a written table of links or pairs.
TASK_ROWS = 100_000


def settle_rows(df: DataFrame, rows: int, per_task: int = TASK_ROWS) -> DataFrame:
    """Write a table of at most ``rows`` rows with no more tasks than these and the cores need."""
    return settle(df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task))))


def stars(edges: DataFrame, rows: int, rounds: int | None = None) -> DataFrame:
    """Links (u, v), v < u, that connect the same nodes as the edges (a, b).

    Every round links each node's larger neighbours, then its smaller ones, to
    its least neighbour. Only minima meet per node, so a node with any number of
    links is no group that one task must hold; rounds grow with the logarithm of
    the longest chain. Each round is a written table. Without ``rounds`` they go
    on until every node has one link, to the least node of its component.
    ``rows`` bounds the number of edges.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    links = settle_rows(ordered(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), rows)
    before = state(links) if rounds is None else (1,)
    while before[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = settle_rows(ordered(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))), rows)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        links = settle_rows(ordered(small), rows)
        if rounds is not None:
            rounds -= 1
            if rounds <= 0:
                break
            continue
        now = state(links)
        if now == before:
            break
        before = now
    return links


def labels(links: DataFrame) -> DataFrame:
    """(node, comp) for each node of a link, comp the least node it links to, or itself."""
    own = links.select(F.col("v").alias("node"), F.col("v").alias("comp"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(own).groupBy("node").agg(F.min("comp").alias("comp"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for each node of an edge, comp the least node of its component."""
    edges = settle(edges.select(F.col(a).alias("a"), F.col(b).alias("b")))
    return labels(stars(edges, edges.count()))
