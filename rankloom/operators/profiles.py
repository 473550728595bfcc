"""Per-position symbol counts from alignment rows: conservation and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import vectors as V
from rankloom.functions.classes import SYMBOLS
from rankloom.functions.sequences import align_stats, aligned_pairs, letters
from rankloom.session import spread


def aligned_columns(hits: DataFrame, symbols: str = SYMBOLS, native: str | None = None) -> DataFrame:
    """(query, position, symbol) for every aligned symbol of the alphabet.

    Query gaps are dropped before numbering, so the running position is the
    index in the remaining array. ``qstart`` is 1-based. ``native`` names an array
    of the query's letters, of which each row gets its own as ``native``.
    """
    kept = F.filter(aligned_pairs("qaln", "taln"), lambda s: (s["q"] != "-") & (s["q"] != ""))
    if native:
        at = lambda i: F.col("qstart") - 1 + i
        # Looked up before rows are made, so that no row carries the letters.
        kept = F.transform(kept, lambda s, i: F.struct(s["t"].alias("t"), F.when(at(i) >= 0, F.get(native, at(i).cast("int"))).alias("native")))
    cols = spread(hits, "query", "target").select("query", "qstart", F.posexplode(kept).alias("_i", "_s"))
    sym = F.col("_s.t")
    return cols.where((F.instr(F.lit(symbols), sym) > 0) & (sym != "")).select(
        "query", (F.col("qstart") - 1 + F.col("_i")).alias("position"), sym.alias("symbol"), *[F.col("_s.native")] * bool(native)
    )


def position_grid(seqs: DataFrame, id: str, sequence: str, *extra: Column) -> DataFrame:
    return seqs.select(F.col(id).alias("query"), *extra, F.posexplode(letters(F.upper(sequence))).alias("position", "native")).where("native <> ''")


def conservation(hits: DataFrame, seqs: DataFrame, id: str, sequence: str, symbols: str = SYMBOLS) -> DataFrame:
    """Share of aligned symbols equal to the native one; 0.5 where none aligned.

    A query's hit on itself does not count. Texts meet their hits whole, so letters
    are summed in one grouping and are not joined.
    """
    own = seqs.select(F.col(id).alias("query"), letters(F.upper(sequence)).alias("_own"))
    one = lambda c: c.cast("long")
    seen = aligned_columns(hits.where("query <> target").join(own, "query"), symbols, "_own").where("native <> ''").select(
        "query", "position", "native", one(F.lit(1)).alias("_k"), one(F.col("symbol") == F.col("native")).alias("_m"))
    grid = position_grid(seqs, id, sequence).select("query", "position", "native", one(F.lit(0)).alias("_k"), one(F.lit(0)).alias("_m"))
    out = grid.unionByName(seen).groupBy("query", "position", "native").agg(F.sum("_k").alias("homolog_observations"), F.sum("_m").alias("_m"))
    n = F.col("homolog_observations")
    return out.withColumn("conservation_score", F.when(n > 0, F.col("_m") / F.nullif(n, F.lit(0))).otherwise(0.5)).drop("_m")


def accepted_hits(hits: DataFrame, seqs: DataFrame, id: str, sequence: str, lo: float, hi: float, coverage: float, symbols: str = SYMBOLS) -> DataFrame:
    q = seqs.select(F.col(id).alias("query"), F.length(sequence).alias("_len"))
    # Letters of the query that are aligned, then by its length: a length inside the lambda can be lost when Spark moves the filter.
    s = hits.withColumn("_s", align_stats("qaln", "taln", F.lit(1), symbols)).join(q, "query")
    ok = (F.col("_s.identity") >= lo) & (F.col("_s.identity") < hi) & (F.col("_s.query_coverage") / F.greatest("_len", F.lit(1)) >= coverage)
    return s.where(ok).drop("_s", "_len")


def homolog_profile(
    seqs: DataFrame, hits: DataFrame, id: str, sequence: str, *, lo: float = 0.20, hi: float = 0.80, coverage: float = 0.70,
    pseudocount: float = 0.5, symbols: str = SYMBOLS,
) -> DataFrame:
    """Pseudocounted symbol frequencies per position from accepted hits.

    Counts travel as a map of the symbols seen, not as a column per symbol.
    """
    good = accepted_hits(hits, seqs, id, sequence, lo, hi, coverage, symbols)
    n_hits = good.groupBy("query").agg(F.count(F.lit(1)).alias("_hits"))
    seen = aligned_columns(good, symbols).groupBy("query", "position", "symbol").agg(F.count(F.lit(1)).alias("_k"))
    # As many entries as the alphabet has symbols at most.
    counts = seen.groupBy("query", "position").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "_k"))).alias("_seen"), F.sum("_k").alias("_n"))
    texts = seqs.select(F.col(id).alias("query"), F.col(sequence).alias("_text")).join(n_hits, "query", "left")
    grid = position_grid(texts, "query", "_text", F.coalesce("_hits", F.lit(0)).alias("accepted_hits"))
    out = grid.join(counts, ["query", "position"], "left").withColumn("observed", F.coalesce("_n", F.lit(0)))
    total = F.col("observed") + pseudocount * len(symbols)
    freq = F.array(*[(F.coalesce(F.try_element_at("_seen", F.lit(s)), F.lit(0)) + pseudocount) / total for s in symbols])
    return (
        out.select("query", "position", "native", "observed", "accepted_hits", freq.alias("profile"))
        .withColumn("profile_entropy", V.vsum(F.transform("profile", lambda p: -p * F.log(p))))
        .withColumn("profile_covered", F.col("observed") > 0)
    )
