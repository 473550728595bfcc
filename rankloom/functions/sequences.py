"""Expressions over sequence strings; every symbol of a text is used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.classes import SYMBOLS
from rankloom.functions.vectors import _col, let


def letters(seq: Column | str) -> Column:
    return F.split(_col(seq), "")


def parse_mutation(text: Column | str) -> Column:
    """Struct (wild_type, position, mutant) of a text such as ``A123C``; the
    position is 0-based. Anything else gives NULL."""
    t = F.trim(_col(text))
    at = F.regexp_extract(t, "^.([0-9]+)", 1)
    # Where the pattern holds, the letters stand beside the number.
    return F.when(
        t.rlike("^[A-Z][0-9]+[A-Z]$"),
        F.struct(
            F.substring(t, 1, 1).alias("wild_type"),
            (at.try_cast("int") - 1).alias("position"),
            F.substring(t, F.length(at) + 2, F.lit(1)).alias("mutant"),
        ),
    )


def parse_mutations(df: DataFrame, sequences: DataFrame, key: str, text: str, effect: str, sequence: str) -> DataFrame:
    """Single mutations with a numeric effect whose wild type is the parent's letter.

    The parent's letters are looked up in an array: taking a substring would scan
    the parent from its start for every mutation.
    """
    rows = df.withColumn("_m", parse_mutation(text)).withColumn(effect, F.col(effect).try_cast("double"))
    rows = rows.where(F.col("_m").isNotNull() & F.col(effect).isNotNull() & ~F.isnan(effect)).select("*", "_m.*").drop("_m")
    parents = sequences.select(key, sequence, letters(sequence).alias("_letters"))
    out = rows.where("wild_type <> mutant").join(parents, key)
    return out.where(F.get("_letters", F.col("position")) == F.col("wild_type")).drop("_letters")


def hamming_identity(l: Column | str, r: Column | str) -> Column:
    """Share of equal letters of two equally long sequences."""
    same = F.aggregate(
        F.zip_with(letters(l), letters(r), lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda a, x: a + x
    )
    return F.when(F.length(_col(l)) == F.length(_col(r)), same / F.nullif(F.length(_col(l)), F.lit(0)))


def aligned_pairs(qaln: Column | str, taln: Column | str) -> Column:
    """Array of (q, t) letters of an alignment, upper-case."""
    return F.zip_with(
        letters(F.upper(_col(qaln))), letters(F.upper(_col(taln))), lambda a, b: F.struct(a.alias("q"), b.alias("t"))
    )


def align_stats(qaln: Column | str, taln: Column | str, query_length: Column, symbols: str = SYMBOLS) -> Column:
    """Struct (identity over valid pairs, query coverage) of an alignment."""
    known = lambda c: F.instr(F.lit(symbols), c) > 0

    def stats(p: Column) -> Column:
        # A letter is valid only if it is a single character of the alphabet.
        valid = F.filter(p, lambda s: known(s["q"]) & known(s["t"]) & (s["q"] != "") & (s["t"] != ""))
        return let(
            valid,
            lambda v: F.struct(
                (F.size(F.filter(v, lambda s: s["q"] == s["t"])) / F.greatest(F.size(v), F.lit(1))).alias("identity"),
                (F.size(F.filter(p, lambda s: s["q"] != "-")) / F.greatest(query_length, F.lit(1))).alias("query_coverage"),
            ),
        )

    return let(aligned_pairs(qaln, taln), stats)


def unique_find(text: Column | str, part: Column | str) -> Column:
    """0-based start of the only occurrence; an absent or repeated part is an error."""
    t, p = _col(text), _col(part)
    first = F.instr(t, p)
    again = F.instr(F.substring(t, first + 1, F.length(t)), p)
    return F.when((first > 0) & (again == 0), first - 1).otherwise(F.raise_error(F.lit("part is absent or repeated")).cast("int"))


def occurrences_start(text: Column | str, part: Column | str) -> Column:
    """Like ``unique_find`` with NULL instead of an error."""
    t, p = _col(text), _col(part)
    first = F.instr(t, p)
    again = F.instr(F.substring(t, first + 1, F.length(t)), p)
    return F.when((first > 0) & (again == 0), first - 1)


def shingles(seq: Column | str, k: int) -> Column:
    """All overlapping k-letter words with their 0-based position.

    Words are sliced from the letter array: taking a substring would scan the
    text from its start for every word.
    """

    def words(cs: Column) -> Column:
        spots = F.when(F.size(cs) >= k, F.sequence(F.lit(0), F.size(cs) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct(F.array_join(F.slice(cs, i + 1, k), "").alias("word"), i.alias("at")))

    return let(letters(seq), words)


def context_features(df: DataFrame, seq: str, pos: str, radius: int, symbols: str = SYMBOLS) -> DataFrame:
    """Composition of the neighbourhood without its centre, relative position,
    distance to the nearer end, and log length."""
    at, n = F.col(pos), F.length(seq)
    left = F.substring(seq, F.greatest(at - radius, F.lit(0)) + 1, F.least(at, F.lit(radius)))
    right = F.substring(seq, at + 2, F.lit(radius))
    near = F.concat(left, right)
    size = F.greatest(F.length("_near"), F.lit(1))
    shares = [(F.length("_near") - F.length(F.replace(F.col("_near"), F.lit(s), F.lit("")))) / size for s in symbols]
    return df.withColumn("_near", near).withColumns({
        "local_composition": F.array(*shares),
        "relative_position": at / F.greatest(n - 1, F.lit(1)),
        "edge_distance": F.least(at, n - 1 - at),
        "log_length": F.log(n.cast("double")),
    }).drop("_near")
