"""Language identification by fusing independent evidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from rankloom.llm.texts import add_grams, dense, gram_counts, gram_sums, map_texts, sparse_counts, text_bytes, text_slices
from rankloom.session import settle

BITS = 14
UNIT = 1 << 16
#: The language of what no model explains.
NONE = "und"
#: Neighbouring windows share letters; a text counts as this share of its windows.
EVIDENCE = 0.25
#: Strength, in documents, of the suffix over the host and of all over the suffix.
HOST_STRENGTH = 5.0
SUFFIX_STRENGTH = 20.0
#: A host or suffix of more than one in so many documents is looked up without a
#: shuffle: there are fewer of these than this.
FREQUENT = 1000


def language_code(value: Column) -> Column:
    """Two-letter code that a language tag begins with, else null."""
    code = F.lower(F.regexp_extract(value, "^\\s*([A-Za-z]{2})(?:[-_].*)?\\s*$", 1))
    return F.when(code != "", code)


def markup_language(text: Column) -> Column:
    """Language that an html tag of the text declares, else null."""
    return language_code(F.regexp_extract(text, "(?i)<html[^>]*\\slang=[\"']?([A-Za-z_-]+)", 1))


def address_suffix(host: Column) -> Column:
    """Last label of a dotted host name in lower case, else null."""
    suffix = F.lower(F.regexp_extract(host, "\\.([A-Za-z]+)\\.?$", 1))
    return F.when(suffix != "", suffix)


def text_models(docs: DataFrame, text: str, declared: str) -> tuple[list[str], list[np.ndarray]]:
    """Log probabilities of hashed windows in each declared language, from all
    documents. Codes have two letters, so there are at most 676 languages."""
    size = 1 << BITS
    langs = sorted(r[0] for r in docs.select(declared).where(F.col(declared).isNotNull()).distinct().collect())
    place = {lang: i for i, lang in enumerate(langs)}

    def make():
        counts: dict[str, np.ndarray] = {}

        def add(batch):
            for code in batch.column(declared).unique().drop_null().to_pylist():
                own = counts.setdefault(code, np.zeros(size, np.int64))
                mask = pa.compute.fill_null(pa.compute.equal(batch.column(declared), code), False)
                for rows in text_slices(batch.filter(mask), text):
                    add_grams(own, *text_bytes(rows.column(text)), BITS)

        def table():
            flat = np.zeros(len(langs) * size, np.int64)
            for code, own in counts.items():
                flat[place[code] * size : (place[code] + 1) * size] = own
            return flat

        return add, table

    table = dense(sparse_counts(docs, [text, declared], make), len(langs) * size).reshape(len(langs), size)
    # Smoothed towards the windows of all languages, then towards evenness.
    every = (table.sum(0) + 1.0) / (table.sum() + size)
    logs = [np.round(np.log((row + 0.01 * size * (0.5 * every + 0.5 / size)) / (row.sum() + 0.01 * size)) * UNIT).astype(np.int64) for row in table]
    return langs, logs


def identify_languages(docs: DataFrame, *, text: str = "text", declared: Column, host: Column, least: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Settled table of ``keep`` columns with language, posterior and accepted.

    The posterior of each language multiplies the likelihood of the text under
    hashed n-gram models, of the declared language given its error rate, and a
    prior for the host. Host priors are counts of what the text alone decides,
    less the document's own, smoothed by the counts of the host's suffix, and
    these by those of all documents. ``und`` competes with an even model.

    Accepted are documents whose best language is not ``und`` and has at least
    ``least`` of the posterior. A null or empty text leaves the decision to the
    other evidence; a null host or declared language is no evidence. Ties go to
    the first code. Without any declared language everything is ``und``.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    base = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text).alias("_text"), language_code(declared).alias("_declared"), host.cast("string").alias("_host"))
    langs, logs = text_models(base, "_text", "_declared")
    shared = docs.sparkSession.sparkContext.broadcast([*logs, np.full(1 << BITS, round(-BITS * np.log(2) * UNIT), np.int64)])
    codes = [*langs, NONE]
    names = F.array(*[F.lit(c) for c in codes])

    def make():
        def fn(column):
            data, offsets = text_bytes(column)
            sums = gram_sums(data, offsets, BITS, shared.value).T / UNIT * EVIDENCE
            ends = np.arange(0, sums.size + 1, len(codes), dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(sums).ravel())), pa.array(gram_counts(offsets))]

        return fn

    likely = map_texts(base, "_text", make, [T.StructField("_text_log", T.ArrayType(T.DoubleType(), False), False), T.StructField("_n", T.LongType(), False)]).drop("_text")
    first = F.when(F.col("_n") > 0, names[F.array_position("_text_log", F.array_max("_text_log")).cast("int") - 1]).otherwise(F.coalesce("_declared", F.lit(NONE)))
    scored = settle(likely.withColumn("_first", first).withColumn("_suffix", address_suffix(F.col("_host"))))

    def counts(*by: str) -> DataFrame:
        each = scored.groupBy(*by, "_first").agg(F.count(F.lit(1)).alias("c"))
        entries = F.map_from_entries(F.collect_list(F.struct("_first", "c")))  # a language each
        return each.groupBy(*by).agg(entries.alias(f"_by{''.join(by)}"), F.sum("c").alias(f"_of{''.join(by)}"))

    total = {r["_first"]: r["c"] for r in scored.groupBy("_first").agg(F.count(F.lit(1)).alias("c")).collect()}
    wrong, stated = scored.where(F.col("_declared").isNotNull() & (F.col("_n") > 0)).agg(F.count_if(F.col("_declared") != F.col("_first")), F.count(F.lit(1))).first()
    error = (wrong + 1.0) / (stated + 2.0 * max(1, len(langs)))
    n = sum(total.values())
    overall = F.create_map(*[x for c in codes for x in (F.lit(c), F.lit((total.get(c, 0) + 1.0) / (n + len(codes))))])

    def counted(rows: DataFrame, by: str) -> DataFrame:
        """Rows with the counts of their host or suffix. The few frequent ones are broadcast;
        only rows of the others meet their counts in a shuffle, and null ones none."""
        table = settle(counts(by))
        frequent = F.col(f"_of{by}") * FREQUENT > n
        near = rows.join(F.broadcast(table.where(frequent)), by, "left")
        far = F.col(by).isNotNull() & F.col(f"_of{by}").isNull()
        rest = near.where(far).select(*rows.columns).join(table.where(~frequent), by, "left")
        return near.where(~far).unionByName(rest)

    fused = counted(counted(scored, "_host"), "_suffix")

    def log_posterior(x: Column) -> Column:
        code = x["code"]
        own = F.when(F.col("_first") == code, 1.0).otherwise(0.0)

        def level(by: str, strength: float, below: Column) -> Column:
            had = F.coalesce(F.try_element_at(F.col(f"_by{by}"), code).cast("double"), F.lit(0.0)) - own
            smooth = (had + strength * below) / (F.col(f"_of{by}") - 1 + strength)
            return F.when(F.col(f"_of{by}").isNull(), below).otherwise(smooth)

        prior = level("_host", HOST_STRENGTH, level("_suffix", SUFFIX_STRENGTH, F.try_element_at(overall, code)))
        claim = F.when(F.col("_declared").isNull(), 1.0).when(code == NONE, 1.0 / max(1, len(langs))).when(F.col("_declared") == code, 1 - error).otherwise(error / max(1, len(langs) - 1))
        return x["log"] + F.log(prior) + F.log(claim)

    zipped = F.arrays_zip(names.alias("code"), F.col("_text_log").alias("log"))
    out = (
        fused.withColumn("_log", F.transform(zipped, log_posterior))
        .withColumn("_best", F.array_max("_log"))
        .withColumn("language", names[F.array_position("_log", F.col("_best")).cast("int") - 1])
        .withColumn("posterior", 1 / F.aggregate("_log", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("_best"))))
    )
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "language", "posterior", ((F.col("language") != NONE) & (F.col("posterior") >= least)).alias("accepted"))
