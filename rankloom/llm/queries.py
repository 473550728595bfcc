"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

import importlib.util
import os
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm.bpe import encode_digests
from rankloom.llm.contamination import contamination
from rankloom.llm.importance import importance_sample
from rankloom.llm.language import identify_languages, markup_language
from rankloom.llm.merkle import audit
from rankloom.llm.neardup import near_duplicates
from rankloom.llm.packing import pack_texts
from rankloom.llm.pii import pseudonymise
from rankloom.llm.quality import quality_rules
from rankloom.llm.runs import periodic_runs
from rankloom.llm.secrets import find_secrets
from rankloom.llm.texts import WORDS
from rankloom.llm.topk import exact_top_k
from rankloom.llm.urls import Rule, filter_urls

#: Folder of the public vocabulary files on every machine; the environment may name another.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: Key of the pseudonyms; deployments set their own.
PII_KEY = os.environ.get("RANKLOOM_PII_KEY", "rankloom-public-test-key")
URL_RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file: from the public_tokenizers package if there is one."""
    spec = sys.modules.get("public_tokenizers") or importlib.util.find_spec("public_tokenizers")
    if spec is not None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(TOKENIZERS, name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["strong"])
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(named(base), 256).alias("base_sha256"), named(F.col("secrets")).alias("spans"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary()).drop("text")


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, changed="n_replaced")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_sample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), toxic="toxic")
    return out.withColumn("kept", F.col("selected"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(_table(spark, sf_dir, "documents"), vocabulary(), ids=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = identify_languages(docs, declared=F.coalesce(markup_language(F.col("text")), F.col("lang")), host=F.col("source"), keep=["doc_id"])
    return found.withColumn("kept", F.col("accepted"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Plant periodic words: where h = crc32(doc_id) ends in 0, the words from place
    a = g % n on, g = h // 10, repeat the first 1 + (n - a) // (3 + g % 8) of them.
    Other texts, and those of null ids, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    cut = docs.withColumn("_g", F.when(h % 10 == 0, g)).withColumn("_w", F.when(F.col("_g").isNotNull(), F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))))
    n = F.size("_w")
    cut = cut.withColumn("_a", F.when(n > 0, F.col("_g") % n).cast("int"))
    period = (F.lit(1) + F.floor((n - F.col("_a")) / (F.lit(3) + F.col("_g") % 8))).cast("int")
    block = F.slice("_w", F.col("_a") + 1, period)
    times = F.ceil((n - F.col("_a")) / period).cast("int")
    again = F.slice(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.flatten(F.array_repeat(block, times))), F.lit(1), n)
    return cut.withColumn("text", F.when(F.col("_a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text"))).select(*docs.columns)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    # Runs come by start, then period: the first of the greatest exponents stays.
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda b, r: F.when(more(b, r), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return audit(docs, changed={"n_chars": F.try_add(F.col("n_chars"), F.lit(1))}, where=tampered)


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_url_filter": op2_url_filter,
    "op3_top_k": op3_top_k,
    "op4_bpe": op4_bpe,
    "op5_pseudonyms": op5_pseudonyms,
    "op6_quality": op6_quality,
    "op7_importance": op7_importance,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_packing": op9_packing,
    "op10_language": op10_language,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_contamination": op12_contamination,
    "op13_merkle_manifest": op13_merkle_manifest,
}
