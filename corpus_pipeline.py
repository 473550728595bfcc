"""Corpus pipeline: language, quality, near-duplicates, personal data, packing.

Each stage reads the whole output of the stage before it, written as Parquet.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.llm.language import identify_languages, markup_language
from rankloom.llm.neardup import drop_near_duplicates
from rankloom.llm.packing import pack_texts
from rankloom.llm.pii import pseudonymise
from rankloom.llm.quality import quality_rules
from rankloom.llm.queries import PII_KEY, vocabulary
from rankloom.session import ensure_checkpoint_dir, settle


#: Bytes of word tables in a worker of the packing stage, which still holds what earlier stages left.
TABLES = 40 << 20
#: The columns of ``documents`` that stages read.
READ = ("doc_id", "source", "lang", "n_chars", "text")


def carries(stage):
    """Keep further columns of the input out of a stage's way, in one column that no
    other is named like, and give them back in their places."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        extra = [c for c in docs.columns if c not in READ]
        if not extra:
            return stage(spark, docs, sf_dir)
        held = "extra" + "_" * max(map(len, extra))
        own = [c for c in docs.columns if c in READ]
        out = stage(spark, docs.select(*own, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(extra)]).alias(held)), sf_dir)
        return out.select(*[F.col(held)[f"c{extra.index(c)}"].alias(c) if c in extra else F.col(c) for c in docs.columns])

    return run_stage


@carries
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language stays undecided; ``lang`` becomes the one found.

    Few documents change, so only these are written and joined to the texts, by
    id and a digest of the text, null ids included.
    """
    keyed = docs.withColumn("_digest", F.xxhash64("text"))
    found = identify_languages(keyed, declared=F.coalesce(markup_language(F.col("text")), F.col("lang")), host=F.col("source"), keep=["doc_id", "_digest", "lang"])
    changed = settle(
        found.where(~F.col("accepted") | ~F.col("language").eqNullSafe(F.col("lang")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), F.col("lang").alias("_l"))
        .agg(F.first("language").alias("_language"), F.max("accepted").alias("_accepted"))
    )
    same = keyed["doc_id"].eqNullSafe(changed["_id"]) & (keyed["_digest"] == changed["_d"]) & keyed["lang"].eqNullSafe(changed["_l"])
    out = keyed.join(changed, same, "left").where(F.coalesce("_accepted", F.lit(True)))
    return out.withColumn("lang", F.coalesce("_language", "lang")).select(docs.columns)


@carries
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the countable rules or the n-gram ratio."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).where("kept").select(docs.columns)


@carries
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates."""
    return drop_near_duplicates(docs).select(docs.columns)


@carries
def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal values by pseudonyms of the same format."""
    return pseudonymise(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2,048 tokens."""
    return pack_texts(docs, vocabulary(), ids=False, tables=TABLES)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: The language models, the alignment and the pseudonyms are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each is written and read again."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
