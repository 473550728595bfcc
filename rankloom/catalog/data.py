"""Driver tables and the views of them that stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.functions import vectors as V

#: Total order of line items.
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_tax"]
SCORERS = ["base", "sa", "sb"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: Column | str, name: str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits).alias(name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column for the comparison with the oracle."""
    return df.select(*[r6(c, c, digits) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def scorers(spark: SparkSession, sf: str) -> DataFrame:
    """Slices of the stored vectors as log distributions of three scorers."""
    e = V.as_double("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id",
        "label",
        (F.col("vec_id") % 20 + 1).cast("int").alias("native"),
        *[V.log_normalize(F.slice(e, 1 + 20 * i, 20)).alias(n) for i, n in enumerate(SCORERS)],
    )


def long_scorers(spark: SparkSession, sf: str) -> DataFrame:
    wide = scorers(spark, sf)
    return wide.unpivot(["vec_id", "label", "native"], SCORERS, "scorer", "logp")


def observed(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    mean = li.agg(F.round(F.avg("l_extendedprice"), 2).alias("_m"))
    # One row by construction, so this is a scalar lookup.
    return li.join(F.broadcast(mean)).withColumn("y", F.col("l_extendedprice") - F.col("_m")).drop("_m")
