"""Table readers and writers: typed by suffix, pruned, sharded, resumable."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rankloom.operators.contracts import ContractError, require_columns, tag
from rankloom.operators.inference import finite


def read_table(spark: SparkSession, path: str | None, schema: T.StructType | str | None = None) -> DataFrame | None:
    """Read ``.parquet``, ``.csv`` or ``.tsv``; None means absent. Text formats
    without a schema come as strings, so no pass is spent on inference."""
    if path is None:
        return None
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix == ".parquet":
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    if suffix in (".csv", ".tsv"):
        reader = spark.read.option("header", True).option("sep", "," if suffix == ".csv" else "\t").option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    raise ContractError(f"unsupported table suffix: {suffix or path}")


def read_without(spark: SparkSession, path: str, forbidden: Sequence[str]) -> DataFrame:
    """Everything except the outcome columns, which must exist but are not scanned."""
    df = require_columns(read_table(spark, path), forbidden, path)
    return df.select(*[c for c in df.columns if c not in forbidden])


def scan_assay(df: DataFrame, key: str, mutation: str, position: str, effect: str, sequence: str, cluster: str) -> DataFrame:
    """Per-protein statistics of a large assay scan, in one grouped pass.

    Wild-type rows carry ``wt``; single mutants look like A12C.
    """
    m = F.col(mutation)
    wild, single = F.lower(m) == "wt", m.rlike("^[A-Z][0-9]+[A-Z]$")
    value = finite(F.col(effect).try_cast("double"))
    return df.groupBy(key).agg(
        F.count_if(wild).alias("wt_rows"),
        F.count_if(single).alias("single_rows"),
        F.count_if(~wild & ~single).alias("other_rows"),
        F.count_distinct(F.when(single, F.col(position))).alias("positions"),
        F.count_if(single & value.isNull()).alias("missing_effects"),
        F.max(F.when(wild, F.col(sequence))).alias("sequence"),
        F.max(F.when(wild, F.col(cluster))).alias("cluster"),
        F.count_distinct(cluster).alias("n_clusters"),
    )


def pack(df: DataFrame, prefix: str, symbols: Sequence[str], name: str) -> DataFrame:
    """Wide ``prefix + symbol`` columns to one array, in the order of ``symbols``."""
    cols = [prefix + s for s in symbols]
    require_columns(df, cols, "wide scores")
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols])).drop(*cols)


def unpack(df: DataFrame, col: str, prefix: str, symbols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != col], *[F.element_at(col, i + 1).alias(prefix + s) for i, s in enumerate(symbols)])


def pack_prefix(df: DataFrame, prefix: str, name: str) -> DataFrame:
    """Columns found by prefix, in name order."""
    found = sorted(c for c in df.columns if c.startswith(prefix))
    if not found:
        raise ContractError(f"no columns start with {prefix}")
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in found])).drop(*found)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a result table once the new one is whole.

    It is written beside the old one, which two renames then put away; a failed
    job leaves the old table. Between the renames there is no table for a moment.
    """
    if fmt not in ("parquet", "csv", "tsv"):
        raise ContractError(f"unsupported format: {fmt}")
    tag = uuid.uuid4().hex
    fresh, former = f"{path.rstrip('/')}.{tag}.new", f"{path.rstrip('/')}.{tag}.old"
    if fmt == "parquet":
        df.write.parquet(fresh)
    else:
        df.write.option("header", True).option("sep", "," if fmt == "csv" else "\t").option("escape", '"').csv(fresh)
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(sc._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(former)) or not fs.rename(at(fresh), at(path)):
        if had and not fs.exists(at(path)) and fs.exists(at(former)):
            fs.rename(at(former), at(path))
        raise OSError(f"{path}: the new table could not take the old one's place")
    if had:
        fs.delete(at(former), True)


def write_sharded(df: DataFrame, path: str, rows_per_file: int, sort: Sequence[str] = ()) -> None:
    """Files of at most ``rows_per_file`` rows."""
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def table_manifest(df: DataFrame, path: str) -> DataFrame:
    """One row: path, rows, columns and an order-free content digest.

    The digest adds up row hashes, so repeated rows do not cancel.
    """
    cols = sorted(df.columns)
    h = F.xxhash64(*cols)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(h.cast("decimal(38,0)")).alias("_s"),
        F.bit_xor(h).alias("_x"),
    ).select(
        F.lit(path).alias("path"), "rows", F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.sha2(F.concat_ws("|", F.coalesce(F.col("_s"), F.lit(0)).cast("string"), F.coalesce(F.col("_x"), F.lit(0)).cast("string"), F.col("rows").cast("string")), 256).alias("digest"),
    )


def pending_requests(req: DataFrame, parts: DataFrame, rid: str = "request_id") -> DataFrame:
    """Requests without a finished part."""
    return req.join(parts.select(rid).distinct(), rid, "left_anti")


def finalize_parts(req: DataFrame, parts: DataFrame, rid: str = "request_id") -> DataFrame:
    """The parts, if their ids are exactly the requested ones; else the job fails."""
    both = req.select(rid).distinct().withColumn("_r", F.lit(1)).join(parts.select(rid).distinct().withColumn("_p", F.lit(1)), rid, "full")
    odd = both.agg(F.count_if(F.col("_p").isNull()).alias("missing"), F.count_if(F.col("_r").isNull()).alias("extra"))
    ok = (F.col("missing") == 0) & (F.col("extra") == 0)
    note = F.concat(F.lit("parts do not match requests: missing "), F.col("missing").cast("string"), F.lit(", extra "), F.col("extra").cast("string"))
    checked = odd.select(F.when(ok, True).otherwise(F.raise_error(note).cast("boolean")).alias("_ok"))
    return parts.join(F.broadcast(checked)).where("_ok").drop("_ok")  # one row


def append_part(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def result_table(criteria: DataFrame, labels: Mapping[str, str], detail: Sequence[str]) -> DataFrame:
    """Criterion rows with their details as JSON and run labels as columns."""
    rest = [c for c in criteria.columns if c not in detail]
    return tag(criteria.select(*rest, F.to_json(F.struct(*detail)).alias("details")), **labels)
