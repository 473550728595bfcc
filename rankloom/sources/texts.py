"""Readers and writers of line and record formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rankloom.functions.vectors import finite
from rankloom.operators.contracts import guard, unique_by
from rankloom.operators.leakage import best_hits


def hierarchy_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Classification list: id, four hierarchy numbers ..., length, resolution.

    ``#`` comments are skipped, fewer than 12 fields is an error, codes are
    dot-joined prefixes and a resolution of 999 or more is unknown.
    """
    text = F.trim(line)
    rows = lines.where((text != "") & ~text.startswith("#")).select(F.split(text, r"\s+").alias("_f"))
    rows = guard(rows, F.size("_f") >= 12, F.concat(F.lit("too few fields: "), F.array_join("_f", " ")))
    at = lambda i: F.element_at("_f", i)
    code = lambda n: F.concat_ws(".", *[at(i) for i in range(2, 2 + n)])
    res = at(12).try_cast("double")
    return rows.select(
        at(1).alias("domain_id"), F.substring(at(1), 1, 4).alias("pdb_id"), F.substring(at(1), 5, 1).alias("chain_id"),
        code(1).alias("cath_c"), code(2).alias("cath_a"), code(3).alias("cath_t"), code(4).alias("cath_h"),
        at(11).try_cast("int").alias("length"), F.when(res < 999.0, res).alias("resolution"),
    )


def read_hierarchy_list(spark: SparkSession, path: str) -> DataFrame:
    return hierarchy_rows(spark.read.text(path))


def fasta_rows(records: DataFrame, record: str = "value") -> DataFrame:
    """(id, sequence) from text split where a line begins with ``>``. A header such as
    ``db|version|id/range`` gives its third part up to the slash; a plain one
    gives its first word. Sequences are upper-case without white space."""
    text = F.regexp_replace(record, r"^\s*>", "")  # the first record of a file keeps its mark
    head = F.regexp_extract(text, r"^([^\n\r]*)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"^[^\n\r]*", ""), r"\s+", "")
    parts = F.split(F.trim(head), r"\|")
    name = F.when(F.size(parts) >= 3, F.element_at(F.split(F.element_at(parts, 3), "/"), 1)).otherwise(F.element_at(F.split(F.trim(head), r"\s+"), 1))
    rows = records.where(F.trim(record) != "").select(name.alias("id"), F.upper(body).alias("sequence"))
    return unique_by(rows, ["id"], "fasta")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return fasta_rows(spark.read.text(path, lineSep="\n>"))


def write_fasta(df: DataFrame, path: str, id: str = "id", sequence: str = "sequence") -> None:
    df.select(F.concat(F.lit(">"), F.col(id).cast("string"), F.lit("\n"), F.col(sequence)).alias("value")).write.mode("overwrite").text(path)


HIT_SCHEMA = "domain_id string, benchmark_id string, sequence_identity double, query_coverage double, target_coverage double"


def normalize_hits(hits: DataFrame, keys: Sequence[str] = ("domain_id", "benchmark_id")) -> DataFrame:
    """Percent-style values become fractions; the best hit per pair stays."""
    def frac(c: str) -> Column:
        v = F.col(c)
        return F.when(v > 1, v / 100).otherwise(v).alias(c)

    rows = hits.select(*keys, frac("sequence_identity"), frac("query_coverage"), frac("target_coverage"))
    return best_hits(rows, list(keys))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return normalize_hits(spark.read.option("sep", "\t").schema(HIT_SCHEMA).csv(path))


# Fixed value: order of the twenty values of a property record (two lines of ten).
PROPERTY_ORDER = "ARNDCQEGHILKMFPSTWYV"


def property_rows(records: DataFrame, record: str = "value") -> DataFrame:
    """(property_id, symbol, value) from ``//`` records with an ``H`` name line and
    two value lines after ``I``. ``NA`` is NULL; records without twenty values are dropped."""
    pid = F.regexp_extract(record, r"(?m)^H\s+(\S+)", 1)
    tail = F.regexp_extract(record, r"(?ms)^I\s[^\n]*\n(.*)$", 1)
    values = F.split(F.trim(F.regexp_replace(tail, r"\s+", " ")), " ")
    rows = records.select(pid.alias("property_id"), values.alias("_v")).where((F.col("property_id") != "") & (F.size("_v") == 20))
    out = rows.select("property_id", F.posexplode("_v").alias("_i", "_x"))
    return out.select("property_id", F.substring(F.lit(PROPERTY_ORDER), F.col("_i") + 1, F.lit(1)).alias("symbol"), finite(F.col("_x").try_cast("double")).alias("value"))


def read_property_records(spark: SparkSession, path: str) -> DataFrame:
    return property_rows(spark.read.text(path, lineSep="//"))
