"""Resumable scoring as a file stream.

New request files are scored once each; the stream's checkpoint remembers which
files are done, so a restarted job goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.corruption import Scorer, score_requests


def score_new_requests(
    spark: SparkSession, requests: str, schema: str, fn: Scorer, out_schema: str, out: str, checkpoint: str, files_per_batch: int = 100
) -> StreamingQuery:
    """Score all request files that have arrived, append Parquet parts and stop."""
    req: DataFrame = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(requests)
    return (
        score_requests(req, fn, out_schema)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
