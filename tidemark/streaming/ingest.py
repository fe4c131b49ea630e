"""Append-only ingest of result files as a stream; a repeated result is ignored.

The reference has no streaming of its own: this is the append log as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_results(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON result files as they arrive, with a digest of each row."""
    rows = spark.readStream.schema(schema).json(path)
    return rows.withColumn("result_sha256", F.sha2(F.to_json(F.struct(*schema.fieldNames())), 256))


def append_once(results: DataFrame, sink: str, checkpoint: str, delay: str = "1 day", time_col: str | None = None):
    """Writes each distinct result once; with an event time, state is bounded by the delay."""
    if time_col:
        results = results.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["result_sha256"])
    else:
        results = results.dropDuplicates(["result_sha256"])
    return results.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(sink)
