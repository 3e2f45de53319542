"""The same transforms over streams of flow files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from flowmill.operators.stats import counters


def flow_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed(stream: DataFrame, keys: tuple[str, ...] = ("odid",), minutes: int = 5, late: str = "1 hour") -> DataFrame:
    """Counters by windows of the flows' ends; flows later than the watermark are left out."""
    timed = stream.withColumn("time", F.timestamp_millis("e0id153")).withWatermark("time", late)
    out = timed.groupBy(*keys, F.window("time", f"{minutes} minutes")).agg(*counters())
    return out.withColumn("window_start", F.unix_millis("window.start")).drop("window")


def store(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
