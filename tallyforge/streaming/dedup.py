"""Streams of records: exact duplicates within a watermark, and windowed medians' stand-ins, as structured streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import scratch


def deduplicated(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """The first event of each id within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, delay: str = "30 minutes", width: str = "1 hour") -> DataFrame:
    """Count and sum of values by window and type; late events beyond the watermark are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_available(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes all that is there as Parquet, with a checkpoint in the shared folder, and reads the result."""
    where = scratch(spark)
    q = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")
