"""Series that grow: event-time windows over files that arrive, with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def daily_series(events: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """``series_key, d, n, v``: number and sum for each key and day of event time. Rows later than ``late`` are left out.

    Works on a stream and on a table alike.
    """
    t = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        t = t.withWatermark("_t", late)
    days = t.groupBy(F.window("_t", "1 day").alias("w"), F.col(key).alias("series_key"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(value).cast("decimal(18,6)")).cast("double").alias("v")).select("series_key", F.to_date("w.start").alias("d"), "n", "v")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Take in all files that are there and stop."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
