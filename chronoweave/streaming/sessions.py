"""Streaming extensions: sessions, windowed measurements and deduplication of arriving events. The reference has no streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, files_a_trigger: int = 100, late: str = "1 day") -> DataFrame:
    """Parquet files of events as they arrive; an event more than `late` behind the newest may be left out."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_trigger).parquet(path).withWatermark("ts", late)


def first_seen(events: DataFrame) -> DataFrame:
    """Each event once, whatever is sent again within the watermark."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """A user's sessions: events without a gap as long as `gap`; a session is given out once the watermark has passed it."""
    grouped = events.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "min_value", "max_value")


def daily(events: DataFrame) -> DataFrame:
    """Per type and day: count, lowest, highest and mean value."""
    grouped = events.groupBy("event_type", F.window("ts", "1 day").alias("w"))
    return grouped.agg(F.count("*").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("mean_value")).select("event_type", F.col("w.start").alias("day"), "n", "min_value", "max_value", "mean_value")


def write(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs over what there is and stops; the checkpoint makes a restart go on where it was, `batch` must be idempotent by its number."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
