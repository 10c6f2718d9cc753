"""Verification over streams: windowed review rates, sessions, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A file stream of events; ``path`` is a folder or a glob of files."""
    return spark.readStream.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def review_rate(events: DataFrame, threshold: float, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, n_review, review_rate) of tumbling windows. The
    same on a stream, with a watermark, and on a batch."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    review = F.sum((~F.coalesce(F.col("value") >= threshold, F.lit(False))).cast("int"))
    out = timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), review.alias("n_review"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "n_review", (F.col("n_review") / F.col("n")).alias("review_rate"))


def sliding_rate(events: DataFrame, threshold: float, window: str = "2 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    review = F.sum((~F.coalesce(F.col("value") >= threshold, F.lit(False))).cast("int"))
    out = timed.groupBy(F.window("ts", window, slide)).agg(F.count(F.lit(1)).alias("n"), review.alias("n_review"))
    return out.select(F.col("window.start").alias("start"), "n", "n_review")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n): sessions that a pause of ``gap`` ends."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    out = timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Rows without the repeats of their keys within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there and returns the sink's rows."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
