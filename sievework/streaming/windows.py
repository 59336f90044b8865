"""Usage rollups and silence detection on batches; usage_windows also runs on streams, with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usage_windows(events: DataFrame, width: str = "1 day") -> DataFrame:
    """Events and their value by type and tumbling window."""
    rows = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")


def usage_rollup(events: DataFrame) -> DataFrame:
    """Totals by event type, by tier and over all, in one pass of grouping sets."""
    tier = (F.get_json_object("props", "$.k").cast("long") % 3).alias("tier")
    rows = events.select("event_type", tier, "value")
    sets = rows.groupingSets([["event_type"], ["tier"], []], "event_type", "tier")
    return sets.agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("value"), F.grouping_id().cast("long").alias("level"))


def silences(events: DataFrame, seconds: int) -> DataFrame:
    """user_id, event_id, gap: events after which a user was silent for longer than `seconds`."""
    following = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gap = F.unix_seconds(following.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp"))
    return events.withColumn("gap", gap).where(F.col("gap") > seconds).select("user_id", "event_id", "gap")
