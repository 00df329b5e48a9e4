"""Event-time windows, de-duplication and change feeds on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import ratio
from tidewatch.operators.changes import change_feed
from tidewatch.sources.writers import append_state

LATE = "1 hour"


def keep_newest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str] | None = None):
    """Writes an updating aggregate as a log of batches; ``writers.read_state`` gives the newest row per key. ``order``: which
    of a key's rows in one batch is the newest, where there can be several."""
    return (
        stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, i: append_state(df, path, i, order or keys, keys))
    )


def run_once(writer) -> None:
    """Works off what has arrived and stops."""
    writer.trigger(availableNow=True).start().awaitTermination()


def malformed_windows(validated: DataFrame, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    """Rejected share per tumbling window; rows later than the watermark leave the window but stay in the archive."""
    counts = validated.withWatermark(ts, LATE).groupBy(F.window(ts, width)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_valid")).alias("malformed")
    )
    return counts.select(
        F.col("window.start").alias("period"), "total", "malformed",
        (ratio(F.col("malformed"), F.col("total")) * 100).alias("malformed_rate"),
    )


def alarm_windows(points: DataFrame, ts: str = "timestamp", width: str = "5 minutes") -> DataFrame:
    """Statistics per metric and alarm period."""
    stats = points.withWatermark(ts, LATE).groupBy("metric", F.window(ts, width)).agg(
        F.sum("value").alias("Sum"), F.avg("value").alias("Average"), F.max("value").alias("Maximum")
    )
    return stats.select("metric", F.col("window.start").alias("period"), "Sum", "Average", "Maximum")


def dedup_alerts(alerts: DataFrame, ts: str = "timestamp", window: str = "1 hour") -> DataFrame:
    """The first alert of a type and entity within the watermark delay."""
    return alerts.withWatermark(ts, window).dropDuplicatesWithinWatermark(["alert_type", "entity_id"])


def daily_counts(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Daily partials per student for the sliding windows, as the stream goes on."""
    day = F.window(ts, "1 day")
    done, call = F.col("event_type") == "session_completed", F.col("event_type") == "ib_call_logged"
    return events.withWatermark(ts, LATE).groupBy("student_id", day).agg(
        F.count_if(done).alias("sessions"), F.count_if(call).alias("calls"),
    ).select("student_id", F.to_date("window.start").alias("day"), "sessions", "calls")


def version_feed(spark, old_path: str, new_path: str, keys: list[str]) -> DataFrame:
    """The change feed between two written versions."""
    return change_feed(spark.read.parquet(old_path), spark.read.parquet(new_path), keys)


def session_windows(events: DataFrame, keys: list[str], ts: str, gap: str, sums: dict[str, Column] | None = None, delay: str = LATE) -> DataFrame:
    """Sessions on a stream, each once the watermark has passed its end: as ``operators.sessions`` finds them in a batch."""
    parts = events.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap)).agg(
        F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()])
    return parts.drop("session_window")
