"""Serving result sets over the insight table: pages, KPIs, distributions, trends, merges."""

from __future__ import annotations

import base64
import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import js_round, prettify, ratio
from tidewatch.schemas import INSIGHT_TYPES

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

RANGES = {
    # fixed values: named range -> bucket width
    "1h": 10 * MINUTE_US,
    "3h": 20 * MINUTE_US,
    "today": 2 * HOUR_US,
    "week": DAY_US,
    "default": 30 * MINUTE_US,
}
REACH = {"1h": HOUR_US, "3h": 3 * HOUR_US, "week": 7 * DAY_US, "default": DAY_US}


def insight_items(items: DataFrame) -> DataFrame:
    """Stored items to the served shape; missing, empty and zero fields take defaults."""
    def text(name: str, default: str) -> Column:
        if name not in items.columns:
            return F.lit(default)
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default))

    related = F.col("related_entity")
    advice = F.coalesce("recommendations", F.array().cast("array<string>")) if "recommendations" in items.columns else None
    return items.select(
        F.col("entity_id").alias("alert_id"),
        F.coalesce(related, F.col("entity_id")).alias("entity_id"),
        "timestamp",
        text("prediction_type", "unknown").alias("prediction_type"),
        F.coalesce("risk_score", F.lit(0)).alias("risk_score"),
        text("explanation", "").alias("explanation"),
        *([advice.alias("recommendations")] if advice is not None else []),
        text("model_used", "unknown").alias("model_used"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def since(df: DataFrame, start: Column | None, ts: str = "timestamp") -> DataFrame:
    return df if start is None else df.where(F.col(ts) >= start)


def range_start(name: str, as_of: Column, zone: str = "UTC") -> Column:
    """Start of a named range; ``today`` is midnight in ``zone``."""
    if name == "today":
        local = F.from_utc_timestamp(as_of, zone)
        return F.to_utc_timestamp(F.date_trunc("day", local), zone)
    return F.timestamp_micros(F.unix_micros(as_of) - F.lit(REACH.get(name, REACH["default"])))


def by_type(df: DataFrame, kind: str = "all") -> DataFrame:
    return df if kind == "all" else df.where(F.col("prediction_type") == kind)


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def active(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows without a TTL, or whose TTL is still ahead."""
    return df.where(F.col("ttl").isNull() | (F.col("ttl") > F.unix_timestamp(as_of)))


def newest_first(df: DataFrame, ts: str = "timestamp", key: str = "alert_id") -> DataFrame:
    """All rows, newest first."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc())


def recent(df: DataFrame, limit: int = 50, ts: str = "timestamp", key: str = "alert_id") -> DataFrame:
    """Newest first; the limit makes it a top-k per task and a small merge, not a sort of the table."""
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def page_token(ts_text: str, key) -> str:
    return base64.b64encode(json.dumps({"timestamp": ts_text, "alert_id": key}).encode()).decode()


def read_token(token: str | None) -> dict | None:
    """The last key of the page before; a token that cannot be read, or whose time is none, is ignored."""
    try:
        found = json.loads(base64.b64decode(token, validate=True)) if token else None
        if isinstance(found, dict) and {"timestamp", "alert_id"} <= found.keys():
            dt.datetime.fromisoformat(found["timestamp"])
            return found
    except (ValueError, TypeError):
        pass
    return None


def page(df: DataFrame, limit: int = 50, token: str | None = None, start: Column | None = None) -> DataFrame:
    """One page after ``token`` in (timestamp, alert_id) descending order, with the token to go on from each row."""
    rows, last = since(df, start), read_token(token)
    if last:
        at, key = F.lit(last["timestamp"]).cast("timestamp"), F.lit(last["alert_id"])
        ts = F.col("timestamp")
        rows = rows.where((ts <= at) & ((ts < at) | (F.col("alert_id") < key)))
    stamp = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp")
    return recent(rows, limit).withColumn("next_token", F.base64(F.to_json(F.struct(stamp, "alert_id")).cast("binary")))


def kpis(df: DataFrame) -> DataFrame:
    """Total, critical (risk >= 80) and rounded mean risk, null risk counting as 0; one row, also for no input."""
    risk = F.coalesce("risk_score", F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(risk >= 80).alias("critical"),
        F.coalesce(js_round(F.avg(risk)), F.lit(0)).cast("long").alias("avg_risk"),
    )


def counts_by_type(df: DataFrame) -> DataFrame:
    kind = F.coalesce(F.nullif(F.col("prediction_type"), F.lit("")), F.lit("unknown"))
    return df.groupBy(kind.alias("prediction_type")).agg(F.count(F.lit(1)).alias("n"))


def kpi_card(kpi_row: DataFrame) -> DataFrame:
    pct = F.when(F.col("total") > 0, js_round(ratio(F.col("critical"), F.col("total")) * 100)).otherwise(F.lit(0))
    return kpi_row.withColumns({
        "critical_pct": pct.cast("long"), "trend": F.when(F.col("critical") > 5, "up").otherwise("down"),
    })


def risk_distribution(df: DataFrame) -> DataFrame:
    """Mean risk to one decimal and count per known type, in display order; types without rows are left out."""
    place = F.array_position(F.array(*[F.lit(t) for t in INSIGHT_TYPES]), F.col("prediction_type"))
    return (
        df.where(F.col("prediction_type").isin(INSIGHT_TYPES))
        .groupBy("prediction_type")
        .agg(F.round(F.avg(F.coalesce("risk_score", F.lit(0))), 1).alias("avg_risk"), F.count(F.lit(1)).alias("n"))
        .select(place.cast("int").alias("position"), prettify(F.col("prediction_type")).alias("name"), "avg_risk", "n")
    )


def trend(df: DataFrame, name: str, as_of: Column) -> DataFrame:
    """Critical and churn counts per bucket of a named range, zero filled.

    The filter reaches the scan and the spine is a handful of rows made from the bounds, never from the data.
    """
    width = RANGES.get(name, RANGES["default"])
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(width)) * width
    start = F.timestamp_micros(bucket(range_start(name, as_of)))
    end = F.timestamp_micros(bucket(as_of) + width)
    rows = df.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    counted = rows.groupBy(bucket("timestamp").alias("_b")).agg(
        F.count_if(F.col("risk_score") >= 80).alias("critical_alerts"),
        F.count_if(F.col("prediction_type") == "churn_risk").alias("churn_risks"),
    )
    spark = df.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(bucket(range_start(name, as_of)), bucket(as_of), F.lit(width))).alias("_b"))
    return spine.join(counted, "_b", "left").select(
        F.timestamp_micros("_b").alias("bucket_start"),
        F.coalesce("critical_alerts", F.lit(0)).alias("critical_alerts"),
        F.coalesce("churn_risks", F.lit(0)).alias("churn_risks"),
    ).orderBy("bucket_start")


def merge_unique(new: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows before existing ones, one per ``alert_id``: a known alert keeps the existing content."""
    ranked = existing.withColumn("_rank", F.lit(0)).unionByName(new.withColumn("_rank", F.lit(1)))
    # of several rows of one side the one with the smallest content counts, whatever the order they come in
    content = F.to_json(F.struct(*sorted(new.columns)))
    one = Window.partitionBy("alert_id").orderBy("_rank", content)
    listed = F.max("_rank").over(Window.partitionBy("alert_id"))
    return (
        ranked.withColumn("is_new", listed == 1).withColumn("_rn", F.row_number().over(one))
        .where("_rn = 1").drop("_rn", "_rank")
    )


def not_held(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select("alert_id"), "alert_id", "left_anti")


def poll(df: DataFrame, newest_seen: Column | None, limit: int = 10) -> DataFrame:
    """The newest rows after the newest one seen."""
    rows = df if newest_seen is None else df.where(F.col("timestamp") > newest_seen)
    return recent(rows, limit)


def critical_per_hour(df: DataFrame) -> DataFrame:
    hour = F.window("timestamp", "1 hour").start
    return df.where(F.col("risk_score") >= 80).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("critical_alerts"))


def access_path(df: DataFrame, entity_type: str, where: Column, order: list[Column]) -> DataFrame:
    """A secondary access path: one entity type, a filter, an order. The table is partitioned by entity type."""
    return df.where((F.col("entity_type") == entity_type) & where).orderBy(*order)
