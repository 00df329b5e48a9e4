"""Canonical views: the operators' input shapes, derived from the driver tables in one projection each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.schemas import TABLES

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return instant(AS_OF)


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def events_stream(spark: SparkSession, sf_dir: str, max_files: int = 100) -> DataFrame:
    """The events table as a stream; the pattern is there because a file source wants a glob or a folder."""
    return (
        spark.readStream.schema(TABLES["events"]).option("maxFilesPerTrigger", max_files)
        .parquet(f"{sf_dir}/events.parque[t]")
    )


def mkt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marketplace events, one typed row per event."""
    return mkt_of(table(spark, sf_dir, "events"))


def mkt_of(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", _k())
    k, eid = F.col("k"), F.col("event_id")
    kind = (
        F.when(F.col("event_type") == "view", "session_started")
        .when(F.col("event_type") == "purchase", "session_completed")
        .when(F.col("event_type") == "error", "ib_call_logged")
        .when(F.col("event_type") == "signup", "customer_health_update")
        .when(k % 2 == 0, "tutor_availability_updated")
        .otherwise("supply_demand_update")
    )
    e = e.withColumn("kind", kind)

    def only(name: str, value: Column) -> Column:
        return F.when(F.col("kind") == name, value)

    demand, supply = (F.lit(50) + k).cast("double"), (F.lit(50) + eid % 50).cast("double")
    return e.select(
        "event_id",
        "ts",
        F.col("kind").alias("event_type"),
        F.col("user_id").alias("student_id"),
        (k % 20).cast("long").alias("tutor_id"),
        F.concat(F.lit("subject-"), (k % 9).cast("string")).alias("subject"),
        F.concat(F.lit("region-"), (eid % 4).cast("string")).alias("region"),
        only("session_completed", (eid % 6).cast("int")).alias("rating"),
        only("session_completed", (F.lit(20) + k).cast("int")).alias("duration_min"),
        only("session_completed", k % 10 == 0).alias("was_cancelled"),
        only("session_completed", k % 15 == 1).alias("no_show"),
        only("ib_call_logged", (k - 50) / F.lit(50.0)).alias("sentiment"),
        only("customer_health_update", F.lit(100.0) - F.least(F.lit(100.0), F.col("value"))).alias("health_score"),
        only("customer_health_update", F.when(k % 3 == 0, k % 8)).cast("long").alias("sessions_last_7_days"),
        only("customer_health_update", F.when(k % 4 == 0, k % 30)).cast("long").alias("sessions_last_30_days"),
        only("customer_health_update", F.when(k % 5 == 0, k % 6)).cast("long").alias("ib_calls_last_14_days"),
        only("supply_demand_update", demand).alias("demand_score"),
        only("supply_demand_update", supply).alias("supply_score"),
        only(
            "supply_demand_update",
            F.when(demand / supply > 1.5, "high_demand").when(supply / demand > 1.5, "high_supply").otherwise("balanced"),
        ).alias("balance_status"),
        only("supply_demand_update", (eid % 20).cast("long")).alias("available_tutors"),
        only("supply_demand_update", (F.col("user_id") % 40).cast("long")).alias("active_students"),
        only("supply_demand_update", (k % 12).cast("long")).alias("pending_requests"),
        only("tutor_availability_updated", (k % 40).cast("long")).alias("available_slots_this_week"),
        only("tutor_availability_updated", k % 4 == 0).alias("instant_book_enabled"),
        "value",
        "k",
    )


def tutor_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rates, each from the time of the availability update that brought it."""
    e = mkt_events(spark, sf_dir).where(F.col("event_type") == "tutor_availability_updated")
    return e.select("tutor_id", "ts", "event_id", (F.lit(20) + F.col("k") % 40).cast("double").alias("hourly_rate"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer activity with logins, messages, payments, calls and scheduled sessions."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "view", "login")
        .when(F.col("event_type") == "click", "message")
        .when(F.col("event_type") == "purchase", "payment")
        .when(F.col("event_type") == "error", "ib_call")
        .otherwise("session")
    )
    e = e.withColumn("kind", kind)
    session, call, pay = (F.col("kind") == x for x in ("session", "ib_call", "payment"))
    status = F.when(k % 10 == 0, "cancelled").when(k % 15 == 1, "no_show").otherwise("completed")
    return e.select(
        "event_id", "ts",
        F.col("user_id").alias("customer_id"),
        F.col("kind").alias("activity"),
        F.when(session, status).alias("status"),
        F.when(session, (F.lit(20) + k)).cast("double").alias("duration_min"),
        F.when(session & (status == "completed"), (F.col("event_id") % 6)).cast("double").alias("rating"),
        F.when(call, k * 10).cast("double").alias("call_seconds"),
        F.when(call, (k - 50) / F.lit(50.0)).alias("sentiment"),
        F.when(call, k >= 80).alias("escalated"),
        F.when(pay, F.col("value")).alias("amount"),
        F.when(pay, k % 10 != 0).alias("paid"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device telemetry samples."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k, v = F.col("k"), F.col("value")
    return e.select(
        F.col("event_id").alias("insight_id"),
        F.col("user_id").alias("device_id"),
        "ts", "value",
        (v * 1000).alias("iops"),
        (v * 600).alias("read_iops"),
        (v * 400).alias("write_iops"),
        (v / 5).alias("latency"),
        (v / 5 * 1.5).alias("p95_latency"),
        (v / 5 * (F.lit(1.2) + (k % 10) / F.lit(8.0))).alias("p99_latency"),
        (k / F.lit(25.0)).alias("error_rate"),
        k.alias("queue_depth"),
        (v * 20).alias("throughput"),
        F.when(k % 2 == 0, "sequential").otherwise("random").alias("access_pattern"),
        (F.lit(4) + k).cast("double").alias("io_size_kb"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(
            F.when(v >= 150, "critical").when(v >= 80, "high").when(v >= 30, "medium").otherwise("low")
        ).alias("risk_level"),
        F.when(F.col("event_id") % 5 != 0, F.lit(100.0) - F.least(F.lit(100.0), v)).alias("performance_score"),
    )


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network stream metrics."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k, v = F.col("k"), F.col("value")
    return e.select(
        F.col("event_id").alias("metric_id"),
        F.col("user_id").alias("stream_id"),
        "ts",
        (v / 5).alias("latency_p99"),
        k.cast("double").alias("utilization"),
        ((k % 13) / F.lit(200.0)).alias("error_rate"),
        (F.lit(50.0) + v).alias("bandwidth_gbps"),
        (F.col("event_id") % 150).cast("long").alias("qp_errors"),
    )


def insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored insight items as the table holds them: some fields are missing on purpose."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "view", "customer_health")
        .when(F.col("event_type") == "purchase", "session_quality")
        .when(F.col("event_type") == "error", "churn_risk")
        .when(F.col("event_type") == "signup", "first_session_success")
        .otherwise("tutor_capacity")
    )
    return e.select(
        F.col("event_id").alias("entity_id"),
        F.lit("insight").alias("entity_type"),
        F.col("ts").alias("timestamp"),
        F.when(k % 19 != 0, F.col("user_id")).alias("related_entity"),
        F.when(k % 11 != 0, kind).alias("prediction_type"),
        F.when(k % 17 != 0, F.least(F.lit(100), F.floor("value"))).cast("int").alias("risk_score"),
        F.when(k % 7 != 0, F.concat(F.lit("value "), F.col("k").cast("string"))).alias("explanation"),
        F.when(k % 5 != 0, F.when(k % 3 == 0, F.lit("rules")).otherwise(F.lit("health-v1"))).alias("model_used"),
        (F.lit(0.5) + k / F.lit(200.0)).alias("confidence"),
        (F.unix_timestamp("ts") + F.lit(30 * 86400)).alias("ttl"),
    )


def _text(value: Column) -> Column:
    return F.concat(F.lit('"'), value.cast("string"), F.lit('"'))


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 transport records with defects injected by ``event_id % 37``."""
    return raw_of(mkt_events(spark, sf_dir))


def raw_of(e: DataFrame) -> DataFrame:
    eid, kind, k = F.col("event_id"), F.col("event_type"), F.col("k")
    d = eid % 37
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    number = lambda name, c: F.concat(F.lit(f'"{name}":'), c.cast("string"))
    text = lambda name, c: F.concat(F.lit(f'"{name}":'), _text(c))
    rating_key = F.when(eid % 3 == 0, "tutor_rating").when(eid % 3 == 1, "rating").otherwise("student_rating")
    duration_key = F.when(eid % 2 == 0, "duration_minutes").otherwise("actual_duration_minutes")
    who_key = F.when(eid % 4 == 0, "customer_id").otherwise("student_id")
    payload = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.concat(F.lit('"'), who_key, F.lit('":'), F.col("student_id").cast("string")),
            number("tutor_id", F.col("tutor_id")),
            text("subject", F.col("subject")),
            F.when(F.col("rating").isNotNull(), F.concat(F.lit('"'), rating_key, F.lit('":'), F.col("rating").cast("string"))),
            F.when(F.col("duration_min").isNotNull(), F.concat(F.lit('"'), duration_key, F.lit('":'), F.col("duration_min").cast("string"))),
            F.when(F.col("was_cancelled").isNotNull(), number("was_cancelled", F.col("was_cancelled"))),
            F.when(F.col("no_show").isNotNull(), number("no_show", F.col("no_show"))),
            F.when(kind == "tutor_availability_updated", number("available_slots_this_week", F.col("available_slots_this_week"))),
        ),
        F.lit("}"),
    )
    body = F.concat(
        F.lit("{"),
        F.concat_ws(
            ",",
            F.when(d == 1, F.lit(None)).when(d == 2, F.lit('"event_type":"bogus"')).when(d == 11, F.lit('"event_type":""'))
            .otherwise(text("event_type", kind)),
            F.when(d == 3, F.lit('"timestamp":"nope"')).when(d == 12, F.lit(None)).otherwise(text("timestamp", stamp)),
            F.when(d == 4, F.lit(None)).when(d == 5, F.lit('"payload":[]')).when(d == 13, F.lit('"payload":7'))
            .otherwise(F.concat(F.lit('"payload":'), payload)),
            F.when(d == 6, F.lit('"metrics":{"iops":-1}')).when(d == 7, F.lit('"metrics":{"iops":null}'))
            .when(d == 8, F.lit('"metrics":{"errorRate":100.5}')).when(d == 9, F.lit('"metrics":"high"'))
            .when(d == 10, F.lit('"metrics":{"latency":"slow","iops":12}'))
            .when(d == 14, F.concat(F.lit('"metrics":{"iops":'), k.cast("string"), F.lit(',"latency":1.5,"errorRate":0}'))),
        ),
        F.lit("}"),
    )
    raw = F.when(d == 0, F.lit("{bad")).otherwise(body)
    return e.select("event_id", "ts", F.base64(raw.cast("binary")).alias("data"))


def entity_predictions(metrics: DataFrame) -> DataFrame:
    """Closed-form predictions per student, in place of a hosted model, for the scoring operators."""
    calls, s30 = F.col("ib_calls_14d"), F.col("sessions_30d")
    return metrics.select(
        "*",
        F.least(F.lit(1.0), calls / F.lit(10.0)).alias("churn_risk_14d"),
        F.least(F.lit(1.0), calls / F.lit(8.0)).alias("churn_risk_30d"),
        (s30 / F.lit(30.0) * 7).alias("session_velocity"),
        F.round(F.col("avg_rating") / 5, 6).alias("first_session_success"),
    )
