"""Decode, validate, gate, route and normalise raw event records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import keep, truthy_or, ttl_stamp
from tidewatch.schemas import ERROR, EVENT_TYPES

TYPE_LIST = ", ".join(EVENT_TYPES)


def decode_records(df: DataFrame, data: str = "data") -> DataFrame:
    """Base64 -> UTF-8 text (``raw``) -> VARIANT (``v``); what cannot be decoded is null and the batch goes on."""
    return df.withColumn("raw", F.expr(f"CAST(try_to_binary({data}, 'base64') AS STRING)")).withColumn(
        "v", F.try_parse_json("raw")
    )


def _at(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "variant")


def _kind(path: str) -> Column:
    """VARIANT type name at a path: null when absent, ``VOID`` for a JSON null."""
    return F.schema_of_variant(_at(path))


def _text(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "string")


def _is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")


def _is_object(kind: Column) -> Column:
    return kind.startswith("OBJECT") | kind.startswith("ARRAY")


def _present(kind: Column, text: Column) -> Column:
    """Neither absent, null, empty text, zero nor false."""
    falsy = kind.isNull() | (kind == "VOID") | text.isin("", "false")
    falsy = falsy | (_is_number(kind) & (text.try_cast("double") == 0))
    return ~F.coalesce(falsy, F.lit(False))


def _error(field: str, message: Column | str, severity: str) -> Column:
    message = F.lit(message) if isinstance(message, str) else message
    return F.struct(F.lit(field).alias("field"), message.alias("message"), F.lit(severity).alias("severity"))


def _bad_number(kind: Column, value: Column, low: float, high: float | None) -> Column:
    outside = value < low if high is None else (value < low) | (value > high)
    return kind.isNotNull() & F.coalesce(~_is_number(kind) | outside, F.lit(True))


def _facts(decoded: DataFrame) -> DataFrame:
    """The few typed facts the rules need, each path read once; records without metrics skip the metric paths."""
    m = lambda name, kind: F.try_variant_get("_metrics", f"$.{name}", kind)
    return decoded.withColumns({
        "event_type": _text("event_type"), "_type_kind": _kind("event_type"), "_payload_kind": _kind("payload"),
        "_metrics": _at("metrics"), "event_time": _text("timestamp"), "_time_kind": _kind("timestamp"),
    }).withColumns({
        "_metrics_kind": F.schema_of_variant("_metrics"), "_metrics_text": F.try_variant_get("_metrics", "$", "string"),
        "_iops_kind": F.schema_of_variant(m("iops", "variant")), "_iops": m("iops", "double"),
        "_lat_kind": F.schema_of_variant(m("latency", "variant")), "_lat": m("latency", "double"),
        "_err_kind": F.schema_of_variant(m("errorRate", "variant")), "_err": m("errorRate", "double"),
    })


def validate_events(decoded: DataFrame) -> DataFrame:
    """Adds ``errors`` (field, message, severity), ``is_valid`` and the typed envelope columns.

    Facts and rules are kept apart on purpose: fused into one generated method they would be too large for the JVM
    to compile.
    """
    col = F.col
    df = _computed_once(_facts(decoded)).withColumns({
        "_typed": _present(col("_type_kind"), col("event_type")),
        "_has_metrics": _present(col("_metrics_kind"), col("_metrics_text")),
        "_metrics_object": F.coalesce(_is_object(col("_metrics_kind")), F.lit(False)),
        "_timed": _present(col("_time_kind"), col("event_time")) & ~_is_number(col("_time_kind")),
        "_readable": col("v").isNotNull() & ~F.is_variant_null("v"),
    })
    typed, has_metrics, metrics_object, readable = col("_typed"), col("_has_metrics"), col("_metrics_object"), col("_readable")
    unknown = F.concat(F.lit("Invalid event_type: "), col("event_type"), F.lit(f". Must be one of: {TYPE_LIST}"))
    rules = [
        # fixed texts, in the order errors are reported
        (~typed, "event_type", "Missing required field: event_type", "critical"),
        (typed & ~col("event_type").isin(EVENT_TYPES), "event_type", unknown, "error"),
        (~F.coalesce(_is_object(col("_payload_kind")), F.lit(False)), "payload", "Missing or invalid payload field", "critical"),
        (has_metrics & ~metrics_object, "metrics", "Metrics must be an object", "error"),
        (metrics_object & _bad_number(col("_iops_kind"), col("_iops"), 0, None),
         "metrics.iops", "IOPS must be a non-negative number", "error"),
        (metrics_object & _bad_number(col("_lat_kind"), col("_lat"), 0, None),
         "metrics.latency", "Latency must be a non-negative number", "error"),
        (metrics_object & _bad_number(col("_err_kind"), col("_err"), 0, 100),
         "metrics.errorRate", "Error rate must be between 0 and 100", "error"),
        (col("_timed") & F.try_to_timestamp("event_time").isNull(),
         "timestamp", "Invalid timestamp format", "warning"),
    ]
    kept = [c for c in df.columns if not c.startswith("_")]
    flags = df.withColumn("_unreadable", ~readable)
    for first in range(0, len(rules), 3):
        part = {f"_rule{i}": readable & F.coalesce(rules[i][0], F.lit(False)) for i in range(first, min(first + 3, len(rules)))}
        flags = flags.withColumns(part)
    found = [F.when(col("_unreadable"), _error("raw_data", "Parse error: not a JSON event", "critical"))]
    found += [F.when(col(f"_rule{i}"), _error(*rule[1:])) for i, rule in enumerate(rules)]
    blocking = col("_unreadable")
    for i, rule in enumerate(rules):
        blocking = blocking | col(f"_rule{i}") if rule[3] != "warning" else blocking
    errors = F.array_compact(F.array(*found)).cast(f"array<{ERROR}>")
    return _computed_once(flags.select(*kept, errors.alias("errors"), (~blocking).alias("is_valid")))


def _computed_once(df: DataFrame) -> DataFrame:
    """Keeps later filters above the parse (pushed below it, each would parse the record again) and starts a new
    generated method."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def malformed_summary(validated: DataFrame) -> DataFrame:
    """Per rejected record: counts by severity, the worst one and a line of text."""
    def count(severity: str) -> Column:
        return F.size(F.filter("errors", lambda e: e.severity == severity))

    return (
        validated.where(~F.col("is_valid"))
        .withColumns({"n_critical": count("critical"), "n_error": count("error"), "n_warning": count("warning")})
        .withColumn("severity", F.when(F.col("n_critical") > 0, "critical").when(F.col("n_error") > 0, "error")
                    .otherwise("warning"))
        .withColumn("summary", F.format_string("Found %d critical, %d errors, %d warnings", "n_critical", "n_error", "n_warning"))
    )


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validated.where("is_valid"), validated.where("NOT is_valid")


def reject_reason(body: DataFrame, text: str = "raw") -> DataFrame:
    """The first failing rule of the ingest gate as ``reject_reason``; null when the body is accepted."""
    v = body.withColumn("v", F.try_parse_json(text))
    kind, value = _kind("event_type"), _text("event_type")
    typed = _present(kind, value)
    return v.withColumn(
        "reject_reason",
        F.when(F.coalesce(F.col(text), F.lit("")) == "", "Request body is required")
        .when(F.col("v").isNull(), "Request body is not valid JSON")
        .when(~typed, "event_type is required")
        .when(~value.isin(EVENT_TYPES), f"Invalid event_type. Must be one of: {TYPE_LIST}")
        .when(~F.coalesce(_is_object(_kind("payload")), F.lit(False)), "payload is required and must be an object"),
    ).drop("v")


def missing_required(decoded: DataFrame) -> DataFrame:
    """The metrics gate: required text fields, and objects where objects are declared; names of what fails."""
    checks = [
        F.when(~F.coalesce(_kind(name) == "STRING", F.lit(False)), F.lit(name))
        for name in ("entity_id", "entity_type", "timestamp")
    ] + [
        F.when(_kind(name).isNotNull() & ~F.coalesce(_kind(name).startswith("OBJECT"), F.lit(False)), F.lit(name))
        for name in ("metrics", "metadata")
    ]
    return decoded.withColumn("missing", keep(*checks))


def validate_short(decoded: DataFrame, critical_above: int = 3) -> DataFrame:
    """The short rule set: reasons, and critical when more than ``critical_above`` rules fail."""
    df = _facts(decoded)
    col = F.col
    typed = _present(col("_type_kind"), col("event_type")) & col("event_type").isin(EVENT_TYPES)
    reasons = keep(
        F.when(~F.coalesce(typed, F.lit(False)),
               F.concat(F.lit("Invalid event_type: "), F.coalesce(col("event_type"), F.lit("undefined")))),
        F.when(~_present(col("_time_kind"), col("event_time")), F.lit("Missing timestamp")),
        F.when(~_present(col("_payload_kind"), F.lit("x")), F.lit("Missing payload")),
        F.when(col("_iops") < 0, F.lit("Negative IOPS value")),
    )
    return (
        df.withColumn("reasons", reasons)
        .withColumn("severity", F.when(F.size("reasons") > critical_above, "critical").otherwise("error"))
        .withColumn("is_valid", F.size("reasons") == 0)
        .drop(*[c for c in df.columns if c.startswith("_")])
    )


def enrich(valid: DataFrame, received_at: Column, source_ip: Column, request_id: Column) -> DataFrame:
    """Event time defaulting to the arrival time, and the ingest stamps."""
    return valid.withColumns({
        "ts": F.coalesce(F.try_to_timestamp("event_time"), received_at),
        "ingested_at": received_at,
        "source_ip": source_ip,
        "request_id": request_id,
    })


# Payload fields by the event types that carry them: column -> (type, names the producers use).
COMMON_FIELDS = {
    "student_id": ("string", "student_id", "customer_id"), "tutor_id": ("string", "tutor_id"),
    "subject": ("string", "subject"), "region": ("string", "region"),
}
TYPE_FIELDS = {
    "session_completed": {
        "rating": ("double", "tutor_rating", "rating", "student_rating"),
        "duration_min": ("double", "duration_minutes", "actual_duration_minutes"),
        "was_cancelled": ("boolean", "was_cancelled"), "no_show": ("boolean", "no_show"),
    },
    "ib_call_logged": {"sentiment": ("double", "sentiment_score"), "call_seconds": ("double", "duration_seconds")},
    "customer_health_update": {
        "health_score": ("double", "health_score"), "sessions_last_7_days": ("long", "sessions_last_7_days"),
        "sessions_last_30_days": ("long", "sessions_last_30_days"), "ib_calls_last_14_days": ("long", "ib_calls_last_14_days"),
    },
    "supply_demand_update": {
        "demand_score": ("double", "demand_score"), "supply_score": ("double", "supply_score"),
        "balance_status": ("string", "balance_status"), "available_tutors": ("long", "available_tutors"),
        "active_students": ("long", "active_students"), "pending_requests": ("long", "pending_requests"),
    },
    "tutor_availability_updated": {
        "available_slots_this_week": ("long", "available_slots_this_week", "available_hours_this_week"),
        "instant_book_enabled": ("boolean", "instant_book_enabled", "accepts_instant_book"),
        "profile_rating": ("double", "avg_rating"), "total_sessions_completed": ("long", "total_sessions_completed"),
        "subjects": ("array<string>", "subjects"),
    },
}


def normalise_payload(valid: DataFrame) -> DataFrame:
    """One typed row per event whatever field names its producer used; a field is read only from its event type."""
    def pick(kind: str, *names: str) -> Column:
        return F.coalesce(*[F.try_variant_get("_payload", f"$.{n}", kind) for n in names])

    columns = {name: pick(*spec) for name, spec in COMMON_FIELDS.items()}
    for event_type, fields in TYPE_FIELDS.items():
        columns |= {name: F.when(F.col("event_type") == event_type, pick(*spec)) for name, spec in fields.items()}
    return valid.withColumn("_payload", _at("payload")).withColumns(columns).drop("_payload")


def event_items(events: DataFrame, as_of: Column) -> DataFrame:
    """Entity rows of normalised events, expanded in place: the event itself, a tutor delta, a tutor profile.

    The event row is keyed by a content hash, so two events in one millisecond stay two rows.
    """
    c = F.col
    has_tutor = F.coalesce(c("tutor_id"), F.lit("")) != ""
    rated = truthy_or(c("rating"), 0.0)
    fields = {
        "sessions_completed_count": "long", "session_duration_total_min": "double", "session_rating_sum": "double",
        "session_rating_count": "long", "cancellation_count": "long", "no_show_count": "long", "primary_subject": "string",
        "available_slots_this_week": "long", "avg_rating": "double", "total_sessions_completed": "long",
        "subjects": "array<string>", "instant_book_enabled": "boolean",
    }

    def item(entity_id: Column, entity_type: Column, days: int, **values: Column) -> Column:
        return F.struct(
            entity_id.alias("entity_id"), entity_type.alias("entity_type"), ttl_stamp(as_of, days).alias("ttl"),
            *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()],
        )

    content = F.sha2(c("raw").cast("binary"), 256)
    event = item(
        F.coalesce(F.try_variant_get("v", "$.entity_id", "string"), content),
        F.coalesce(F.try_variant_get("v", "$.entity_type", "string"), F.lit("event")), 30,
    )
    delta = item(
        c("tutor_id"), F.lit("tutor"), 90,
        sessions_completed_count=F.lit(1), session_duration_total_min=F.coalesce("duration_min", F.lit(0.0)),
        session_rating_sum=rated, session_rating_count=(rated != 0).cast("long"),
        cancellation_count=F.coalesce("was_cancelled", F.lit(False)).cast("long"),
        no_show_count=F.coalesce("no_show", F.lit(False)).cast("long"), primary_subject=c("subject"),
    )
    profile = item(
        c("tutor_id"), F.lit("tutor"), 90,
        available_slots_this_week=F.coalesce("available_slots_this_week", F.lit(0)),
        avg_rating=F.coalesce("profile_rating", F.lit(0.0)),
        total_sessions_completed=F.coalesce("total_sessions_completed", F.lit(0)),
        subjects=F.coalesce("subjects", F.array().cast("array<string>")),
        instant_book_enabled=F.coalesce("instant_book_enabled", F.lit(False)),
    )
    items = keep(
        event,
        F.when((c("event_type") == "session_completed") & has_tutor, delta),
        F.when((c("event_type") == "tutor_availability_updated") & has_tutor, profile),
    )
    return events.select("ts", "event_id", "event_type", F.explode(items).alias("_i")).select("ts", "event_id", "event_type", "_i.*")


# columns of a tutor's state: what deltas add to, and what the newest value replaces
ADDED = ["sessions_completed_count", "session_duration_total_min", "session_rating_sum", "session_rating_count", "cancellation_count", "no_show_count"]
KEPT = ["primary_subject", "available_slots_this_week", "avg_rating", "total_sessions_completed", "subjects", "instant_book_enabled"]


def tutor_parts(items: DataFrame) -> DataFrame:
    """Tutor rows of ``event_items`` as parts of a state: sums, and kept values with the event they come from.

    Parts of batches add up to the part of all events, in any order and grouping (``merge_tutor_parts``).
    """
    stamped = [F.when(F.col(c).isNotNull(), F.struct("ts", "event_id", F.col(c).alias("value"))).alias(c) for c in KEPT]
    rows = items.where(F.col("entity_type") == "tutor").select("entity_id", "ttl", "ts", *[F.coalesce(c, F.lit(0)).alias(c) for c in ADDED], *stamped)
    return merge_tutor_parts(rows)


def merge_tutor_parts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("entity_id").agg(
        F.max("ttl").alias("ttl"), F.max("ts").alias("ts"), *[F.sum(c).alias(c) for c in ADDED], *[F.max(c).alias(c) for c in KEPT])


def tutor_state(parts: DataFrame) -> DataFrame:
    """One row per tutor: deltas added up, every other column the newest value it ever had."""
    return merge_tutor_parts(parts).select("entity_id", F.lit("tutor").alias("entity_type"), "ttl", "ts", *ADDED, *[F.col(f"{c}.value").alias(c) for c in KEPT])
