"""Declared schemas: nothing on a production path infers one."""

from __future__ import annotations




EVENT_TYPES = [
    # fixed values
    "session_started",
    "session_completed",
    "ib_call_logged",
    "tutor_availability_updated",
    "customer_health_update",
    "supply_demand_update",
]

INSIGHT_TYPES = [
    # fixed values, in display order
    "customer_health",
    "churn_risk",
    "session_quality",
    "marketplace_balance",
    "tutor_capacity",
    "first_session_success",
]

# Source tables. Timestamps are declared as instants so that range filters reach the Parquet scan.
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}

ENVELOPE = (
    "event_type STRING, timestamp STRING, payload VARIANT, entity_id STRING, entity_type STRING, "
    "metrics VARIANT, metadata VARIANT, ingested_at TIMESTAMP, source_ip STRING, request_id STRING"
)

ERROR = "struct<field:string,message:string,severity:string>"

TELEMETRY_RECORD = (
    "insightId STRING, deviceId STRING, timestamp BIGINT, value DOUBLE, riskLevel STRING, performanceScore DOUBLE, "
    "metadata STRUCT<read_iops: DOUBLE, write_iops: DOUBLE, total_iops: DOUBLE, avg_latency: DOUBLE, "
    "p95_latency: DOUBLE, p99_latency: DOUBLE, bandwidth_mbps: DOUBLE, error_rate: DOUBLE, access_pattern: STRING, "
    "queue_depth: DOUBLE, io_size_kb: DOUBLE>"
)

TELEMETRY_BUNDLE = (
    f"labeled_data ARRAY<STRUCT<{TELEMETRY_RECORD}>>, unlabeled_data ARRAY<STRUCT<{TELEMETRY_RECORD}>>"
)

INSIGHT_ITEM = (
    "entity_id STRING, entity_type STRING, timestamp TIMESTAMP, related_entity STRING, prediction_type STRING, "
    "risk_score INT, explanation STRING, recommendations ARRAY<STRING>, model_used STRING, confidence DOUBLE, ttl BIGINT"
)

ALERT = (
    "alert_type STRING, severity STRING, entity_id STRING, entity_type STRING, details MAP<STRING, STRING>, "
    "message STRING, timestamp TIMESTAMP"
)
