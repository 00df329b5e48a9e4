"""Hand-computed values per operator and every threshold's boundary."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import expr as X
from tidewatch.functions.features import FEATURE_SPECS, feature_table
from tidewatch.operators import alerts as A
from tidewatch.operators import changes as C
from tidewatch.operators import entities as E
from tidewatch.operators import insights as I
from tidewatch.operators import ml as M
from tidewatch.operators import scoring as S
from tidewatch.operators import telemetry as L
from tidewatch.plans import views as W

T0 = dt.datetime(2024, 1, 10)


def col_values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_rules_risk(spark):
    rows = [(35.0, 5, 1), (90.0, 0, 8), (70.0, 2, 4), (0.0, 9, 0)]
    assert col_values(spark, rows, "h DOUBLE, c INT, s INT", S.rules_risk(F.col("h"), F.col("c"), F.col("s"))) == [74, 5, 29, 100]


def test_severity_boundaries(spark):
    assert col_values(spark, [(x,) for x in (49, 50, 69, 70)], "h INT", S.health_severity(F.col("h"))) == ["critical", "warning", "warning", "normal"]
    assert col_values(spark, [(x,) for x in (80, 79, 60, 59)], "r INT", S.risk_severity(F.col("r"))) == ["error", "warning", "warning", "info"]
    assert col_values(spark, [(x,) for x in (80, 60, 40, 39)], "r INT", S.prediction_type_of(F.col("r"))) == [
        "critical_performance_issue", "performance_degradation", "anomaly_detected", "normal_operation"]
    assert col_values(spark, [(x,) for x in (80, 60, 59)], "r INT", S.analysis_tier(F.col("r"))) == ["critical", "high", "medium"]


def test_confidence_by_source(spark):
    assert col_values(spark, [("SageMaker",), ("bedrock-x",), ("rules-based",)], "s STRING", S.confidence_of(F.col("s"))) == [0.95, 0.88, 0.75]


def test_class_scale(spark):
    assert col_values(spark, [(0.0,), (1.0,), (2.0,), (3.0,)], "c DOUBLE", S.class_score(F.col("c"))) == [0, 33, 67, 100]
    assert col_values(spark, [(0.4,), (2.0,), (3.7,)], "c DOUBLE", S.class_label(F.col("c"))) == ["LOW", "HIGH", "CRITICAL"]


@pytest.mark.parametrize(("kind", "c14", "c30", "health", "want"), [
    ("student", 0.1, 0.1, 85.0, "thriving"), ("student", 0.3, 0.61, 75.0, "at_risk"), ("student", 0.1, 0.1, 39.0, "churned"),
    ("student", 0.71, 0.0, 90.0, "churned"), ("student", 0.2, 0.1, 85.0, "healthy"), ("student", 0.1, 0.1, 80.0, "healthy"),
    ("student", 0.1, 0.1, 60.0, "healthy"), ("student", 0.41, 0.1, 90.0, "at_risk"),
    ("tutor", 0.1, 0.9, 81.0, "star"), ("tutor", 0.8, 0.1, 81.0, "churning"), ("tutor", 0.1, 0.1, 59.0, "at_risk"),
])
def test_segments(spark, kind, c14, c30, health, want):
    rows = [(kind, c14, c30, health)]
    got = col_values(spark, rows, "t STRING, a DOUBLE, b DOUBLE, h DOUBLE", S.segment(F.col("t"), F.col("a"), F.col("b"), F.col("h")))
    assert got == [want]


def scored(spark, **over):
    row = {"entity_id": "s1", "entity_type": "student", "first_session_success": 0.65, "session_velocity": 1.8, "churn_risk_14d": 0.32,
           "churn_risk_30d": 0.45, "health_score": 72.5, "segment": "healthy"} | over
    return spark.createDataFrame([row])


def test_insights_of_one_entity(spark):
    rows = S.generate_insights(scored(spark), X.instant("2024-01-31 00:00:00")).orderBy("timestamp").collect()
    assert [(r.prediction_type, r.risk_score) for r in rows] == [("churn_risk", 45), ("tutor_capacity", 64), ("marketplace_balance", 28)]
    assert rows[0].explanation == "Student shows 45% churn probability. Session velocity: 1.80/week, Health score: 72/100."
    assert [(r.timestamp - rows[0].timestamp).microseconds for r in rows] == [0, 100_000, 200_000]
    assert rows[0].ttl == 1706659200 + 30 * 86400 and len({r.entity_id for r in rows}) == 3


def test_insights_all_six_and_stable_ids(spark):
    df = scored(spark, health_score=30.0, session_velocity=0.1, first_session_success=0.2, churn_risk_14d=0.9)
    at = X.instant("2024-01-31 00:00:00")
    a, b = S.generate_insights(df, at).collect(), S.generate_insights(df, at).collect()
    assert len(a) == 6 and [r.entity_id for r in a] == [r.entity_id for r in b]
    assert {r.prediction_type: r.risk_score for r in a} == {
        "churn_risk": 90, "customer_health": 70, "session_quality": 80, "first_session_success": 80, "tutor_capacity": 98, "marketplace_balance": 70}


def test_recommendation_order_and_limit(spark):
    df = scored(spark, churn_risk_14d=0.9, session_velocity=0.1, first_session_success=0.2, segment="at_risk").withColumns({
        "sessions_7d": F.lit(0), "ib_calls_14d": F.lit(4), "payment_success_rate_30d": F.lit(0.5), "tutor_consistency_score": F.lit(0.1)})
    lines = S.recommendations(df).first().recommendations
    assert len(lines) == 5 and lines[0].startswith("⚠️ HIGH CHURN RISK") and lines[4].startswith("Payment failures")


def test_telemetry_rules_golden(spark):
    df = spark.createDataFrame([("n1", 120000, 12, 2, 80, 2000)], "device_id STRING, iops INT, latency INT, error_rate INT, queue_depth INT, throughput INT")
    r = L.telemetry_rules(df).first()
    assert r.points == 90 and len(r.issues) == 4 and r.issues[0] == "Node n1: High IOPS (120000)" and r.advice[3] == "Increase queue depth or reduce load on node n1"
    b = L.rules_by_batch(df.withColumn("id", F.lit(1)), F.lit(0), ["id"]).first()
    assert b.risk_score == 90 and b.analysis.startswith("Rules-based analysis detected 4 issue(s): Node n1: High IOPS (120000); ")


def test_quiet_batch(spark):
    df = spark.createDataFrame([("n1", 1, 1, 0, 1, 2000, 1)], "device_id STRING, iops INT, latency INT, error_rate INT, queue_depth INT, throughput INT, id INT")
    b = L.rules_by_batch(df, F.lit(0), ["id"]).first()
    assert (b.risk_score, b.analysis, b.recommendations) == (0, "All metrics within acceptable thresholds", ["Continue monitoring"])


def test_rolling_and_error_trend_goldens(spark):
    rows = [(i, "d", T0 + dt.timedelta(minutes=i), float(i), e) for i, e in enumerate([0.010, 0.0105, 0.020, 0.005])]
    df = spark.createDataFrame(rows, "insight_id INT, device_id STRING, ts TIMESTAMP, value DOUBLE, error_rate DOUBLE").withColumns(
        {"throughput": F.lit(1.0), "io_size_kb": F.lit(1.0)})
    out = L.rolling_device_features(df).orderBy("ts").collect()
    assert [r.error_trend for r in out] == [0, 0, 1, -1] and [r.trend_score for r in out] == [0.0, 1.0, 1.0, 1.0]
    assert out[0].iops_variance is None and [round(r.iops_variance, 4) for r in out[1:3]] == [0.7071, 1.0]


def label(spark, **over):
    row = {"stream_id": "s", "utilization": 50.0, "latency_p99": 5.0, "error_rate": 0.0, "bandwidth_gbps": 100.0, "qp_errors": 0,
           "latency_p99_baseline": 5.0, "bandwidth_gbps_baseline": 100.0} | over
    r = L.auto_label(spark.createDataFrame([row])).first()
    return r.prediction_type, r.risk_score, r.label_confidence, r.needs_review


@pytest.mark.parametrize(("over", "want"), [
    ({"utilization": 95.0}, ("resource_saturation", 85, 0.95, False)), ({"utilization": 90.0}, ("anomaly_detected", 55, 0.65, True)),
    ({"qp_errors": 101}, ("qp_error_rate_high", 70, 0.90, False)), ({"error_rate": 0.06, "latency_p99": 21.0}, ("rdma_timeout", 95, 0.92, False)),
    ({"latency_p99": 8.0}, ("performance_degradation", 96, 0.85, False)), ({"error_rate": 0.03}, ("packet_loss_detected", 80, 0.88, False)),
    ({"latency_p99": 7.0}, ("latency_spike", 70, 0.80, False)), ({"bandwidth_gbps": 60.0}, ("bandwidth_throttling", 80, 0.75, False)),
    ({"error_rate": 0.015}, ("connection_instability", 65, 0.82, False)), ({}, (None, 0, 0.0, True)),
])
def test_auto_labels(spark, over, want):
    assert label(spark, **over) == want


def test_default_baseline_keeps_rows(spark):
    m = spark.createDataFrame([("x", 6.0), ("y", 6.0)], "stream_id STRING, latency_p99 DOUBLE")
    b = spark.createDataFrame([("x", 9.0)], "stream_id STRING, latency_p99_baseline DOUBLE")
    got = {r.stream_id: r.latency_p99_baseline for r in L.with_baselines(m, b, {"latency_p99": 5.0}).collect()}
    assert got == {"x": 9.0, "y": 5.0}


def test_kpis_golden(spark):
    df = spark.createDataFrame([(85, "a"), (40, "b"), (80, "a"), (None, None)], "risk_score INT, prediction_type STRING")
    assert tuple(I.kpis(df).first()) == (4, 2, 51)
    assert {r.prediction_type: r.n for r in I.counts_by_type(df).collect()} == {"a": 2, "b": 1, "unknown": 1}
    assert tuple(I.kpis(df.limit(0)).first()) == (0, 0, 0)
    card = I.kpi_card(I.kpis(df)).first()
    assert (card.critical_pct, card.trend) == (50, "down")


def test_pages_walk_the_whole_table_once(spark):
    rows = [(i, T0 + dt.timedelta(seconds=i // 3)) for i in range(25)]
    df = spark.createDataFrame(rows, "alert_id LONG, timestamp TIMESTAMP")
    seen, token = [], None
    while True:
        got = I.page(df, 7, token).orderBy(F.desc("timestamp"), F.desc("alert_id")).collect()
        if not got:
            break
        seen += [r.alert_id for r in got]
        token = got[-1].next_token
    assert seen == list(range(24, -1, -1))
    assert I.page(df, 3, "not a token").count() == 3 and I.page(df, 3, I.page_token("x", 1)[:-4]).count() == 3


def test_merge_keeps_existing_content(spark):
    new = spark.createDataFrame([(1, "new"), (2, "new")], "alert_id INT, text STRING")
    old = spark.createDataFrame([(2, "old"), (3, "old")], "alert_id INT, text STRING")
    got = {(r.alert_id, r.text, r.is_new) for r in I.merge_unique(new, old).collect()}
    assert got == {(1, "new", True), (2, "old", True), (3, "old", False)}
    assert [r.alert_id for r in I.not_held(new, old).collect()] == [1]


def test_ttl(spark):
    df = spark.createDataFrame([(None,), (99,), (100,), (101,)], "ttl LONG")
    assert [r.ttl for r in I.active(df, F.timestamp_seconds(F.lit(100))).collect()] == [None, 101]


def test_today_in_another_zone(spark):
    at = X.instant("2024-01-25 03:30:00")
    got = spark.range(1).select(I.range_start("today", at, "America/New_York").alias("a"), I.range_start("today", at).alias("b"), I.range_start("3h", at).alias("c")).first()
    assert (got.a, got.b, got.c) == (dt.datetime(2024, 1, 24, 5), dt.datetime(2024, 1, 25), dt.datetime(2024, 1, 25, 0, 30))


def test_detection_goldens(spark):
    df = spark.createDataFrame([("student-high-risk", "student", 5, 35.0, 1), ("student-normal", "student", 1, 85.0, 5), ("t", "tutor", 9, 10.0, 0)],
                               "entity_id STRING, entity_type STRING, ib_calls_14d LONG, health_score DOUBLE, sessions_7d LONG")
    got = {(r.entity_id, r.alert_type, r.severity) for r in A.detect_state(df, X.instant("2024-01-31 00:00:00")).collect()}
    assert got == {("student-high-risk", "high_ib_call_frequency", "warning"), ("student-high-risk", "low_health_score", "critical")}
    ev = spark.createDataFrame([("supply_demand_update", "math", "high_demand", 85.0, 45.0, T0), ("supply_demand_update", "art", "balanced", 1.0, 1.0, T0)],
                               "event_type STRING, subject STRING, balance_status STRING, demand_score DOUBLE, supply_score DOUBLE, ts TIMESTAMP")
    a = A.detect_market(ev).collect()
    assert len(a) == 1 and a[0].message == "High demand detected for math (Demand: 85.0, Supply: 45.0)" and a[0].severity == "info"


def test_balance_and_patterns(spark):
    assert col_values(spark, [(85.0, 45.0), (30.0, 70.0), (60.0, 55.0), (15.0, 10.0)], "d DOUBLE, s DOUBLE", E.balance(F.col("d"), F.col("s"))) == [
        "high_demand", "high_supply", "balanced", "balanced"]
    rows = [(2, 6, 15), (8, 12, 18), (0, 2, 5), (3, 6, 9)]
    assert col_values(spark, rows, "a INT, b INT, c INT", E.session_pattern(F.col("a"), F.col("b"), F.col("c"))) == ["declining", "increasing", "inactive", "steady"]


def test_render(spark):
    df = spark.createDataFrame([("low_health_score", "critical", "s1", "student", {"health_score": "35"}, "text", T0, 88, "why", ["call", "mail"])],
                               "alert_type STRING, severity STRING, entity_id STRING, entity_type STRING, details MAP<STRING,STRING>, message STRING, "
                               "timestamp TIMESTAMP, risk_score INT, explanation STRING, recommendations ARRAY<STRING>")
    r = A.render_alerts(df).first()
    assert r.subject == "🚨 CRITICAL: low_health_score"
    for part in ("  • health_score: 35", "  1. call\n  2. mail", "🎯 Risk Score: 88/100", "💡 AI Analysis:\nwhy"):
        assert part in r.body


def test_feature_vectors(spark):
    m = spark.createDataFrame([("s", 5, 10, 20), ("t", 1, 4, 6)], "entity_id STRING, sessions_7d INT, sessions_14d INT, sessions_30d INT")
    assert [len(v) for v in FEATURE_SPECS.values()] == [46, 46]
    a, b = feature_table(m, "student").orderBy("entity_id").collect()
    assert (a.session_trend_7d_14d, a.session_trend_14d_30d, a.session_acceleration) == (0.0, 0.0, 0.0)
    assert (b.session_trend_7d_14d, b.session_trend_14d_30d, b.session_acceleration, b.avg_gap_between_sessions) == (-2.0, 2.0, -4.0, 5.0)
    assert a.avg_transaction_value == 50.0 and len(a) == 48 and len(feature_table(m, "tutor").columns) == 48


def test_response_parsing(spark):
    texts = ['```json\n{"risk_score": 88, "prediction_type": "t", "recommendations": ["x"]}\n```', "nothing here", '{"risk_score": 120, "prediction_type": "t", "recommendations": []}']
    r = S.parse_responses(spark.createDataFrame([(t,) for t in texts], "response STRING")).collect()
    assert [x.risk_score for x in r] == [88.0, 50.0, 120.0] and [x.usable for x in r] == [True, True, False]
    assert r[1].explanation == "nothing here" and r[1].recommendations == ["Review metric manually"]


def test_fallback_chain(spark):
    df = spark.createDataFrame([(10, 20, 30), (None, 20, 30), (None, None, 30)], "a INT, b INT, r INT")
    got = [(x.risk_score, x.source) for x in S.choose_source(df, {"first": "a", "second": "b"}, "r").collect()]
    assert got == [(10, "first"), (20, "second"), (30, "rules-based")]


def test_rounding_rules(spark):
    r = spark.range(1).select(X.js_round(F.lit(-2.5)).alias("a"), X.half_even(F.lit(0.5), 0).alias("b"), X.fixed(F.lit(2.5), 0).alias("c"), X.whole_percent(F.lit(0.65)).alias("d"),
                              (F.lit(0.29) * 100).cast("int").alias("e"), X.prettify(F.lit("churn_risk")).alias("f"), X.utc_text(F.lit("2024-01-10T00:00:00")).alias("g"),
                              X.utc_text(F.lit("2024-01-10T00:00:00Z")).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f, r.g, r.h) == (-2, 0.0, "2", "65%", 28, "Churn Risk", T0, T0)


def test_change_feed_and_overlay(spark):
    old = spark.createDataFrame([("a", "t", 1, None), ("b", "t", 2, None), ("c", "t", 3, "x")], "entity_id STRING, entity_type STRING, n INT, s STRING")
    new = spark.createDataFrame([("a", "t", 1, None), ("b", "t", 5, None), ("d", "t", 4, "y")], "entity_id STRING, entity_type STRING, n INT, s STRING")
    feed = C.change_feed(old, new)
    assert {(r.entity_id, r.change_type) for r in feed.collect()} == {("b", "MODIFY"), ("c", "REMOVE"), ("d", "INSERT")}
    assert {(r.entity_id, r.n) for r in C.new_images(feed).collect()} == {("b", 5), ("c", 3), ("d", 4)}
    upd = spark.createDataFrame([("a", "t", 9)], "entity_id STRING, entity_type STRING, n INT")
    assert {(r.entity_id, r.n, r.s) for r in C.overlay(old, upd).collect()} == {("a", 9, None), ("b", 2, None), ("c", 3, "x")}


def test_upsert_is_idempotent(spark):
    schema = "entity_id STRING, entity_type STRING, ts INT, v INT"
    state = spark.createDataFrame([("a", "t", 1, 1), ("b", "t", 1, 1)], schema)
    batch = spark.createDataFrame([("a", "t", 2, 2), ("a", "t", 3, 3), ("c", "t", 2, 2)], schema)
    once = C.upsert(state, batch, ["ts"])
    want = {("a", 3), ("b", 1), ("c", 2)}
    assert {(r.entity_id, r.v) for r in once.collect()} == want == {(r.entity_id, r.v) for r in C.upsert(once, batch, ["ts"]).collect()}


def test_window_counts_are_monotone(spark):
    rows = E.windowed_features(W.mkt_events(spark, "/root/testdata/sf0.001"), W.as_of()).collect()
    assert rows and all(r.session_count_7d <= r.session_count_14d <= r.session_count_30d for r in rows)


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(1000).withColumn("y", F.col("id") % 3)
    s = M.stratified_split(df, "y", "id").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in s if r.split == "train"} == {(0, "train"): 233, (1, "train"): 233, (2, "train"): 233}
    assert sum(r["count"] for r in s) == 1000 and M.hash_split(df, "id").count() == 1000


def test_codes(spark):
    assert col_values(spark, [("budget",), ("premium",), ("gold",)], "t STRING", M.encode_codes(F.col("t"), M.TIERS)) == [0, 2, None]


def test_metrics_with_defaults(spark):
    keys = spark.createDataFrame([("a",), ("z",)], "entity_id STRING")
    m = spark.createDataFrame([("a", 3, 55.0)], "entity_id STRING, sessions_7d LONG, health_score DOUBLE")
    assert {tuple(r) for r in E.metrics_with_defaults(keys, m, ["entity_id"]).collect()} == {("a", 3, 55.0), ("z", 0, 100.0)}


def test_fixed_decimals_by_the_exact_value(spark):
    """As printf writes them, and with ties up as decimal arithmetic rounds half up."""
    import random
    from decimal import ROUND_HALF_UP, Decimal

    rnd = random.Random(1)
    xs = [rnd.choice([1, -1]) * rnd.choice([rnd.random(), round(rnd.random() * 100, 3), rnd.randrange(1, 1000) / 8, rnd.random() * 1e9, 1e-7]) for _ in range(3000)] + [1.005, 8.585, 84.08500000000001, 0.125, 2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", X.fixed(F.col("x"), 2).alias("a"), X.fixed(F.col("x"), 0).alias("b"), X.fixed(F.col("x"), 2, "up").alias("c")).collect():
        assert (r.a, r.b, r.c) == (f"{r.x:.2f}", f"{r.x:.0f}", str(Decimal(r.x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)))
