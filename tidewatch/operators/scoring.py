"""Rules, segments, recommendations, insights, fallbacks and response parsing on scored entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.expr import fixed, half_even, js_round, keep, ratio, stable_id, ttl_stamp, whole_percent

PREDICTION_DEFAULTS = {
    # fixed values: what a failed scoring call counts as
    "first_session_success": 0.5,
    "session_velocity": 0.0,
    "churn_risk_14d": 0.5,
    "churn_risk_30d": 0.5,
    "health_score": 50.0,
}


def with_prediction_defaults(df: DataFrame) -> DataFrame:
    """A row without a complete prediction takes all the conservative defaults."""
    failed = F.lit(False)
    for name in PREDICTION_DEFAULTS:
        failed = failed | F.col(name).isNull()
    return df.withColumn("_failed", failed).withColumns({
        name: F.when(F.col("_failed"), F.lit(value)).otherwise(F.col(name)) for name, value in PREDICTION_DEFAULTS.items()
    }).drop("_failed")


def rules_risk(health: Column, ib14: Column, s7: Column) -> Column:
    """Half from health, up to 30 from calls, 4 per session missing to 5; capped at 100."""
    score = (F.lit(100) - health) * 0.5 + F.least(ib14 * 5, F.lit(30)) + F.greatest(F.lit(5) - s7, F.lit(0)) * 4
    return F.least(js_round(score), F.lit(100)).cast("int")


def health_severity(health: Column) -> Column:
    return F.when(health < 50, "critical").when(health < 70, "warning").otherwise("normal")


def risk_severity(risk: Column) -> Column:
    return F.when(risk >= 80, "error").when(risk >= 60, "warning").otherwise("info")


def prediction_type_of(risk: Column) -> Column:
    return (
        F.when(risk >= 80, "critical_performance_issue").when(risk >= 60, "performance_degradation")
        .when(risk >= 40, "anomaly_detected").otherwise("normal_operation")
    )


def confidence_of(source: Column) -> Column:
    low = F.lower(source)
    return F.when(low.contains("sagemaker"), 0.95).when(low.contains("bedrock"), 0.88).otherwise(0.75)


def analysis_tier(risk: Column) -> Column:
    return F.when(risk >= 80, "critical").when(risk >= 60, "high").otherwise("medium")


def class_score(level: Column) -> Column:
    return js_round(level * 33.33).cast("int")


def class_label(level: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("LOW", "MEDIUM", "HIGH", "CRITICAL")])
    return F.element_at(names, (F.least(F.floor(level), F.lit(3)) + 1).cast("int"))


def class_recommendations(level: Column) -> Column:
    """Advice by risk class; the extra lines depend on the sample's metrics."""
    c = F.col
    high, mid, low = level >= 3, (level >= 2) & (level < 3), (level >= 1) & (level < 2)
    return keep(
        F.when(high, "CRITICAL: Immediate investigation required"),
        F.when(high & (c("error_rate") > 3), "Check for hardware failures or connectivity issues"),
        F.when(high & (c("latency") > 20), "Network congestion detected - investigate InfiniBand fabric"),
        F.when(high & (c("iops") > 120000), "Resource saturation - consider scaling or load balancing"),
        F.when(mid, "HIGH: Schedule maintenance window for investigation"),
        F.when(mid & (c("latency") > 10), "Monitor latency trends - potential congestion building"),
        F.when(mid & (c("queue_depth") > 64), "Queue depth approaching limits - review workload distribution"),
        F.when(low, "MEDIUM: Monitor closely for trend changes"),
        F.when(low & (c("iops") > 80000), "IOPS trending high - prepare capacity plan"),
        F.when(level < 1, "LOW: Continue normal monitoring"),
    )


def segment(entity_type: Column, churn14: Column, churn30: Column, health: Column) -> Column:
    tutor = entity_type == "tutor"
    lost = (churn14 > 0.7) | (health < 40)
    risky = (churn14 > 0.4) | (health < 60)
    best = (churn14 < 0.2) & (health > 80)
    return (
        F.when(tutor & lost, "churning").when(lost, "churned")
        .when(risky | (~tutor & (churn30 > 0.6)), "at_risk")
        .when(tutor & best, "star").when(best, "thriving").otherwise("healthy")
    )


def with_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", segment(F.col("entity_type"), F.col("churn_risk_14d"), F.col("churn_risk_30d"), F.col("health_score")))


SEGMENTS = ["thriving", "healthy", "at_risk", "churned", "star", "churning"]  # fixed values


def segment_counts(df: DataFrame) -> DataFrame:
    """Entities per segment by type, zeros kept; the pivot list is fixed, so no extra pass finds it."""
    return df.groupBy("entity_type").pivot("segment", SEGMENTS).count().fillna(0)


def prediction_kpis(df: DataFrame) -> DataFrame:
    n = lambda name: F.count_if(F.col("segment") == name)
    return df.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.count_if(F.col("churn_risk_14d") > 0.7).alias("high_churn_count"),
        F.coalesce(F.avg("churn_risk_14d"), F.lit(0.0)).alias("avg_churn_risk_14d"),
        F.coalesce(F.avg("health_score"), F.lit(0.0)).alias("avg_health_score"),
        n("thriving").alias("thriving"), n("at_risk").alias("at_risk"), n("churned").alias("churned"),
    )


METRIC_NAMES = [
    # fixed values: published metric name, source column, unit
    ("TotalCustomersProcessed", "total_processed", "Count"),
    ("HighChurnRiskCount", "high_churn_count", "Count"),
    ("AverageChurnRisk14d", "avg_churn_risk_14d", "None"),
    ("AverageHealthScore", "avg_health_score", "None"),
    ("ThrivingCustomers", "thriving", "Count"),
    ("AtRiskCustomers", "at_risk", "Count"),
    ("ChurnedCustomers", "churned", "Count"),
]


def metric_points(kpis: DataFrame, at: Column) -> DataFrame:
    """The KPI row in long format, one metric data point per row."""
    units = F.create_map(*[F.lit(x) for name, _, unit in METRIC_NAMES for x in (name, unit)])
    wide = kpis.select(*[F.col(column).cast("double").alias(name) for name, column, _ in METRIC_NAMES])
    return wide.unpivot([], [name for name, _, _ in METRIC_NAMES], "metric_name", "value").select(
        "metric_name", "value", units[F.col("metric_name")].alias("unit"), at.alias("timestamp")
    )


def _metric(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def recommendations(df: DataFrame, limit: int = 5) -> DataFrame:
    """Ordered advice per entity, at most ``limit`` lines; needs predictions and ``segment``."""
    tutor = F.col("entity_type") == "tutor"
    student = ~tutor
    churn, velocity, seg = F.col("churn_risk_14d"), F.col("session_velocity"), F.col("segment")
    m = lambda name, default: _metric(df, name, default)
    lines = keep(
        # fixed texts: tutors
        F.when(tutor & (churn > 0.6), "⚠️ HIGH BURNOUT RISK: Schedule wellness check-in within 48 hours"),
        F.when(tutor & (m("utilization_rate", 0.0) > 0.9), "High utilization - suggest reducing hours or adding breaks"),
        F.when(tutor & (m("avg_rating", 5.0) < 4.0), "Low ratings detected - provide coaching or additional training"),
        F.when(tutor & (velocity < 0.5), "Low booking rate - increase visibility or marketing support"),
        F.when(tutor & (m("student_retention_rate", 1.0) < 0.5), "Low student retention - review teaching style and student feedback"),
        F.when(tutor & (seg == "star"), "✅ Star tutor - consider featuring in marketplace or bonus incentives"),
        # fixed texts: students
        F.when(student & (churn > 0.6), "⚠️ HIGH CHURN RISK: Schedule proactive check-in call within 48 hours"),
        F.when(student & (churn > 0.6) & (m("sessions_7d", 0.0) == 0), "No sessions in 7 days - send re-engagement campaign"),
        F.when(student & (churn > 0.6) & (m("ib_calls_14d", 0.0) >= 2), "Multiple IB calls detected - assign dedicated account manager"),
        F.when(student & (velocity < 0.5) & (seg != "churned"), "Low session frequency - offer scheduling assistance or flexible hours"),
        F.when(student & (m("payment_success_rate_30d", 1.0) < 0.9), "Payment failures detected - update billing information"),
        F.when(student & (m("tutor_consistency_score", 1.0) < 0.5), "Low tutor consistency - assign preferred tutor for better match"),
        F.when(student & (F.col("first_session_success") < 0.5), "Low first session success probability - provide onboarding support"),
        F.when(student & (seg == "thriving"), "✅ Thriving customer - consider upsell or referral program"),
    )
    return df.withColumn("recommendations", F.slice(lines, 1, limit))


def generate_insights(df: DataFrame, run_at: Column, model: str = "health-v1", ttl_days: int = 30) -> DataFrame:
    """2 to 6 insight rows per scored entity, by threshold.

    Each entity expands to its rows in place (no shuffle); ids depend on content, timestamps are 100 ms apart.
    """
    c = F.col
    c14, c30, velocity, health, success = (
        c("churn_risk_14d"), c("churn_risk_30d"), c("session_velocity"), c("health_score"), c("first_session_success")
    )
    churn = F.greatest(c14, c30)
    rate, score = fixed(velocity, 2), fixed(health, 0)
    percent = lambda x: (x * 100).cast("int")
    capacity = F.least((velocity * 20).cast("int"), F.lit(100))
    days = fixed(_metric(df, "days_since_last_session", 0.0), 0)

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def item(cond: Column, kind: str, risk: Column, explanation: Column, confidence: float) -> Column:
        return F.when(cond, F.struct(
            F.lit(kind).alias("prediction_type"), risk.cast("int").alias("risk_score"),
            explanation.alias("explanation"), F.lit(confidence).alias("confidence"),
        ))

    items = keep(
        # fixed texts and thresholds of the six insight types
        item(churn > 0.3, "churn_risk", percent(churn), text(
            "Student shows ", percent(churn).cast("string"), "% churn probability. ",
            F.when(c14 > 0.5, "High risk of churning within 14 days. ")
            .when(c30 > 0.5, "Elevated risk of churning within 30 days. ").otherwise(""),
            "Session velocity: ", rate, "/week, Health score: ", score, "/100."), 0.85),
        item(health < 70, "customer_health", (F.lit(100) - health).cast("int"), text(
            "Overall health score of ", score, "/100 indicates ", c("segment"), " status. Session frequency: ", rate, "/week. ",
            F.when(_metric(df, "avg_rating", 0.0) < 4.0, "Low satisfaction ratings detected. ").otherwise("")), 0.88),
        item(velocity < 0.5, "session_quality", F.least(((F.lit(0.5) - velocity) * 200).cast("int"), F.lit(100)), text(
            "Low session booking rate of ", rate, " sessions/week. Last session ", days, " days ago. "), 0.82),
        item(success < 0.6, "first_session_success", percent(F.lit(1) - success), text(
            "First session success probability: ", whole_percent(success),
            ". Student may need additional onboarding support or tutor matching optimization."), 0.79),
        item(F.lit(True), "tutor_capacity", F.lit(100) - capacity, text(
            "Current session velocity: ", rate, "/week. ",
            F.when(velocity > 2.0, "High engagement - ensure tutor availability matches demand.")
            .when(velocity < 0.5, "Low engagement - may need tutor outreach or scheduling flexibility.")
            .otherwise("Moderate engagement - monitor for changes.")), 0.75),
        item(F.lit(True), "marketplace_balance", F.lit(100) - health.cast("int"), text(
            "Student health: ", score, "/100, Segment: ", c("segment"), ". Churn risk: ", whole_percent(churn),
            ", Session velocity: ", rate, "/week."), 0.80),
    )
    advice = F.slice("recommendations", 1, 3) if "recommendations" in df.columns else F.array().cast("array<string>")
    return df.withColumn("_advice", advice).select(
        c("entity_id").cast("string").alias("related_entity"), F.col("entity_type").alias("_type"), "_advice", F.posexplode(items).alias("idx", "_i")
    ).select(
        stable_id("insight_", c("_type"), c("related_entity"), c("_i.prediction_type"), F.unix_millis(run_at)).alias("entity_id"),
        F.lit("insight").alias("entity_type"),
        F.timestamp_micros(F.unix_micros(run_at) + c("idx") * 100_000).alias("timestamp"),
        "related_entity", "_i.prediction_type", "_i.risk_score", "_i.explanation",
        c("_advice").alias("recommendations"), F.lit(model).alias("model_used"), "_i.confidence",
        ttl_stamp(run_at, ttl_days).alias("ttl"),
    )


def stored_predictions(df: DataFrame, run_at: Column, model: str = "health-v1") -> DataFrame:
    """The nine overlay columns in their exact stored types."""
    exact = lambda name, places, kind: half_even(F.col(name), places).cast(kind)
    return df.select(
        "entity_id", "entity_type",
        exact("churn_risk_14d", 4, "decimal(9,4)").alias("churn_risk_14d"),
        exact("churn_risk_30d", 4, "decimal(9,4)").alias("churn_risk_30d"),
        exact("first_session_success", 4, "decimal(9,4)").alias("first_session_success_prob"),
        exact("session_velocity", 4, "decimal(9,4)").alias("session_velocity"),
        exact("health_score", 2, "decimal(6,2)").alias("health_score"),
        "segment", F.lit(model).alias("model_version"), run_at.alias("prediction_timestamp"), "recommendations",
    )


def fallback_insight(df: DataFrame) -> DataFrame:
    """The insight given when no model answers, from ``utilization``, ``latency_delta`` and ``baseline_latency``."""
    c = F.col
    busy, slow = c("utilization") > 90, c("latency_delta") > c("baseline_latency") * 0.5

    def insight(kind: str, risk: int, explanation: Column, advice: list[str], confidence: float) -> Column:
        return F.struct(
            F.lit(kind).alias("prediction_type"), F.lit(risk).alias("risk_score"), explanation.alias("explanation"),
            F.array(*[F.lit(a) for a in advice]).alias("recommendations"), F.lit(confidence).alias("confidence"),
        )

    chosen = (
        F.when(busy, insight("resource_saturation", 85, F.format_string("Port utilization at %s%% (fallback analysis)",
                                                                        c("utilization").cast("string")),
                             ["Scale workload", "Check for hot spots"], 0.6))
        .when(slow, insight("performance_degradation", 70, F.format_string("Latency increased by %sμs (fallback analysis)",
                                                                           c("latency_delta").cast("string")),
                            ["Check network topology", "Review switch configs"], 0.6))
        .otherwise(insight("anomaly_detected", 50, F.lit("Anomaly detected, AI analysis unavailable (fallback)"),
                           ["Manual investigation required"], 0.5))
    )
    return df.withColumn("_f", chosen).select(*df.columns, "_f.*")


def choose_source(df: DataFrame, scores: dict[str, str], rules: str) -> DataFrame:
    """The first scorer that answered, else the rules: ``risk_score`` and its ``source``.

    ``scores`` maps a source name to its score column, in order of preference.
    """
    risk = F.coalesce(*[F.col(c) for c in scores.values()], F.col(rules))
    source = None
    for name, column in scores.items():
        found = F.col(column).isNotNull()
        source = F.when(found, name) if source is None else source.when(found, name)
    return df.withColumns({"risk_score": risk, "source": source.otherwise("rules-based")})


def source_mix(df: DataFrame) -> DataFrame:
    """Insights per source and their share; the share of rules is the fallback rate."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("share", ratio(F.col("n"), total))


def compare_scorers(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two scorers side by side: same type, risk difference, length ratio of the texts."""
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, key).select(
        key,
        (F.col("a.prediction_type") == F.col("b.prediction_type")).alias("type_match"),
        F.abs(F.col("a.risk_score") - F.col("b.risk_score")).alias("risk_delta"),
        ratio(F.length("b.explanation"), F.length("a.explanation")).alias("length_ratio"),
    )


def comparison_summary(compared: DataFrame) -> DataFrame:
    mean = F.avg("risk_delta")
    return compared.agg(
        F.count(F.lit(1)).alias("comparisons"), F.count_if("type_match").alias("matches"),
        (ratio(F.count_if("type_match"), F.count(F.lit(1))) * 100).alias("match_pct"), mean.alias("avg_risk_delta"),
        F.when(mean > 10, "MORE").otherwise("SIMILARLY").alias("sensitivity"),
    )


def with_outcomes(predictions: DataFrame, outcomes: DataFrame, on: list[str]) -> DataFrame:
    """Predictions with what was observed, for feedback; unobserved ones stay."""
    return predictions.join(outcomes, on, "left").withColumn("observed", F.col("outcome").isNotNull())


def parse_responses(df: DataFrame, text: str = "response", unreadable_chars: int | None = None) -> DataFrame:
    """Model answers to typed columns: JSON bare, inside a fence, or inside prose; the unreadable gets defaults and its
    text as explanation, whole unless ``unreadable_chars`` cuts it."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```json\s*(.*?)\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    body = F.coalesce(F.try_parse_json(text), F.try_parse_json(fenced), F.try_parse_json(braced))
    at = lambda path, kind: F.try_variant_get("_v", f"$.{path}", kind)
    risk = at("risk_score", "double")
    lists = at("recommendations", "array<string>")
    usable = at("prediction_type", "string").isNotNull() & risk.between(0, 100) & lists.isNotNull()
    unreadable = F.col("_v").isNull()
    return df.withColumn("_v", body).withColumns({
        "prediction_type": F.when(unreadable, "unknown").otherwise(at("prediction_type", "string")),
        "risk_score": F.when(unreadable, 50.0).otherwise(risk),
        "explanation": F.when(unreadable, F.substring(text, 1, unreadable_chars) if unreadable_chars else F.col(text)).otherwise(F.coalesce(at("explanation", "string"), F.lit(""))),
        "recommendations": F.when(unreadable, F.array(F.lit("Review metric manually"))).otherwise(lists),
        "confidence": F.when(unreadable, 0.5).otherwise(at("confidence", "double")),
        "usable": unreadable | F.coalesce(usable, F.lit(False)),
    }).drop("_v")


def parse_model_predictions(df: DataFrame, text: str = "response") -> DataFrame:
    """Five-target scoring answers, as a dict of one-element lists or as an array; else conservative defaults."""
    names = list(PREDICTION_DEFAULTS)
    v = F.try_parse_json(text)
    wide = df.withColumn("_v", v)
    for i, name in enumerate(names):
        wide = wide.withColumn(name, F.coalesce(
            F.try_variant_get("_v", f"$.predictions[0].{name}[0]", "double"),
            F.try_variant_get("_v", f"$.predictions[0][{i}]", "double"),
        ))
    return with_prediction_defaults(wide.drop("_v"))
