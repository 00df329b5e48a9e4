"""Every query by name: the operators on the canonical views, whole tables in, one DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import expr as X
from tidewatch.functions.features import feature_table
from tidewatch.operators import alerts as A
from tidewatch.operators import changes as C
from tidewatch.operators import entities as E
from tidewatch.operators import insights as I
from tidewatch.operators import ml as M
from tidewatch.operators import ordered as O
from tidewatch.operators import scoring as S
from tidewatch.operators import telemetry as L
from tidewatch.operators import sessions as SN
from tidewatch.operators import validate as V
from tidewatch.plans import views as W
from tidewatch.plans.refresh import refresh_table
from tidewatch.session import prepare, scratch_dir
from tidewatch.sources.versions import VersionedTable
from tidewatch.sources.writers import read_state, read_tutors
from tidewatch.streaming import alarms as SA
from tidewatch.streaming import ingest as SI
from tidewatch.streaming import late as SLT
from tidewatch.streaming import state as SS
from tidewatch.streaming import windows as SW

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
NOW = W.as_of


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Registers a query; its instants leave as UTC wall-clock times."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(prepare(spark), sf_dir)
        naive = {f.name: F.col(f.name).cast("timestamp_ntz") for f in df.schema.fields if isinstance(f.dataType, T.TimestampType)}
        return df.withColumns(naive) if naive else df

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame, places: int = 6, means: int = 9) -> DataFrame:
    """Doubles to a fixed number of decimals: sums of doubles depend on their order in the last bits.

    Rolling means keep more decimals, where a mean of few short decimals cannot fall on a rounding tie.
    """
    digits = lambda name: means if name.endswith(("m_avg", "h_avg")) else places
    return df.withColumns({
        f.name: F.round(f.name, digits(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
    })


# --- entity metrics -------------------------------------------------------------------------------------------


@query
def windowed_features(spark, sf):
    return rounded(E.windowed_features(W.mkt_events(spark, sf), NOW()))


@query
def window_catalogue(spark, sf):
    return rounded(E.window_catalogue(W.activity(spark, sf), NOW()))


@query
def entity_counters(spark, sf):
    return E.entity_counters(W.mkt_events(spark, sf), NOW())


@query
def entity_counters_total(spark, sf):
    return E.entity_counters(W.mkt_events(spark, sf), NOW(), mode="counter")


@query
def tutor_session_agg(spark, sf):
    t = E.tutor_sessions(W.mkt_events(spark, sf))
    return t.withColumn("subjects_taught", F.array_join("subjects_taught", ","))


@query
def tutor_feature_agg(spark, sf):
    ev = W.mkt_events(spark, sf)
    earned = E.tutor_earnings(ev, W.tutor_rates(spark, sf), NOW())
    return rounded(E.tutor_features(ev, NOW()).join(earned, "tutor_id", "left").fillna(0, ["total_earnings", "paid_sessions", "unrated_sessions"]))


@query
def running_rating(spark, sf):
    return rounded(E.running_rating(W.mkt_events(spark, sf)))


@query
def mean_rating(spark, sf):
    return rounded(E.mean_rating(W.mkt_events(spark, sf)))


@query
def health_overlay(spark, sf):
    return rounded(E.health_overlay(W.mkt_events(spark, sf)))


@query
def latest_supply_demand(spark, sf):
    return E.latest_supply_demand(W.mkt_events(spark, sf))


@query
def supply_demand_features(spark, sf):
    return rounded(E.supply_demand(W.mkt_events(spark, sf), NOW()))


SUBJECTS = [f"subject-{i}" for i in range(9)]


@query
def supply_demand_wide(spark, sf):
    wide = E.supply_demand_wide(E.supply_demand(W.mkt_events(spark, sf), NOW()), SUBJECTS)
    return rounded(wide.withColumn("other_subjects", F.size("other_subjects")))


@query
def recency(spark, sf):
    return E.recency(W.activity(spark, sf), NOW())


@query
def lifetime(spark, sf):
    return rounded(E.lifetime(W.activity(spark, sf), NOW()))


@query
def tutor_consistency(spark, sf):
    return rounded(E.tutor_consistency(W.mkt_events(spark, sf), NOW()))


@query
def session_trends(spark, sf):
    f = E.trend_features(E.windowed_features(W.mkt_events(spark, sf), NOW()))
    return rounded(f.select("student_id", "session_velocity_change", "rating_trend", "call_acceleration", "session_pattern"))


@query
def activity_trends(spark, sf):
    t = E.activity_trends(E.window_catalogue(W.activity(spark, sf), NOW()))
    return rounded(t.select("customer_id", "engagement_trend", "spend_acceleration"))


@query
def latest_metrics(spark, sf):
    """The newest completed session of every student."""
    ev = W.mkt_events(spark, sf).where("event_type = 'session_completed'")
    rows = ev.select(F.col("student_id").alias("entity_id"), F.lit("student").alias("entity_type"), "ts", "event_id", "rating", "duration_min")
    return E.latest_metrics(rows)


@query
def sliding_refresh(spark, sf):
    return rounded(E.refresh_windows(E.daily_partials(W.mkt_events(spark, sf)), NOW()))


@query
def metrics_with_defaults(spark, sf):
    """Every customer of the customer table, with the defaults of a new entity when nothing is known."""
    keys = W.table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    m = E.student_metrics(W.mkt_events(spark, sf), NOW()).select(
        "entity_id", "sessions_7d", "sessions_14d", "sessions_30d", "ib_calls_7d", "ib_calls_14d", "avg_rating", "health_score"
    )
    return rounded(E.metrics_with_defaults(keys, m, ["entity_id"]))


# --- validation and routing -----------------------------------------------------------------------------------


def _validated(spark, sf):
    return V.validate_events(V.decode_records(W.raw_records(spark, sf)))


@query
def event_validation(spark, sf):
    v = _validated(spark, sf)
    return v.select(
        "event_id", "is_valid",
        F.concat_ws("; ", F.transform("errors", lambda e: F.concat(e.field, F.lit(":"), e.severity))).alias("errors"),
    )


@query
def malformed_summary(spark, sf):
    return V.malformed_summary(_validated(spark, sf)).select("event_id", "severity", "summary")


@query
def quarantine_by_severity(spark, sf):
    return V.malformed_summary(_validated(spark, sf)).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query
def ingest_reject_reason(spark, sf):
    return V.reject_reason(V.decode_records(W.raw_records(spark, sf))).select("event_id", "reject_reason")


@query
def required_gate(spark, sf):
    return V.missing_required(V.decode_records(W.raw_records(spark, sf))).select(
        "event_id", F.array_join("missing", ",").alias("missing")
    )


@query
def short_validation(spark, sf):
    return V.validate_short(V.decode_records(W.raw_records(spark, sf))).select(
        "event_id", "is_valid", "severity", F.size("reasons").alias("n_reasons")
    )


def _normalised(spark, sf):
    valid, _ = V.split_valid(_validated(spark, sf))
    none = F.lit(None).cast("string")
    return V.normalise_payload(V.enrich(valid.drop("ts"), NOW(), none, none))


@query
def ingest_normalised(spark, sf):
    return _normalised(spark, sf).select(
        "event_id", "ts", "event_type", "student_id", "tutor_id", "subject", "rating", "duration_min", "was_cancelled", "no_show",
        "available_slots_this_week",
    )


@query
def event_items(spark, sf):
    """Event rows of the valid events, the newest row per key."""
    items = V.event_items(_normalised(spark, sf), NOW()).where("entity_type <> 'tutor'")
    return O.keep_last(items, C.KEYS, ["ts", "event_id"]).select("entity_id", "entity_type", "ts", "event_id", "event_type", "ttl")


TUTOR_STATE = ["entity_id", "entity_type", "ttl", "ts", *V.ADDED, "primary_subject", "available_slots_this_week"]


@query
def ingest_tutor_state(spark, sf):
    """Tutors as the write path keeps them: deltas added up, profile columns beside them."""
    return V.tutor_state(V.tutor_parts(V.event_items(_normalised(spark, sf), NOW()))).select(*TUTOR_STATE)


@query
def malformed_rate_5m(spark, sf):
    return rounded(A.malformed_rate(_validated(spark, sf), "ts"))


# --- insight serving ------------------------------------------------------------------------------------------


def _served(spark, sf):
    return I.insight_items(W.insights(spark, sf))


@query
def insight_recent(spark, sf):
    return rounded(I.recent(_served(spark, sf), 50))


@query
def insight_stream_view(spark, sf):
    return rounded(I.recent(_served(spark, sf), 10))


SINCE = "2024-01-20 00:00:00"
PAGE_AFTER = ("2024-01-25 12:00:00.000000", 1_000_000_000)


@query
def insight_page(spark, sf):
    token = I.page_token(*PAGE_AFTER)
    return rounded(I.page(_served(spark, sf), 50, token, X.instant(SINCE)).drop("next_token"))


@query
def insight_fetch_all(spark, sf):
    return rounded(I.newest_first(I.since(_served(spark, sf), X.instant(SINCE))))


@query
def insight_kpis(spark, sf):
    return I.kpis(I.since(W.insights(spark, sf), X.instant(SINCE)))


@query
def insight_by_type(spark, sf):
    return I.counts_by_type(W.insights(spark, sf))


@query
def insight_page_kpis(spark, sf):
    return I.kpis(I.page(_served(spark, sf), 50, I.page_token(*PAGE_AFTER), X.instant(SINCE)))


@query
def kpi_card(spark, sf):
    return I.kpi_card(I.kpis(W.insights(spark, sf)))


@query
def risk_distribution(spark, sf):
    return I.risk_distribution(W.insights(spark, sf))


def _trend(name: str, at: str):
    def run(spark, sf):
        return I.trend(W.insights(spark, sf), name, X.instant(at))

    run.__name__ = f"insight_trend_{name}"
    run.__doc__ = f"Zero-filled trend of the range {name}."
    return query(run)


TREND_AT = "2024-01-25 17:42:10"
for _name in ("1h", "3h", "today", "week", "default"):
    _trend(_name, TREND_AT)


@query
def ttl_active(spark, sf):
    """Insights not expired at a time 35 days after the first ones were written."""
    return I.active(W.insights(spark, sf), X.instant("2024-02-05 00:00:00")).select("entity_id", "timestamp", "ttl")


def _overlapping(spark, sf):
    served = _served(spark, sf)
    existing = served.where(F.col("timestamp") < X.instant("2024-01-22 00:00:00"))
    new = served.where(F.col("timestamp") >= X.instant("2024-01-18 00:00:00")).withColumn("risk_score", F.col("risk_score") + 1)
    return new, existing


@query
def insight_merge_unique(spark, sf):
    return I.merge_unique(*_overlapping(spark, sf)).select("alert_id", "entity_id", "risk_score", "is_new")


@query
def insight_not_held(spark, sf):
    return I.not_held(*_overlapping(spark, sf)).select("alert_id", "entity_id", "risk_score")


@query
def insight_poll(spark, sf):
    return rounded(I.poll(_served(spark, sf), X.instant("2024-01-29 00:00:00")))


@query
def insight_by_filter(spark, sf):
    return I.by_type(_served(spark, sf), "churn_risk").select("alert_id", "entity_id", "risk_score", I.F.lit("churn_risk").alias("kind"))


@query
def insight_lookup(spark, sf):
    """Point lookups in bulk: the insights whose id is an order key, a miss giving no row."""
    keys = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("alert_id"))
    return rounded(_served(spark, sf).join(keys, "alert_id", "left_semi").select("alert_id", "entity_id", "prediction_type", "risk_score", "confidence"))


@query
def critical_per_hour(spark, sf):
    return I.critical_per_hour(_served(spark, sf))


@query
def severity_view(spark, sf):
    r = F.col("risk_score")
    return _served(spark, sf).select(
        "alert_id", "risk_score", S.risk_severity(r).alias("severity"), S.analysis_tier(r).alias("tier"),
        S.prediction_type_of(r).alias("performance_type"),
    )


@query
def path_unhealthy_students(spark, sf):
    m = E.student_metrics(W.mkt_events(spark, sf), NOW())
    return rounded(I.access_path(m, "student", F.col("health_score") < 70, [F.asc("health_score")]).select("entity_id", "health_score", "last_updated"))


@query
def path_risky_by_type(spark, sf):
    return I.access_path(
        W.insights(spark, sf), "insight", (F.col("prediction_type") == "churn_risk") & (F.col("risk_score") > 80), [F.desc("risk_score")]
    ).select("entity_id", "risk_score", "timestamp")


# --- telemetry ------------------------------------------------------------------------------------------------


@query
def rolling_std10(spark, sf):
    r = L.rolling_device_features(W.telemetry(spark, sf))
    return rounded(r.select("insight_id", "iops_variance", "throughput_variance", "io_size_variance"), 4)


@query
def error_trend(spark, sf):
    return rounded(L.rolling_device_features(W.telemetry(spark, sf)).select("insight_id", "trend_score", "error_trend"), 4)


@query
def device_anomaly(spark, sf):
    d = L.device_anomaly(W.telemetry(spark, sf)).select("insight_id", "device_mean", "device_std", "anomaly_score")
    return d.withColumns({"device_mean": F.round("device_mean", 9), "device_std": F.round("device_std", 6), "anomaly_score": F.round("anomaly_score", 6)})


@query
def telemetry25(spark, sf):
    return rounded(L.telemetry_features(W.telemetry(spark, sf)))


@query
def serving_features(spark, sf):
    f = L.serving_features(W.telemetry(spark, sf))
    return rounded(f.select(F.col("insight_id"), *[c for c, _ in L.SERVING_ORDER]), 4)


@query
def feature_csv(spark, sf):
    f = L.feature_csv(L.serving_features(W.telemetry(spark, sf)))
    return f.select("insight_id", F.element_at(F.split("features_csv", ","), 5).alias("avg_latency"),
                    F.size(F.split("features_csv", ",")).alias("cells"))


@query
def rolling_means(spark, sf):
    r = L.rolling_means(W.stream_metrics(spark, sf))
    return rounded(r.select("metric_id", *[c for c in r.columns if c.endswith(("_avg", "_std"))]))


@query
def rate_accel(spark, sf):
    r = L.rolling_means(W.stream_metrics(spark, sf))
    return rounded(r.select("metric_id", "latency_p99_rate", "utilization_rate", "latency_p99_accel"), 4)


@query
def stream_baselines(spark, sf):
    return rounded(L.stream_baselines(W.stream_metrics(spark, sf)))


@query
def stream_baseline_delta(spark, sf):
    m = W.stream_metrics(spark, sf)
    d = L.interactions(L.baseline_deltas(L.with_baselines(m, L.stream_baselines(m))))
    return rounded(d.select("metric_id", "latency_p99_delta_pct", "utilization_delta_pct", "bandwidth_delta_pct", "latency_p99_delta_abs",
                            "latency_x_utilization", "error_x_bandwidth", "health_score"))


@query
def stream_features(spark, sf):
    return rounded(L.stream_features(W.stream_metrics(spark, sf)).select("metric_id", *L.STREAM_FEATURES))


@query
def trailing_baseline_15m(spark, sf):
    b = L.trailing_baseline(W.stream_metrics(spark, sf), "latency_p99")
    b = b.withColumn("is_anomaly", L.above_baseline(F.col("latency_p99"), F.col("baseline")))
    return rounded(b.select("metric_id", "history", "baseline", "is_anomaly"), 8)


@query
def trailing_baseline_extremes(spark, sf):
    """The trailing mean over values from 2e-11 to 2e24, with infinite ones and NaN among them."""
    k = F.col("metric_id") % 101
    wild = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).when(k < 20, 2e24).when(k < 60, 2e-11).otherwise(F.col("latency_p99"))
    b = L.trailing_baseline(W.stream_metrics(spark, sf).withColumn("wild", wild), "wild", minutes=24 * 60)
    text = F.when(F.isnan("baseline"), "nan").when(F.abs("baseline") == float("inf"), F.when(F.col("baseline") > 0, "inf").otherwise("-inf")).otherwise(
        F.format_string("%.6e", "baseline"))
    return b.select("metric_id", "history", text.alias("baseline"))


@query
def trailing_baseline_3d(spark, sf):
    b = L.trailing_baseline(W.stream_metrics(spark, sf), "latency_p99", minutes=3 * 24 * 60)
    return rounded(b.select("metric_id", "history", "baseline"), 8)


@query
def asof_next_alert(spark, sf):
    """Each metric with the next risky insight of its stream within 5 minutes."""
    return _asof(spark, sf, 5)


@query
def asof_next_alert_1d(spark, sf):
    """The same with a day of tolerance, where most metrics have a match."""
    return _asof(spark, sf, 24 * 60)


def _asof(spark, sf, minutes: int):
    metrics = W.stream_metrics(spark, sf).select("metric_id", "stream_id", "ts", "latency_p99")
    found = W.insights(spark, sf).where("risk_score >= 30").select(
        F.col("entity_id").alias("alert_id"), F.col("related_entity").alias("stream_id"), F.col("timestamp").alias("ts"), "prediction_type", "risk_score"
    )
    return rounded(O.asof_forward(metrics, found, ["stream_id"], "ts", minutes * L.MINUTE_US, ["alert_id", "prediction_type", "risk_score"], ["alert_id"]))


def _labelled(spark, sf):
    m = W.stream_metrics(spark, sf)
    return L.auto_label(L.with_baselines(m, L.stream_baselines(m), L.DEFAULT_BASELINE))


@query
def auto_label(spark, sf):
    return _labelled(spark, sf).select("metric_id", "prediction_type", "risk_score", "label_confidence", "needs_review")


@query
def label_coverage(spark, sf):
    return rounded(L.label_coverage(_labelled(spark, sf)))


@query
def analysis_trigger(spark, sf):
    m = W.stream_metrics(spark, sf)
    d = L.baseline_deltas(L.with_baselines(m, L.stream_baselines(m)))
    return d.select("metric_id", L.needs_analysis(d).alias("needs_analysis"), L.looks_normal(d).alias("looks_normal"))


@query
def trigger_suppression(spark, sf):
    """Not normal, and the first of its stream and type in 5 minutes."""
    rows = _labelled(spark, sf)
    rows = rows.where(~L.looks_normal(rows)).select(
        "metric_id", F.coalesce("prediction_type", F.lit("none")).alias("alert_type"), F.col("stream_id").alias("entity_id"), F.col("ts").alias("timestamp")
    )
    streams = W.stream_metrics(spark, sf).select(F.col("stream_id").alias("entity_id"), F.col("ts").alias("timestamp"))
    return A.dedup_gap(rows, ["metric_id"], 5 * L.MINUTE_US, counted=streams).where("is_new").select("metric_id", "alert_type", "entity_id", "timestamp")


@query
def similar_metric_reuse(spark, sf):
    return L.reuse_similar(_labelled(spark, sf)).select("metric_id", "source_metric", "reused")


@query
def telemetry_rules(spark, sf):
    r = L.telemetry_rules(W.telemetry(spark, sf))
    return r.select("insight_id", "points", F.array_join("issues", "; ").alias("issues"), F.array_join("advice", "; ").alias("advice"))


@query
def rules_by_batch(spark, sf):
    b = L.rules_by_batch(W.telemetry(spark, sf), F.floor(F.col("insight_id") / 100), ["insight_id"])
    return b.select("batch_id", "node_id", "risk_score", "analysis", F.array_join("recommendations", "; ").alias("recommendations"))


@query
def class_advice(spark, sf):
    t = W.telemetry(spark, sf).withColumn("level", F.col("queue_depth") % 4)
    return t.select("insight_id", S.class_score(F.col("level")).alias("score"), S.class_label(F.col("level")).alias("label"),
                    F.array_join(S.class_recommendations(F.col("level")), "; ").alias("advice"))


# --- scoring --------------------------------------------------------------------------------------------------


def _students(spark, sf):
    return E.student_metrics(W.mkt_events(spark, sf), NOW())


def _tutor_metrics(spark, sf):
    ev = W.mkt_events(spark, sf)
    f = E.tutor_features(ev, NOW())
    counts = E.entity_counters(ev, NOW()).where("entity_type = 'tutor'")
    rating = E.mean_rating(ev)
    return (
        counts.join(f.withColumn("entity_id", F.col("tutor_id").cast("string")).drop("tutor_id"), "entity_id", "left")
        .join(rating.withColumn("entity_id", F.col("tutor_id").cast("string")), "entity_id", "left")
        .select(
            "entity_id",
            *[(F.col(f"started_{d}d") + F.col(f"completed_{d}d")).alias(f"sessions_taught_{d}d") for d in (7, 14, 30)],
            *[F.col(f"completed_{d}d").alias(f"sessions_completed_{d}d") for d in (7, 14, 30)],
            F.col("completion_rate").alias("session_completion_rate"), F.col("mean_rating").alias("avg_rating"),
            F.col("negative_reviews").alias("negative_reviews_count_30d"), F.col("positive_reviews").alias("positive_reviews_count_30d"),
            F.col("retention_rate").alias("student_retention_rate"), F.col("unique_students").alias("unique_students_30d"),
            F.col("sessions_per_subject").alias("sessions_per_subject_30d"), "utilization_rate",
        )
    )


@query
def student_features46(spark, sf):
    return rounded(feature_table(_students(spark, sf), "student"))


@query
def student_vector46(spark, sf):
    """The student vector with every metric that events can tell; the other columns keep their defaults."""
    ev = W.mkt_events(spark, sf)
    habits = E.student_habits(ev, NOW())
    steady = E.tutor_consistency(ev, NOW()).select(F.col("student_id").alias("entity_id"), "tutor_consistency_score", F.col("primary_tutor_rating").alias("tutor_rating_avg"))
    m = E.student_metrics(ev, NOW()).join(habits, "entity_id", "left").join(steady, "entity_id", "left")
    return rounded(feature_table(m.withColumn("preferred_tutor_sessions_ratio", F.col("preferred_tutor_ratio")), "student"))


@query
def tutor_vector46(spark, sf):
    """The tutor vector with every metric that events can tell. 13 columns have no source and keep their defaults: next week's
    hours, response and booking times, subject match, certificates, experience, advanced topics, grades, premium and
    discount shares, disputes, refunds and pricing."""
    ev = W.mkt_events(spark, sf)
    f = E.tutor_features(ev, NOW()).join(E.tutor_ratings(ev, NOW()), "tutor_id", "left").join(E.tutor_earnings(ev, W.tutor_rates(spark, sf), NOW()), "tutor_id", "left")
    trend = F.when(F.col("earnings_trend") == "growing", 1.0).when(F.col("earnings_trend") == "declining", -1.0).otherwise(0.0)
    more = f.select(
        F.col("tutor_id").cast("string").alias("entity_id"), "avg_session_duration_min", "no_show_rate", "cancellation_rate", "days_since_last_session", "rating_trend", "rating_volatility",
        F.col("avg_student_sessions").alias("avg_student_lifetime_sessions"), F.col("available_hours").alias("available_hours_this_week"), F.col("instant_book_enabled").cast("int").alias("instant_book_enabled"), F.col("subjects").alias("primary_subject_count"),
        "subject_diversity_score", "avg_rating_by_subject", F.col("specialization").alias("specialization_score"), F.col("total_earnings").alias("total_earnings_30d"),
        "avg_earnings_per_session", trend.alias("earnings_trend"), X.ratio(F.col("total_earnings"), F.col("available_hours")).alias("revenue_per_available_hour"))
    return rounded(feature_table(_tutor_metrics(spark, sf).join(more, "entity_id", "left"), "tutor"))


def _scored(spark, sf):
    """Students and tutors with closed-form predictions, as the scoring operators expect."""
    students = W.entity_predictions(_students(spark, sf)).withColumn("entity_id", F.col("entity_id").cast("string"))
    t = _tutor_metrics(spark, sf)
    load = F.col("sessions_taught_30d")
    tutors = t.select(
        "entity_id", F.lit("tutor").alias("entity_type"), F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        "utilization_rate", "student_retention_rate",
        F.least(F.lit(1.0), load / 2000.0).alias("churn_risk_14d"), F.least(F.lit(1.0), load / 1500.0).alias("churn_risk_30d"),
        (F.col("sessions_completed_30d") / 30.0 * 7).alias("session_velocity"),
        F.round(F.coalesce("avg_rating", F.lit(0.0)) / 5, 6).alias("first_session_success"),
        (F.lit(100) - (F.coalesce("negative_reviews_count_30d", F.lit(0)) % 90)).cast("double").alias("health_score"),
    )
    return S.with_segment(students.unionByName(tutors, allowMissingColumns=True))


@query
def rules_risk(spark, sf):
    m = _students(spark, sf)
    h, c, s = F.col("health_score"), F.col("ib_calls_14d"), F.col("sessions_7d")
    return m.select("entity_id", S.rules_risk(h, c, s).alias("risk_score"), S.health_severity(h).alias("severity"))


@query
def segments(spark, sf):
    return rounded(_scored(spark, sf).select("entity_id", "entity_type", "churn_risk_14d", "churn_risk_30d", "health_score", "segment"))


@query
def segment_counts(spark, sf):
    return S.segment_counts(_scored(spark, sf))


@query
def prediction_kpis(spark, sf):
    return rounded(S.prediction_kpis(_scored(spark, sf)))


@query
def metric_points(spark, sf):
    return rounded(S.metric_points(S.prediction_kpis(_scored(spark, sf)), NOW()))


@query
def recommendations(spark, sf):
    return S.recommendations(_scored(spark, sf)).select("entity_id", "entity_type", F.array_join("recommendations", " | ").alias("recommendations"))


@query
def generate_insights(spark, sf):
    scored = S.recommendations(_scored(spark, sf))
    g = S.generate_insights(scored, NOW())
    return g.select("related_entity", "prediction_type", "risk_score", "explanation", "confidence", "timestamp", "ttl",
                    F.array_join("recommendations", "; ").alias("recommendations"))


@query
def stored_predictions(spark, sf):
    """Predictions laid over the entity rows: the other columns stay."""
    scored = S.recommendations(_scored(spark, sf))
    entities = scored.select("entity_id", "entity_type", "last_updated", F.lit(None).cast("decimal(6,2)").alias("health_score"))
    preds = S.stored_predictions(scored, NOW())
    o = C.overlay(entities, preds)
    return o.select("entity_id", "entity_type", "last_updated", F.col("health_score").cast("double").alias("health_score"),
                    *[F.col(c).cast("double").alias(c) for c in ("churn_risk_14d", "churn_risk_30d", "first_session_success_prob", "session_velocity")],
                    "segment", "model_version")


@query
def refresh_twice(spark, sf):
    """Two scheduled refreshes over a versioned table; the second smooths with what the first has stored."""
    base = scratch_dir(spark, "refresh")
    stored = ["churn_risk_14d", "churn_risk_30d", "session_velocity", "segment", "recommendations", "model_version", "prediction_timestamp", "first_session_success_prob"]

    def smoothed(entities: DataFrame) -> DataFrame:
        before = F.col("churn_risk_14d").cast("double") if "churn_risk_14d" in entities.columns else F.lit(0.0)
        fresh = W.entity_predictions(entities.withColumn("_before", before).drop(*stored))
        return fresh.withColumn("churn_risk_14d", (F.col("_before") + F.col("churn_risk_14d")) / 2).drop("_before")

    table = VersionedTable(spark, f"{base}/entities")
    table.write(_students(spark, sf), "load")
    for run, at in (("first", "2024-01-30 00:00:00"), ("second", "2024-01-31 00:00:00")):
        refresh_table(table, smoothed, base, run, X.instant(at))
    return table.read().select("entity_id", "sessions_30d", F.col("churn_risk_14d").cast("double").alias("churn_risk_14d"), F.col("churn_risk_30d").cast("double").alias("churn_risk_30d"), "segment", "prediction_timestamp")


def _fallback(spark, sf):
    m = W.stream_metrics(spark, sf)
    m = L.with_baselines(m, L.stream_baselines(m)).withColumns({
        "baseline_latency": F.col("latency_p99_baseline"), "latency_delta": F.round(F.col("latency_p99") - F.col("latency_p99_baseline"), 4),
    })
    return S.fallback_insight(m)


@query
def fallback_insight(spark, sf):
    return _fallback(spark, sf).select("metric_id", "prediction_type", "risk_score", F.array_join("recommendations", "; ").alias("recommendations"),
                                       "confidence", "explanation")


@query
def scorer_compare(spark, sf):
    """The rule labels against the fallback insights, metric by metric, summed up."""
    return rounded(S.comparison_summary(_compared(spark, sf)))


def _compared(spark, sf):
    a = _labelled(spark, sf).withColumn("explanation", F.concat(F.lit("type "), F.coalesce("prediction_type", F.lit("none"))))
    return S.compare_scorers(a.select("metric_id", "prediction_type", "risk_score", "explanation"),
                             _fallback(spark, sf).select("metric_id", "prediction_type", "risk_score", "explanation"), "metric_id")


@query
def source_mix(spark, sf):
    rows = _labelled(spark, sf).select(
        "metric_id", F.when(F.col("metric_id") % 3 == 0, F.col("risk_score")).alias("first"),
        F.when(F.col("metric_id") % 3 == 1, F.col("risk_score")).alias("second"), F.lit(50).alias("rules"),
    )
    return rounded(S.source_mix(S.choose_source(rows, {"primary-model": "first", "second-model": "second"}, "rules")))


def _responses(spark, sf):
    c = W.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    good = F.concat(F.lit('{"prediction_type": "'), F.col("event_type"), F.lit('", "risk_score": '), k.cast("string"),
                    F.lit(', "explanation": "user '), F.col("user_id").cast("string"), F.lit('", "recommendations": ["a", "b"], "confidence": 0.9}'))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(k % 5 == 1, F.concat(F.lit("Here it is: "), good, F.lit(" Done.")))
        .when(k % 5 == 2, F.lit("no json at all")).when(k % 5 == 3, F.lit('{"risk_score": 12}')).otherwise(good)
    )
    return c.select("event_id", text.alias("response"))


@query
def response_parse(spark, sf):
    r = S.parse_responses(_responses(spark, sf))
    return r.select("event_id", "prediction_type", "risk_score", "explanation", F.array_join("recommendations", ",").alias("recommendations"),
                    "confidence", "usable")


@query
def model_response_parse(spark, sf):
    c = W.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, n = F.col("k"), F.col("k").cast("string")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit('{"predictions":[{"first_session_success":[0.25],"session_velocity":['), n,
                                    F.lit('],"churn_risk_14d":[0.5],"churn_risk_30d":[0.75],"health_score":['), n, F.lit("]}]}")))
        .when(k % 3 == 1, F.concat(F.lit('{"predictions":[[0.5,'), n, F.lit(",0.1,0.2,"), n, F.lit("]]}"))).otherwise(F.lit("timeout"))
    )
    return S.parse_model_predictions(c.select("event_id", text.alias("response"))).drop("response")


# --- alerts ---------------------------------------------------------------------------------------------------


def _alerts(spark, sf):
    state = A.detect_state(_students(spark, sf), NOW())
    return state.unionByName(A.detect_market(W.mkt_events(spark, sf), ("high_demand",)))


@query
def detect_anomalies(spark, sf):
    return _alerts(spark, sf).select(
        "alert_type", "severity", "entity_id", "entity_type", "message", "timestamp",
        F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e.key, F.lit(": "), e.value)), "; ").alias("details")
    )


def _with_details(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("details", F.array_join(F.transform(F.map_entries("details"), lambda e: F.concat(e.key, F.lit(": "), e.value)), "; "))


@query
def alerts_after_events(spark, sf):
    """What every event raises, given its student's state after it, with whole messages and details."""
    return _with_details(A.detect_after_events(W.mkt_events(spark, sf)))


@query
def prediction_alerts(spark, sf):
    s = _scored(spark, sf).withColumn("session_frequency_30d", F.col("sessions_30d") / 30.0 * 7)
    return A.prediction_alerts(s).select("entity_id", "entity_type", "alert_type", "severity", "recommendation")


@query
def threshold_alerts(spark, sf):
    s = _scored(spark, sf).withColumn("ib_call_risk_14d", F.col("churn_risk_14d"))
    return A.threshold_alerts(s).select("entity_id", "entity_type", "alert_type", "severity")


@query
def alert_render(spark, sf):
    r = A.render_alerts(_alerts(spark, sf))
    return r.select("alert_type", "entity_id", "timestamp", "subject", "body")


def _event_alerts(spark, sf, events=None):
    """One alert per error, click or signup event, by user and severity of its value."""
    ev = (events if events is not None else W.table(spark, sf, "events")).where(F.col("event_type").isin("error", "click", "signup"))
    v = F.col("value")
    return ev.select(
        F.col("event_id").alias("alert_no"), F.col("event_type").alias("alert_type"), (F.col("user_id") % 25).alias("entity_id"),
        F.col("ts").alias("timestamp"), F.when(v >= 100, "critical").when(v >= 30, "warning").otherwise("info").alias("severity"),
    )


@query
def alerts_dedup_gap(spark, sf):
    return A.dedup_gap(_event_alerts(spark, sf), ["alert_no"]).select("alert_no", "is_new")


@query
def alerts_dedup_cooldown(spark, sf):
    return A.dedup_cooldown(_event_alerts(spark, sf), "alert_no").select("alert_no", "alert_type", "entity_id", "timestamp")


@query
def alert_severity(spark, sf):
    return A.severity_counts(_event_alerts(spark, sf))


@query
def alert_delivery(spark, sf):
    return rounded(A.delivery_rate(_event_alerts(spark, sf), F.col("alert_no") % 50 != 0))


@query
def alert_batch(spark, sf):
    b = A.batch_alerts(_event_alerts(spark, sf), ["alert_no"], per="1 day", max_alerts=10)
    return b.select("entity_id", "period", "part", "alert_count",
                    F.array_join(F.transform("alerts", lambda a: a.alert_no.cast("string")), ",").alias("alert_nos"))


@query
def alert_digest(spark, sf):
    return A.digest(_event_alerts(spark, sf))


ALARM_RULES = [
    # rules on the metrics the driver table offers
    ("errors-high", "error", "Sum", 3600, ">", 100.0, 2),
    ("errors-max", "error", "Maximum", 300, ">=", 90.0, 1),
    ("views-low", "view", "Average", 900, "<", 20.0, 2),
    ("clicks-high", "click", "Sum", 3600, ">", 60.0, 3),
]


@query
def alarm_eval(spark, sf):
    points = W.table(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("timestamp"), "value")
    return rounded(A.evaluate_alarms(points, ALARM_RULES, X.instant("2024-01-01 00:00:00"), NOW()), 9)


@query
def alarms_on_metrics(spark, sf):
    """The 15 rules on the metrics that events can make: malformed rate, customers at high churn risk, average health and
    customers at risk. The other eleven metrics are those of hosted services; without points their alarms are calm."""
    events = W.mkt_events(spark, sf)
    states = E.states_after(E.entity_events(events)).where("entity_type = 'student'")
    calls, health = F.col("ib_calls_14d"), F.col("health_score")
    churn14, churn30 = F.least(F.lit(1.0), calls / 10.0), F.least(F.lit(1.0), calls / 8.0)
    people = A.population_points(
        states, {"HighChurnRiskCount": churn14 > 0.7, "AtRiskCustomers": S.segment(F.col("entity_type"), churn14, churn30, health) == "at_risk"}, {"AverageHealthScore": health})
    malformed = A.malformed_rate(_validated(spark, sf), "ts").select(F.lit("malformed_rate").alias("metric"), F.col("period").alias("timestamp"), F.col("malformed_rate").alias("value"))
    return rounded(A.evaluate_alarms(malformed.unionByName(people), A.ALARMS, X.instant("2024-01-01 00:00:00"), NOW()))


@query
def stream_alarm_states(spark, sf):
    """The alarms of ``alarm_eval`` by a state machine on the stream of points, up to the stream's watermark."""
    points = _stream(spark, sf).select(F.col("event_type").alias("metric"), F.col("ts").alias("timestamp"), "value")
    start = spark.sql("SELECT unix_micros(timestamp '2024-01-01 00:00:00')").first()[0]
    return rounded(_appended(spark, SA.alarm_states(points, ALARM_RULES, start), "alarm-states"), 9)


def _requests(spark, sf):
    ev = W.table(spark, sf, "events")
    status = F.when(F.col("event_id") % 40 == 0, 500).when(F.col("event_id") % 25 == 0, 404).otherwise(200)
    return ev.select("event_id", F.col("event_type").alias("operation"), F.col("value").alias("duration"), status.alias("status"))


@query
def latency_stats(spark, sf):
    return rounded(A.latency_stats(_requests(spark, sf), ["operation"], "duration"))


@query
def latency_stats_ok(spark, sf):
    return A.latency_stats_one_based(_requests(spark, sf), ["operation"], "duration", F.col("status") == 200)


@query
def latency_stats_lineitem(spark, sf):
    """The same statistics on the largest table."""
    return rounded(A.latency_stats(W.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"), 4)


@query
def request_rates(spark, sf):
    return rounded(A.request_rates(_requests(spark, sf), ["operation"]))


@query
def partition_skew(spark, sf):
    return rounded(A.partition_skew(W.mkt_events(spark, sf), "event_type"), 4)


@query
def partition_skew_orders(spark, sf):
    return rounded(A.partition_skew(W.table(spark, sf, "lineitem"), "l_suppkey"), 4)


@query
def high_risk_routing(spark, sf):
    rows = W.insights(spark, sf).withColumn("source", F.coalesce("model_used", F.lit("none")))
    return A.high_risk(rows, ["rules", "health-v1"]).select("entity_id", "risk_score", "source")


@query
def inference_trigger(spark, sf):
    ev = W.mkt_events(spark, sf)
    return ev.where(F.col("event_type").isin(A.INFERENCE_TRIGGERS)).select("event_id", "student_id", "event_type")


@query
def error_log(spark, sf):
    ev = W.table(spark, sf, "events")
    logs = ev.select(F.col("ts").alias("timestamp"), F.concat(F.upper("event_type"), F.lit(" user "), F.col("user_id").cast("string")).alias("message"))
    return A.error_log(logs)


# --- state and change feeds -----------------------------------------------------------------------------------


def _snapshots(spark, sf):
    cols = ["entity_id", "entity_type", "region", "demand_score", "supply_score", "balance_status"]
    ev = W.mkt_events(spark, sf).where("event_type = 'supply_demand_update'").withColumns(
        {"entity_id": F.concat("subject", F.lit("/"), F.col("region"), F.lit("/"), (F.col("student_id") % 50).cast("string")), "entity_type": F.lit("subject")}
    )
    early = O.keep_last(ev.where(F.col("ts") < X.instant("2024-01-15 00:00:00")), C.KEYS, ["ts", "event_id"]).select(*cols)
    late = O.keep_last(ev.where(F.col("ts") >= X.instant("2024-01-08 00:00:00")), C.KEYS, ["ts", "event_id"]).select(*cols)
    return early, late


@query
def change_feed(spark, sf):
    feed = C.change_feed(*_snapshots(spark, sf))
    return feed.select("entity_id", "entity_type", "change_type", F.col("old_image.demand_score").alias("old_demand"), F.col("new_image.demand_score").alias("new_demand"))


@query
def change_messages(spark, sf):
    return C.new_images(C.change_feed(*_snapshots(spark, sf)))


@query
def upsert_merge(spark, sf):
    ev = W.mkt_events(spark, sf).where("event_type = 'session_completed'")
    rows = ev.select(F.col("student_id").alias("entity_id"), F.lit("student").alias("entity_type"), "ts", "event_id", "rating", "subject")
    cut = X.instant("2024-01-16 00:00:00")
    state = O.keep_last(rows.where(F.col("ts") < cut), C.KEYS, ["ts", "event_id"])
    return C.upsert(state, rows.where(F.col("ts") >= cut), ["ts", "event_id"])


# --- training data and models ---------------------------------------------------------------------------------


@query
def stratified_split(spark, sf):
    t = L.row_features(W.telemetry(spark, sf)).select("insight_id", "risk_level")
    known, _ = M.labelled(t)
    return M.stratified_split(known, "risk_level", "insight_id")


@query
def stratified_split_lineitem(spark, sf):
    """Three strata over the largest table: the case where a plain ranking window would use three tasks."""
    li = W.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_key"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"
    )
    keyed = li.withColumn("row_key", F.col("row_key") * 20011 + F.col("l_partkey"))
    split = M.stratified_split(keyed, "l_returnflag", "row_key")
    return split.groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("sum_orderkey"))


@query
def hash_split(spark, sf):
    return M.hash_split(W.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query
def dataset_union(spark, sf):
    """Labelled and unlabelled rows, and the classes they fall into."""
    known, unknown = M.labelled(L.row_features(W.telemetry(spark, sf)))
    both = known.select("insight_id", "risk_level", "performance_score").unionByName(unknown.select("insight_id", "risk_level"), allowMissingColumns=True)
    return rounded(both.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("performance_score", F.lit(-1.0))).alias("avg_score")))


SCALED = ["value", "latency", "error_rate", "queue_depth"]


@query
def scaling_params(spark, sf):
    t = W.telemetry(spark, sf)
    train = M.hash_split(t, "insight_id").where("split = 'train'")
    return rounded(M.scaling_params(train, SCALED))


def _standardized(spark, sf, epsilon=None):
    t = M.hash_split(W.telemetry(spark, sf).select("insight_id", *SCALED), "insight_id")
    params = M.scaling_params(t.where("split = 'train'"), SCALED)
    return rounded(M.standardize(t, params, SCALED, epsilon), 5)


@query
def standardize(spark, sf):
    return _standardized(spark, sf)


@query
def standardize_epsilon(spark, sf):
    return _standardized(spark, sf, 1e-7)


def _quality(spark, sf):
    d = W.table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = W.table(spark, sf, "labels")
    return lab.join(d, "doc_id").select("doc_id", "quality", "toxic", "n_chars", (F.col("n_chars") > 400).cast("int").alias("predicted"))


@query
def confusion(spark, sf):
    return M.confusion(_quality(spark, sf), "quality", "predicted")


@query
def class_report(spark, sf):
    return rounded(M.class_report(M.confusion(_quality(spark, sf), "quality", "predicted")))


@query
def summary_report(spark, sf):
    return rounded(M.summary_report(M.class_report(M.confusion(_quality(spark, sf), "quality", "predicted"))))


@query
def regression_report(spark, sf):
    o = W.table(spark, sf, "orders").withColumn("guess", F.lit(250000.0))
    return rounded(M.regression_report(o, "o_totalprice", "guess"), 3)


@query
def dataset_profile(spark, sf):
    return rounded(M.dataset_profile(_scored(spark, sf), "segment", ["session_velocity", "health_score"], ["churn_risk_14d", "health_score"]))


@query
def feature_drift(spark, sf):
    t = W.telemetry(spark, sf)
    cut = X.instant("2024-01-16 00:00:00")
    return rounded(M.drift(t.where(F.col("ts") < cut), t.where(F.col("ts") >= cut), ["value", "latency", "error_rate"]), 9).select(
        "feature", "mean_expected", "mean_actual", "std_expected", "std_actual", "psi"
    )


@query
def encode_codes(spark, sf):
    c = W.table(spark, sf, "customer")
    tier = F.element_at(F.array(*[F.lit(x) for x in [*M.TIERS, "gold"]]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", tier.alias("tier"), M.encode_codes(tier, M.TIERS).alias("subscription_tier"))


@query
def subject_regressions(spark, sf):
    ev = W.mkt_events(spark, sf).where("event_type = 'supply_demand_update'")
    return rounded(M.subject_regressions(ev, "subject", "supply_score", "demand_score"), 4)


@query
def prediction_outcomes(spark, sf):
    """Early predictions against what happened later: a call in the last two weeks."""
    ev = W.mkt_events(spark, sf)
    mid = X.instant("2024-01-16 00:00:00")
    early = W.entity_predictions(E.student_metrics(ev.where(F.col("ts") < mid), mid)).select("entity_id", "churn_risk_14d")
    seen = ev.where((F.col("ts") >= mid) & (F.col("event_type") == "ib_call_logged")).groupBy(F.col("student_id").alias("entity_id")).agg(F.count(F.lit(1)).alias("outcome"))
    return rounded(S.with_outcomes(early, seen, ["entity_id"]))


def _risk_rows(spark, sf):
    t = L.row_features(W.telemetry(spark, sf))
    return M.hash_split(t.where("risk_level <> 'unknown'"), "insight_id")


MODEL_FEATURES = ["total_iops", "avg_latency", "bandwidth_mbps", "error_rate", "queue_depth", "io_size_avg", "iops_per_latency", "hour_of_day"]


@query
def risk_classifier_report(spark, sf):
    """Boosted trees, one model a class, on the train split, judged per class on the test split."""
    rows = _risk_rows(spark, sf)
    model = M.risk_classifier(MODEL_FEATURES, boosted=True, rounds=20).fit(rows.where("split = 'train'"))
    scored = model.transform(rows.where("split = 'test'"))
    return rounded(M.class_report(M.confusion(scored, "label", "prediction")), 4)


@query
def score_regressor_report(spark, sf):
    rows = _risk_rows(spark, sf)
    model = M.score_regressor(MODEL_FEATURES, "performance_score", rounds=10).fit(rows.where("split = 'train'"))
    return rounded(M.regression_report(model.transform(rows.where("split = 'test'")), "performance_score", "prediction"), 4)


@query
def feature_importance(spark, sf):
    rows = _risk_rows(spark, sf)
    model = M.risk_classifier(MODEL_FEATURES, rounds=10).fit(rows.where("split = 'train'"))
    return rounded(M.feature_importance(model, MODEL_FEATURES, spark), 6)


TRAIN_AT = ["2024-01-08 00:00:00", "2024-01-11 00:00:00", "2024-01-14 00:00:00"]  # their labels end on 21 January
TEST_AT = "2024-01-22 00:00:00"


@query
def horizon_examples(spark, sf):
    """Features before, and labels of the seven days after, each of four as-of times."""
    return rounded(M.horizon_examples(W.mkt_events(spark, sf), [X.instant(t) for t in [*TRAIN_AT, TEST_AT]]))


@query
def five_target_holdout(spark, sf):
    """The five models, fitted on what followed earlier as-of times and judged on what followed a later one."""
    ev = W.mkt_events(spark, sf)
    train = M.horizon_examples(ev, [X.instant(t) for t in TRAIN_AT])
    return rounded(M.holdout_report(train, M.horizon_examples(ev, [X.instant(TEST_AT)])), 4)


@query
def five_target_scoring(spark, sf):
    """Every student scored now by five models that were fitted on what followed earlier as-of times, with segments."""
    ev = W.mkt_events(spark, sf)
    train = M.horizon_examples(ev, [X.instant(t) for t in [*TRAIN_AT, TEST_AT]])
    models = M.train_five_targets(train, M.EXAMPLE_FEATURES, {t: f"y_{t}" for t in M.OUTCOMES})
    now = M.horizon_examples(ev, [NOW()]).select(F.col("student_id").alias("entity_id"), F.lit("student").alias("entity_type"), *M.EXAMPLE_FEATURES)
    scored = S.with_segment(M.score_five_targets(now, M.EXAMPLE_FEATURES, models))
    return rounded(scored.select("entity_id", *S.PREDICTION_DEFAULTS, "segment"), 4)


@query
def model_accuracy_drops(spark, sf):
    """Stored reports of four model versions, whose thresholds age, and the alerts on losses of more than 2 %."""
    base = scratch_dir(spark, "reports")
    t = W.telemetry(spark, sf).where(F.col("risk_level").isNotNull())
    v = F.col("value")
    for k, shift in enumerate((0, 1, 12, 5)):
        guess = F.when(v >= 150 + shift, "critical").when(v >= 80 + shift, "high").when(v >= 30 + shift, "medium").otherwise("low")
        M.save_report(M.summary_report(M.class_report(M.confusion(t.withColumn("guess", guess), "risk_level", "guess"))), base, f"risk-v{k + 1}")
    return rounded(M.accuracy_drops(M.read_reports(spark, base)))


# --- streams --------------------------------------------------------------------------------------------------


def _stream(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return W.events_stream(spark, sf)


def _appended(spark, stream: DataFrame, name: str) -> DataFrame:
    """Runs an append stream to its end into a table of the shared folder and reads that."""
    base = scratch_dir(spark, name)
    writer = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    SW.run_once(writer)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _upserted(spark, stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    base = scratch_dir(spark, name)
    SW.run_once(SW.keep_newest(stream, f"{base}/out", f"{base}/checkpoint", keys))
    return read_state(spark, f"{base}/out", keys, keys).drop("_batch", "b")


@query
def stream_entity_fold(spark, sf):
    """The stateful fold: final state of every entity, and how often each alert fired on the way."""
    base = scratch_dir(spark, "entity-fold")
    SW.run_once(SS.fold_entities(W.mkt_of(_stream(spark, sf)), base, f"{base}/checkpoint"))
    folded = SS.read_folded(spark, base)
    fired = lambda kind: F.coalesce(F.size(F.filter("alerts", lambda a: a.startswith(kind))), F.lit(0))
    counts = folded.groupBy("entity_id", "entity_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(fired("high_ib")).alias("call_alerts"), F.sum(fired("low_health")).alias("health_alerts"),
        F.max_by(F.struct("sessions_7d", "sessions_14d", "sessions_30d", "ib_calls_7d", "ib_calls_14d", "avg_rating", "health_score"),
                 F.struct("ts", "event_id")).alias("s"),
    )
    return rounded(counts.select("entity_id", "entity_type", "events", "call_alerts", "health_alerts", "s.*"))


def _recent(spark, sf, cause: str | None) -> DataFrame:
    """The newest row of each student; ``cause``: of those that events or timers made only."""
    base = scratch_dir(spark, "recent")
    stream = SS.recent_windows(W.mkt_of(_stream(spark, sf)))
    stream = stream.where(F.col("cause") == cause) if cause else stream
    SW.run_once(SW.keep_newest(stream, f"{base}/out", f"{base}/checkpoint", ["entity_id"], ["day", "cause"]))
    return read_state(spark, f"{base}/out", ["day", "cause"], ["entity_id"]).drop("_batch")


@query
def stream_recent_windows(spark, sf):
    """Window counts per student as of the student's own last event, from daily state that is pruned after 30 days."""
    return _recent(spark, sf, "event").drop("cause")


@query
def stream_idle_windows(spark, sf):
    """Window counts per student as of the stream's time: timers take out what has left a window since the last event."""
    return _recent(spark, sf, None).drop("cause", "day")


@query
def stream_ingest(spark, sf):
    """Raw records through the micro-batch ingest; the state it leaves behind."""
    base = scratch_dir(spark, "ingest")
    records = W.raw_of(W.mkt_of(_stream(spark, sf)))
    SI.start_ingest(records, base, f"{base}/checkpoint", received_at=NOW(), once=True).awaitTermination()
    return read_state(spark, f"{base}/state", ["ts", "event_id"]).select("entity_id", "entity_type", "ts", "event_id", "event_type", "ttl")


@query
def stream_tutor_state(spark, sf):
    """Tutor rows that the micro-batch ingest leaves behind, added up over its batches."""
    base = scratch_dir(spark, "tutors")
    records = W.raw_of(W.mkt_of(_stream(spark, sf)))
    SI.start_ingest(records, base, f"{base}/checkpoint", received_at=NOW(), once=True).awaitTermination()
    return read_tutors(spark, f"{base}/tutors").select(*TUTOR_STATE)


@query
def stream_quarantine(spark, sf):
    """What the ingest put aside, by its worst severity."""
    base = scratch_dir(spark, "quarantine")
    records = W.raw_of(W.mkt_of(_stream(spark, sf)))
    SI.start_ingest(records, base, f"{base}/checkpoint", received_at=NOW(), once=True).awaitTermination()
    rejected = spark.read.parquet(f"{base}/quarantine").withColumn("is_valid", F.lit(False))
    return V.malformed_summary(rejected).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_malformed_rate(spark, sf):
    checked = V.validate_events(V.decode_records(W.raw_of(W.mkt_of(_stream(spark, sf)))))
    return rounded(_upserted(spark, SW.malformed_windows(checked), "malformed", ["period"]))


@query
def stream_alarm_windows(spark, sf):
    points = _stream(spark, sf).select(F.col("event_type").alias("metric"), F.col("ts").alias("timestamp"), "value")
    return rounded(_upserted(spark, SW.alarm_windows(points), "alarms", ["metric", "period"]))


@query
def stream_daily_counts(spark, sf):
    return _upserted(spark, SW.daily_counts(W.mkt_of(_stream(spark, sf))), "daily", ["student_id", "day"])


ARRIVALS = 10  # micro-batches the events arrive in


def _arrivals(spark, sf) -> DataFrame:
    """The events as a stream of ARRIVALS batches of three days by arrival; every 29th event arrives 36 hours late."""
    base = scratch_dir(spark, "arrivals")
    events = W.table(spark, sf, "events")
    late = F.when(F.col("event_id") % 29 == 0, 36 * 3600).otherwise(0)
    day = F.floor((F.unix_timestamp("ts") + late - F.unix_timestamp(X.instant("2024-01-01 00:00:00"))) / (3 * 86400))
    for k in range(ARRIVALS):  # one folder after the other, so their files are read in this order
        events.where(F.least(F.greatest(day, F.lit(0)), F.lit(ARRIVALS - 1)) == k).coalesce(1).write.parquet(f"{base}/{k}")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(base)


def _split(spark, sf) -> str:
    base = scratch_dir(spark, "late")
    SW.run_once(SLT.split_late(_arrivals(spark, sf), base, f"{base}/checkpoint", counts={"errors": F.col("event_type") == "error"}))
    return base


@query
def stream_late_rows(spark, sf):
    """Rows that came after their window had ended: kept in the archive, with the watermark they were behind."""
    return SLT.read_late(spark, _split(spark, sf)).select("event_id", "ts", "event_type", "period", "watermark", "batch")


@query
def stream_windows_on_time(spark, sf):
    """Hourly counts without late rows, beside what the archive holds of each hour."""
    base = _split(spark, sf)
    archived = SLT.read_archived(spark, base).groupBy("period").agg(F.count(F.lit(1)).alias("archived"), F.count_if("late").alias("late"))
    return archived.join(SLT.read_windows(spark, base), "period", "left").fillna(0, ["total", "errors"])


@query
def activity_sessions(spark, sf):
    """Sessions of every user: events that follow each other within 12 hours."""
    ev = W.table(spark, sf, "events")
    bought = {"purchases": F.when(F.col("event_type") == "purchase", 1).otherwise(0), "spent": F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)}
    return rounded(SN.sessions(ev, ["user_id"], "ts", ["event_id"], 12 * 3_600_000_000, bought))


@query
def stream_sessions(spark, sf):
    """The same on the stream of events: the sessions that had ended by its watermark."""
    bought = {"purchases": F.when(F.col("event_type") == "purchase", 1).otherwise(0), "spent": F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)}
    return rounded(_appended(spark, SW.session_windows(_stream(spark, sf), ["user_id"], "ts", "12 hours", bought), "sessions"))


@query
def stream_alerts_cooldown(spark, sf):
    return _appended(spark, SS.cooldown_alerts(_event_alerts(spark, sf, _stream(spark, sf))), "cooldown")


from tidewatch.plans import roundtrips  # noqa: E402, F401  registers its queries, which use the views above
