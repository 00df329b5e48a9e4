"""Declarative feature vectors of 46 columns for students and tutors.

A feature is (name, default) when it is read from a metric of that name, or (name, None) when it is derived below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUDENT_FEATURES = [
    # fixed values: vector order, metric default (None = derived)
    ("sessions_7d", 0), ("sessions_14d", 0), ("sessions_30d", 0),
    ("session_freq_7d", None), ("session_freq_14d", None), ("session_freq_30d", None),
    ("days_since_last_session", 30), ("avg_gap_between_sessions", None),
    ("session_trend_7d_14d", None), ("session_trend_14d_30d", None), ("session_acceleration", None),
    ("sessions_weekend_ratio", 0.3), ("sessions_evening_ratio", 0.5),
    ("avg_rating", 0), ("rating_trend", 0), ("rating_volatility", 0), ("avg_session_duration_min", 60),
    ("total_session_hours_30d", 0), ("engagement_score", 50), ("questions_asked_30d", 0), ("materials_accessed_30d", 0),
    ("payment_success_rate_30d", 1.0), ("payment_failures_30d", 0), ("avg_transaction_value", 50),
    ("total_revenue_30d", 0), ("payment_method_count", 1), ("days_since_last_payment", 7),
    ("ib_calls_7d", 0), ("ib_calls_14d", 0), ("ib_call_rate", None), ("cancellation_rate_7d", 0),
    ("cancellation_rate_30d", 0), ("no_show_rate_30d", 0), ("late_cancellations_30d", 0),
    ("avg_response_time_hours", 24), ("support_tickets_30d", 0), ("complaints_30d", 0),
    ("tutor_consistency_score", 0.5), ("unique_tutors_30d", 1), ("preferred_tutor_ratio", 0.7),
    ("tutor_rating_avg", 4.0), ("tutor_availability_score", 0.8), ("tutor_subject_expertise_score", 0.7),
    ("tutor_match_score", 0.75), ("tutor_changed_count_30d", 0), ("preferred_tutor_sessions_ratio", 0.8),
]

TUTOR_FEATURES = [
    # fixed values: vector order, metric default (None = derived)
    ("sessions_taught_7d", 0), ("sessions_taught_14d", 0), ("sessions_taught_30d", 0),
    ("sessions_completed_7d", 0), ("sessions_completed_14d", 0), ("sessions_completed_30d", 0),
    ("avg_session_duration_min", 60), ("session_completion_rate", 0.95), ("no_show_rate", 0), ("cancellation_rate", 0),
    ("days_since_last_session", 7), ("session_frequency_7d", None), ("session_frequency_14d", None),
    ("avg_rating", 4.5), ("rating_trend", 0), ("rating_volatility", 0), ("positive_reviews_count_30d", 0),
    ("negative_reviews_count_30d", 0), ("student_retention_rate", 0.7), ("unique_students_30d", 10),
    ("avg_student_lifetime_sessions", 5),
    ("available_hours_this_week", 20), ("available_hours_next_week", 20), ("utilization_rate", 0.6),
    ("instant_book_enabled", 1), ("avg_response_time_hours", 2), ("booking_lead_time_avg_hours", 48),
    ("primary_subject_count", 1), ("subject_diversity_score", 0.5), ("avg_rating_by_subject", 4.5),
    ("sessions_per_subject_30d", 10), ("subject_match_accuracy", 0.8), ("certification_count", 2),
    ("years_of_experience", 3), ("specialization_score", 0.7), ("advanced_topics_count", 1),
    ("student_grade_improvement_avg", 10),
    ("total_earnings_30d", 1000), ("avg_earnings_per_session", 50), ("earnings_trend", 0),
    ("premium_tier_sessions_ratio", 0.3), ("discount_sessions_ratio", 0.1), ("payment_disputes_count_30d", 0),
    ("refund_rate_30d", 0), ("pricing_competitiveness_score", 0.75), ("revenue_per_available_hour", 25),
]

FEATURE_SPECS = {"student": STUDENT_FEATURES, "tutor": TUTOR_FEATURES}


def _recent_trend(recent: Column, longer: Column) -> Column:
    """What the recent window has over the rest of the longer one, when the longer one has more at all."""
    return F.when(longer > recent, recent - (longer - recent)).otherwise(F.lit(0.0))


def _derived(entity_type: str, read) -> dict[str, Column]:
    if entity_type == "tutor":
        return {
            "session_frequency_7d": read("sessions_taught_7d") / 7,
            "session_frequency_14d": read("sessions_taught_14d") / 14,
        }
    s7, s14, s30 = read("sessions_7d"), read("sessions_14d"), read("sessions_30d")
    near, far = _recent_trend(s7, s14), _recent_trend(s14, s30)
    return {
        "session_freq_7d": s7 / 7, "session_freq_14d": s14 / 14, "session_freq_30d": s30 / 30,
        "avg_gap_between_sessions": F.when(s30 > 0, F.try_divide(F.lit(30.0), s30)).otherwise(30.0),
        "session_trend_7d_14d": near, "session_trend_14d_30d": far, "session_acceleration": near - far,
        "ib_call_rate": read("ib_calls_14d") / 14,
    }


def feature_columns(metrics: DataFrame, entity_type: str) -> list[Column]:
    """The 46 columns; a metric the table does not have, or has as null, takes its default."""
    spec = FEATURE_SPECS[entity_type]
    defaults = {name: float(d) for name, d in spec if d is not None}

    def read(name: str) -> Column:
        default = F.lit(defaults[name])
        return F.coalesce(F.col(name).cast("double"), default) if name in metrics.columns else default

    derived = _derived(entity_type, read)
    return [(derived[name] if default is None else read(name)).alias(name) for name, default in spec]


def feature_table(metrics: DataFrame, entity_type: str) -> DataFrame:
    """Keys and the feature vector as named columns, in one projection."""
    return metrics.select("entity_id", F.lit(entity_type).alias("entity_type"), *feature_columns(metrics, entity_type))
