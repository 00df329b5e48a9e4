"""Per-entity metrics: windowed counters, running folds, tutor aggregates, recency, lifetime, supply and demand.

Window metrics are conditional aggregates in one ``groupBy``: partial sums are built before the shuffle, so a hot
entity costs one row per input task.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import age_days, any_of, ratio, truthy_or
from tidewatch.operators.ordered import asof_backward, keep_last, slice_window, sliced, with_row_halo, without_halo
from tidewatch.operators.running import Affine, Step, state_after

WINDOWS = (7, 14, 30)
SESSION = ("session_started", "session_completed")


def _within(age: Column, days: int) -> Column:
    return (age >= 0) & (age < days)


def _count(cond: Column) -> Column:
    return F.count_if(cond)


def _of(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def entity_counters(events: DataFrame, as_of: Column, mode: str = "window") -> DataFrame:
    """Session and call counts for students and tutors.

    ``window``: event-time windows, started and completed sessions apart. ``counter``: every started or completed
    event adds one and nothing ever leaves the count.
    """
    relevant = events.where(_of(*SESSION, "ib_call_logged"))
    owners = F.array(
        F.struct(F.col("student_id").cast("string").alias("entity_id"), F.lit("student").alias("entity_type")),
        F.struct(F.when(_of(*SESSION), F.col("tutor_id")).cast("string").alias("entity_id"), F.lit("tutor").alias("entity_type")),
    )
    rows = relevant.select("event_type", "ts", F.explode(owners).alias("_o")).where("_o.entity_id IS NOT NULL")
    age = age_days("ts", as_of)
    call = _of("ib_call_logged")
    if mode == "counter":
        aggs = [_count(_of(*SESSION)).alias(f"sessions_{d}d") for d in WINDOWS]
        aggs += [_count(call).alias(f"ib_calls_{d}d") for d in (7, 14)]
    else:
        aggs = [_count(_of("session_started") & _within(age, d)).alias(f"started_{d}d") for d in WINDOWS]
        aggs += [_count(_of("session_completed") & _within(age, d)).alias(f"completed_{d}d") for d in WINDOWS]
        aggs += [_count(call & _within(age, d)).alias(f"ib_calls_{d}d") for d in (7, 14)]
    return rows.groupBy("_o.entity_id", "_o.entity_type").agg(*aggs)


def running_rating(events: DataFrame, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """The running rating ``avg = (avg * (n - 1) + r) / n`` per tutor, n counting started and completed sessions.

    Each rated event is the affine step avg -> a * avg + b with a = (n - 1) / n, b = r / n. Steps compose, so every
    time slice of a tutor folds on its own and the slices are chained afterwards.
    """
    sessions = events.where(_of(*SESSION) & F.col("tutor_id").isNotNull()).select(
        "tutor_id", "ts", "event_id", F.when(_of("session_completed"), F.col("rating")).cast("double").alias("r")
    )
    rows = sliced(sessions, ["tutor_id"], "ts", min_rows, slice_rows)
    in_slice = Window.partitionBy("tutor_id", "_slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("tutor_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.where("_hot").groupBy("tutor_id", "_slice").agg(F.count(F.lit(1)).alias("_c"))
        .select("tutor_id", "_slice", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    )
    n = F.coalesce(F.col("_before"), F.lit(0)) + F.col("_pos")
    log_a = F.when(F.col("r").isNotNull() & (F.col("n") > 1), F.ln((F.col("n") - 1) / F.col("n"))).otherwise(F.lit(0.0))
    folded = (
        rows.withColumn("_pos", F.count(F.lit(1)).over(in_slice))
        .join(before, ["tutor_id", "_slice"], "left")
        .withColumn("n", n)
        .withColumn("_log_a", log_a)
        .withColumn("_run", F.sum("_log_a").over(in_slice))
        .groupBy("tutor_id", "_slice")
        .agg(
            F.max("n").alias("n"),
            F.exp(F.sum("_log_a")).alias("a"),
            (F.exp(F.sum("_log_a")) * F.coalesce(F.sum(F.col("r") / F.col("n") * F.exp(-F.col("_run"))), F.lit(0.0))).alias("b"),
        )
    )
    steps = F.array_sort(F.collect_list(F.struct("_slice", "a", "b")))
    return folded.groupBy("tutor_id").agg(
        F.max("n").alias("sessions"),
        F.aggregate(steps, F.lit(0.0), lambda avg, s: avg * s.a + s.b).alias("running_rating"),
    )


def mean_rating(events: DataFrame) -> DataFrame:
    """The plain mean of real ratings (0 means unrated)."""
    rated = events.where(_of("session_completed")).select("tutor_id", F.nullif("rating", F.lit(0)).alias("r"))
    return rated.groupBy("tutor_id").agg(F.avg("r").alias("mean_rating"), F.count("r").alias("n_rated"))


# Fields a health snapshot sets: metric -> (payload field, event types that count on after it).
SNAPSHOT_FIELDS = {
    "sessions_7d": ("sessions_last_7_days", SESSION),
    "sessions_30d": ("sessions_last_30_days", SESSION),
    "ib_calls_14d": ("ib_calls_last_14_days", ("ib_call_logged",)),
}


def health_overlay(events: DataFrame, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Student counters where a health update overwrites some of them and later events count on from there.

    Within a time slice: the newest snapshot of each field and the events after it. Slices of a student are then
    folded in order; there are few, whatever the number of events.
    """
    rows = sliced(
        events.where(_of(*SESSION, "ib_call_logged", "customer_health_update") & F.col("student_id").isNotNull()),
        ["student_id"], "ts", min_rows, slice_rows,
    )
    snapshot = _of("customer_health_update") & F.col("health_score").isNotNull()
    at = F.struct("ts", "event_id")
    here = Window.partitionBy("student_id", "_slice")
    per_slice = []
    for metric, (field, types) in SNAPSHOT_FIELDS.items():
        value = F.when(snapshot & F.col(field).isNotNull(), F.struct("ts", "event_id", F.col(field).alias("v")))
        rows = rows.withColumn(f"_{metric}", F.max(value).over(here))
        snap = F.col(f"_{metric}")
        after = snap.isNull() | (at > F.struct(snap.ts.alias("ts"), snap.event_id.alias("event_id")))
        per_slice += [F.max(f"_{metric}.v").alias(f"{metric}_set"), _count(_of(*types) & after).alias(f"{metric}_n")]
    health = F.when(snapshot, F.struct("ts", "event_id", F.col("health_score").alias("v")))
    slices = rows.groupBy("student_id", "_slice").agg(
        *per_slice,
        _count(_of(*SESSION)).alias("sessions_14d"), _count(_of("ib_call_logged")).alias("ib_calls_7d"),
        F.max(health).alias("_health"),
    )

    def fold(metric: str) -> Column:
        steps = F.array_sort(F.collect_list(F.struct("_slice", F.col(f"{metric}_set").alias("set"), F.col(f"{metric}_n").alias("n"))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: F.coalesce(s.set, acc) + s.n).alias(metric)

    return slices.groupBy("student_id").agg(
        fold("sessions_7d"), F.sum("sessions_14d").alias("sessions_14d"), fold("sessions_30d"),
        F.sum("ib_calls_7d").alias("ib_calls_7d"), fold("ib_calls_14d"),
        F.coalesce(F.max("_health").v, F.lit(100.0)).alias("health_score"),
    )


# what a health update may overwrite, as the payload names it
SNAPSHOTS = ("sessions_last_7_days", "sessions_last_30_days", "ib_calls_last_14_days")
STATE = ("sessions_7d", "sessions_14d", "sessions_30d", "ib_calls_7d", "ib_calls_14d", "avg_rating", "health_score")
EARLIEST = -62_000_000_000_000_000  # microseconds: before any event
CARRIED = "_state"  # the type of the row that brings an entity's earlier state


def entity_steps(health: Column) -> dict[str, Step]:
    """What an event does to its entity's counters and health; rows have entity_type, event_type and SNAPSHOTS."""
    student = F.col("entity_type") == "student"
    session = F.when(_of(*SESSION), 1).otherwise(0).cast("long")
    call = F.when(student & _of("ib_call_logged"), 1).otherwise(0).cast("long")
    snapshot = student & _of("customer_health_update") & health.isNotNull()
    of = lambda name: F.when(snapshot, F.col(name).cast("long"))
    kept = F.lit(None).cast("long")
    return {
        "sessions_7d": Step(session, of(SNAPSHOTS[0])), "sessions_14d": Step(session, kept), "sessions_30d": Step(session, of(SNAPSHOTS[1])),
        "ib_calls_7d": Step(call, kept), "ib_calls_14d": Step(call, of(SNAPSHOTS[2])), "health_score": Step(F.lit(0.0), F.when(snapshot, health), 100.0),
    }


def entity_events(events: DataFrame) -> DataFrame:
    """Each event once per entity whose state it changes."""
    session = _of(*SESSION)
    owners = F.array(
        F.struct(F.col("student_id").cast("string").alias("entity_id"), F.lit("student").alias("entity_type")),
        F.struct(F.when(session, F.col("tutor_id")).cast("string").alias("entity_id"), F.lit("tutor").alias("entity_type")),
    )
    wanted = events.where(session | _of("ib_call_logged", "customer_health_update"))
    numbers = [F.col(c).cast("double").alias(c) for c in ("rating", "health_score", *SNAPSHOTS)]
    return wanted.withColumn("_o", F.explode(owners)).where("_o.entity_id IS NOT NULL").select(
        "_o.entity_id", "_o.entity_type", "event_id", "ts", "event_type", *numbers
    )


def states_after(rows: DataFrame, before: DataFrame | None = None, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """The state of its entity after each of ``rows`` (see ``entity_events``), counters, running rating and health.

    ``before``: entity_id, entity_type and STATE of entities that have a state already; it enters as a first row that
    overwrites everything, so a hot entity's rows are spread like those of any other key."""
    keys = ["entity_id", "entity_type"]
    known = rows.withColumns({f"_was_{m}": F.lit(None).cast("double" if m in ("avg_rating", "health_score") else "long") for m in STATE})
    if before is not None:
        known = known.unionByName(before.select(
            *keys, F.timestamp_micros(F.lit(EARLIEST)).alias("ts"), F.lit(CARRIED).alias("event_type"), *[F.col(m).alias(f"_was_{m}") for m in STATE]), allowMissingColumns=True)
    known = known.withColumnRenamed("health_score", "_health")
    steps = {m: Step(s.add, F.coalesce(f"_was_{m}", s.put), s.start) for m, s in entity_steps(F.col("_health")).items()}
    rated = F.when((F.col("entity_type") == "tutor") & _of("session_completed"), F.col("rating"))
    rating = {"avg_rating": Affine(F.col("sessions_30d"), rated, F.col("_was_avg_rating"))}
    after = state_after(known, keys, "ts", ["event_id"], steps, rating, min_rows, slice_rows, counted=rows)
    return after.where(F.col("event_type") != CARRIED).select(*keys, "event_id", "ts", *STATE)


def latest_supply_demand(events: DataFrame) -> DataFrame:
    """The newest supply and demand row per subject, with its balance by ratio."""
    latest = keep_last(events.where(_of("supply_demand_update") & F.col("subject").isNotNull()), ["subject"], ["ts", "event_id"])
    return latest.select(
        "subject", "region",
        F.coalesce("available_tutors", F.lit(0)).alias("available_tutors"),
        F.coalesce("active_students", F.lit(0)).alias("active_students"),
        F.coalesce("demand_score", F.lit(0.0)).alias("demand_score"),
        F.coalesce("supply_score", F.lit(0.0)).alias("supply_score"),
        F.coalesce("balance_status", F.lit("unknown")).alias("balance_status"),
        balance(F.col("demand_score"), F.col("supply_score")).alias("balance_by_ratio"),
        F.col("ts").alias("last_updated"),
    )


def balance(demand: Column, supply: Column, factor: float = 1.5) -> Column:
    return (
        F.when(demand > supply * factor, "high_demand").when(supply > demand * factor, "high_supply").otherwise("balanced")
    )


def tutor_sessions(events: DataFrame) -> DataFrame:
    """Completed-session totals per tutor; a rating of 0 means unrated."""
    rated = F.nullif(F.col("rating"), F.lit(0))
    done = events.where(_of("session_completed") & F.col("tutor_id").isNotNull()).withColumn("r", rated)
    newest = F.struct("ts", "event_id")
    return done.groupBy("tutor_id").agg(
        F.count(F.lit(1)).alias("sessions_completed_count"),
        F.sum(F.coalesce("duration_min", F.lit(0)).cast("long")).alias("session_duration_total_min"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("session_rating_sum"),
        F.count("r").alias("session_rating_count"),
        _count(F.col("was_cancelled")).alias("cancellation_count"),
        _count(F.col("no_show")).alias("no_show_count"),
        F.max_by("subject", newest).alias("primary_subject"),
        F.array_sort(F.collect_set("subject")).alias("subjects_taught"),
        F.max("ts").alias("last_session_timestamp"),
        F.max_by("r", newest).alias("last_session_rating"),
    )


def tutor_features(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Completion, students, retention, reviews, subjects, utilization per tutor over a window.

    Students and subjects are counted in two levels, so no task holds a tutor's whole student list.
    """
    inside = events.where(_within(age_days("ts", as_of), days) & F.col("tutor_id").isNotNull())
    sessions = inside.where(_of(*SESSION))
    r = F.nullif(F.col("rating"), F.lit(0))
    done = _of("session_completed")
    by_student = sessions.groupBy("tutor_id", "student_id").agg(
        _count(_of("session_started")).alias("started"),
        _count(done).alias("completed"),
        _count(done & (r < 3)).alias("negative"),
        _count(done & (r >= 4)).alias("positive"),
        F.sum(F.when(done, F.col("duration_min"))).cast("long").alias("minutes"),
        _count(done & F.col("was_cancelled")).alias("cancelled"), _count(done & F.col("no_show")).alias("no_shows"),
        F.count(F.when(done, r)).alias("rated"), F.sum(F.when(done, r)).cast("long").alias("rating_sum"),
        F.sum(F.when(done, r * r)).cast("long").alias("rating_squares"),
        F.min(F.when(done, age_days("ts", as_of))).alias("age"),
    )
    per_tutor = by_student.groupBy("tutor_id").agg(
        F.sum("started").alias("sessions_started"), F.sum("completed").alias("sessions_completed"),
        F.sum("negative").alias("negative_reviews"), F.sum("positive").alias("positive_reviews"),
        F.coalesce(F.sum("minutes"), F.lit(0)).alias("booked_minutes"),
        _count(F.col("completed") > 0).alias("unique_students"),
        _count(F.col("completed") > 1).alias("returning_students"),
        F.sum("cancelled").alias("cancelled"), F.sum("no_shows").alias("no_shows"), F.sum("rated").alias("rated"),
        F.sum("rating_sum").alias("rating_sum"), F.sum("rating_squares").alias("rating_squares"), F.min("age").alias("age"),
    )
    spread = F.col("rating_squares") - F.col("rating_sum") * F.col("rating_sum") / F.col("rated")
    subjects = (
        sessions.where(done).groupBy("tutor_id", "subject").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("tutor_id").agg(F.count(F.lit(1)).alias("subjects"), F.max("c").alias("top_subject_sessions"))
    )
    hours = keep_last(inside.where(_of("tutor_availability_updated")), ["tutor_id"], ["ts", "event_id"]).select(
        "tutor_id", F.col("available_slots_this_week").alias("available_hours"), "instant_book_enabled"
    )
    return (
        per_tutor.join(subjects, "tutor_id", "left").join(hours, "tutor_id", "left")
        .select(
            "tutor_id", "sessions_started", "sessions_completed", "unique_students", "returning_students",
            "negative_reviews", "positive_reviews", "booked_minutes",
            F.coalesce("subjects", F.lit(0)).alias("subjects"),
            ratio(F.col("sessions_completed"), F.col("sessions_started")).alias("completion_rate"),
            ratio(F.col("returning_students"), F.col("unique_students")).alias("retention_rate"),
            ratio(F.col("sessions_completed"), F.col("subjects")).alias("sessions_per_subject"),
            ratio(F.col("top_subject_sessions"), F.col("sessions_completed")).alias("specialization"),
            ratio(F.col("booked_minutes") / 60, F.col("available_hours")).alias("utilization_rate"),
            ratio(F.col("cancelled"), F.col("sessions_completed")).alias("cancellation_rate"),
            ratio(F.col("no_shows"), F.col("sessions_completed")).alias("no_show_rate"),
            ratio(F.col("booked_minutes"), F.col("sessions_completed")).alias("avg_session_duration_min"),
            F.when(F.col("rated") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col("rated") - 1))).alias("rating_volatility"),
            ratio(F.col("sessions_completed"), F.col("unique_students")).alias("avg_student_sessions"),
            F.coalesce("age", F.lit(999)).cast("int").alias("days_since_last_session"), "available_hours", "instant_book_enabled",
        )
    )


def windowed_features(events: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Session, rating and call features per student and window, with recency; one shuffle for all windows."""
    done, call = _of("session_completed"), _of("ib_call_logged")
    age = F.col("_age")
    rows = events.where((done | call) & F.col("student_id").isNotNull()).withColumn("_age", age_days("ts", as_of)).where("_age >= 0")
    aggs = []
    for d in windows:
        s = done & (age < d)
        rated = F.when(s, F.nullif(F.col("rating"), F.lit(0)))
        aggs += [
            _count(s).alias(f"session_count_{d}d"),
            (_count(s) / F.lit(float(d))).alias(f"session_frequency_{d}d"),
            F.coalesce(F.avg(rated), F.lit(0.0)).alias(f"avg_rating_{d}d"),
            _count(call & (age < d)).alias(f"ib_call_count_{d}d"),
            _count(call & (age < d) & (F.col("sentiment") < -0.3)).alias(f"negative_calls_{d}d"),
        ]
    aggs.append(F.coalesce(F.min(F.when(done, age)), F.lit(999)).cast("int").alias("days_since_last_session"))
    aggs.append(F.coalesce(F.min(F.when(call, age)), F.lit(999)).cast("int").alias("days_since_last_ib_call"))
    return rows.groupBy("student_id").agg(*aggs)


def window_catalogue(activity: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """The full window catalogue per customer.

    Distinct active days are bits of longs, 63 days to each, so they aggregate like sums for windows of any length.
    """
    day_no = F.datediff(F.to_date(as_of), F.to_date("ts"))
    rows = activity.withColumns({"_age": age_days("ts", as_of), "_day": day_no}).where("_age >= 0")
    kind, age = F.col("activity"), F.col("_age")
    session, call, pay = kind == "session", kind == "ib_call", kind == "payment"
    aggs = []
    for d in windows:
        w = age < d
        of = lambda c: _count(w & c)  # noqa: B023,E731
        done = session & (F.col("status") == "completed")
        day_bit = F.expr("shiftleft(1L, CAST(_day % 63 AS INT))")
        days = [F.bit_count(F.bit_or(F.when(w & (F.floor(F.col("_day") / 63) == k), day_bit))) for k in range(d // 63 + 1)]  # noqa: B023
        aggs += [
            ratio(of(done), of(session)).alias(f"session_completion_rate_{d}d"),
            ratio(of(session & (F.col("status") == "cancelled")), of(session)).alias(f"cancellation_rate_{d}d"),
            ratio(of(session & (F.col("status") == "no_show")), of(session)).alias(f"no_show_rate_{d}d"),
            F.avg(F.when(w & session, F.col("duration_min"))).alias(f"avg_session_duration_{d}d"),
            F.avg(F.when(w & call, F.col("call_seconds"))).alias(f"avg_call_duration_{d}d"),
            of(call & F.col("escalated")).alias(f"escalation_count_{d}d"),
            of(kind == "login").alias(f"login_count_{d}d"),
            of(kind == "message").alias(f"message_count_{d}d"),
            reduce(add, [F.coalesce(x, F.lit(0)) for x in days]).alias(f"days_active_{d}d"),
            ratio(of(pay & F.col("paid")), of(pay)).alias(f"payment_success_rate_{d}d"),
            F.coalesce(F.sum(F.when(w & pay & F.col("paid"), F.col("amount"))), F.lit(0.0)).alias(f"payment_amount_{d}d"),
        ]
    return rows.groupBy("customer_id").agg(*aggs)


def recency(activity: DataFrame, as_of: Column) -> DataFrame:
    """Whole days since the last activity of each kind; 999 when there is none."""
    age, kind = age_days("ts", as_of), F.col("activity")
    past = activity.where(F.unix_micros("ts") <= F.unix_micros(as_of))
    names = {"session": "session", "login": "login", "payment": "payment", "ib_call": "ib_call"}
    return past.groupBy("customer_id").agg(
        *[F.coalesce(F.min(F.when(kind == k, age)), F.lit(999)).cast("int").alias(f"days_since_last_{n}") for k, n in names.items()],
        F.max(age).cast("int").alias("days_since_signup"),
    )


def lifetime(activity: DataFrame, as_of: Column) -> DataFrame:
    """Totals, tenure, success of the first rated session, mean rating over the whole history."""
    kind = F.col("activity")
    rating = F.nullif(F.col("rating"), F.lit(0.0))
    order = F.struct("ts", "event_id")
    return activity.groupBy("customer_id").agg(
        _count(kind == "session").alias("total_sessions_lifetime"),
        F.coalesce(F.sum(F.when(F.col("paid"), F.col("amount"))), F.lit(0.0)).alias("total_spend_lifetime"),
        F.max(age_days("ts", as_of)).cast("int").alias("customer_tenure_days"),
        F.coalesce(F.min_by(rating, F.when(rating.isNotNull(), order)) > 4.0, F.lit(False)).alias("first_session_was_success"),
        F.avg(rating).alias("avg_lifetime_rating"),
    )


def tutor_earnings(events: DataFrame, rates: DataFrame, as_of: Column, days: int = 30, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """What tutors earned in the window: a session pays the hourly rate in force when it was completed. Cancelled and missed
    sessions pay nothing; so do sessions before a tutor's first rate, which are counted as ``unrated_sessions``.

    ``rates``: tutor_id, ts (from when), event_id, hourly_rate. The trend compares the later half of the window with the
    earlier one: growing or declining by more than a tenth, else stable."""
    missed = F.coalesce("was_cancelled", F.lit(False)) | F.coalesce("no_show", F.lit(False))
    age = age_days("ts", as_of)
    paid = events.where(_of("session_completed") & F.col("tutor_id").isNotNull() & _within(age, days) & ~missed).select("tutor_id", "ts", F.col("duration_min").alias("_minutes"))
    held = asof_backward(paid, rates, ["tutor_id"], "ts", ["hourly_rate"], ["event_id"], min_rows=min_rows, slice_rows=slice_rows)
    earned = F.coalesce(F.col("hourly_rate") * F.col("_minutes") / 60, F.lit(0.0))
    late = age_days("ts", as_of) < days / 2
    sums = held.groupBy("tutor_id").agg(
        F.sum(earned).alias("total_earnings"), F.count(F.lit(1)).alias("paid_sessions"), _count(F.col("hourly_rate").isNull()).alias("unrated_sessions"),
        F.sum(F.when(late, earned).otherwise(0.0)).alias("_late"), F.sum(F.when(late, 0.0).otherwise(earned)).alias("_early"))
    trend = F.when(F.col("_late") > F.col("_early") * 1.1, "growing").when(F.col("_late") < F.col("_early") * 0.9, "declining").otherwise("stable")
    return sums.select("tutor_id", "total_earnings", "paid_sessions", "unrated_sessions", ratio(F.col("total_earnings"), F.col("paid_sessions")).alias("avg_earnings_per_session"), trend.alias("earnings_trend"))


def tutor_ratings(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """How a tutor's ratings move and spread: later half of the window less the earlier one, the mean over subjects of their
    mean ratings, and the subjects' diversity (one less the sum of squared shares)."""
    done = events.where(_of("session_completed") & F.col("tutor_id").isNotNull() & _within(age_days("ts", as_of), days))
    r, late = F.nullif(F.col("rating"), F.lit(0)), age_days("ts", as_of) < days / 2
    by_subject = done.groupBy("tutor_id", "subject").agg(
        F.count(F.lit(1)).alias("c"), F.avg(r).alias("mean"), *[f(F.when(c, r)).alias(n) for n, f, c in (("s1", F.sum, late), ("n1", F.count, late), ("s0", F.sum, ~late), ("n0", F.count, ~late))])
    sums = by_subject.groupBy("tutor_id").agg(
        F.avg("mean").alias("avg_rating_by_subject"), (1 - F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("subject_diversity_score"),
        *[F.sum(c).alias(c) for c in ("s1", "n1", "s0", "n0")])
    return sums.select("tutor_id", "avg_rating_by_subject", "subject_diversity_score", (ratio(F.col("s1"), F.col("n1")) - ratio(F.col("s0"), F.col("n0"))).alias("rating_trend"))


def student_habits(events: DataFrame, as_of: Column, days: int = 30, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """When, how long, how well and with whom students had their sessions of the window, and how often the tutor changed from
    one session to the next."""
    done = events.where(_of("session_completed") & F.col("student_id").isNotNull() & _within(age_days("ts", as_of), days))
    halo = with_row_halo(done, ["student_id"], "ts", ["event_id"], 1, min_rows, slice_rows)
    was = F.lag("tutor_id").over(slice_window(["student_id"], "ts", ["event_id"]))
    moved = without_halo(halo.withColumn("_changed", F.coalesce(~F.col("tutor_id").eqNullSafe(was) & was.isNotNull(), F.lit(False))))
    age, r = age_days("ts", as_of), F.nullif(F.col("rating"), F.lit(0))
    sums = {
        "weekend": F.weekday("ts") >= 5, "evening": F.hour("ts") >= 18, "cancelled": F.coalesce("was_cancelled", F.lit(False)), "missed": F.coalesce("no_show", F.lit(False)),
        "last7": age < 7, "cancelled7": F.coalesce("was_cancelled", F.lit(False)) & (age < 7), "changed": F.col("_changed"),
    }
    late = age < days / 2
    by_tutor = moved.groupBy("student_id", "tutor_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_min").alias("minutes"), *[_count(c).alias(n) for n, c in sums.items()],
        F.count(r).alias("rated"), F.sum(r).cast("long").alias("r1"), F.sum(r * r).cast("long").alias("r2"),
        F.count(F.when(late, r)).alias("late_n"), F.sum(F.when(late, r)).cast("long").alias("late_r"))
    held = [c for c in by_tutor.columns if c not in ("student_id", "tutor_id")]
    per = by_tutor.groupBy("student_id").agg(*[F.sum(c).alias(c) for c in held], F.max("n").alias("top"), F.count("tutor_id").alias("tutors"))
    c = F.col
    spread = c("r2") - c("r1") * c("r1") / c("rated")
    return per.select(
        c("student_id").alias("entity_id"), ratio(c("weekend"), c("n")).alias("sessions_weekend_ratio"), ratio(c("evening"), c("n")).alias("sessions_evening_ratio"),
        ratio(c("minutes"), c("n")).alias("avg_session_duration_min"), (c("minutes") / 60).alias("total_session_hours_30d"),
        (ratio(c("late_r"), c("late_n")) - ratio(c("r1") - F.coalesce(c("late_r"), F.lit(0)), c("rated") - c("late_n"))).alias("rating_trend"),
        F.when(c("rated") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (c("rated") - 1))).alias("rating_volatility"),
        ratio(c("cancelled7"), c("last7")).alias("cancellation_rate_7d"), ratio(c("cancelled"), c("n")).alias("cancellation_rate_30d"), ratio(c("missed"), c("n")).alias("no_show_rate_30d"),
        c("tutors").alias("unique_tutors_30d"), ratio(c("top"), c("n")).alias("preferred_tutor_ratio"), c("changed").alias("tutor_changed_count_30d"),
    )


def tutor_consistency(events: DataFrame, as_of: Column, last: int = 20, days: int = 30) -> DataFrame:
    """Share of the most used tutor in a student's last sessions, that tutor's rating, tutors seen in the window.

    The last ``last`` sessions are cut on the map side before the shuffle.
    """
    done = events.where(_of("session_completed") & F.col("student_id").isNotNull())
    newest = Window.partitionBy("student_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = done.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
    by_tutor = recent.groupBy("student_id", "tutor_id").agg(
        F.count(F.lit(1)).alias("c"), F.avg(F.nullif(F.col("rating"), F.lit(0))).alias("r")
    )
    primary = by_tutor.groupBy("student_id").agg(
        F.sum("c").alias("recent_sessions"),
        F.max_by(F.struct("tutor_id", "c", "r"), F.struct("c", -F.col("tutor_id"))).alias("p"),
    )
    switches = (
        done.where(_within(age_days("ts", as_of), days)).groupBy("student_id", "tutor_id").agg(F.lit(1).alias("x"))
        .groupBy("student_id").agg(F.count(F.lit(1)).alias("tutor_switch_count_30d"))
    )
    return primary.join(switches, "student_id", "left").select(
        "student_id", F.col("p.tutor_id").alias("primary_tutor"),
        (F.col("p.c") / F.col("recent_sessions")).alias("tutor_consistency_score"),
        F.col("p.r").alias("primary_tutor_rating"),
        F.coalesce("tutor_switch_count_30d", F.lit(0)).alias("tutor_switch_count_30d"),
    )


def supply_demand(events: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Ratio, demand pressure, utilization and active tutors per subject."""
    inside = events.where(_within(age_days("ts", as_of), days) & F.col("subject").isNotNull())
    market = inside.where(_of("supply_demand_update")).groupBy("subject").agg(
        F.sum("available_tutors").alias("available_tutors"), F.sum("pending_requests").alias("pending_requests"),
        F.avg(F.col("demand_score") / F.col("supply_score")).alias("avg_pressure"),
    )
    by_tutor = inside.where(_of(*SESSION, "tutor_availability_updated")).groupBy("subject", "tutor_id").agg(
        F.sum(F.when(_of("session_completed"), F.col("duration_min"))).alias("minutes"),
        F.sum("available_slots_this_week").alias("hours"),
        _count(_of(*SESSION)).alias("sessions"),
    )
    load = by_tutor.groupBy("subject").agg(
        _count(F.col("sessions") > 0).alias("tutor_count"),
        F.sum("minutes").alias("booked_minutes"), F.sum("hours").alias("available_hours"),
    )
    return market.join(load, "subject", "full_outer").select(
        "subject", "available_tutors", "pending_requests", "avg_pressure",
        ratio(F.col("available_tutors"), F.col("pending_requests")).alias("supply_demand_ratio"),
        ratio(F.col("booked_minutes") / 60, F.col("available_hours")).alias("utilization_rate"),
        F.coalesce("tutor_count", F.lit(0)).alias("tutor_count"),
    )


def supply_demand_wide(per_subject: DataFrame, subjects: list[str]) -> DataFrame:
    """One row with a column per listed subject, and ``other_subjects``: the ratios of all others by name."""
    ratio_of = F.col("supply_demand_ratio")
    other = F.collect_list(F.when(~F.col("subject").isin(subjects) | F.col("subject").isNull(), F.struct("subject", "supply_demand_ratio")))
    return per_subject.agg(
        *[F.max(F.when(F.col("subject") == s, ratio_of)).alias(s) for s in subjects], F.array_sort(other).alias("other_subjects"))


def session_pattern(s7: Column, s14: Column, s30: Column) -> Column:
    previous = s14 - s7
    return (
        F.when((s7 == 0) & (s30 > 0), "inactive").when(s7 < previous, "declining").when(s7 > previous, "increasing")
        .otherwise("steady")
    )


def trend_features(features: DataFrame) -> DataFrame:
    """Change between windows, on the columns of ``windowed_features``."""
    c = F.col
    return features.withColumns({
        "session_velocity_change": c("session_count_7d") / 7.0 - c("session_count_30d") / 30.0,
        "rating_trend": c("avg_rating_7d") - c("avg_rating_30d"),
        "call_acceleration": c("ib_call_count_7d") / 7.0 - c("ib_call_count_30d") / 30.0,
        "session_pattern": session_pattern(c("session_count_7d"), c("session_count_14d"), c("session_count_30d")),
    })


def activity_trends(catalogue: DataFrame) -> DataFrame:
    """Engagement and spend trends, on the columns of ``window_catalogue``."""
    c = F.col
    return catalogue.withColumns({
        "engagement_trend": c("login_count_7d") - c("login_count_14d"),
        "spend_acceleration": c("payment_amount_7d") / 7.0 - c("payment_amount_30d") / 30.0,
    })


def daily_partials(events: DataFrame) -> DataFrame:
    """One row per student and UTC day: what a refresh of the sliding windows sums again."""
    done, call = _of("session_completed"), _of("ib_call_logged")
    rows = events.where((done | call) & F.col("student_id").isNotNull())
    return rows.groupBy("student_id", F.to_date("ts").alias("day")).agg(
        _count(done).alias("sessions"),
        F.sum(F.when(done, F.coalesce("rating", F.lit(0)))).cast("long").alias("rating_sum"),
        _count(done & (truthy_or(F.col("rating"), 0) != 0)).alias("rating_count"),
        _count(call).alias("calls"),
        _count(call & (F.col("sentiment") < -0.3)).alias("negative_calls"),
    )


def refresh_windows(daily: DataFrame, as_of: Column, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Sliding windows from daily partials; the day column prunes the partitions outside the largest window."""
    today = F.to_date(as_of)
    rows = daily.where((F.col("day") >= F.date_sub(today, max(windows))) & (F.col("day") < today))
    aggs = []
    for d in windows:
        w = F.col("day") >= F.date_sub(today, d)
        total = lambda c: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))  # noqa: B023,E731
        aggs += [
            total("sessions").alias(f"session_count_{d}d"), total("calls").alias(f"ib_call_count_{d}d"),
            total("negative_calls").alias(f"negative_calls_{d}d"),
            F.coalesce(ratio(total("rating_sum"), total("rating_count")), F.lit(0.0)).alias(f"avg_rating_{d}d"),
            _count(w & (F.col("sessions") + F.col("calls") > 0)).alias(f"days_active_{d}d"),
        ]
    return rows.groupBy("student_id").agg(*aggs)


def latest_metrics(rows: DataFrame, entity_id=None) -> DataFrame:
    """The newest metrics row of every entity, or of one."""
    wanted = rows if entity_id is None else rows.where(F.col("entity_id") == F.lit(entity_id))
    return keep_last(wanted, ["entity_id", "entity_type"], ["ts", "event_id"])


def metrics_with_defaults(keys: DataFrame, metrics: DataFrame, on: list[str]) -> DataFrame:
    """Point lookups in bulk: every asked key, with the defaults of a new entity where nothing is stored."""
    zero = ["sessions_7d", "sessions_14d", "sessions_30d", "ib_calls_7d", "ib_calls_14d"]
    joined = keys.join(metrics, on, "left")
    fill = {c: 0 for c in zero if c in metrics.columns} | {"avg_rating": 0.0, "health_score": 100.0}
    return joined.fillna({k: v for k, v in fill.items() if k in joined.columns})


def student_metrics(events: DataFrame, as_of: Column) -> DataFrame:
    """One row per student with what scoring needs: windows, mean rating, newest health, recency."""
    done, call, snap = _of("session_completed"), _of("ib_call_logged"), _of("customer_health_update")
    rows = events.where(any_of([done, call, snap]) & F.col("student_id").isNotNull()).withColumn("_age", age_days("ts", as_of)).where("_age >= 0")
    age = F.col("_age")
    aggs = [_count(done & (age < d)).alias(f"sessions_{d}d") for d in WINDOWS]
    aggs += [_count(call & (age < d)).alias(f"ib_calls_{d}d") for d in (7, 14)]
    health = F.when(snap & F.col("health_score").isNotNull(), F.struct("ts", "event_id", F.col("health_score").alias("v")))
    aggs += [
        F.coalesce(F.avg(F.when(done, F.nullif(F.col("rating"), F.lit(0)))), F.lit(0.0)).alias("avg_rating"),
        F.coalesce(F.max(health).v, F.lit(100.0)).alias("health_score"),
        F.min(F.when(done, age)).alias("days_since_last_session"),
        F.max("ts").alias("last_updated"),
    ]
    return rows.groupBy(F.col("student_id").alias("entity_id")).agg(*aggs).withColumn("entity_type", F.lit("student"))
