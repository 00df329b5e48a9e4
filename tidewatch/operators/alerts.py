"""Alerts: detection, rendering, de-duplication, batching, digests, alarm rules, latency statistics."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.expr import keep, ratio
from tidewatch.operators.entities import SNAPSHOTS, entity_steps
from tidewatch.operators.ordered import (
    SLICE_ROWS,
    carried_sums,
    hot_keys,
    rank_pick,
    rounds_for,
    slice_window,
    sliced,
    with_row_halo,
    without_halo,
)
from tidewatch.operators.running import state_after
from tidewatch.session import scratch_dir

HOUR_US = 3_600_000_000


def _details(**values: Column) -> Column:
    return F.create_map(*[x for name, v in values.items() for x in (F.lit(name), v.cast("string"))])


def _alert(cond: Column, kind: str, severity: Column | str, entity: Column, entity_type: str, details: Column, message: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(cond, F.struct(
        F.lit(kind).alias("alert_type"), severity.alias("severity"), entity.cast("string").alias("entity_id"),
        F.lit(entity_type).alias("entity_type"), details.alias("details"), message.alias("message"),
    ))


def state_alerts() -> list[Column]:
    """Alerts a student's current state raises; columns entity_id, entity_type, ib_calls_14d, health_score, sessions_7d."""
    c = F.col
    student = c("entity_type") == "student"
    who, calls, health = c("entity_id"), c("ib_calls_14d"), c("health_score")
    return [
        _alert(student & (calls >= 3), "high_ib_call_frequency", "warning", who, "student",
               _details(ib_calls_14d=calls, health_score=health),
               F.concat(F.lit("Student "), who.cast("string"), F.lit(" has "), calls.cast("string"), F.lit(" IB calls in 14 days"))),
        _alert(student & (health < 70), "low_health_score", F.when(health < 50, "critical").otherwise("warning"), who, "student",
               _details(health_score=health, sessions_7d=c("sessions_7d"), ib_calls_14d=calls),
               F.concat(F.lit("Student "), who.cast("string"), F.lit(" has low health score: "), health.cast("string"))),
    ]


def market_alert(statuses: tuple[str, ...] = ("high_demand",)) -> Column:
    """The alert of one supply and demand event."""
    c = F.col
    cond = (c("event_type") == "supply_demand_update") & c("balance_status").isin(*statuses)
    demand, supply = F.coalesce("demand_score", F.lit(0.0)), F.coalesce("supply_score", F.lit(0.0))
    return _alert(
        cond, "supply_demand_imbalance", "info", c("subject"), "subject",
        _details(balance_status=c("balance_status"), demand_score=demand, supply_score=supply),
        F.concat(F.lit("High demand detected for "), c("subject"), F.lit(" (Demand: "), demand.cast("string"),
                 F.lit(", Supply: "), supply.cast("string"), F.lit(")")),
    )


def detect_state(metrics: DataFrame, at: Column) -> DataFrame:
    """0 to 2 alerts per entity row."""
    return metrics.withColumn("_a", F.explode(keep(*state_alerts()))).select("_a.*", at.alias("timestamp"))


def detect_market(events: DataFrame, statuses: tuple[str, ...] = ("high_demand",)) -> DataFrame:
    return events.withColumn("_a", F.explode(keep(market_alert(statuses)))).select("_a.*", F.col("ts").alias("timestamp"))


def detect_after_events(events: DataFrame, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Every event re-checks its student's state as it is after that event; market events are checked by themselves.

    Calls and sessions count on, health updates overwrite; an event of another type finds the state unchanged. Events
    without a student raise market alerts only: no other entity type has a rule on its state."""
    mine = events.where(F.col("student_id").isNotNull()).select(
        F.lit("student").alias("entity_type"), F.col("student_id").cast("string").alias("entity_id"), "event_id", "ts", "event_type",
        F.col("health_score").cast("double").alias("_health"), *SNAPSHOTS)
    steps = entity_steps(F.col("_health"))
    after = state_after(mine, ["entity_id"], "ts", ["event_id"], {m: steps[m] for m in ("sessions_7d", "ib_calls_14d", "health_score")}, min_rows=min_rows, slice_rows=slice_rows)
    of_state = after.withColumn("_a", F.explode(keep(*state_alerts()))).select("event_id", "_a.*", F.col("ts").alias("timestamp"))
    of_market = events.withColumn("_a", F.explode(keep(market_alert()))).select("event_id", "_a.*", F.col("ts").alias("timestamp"))
    return of_state.unionByName(of_market)


def prediction_alerts(df: DataFrame) -> DataFrame:
    """Alerts from predictions and features: calls, churn, health, first session, velocity drop."""
    c = F.col

    def rule(cond: Column, kind: str, severity: str, advice: str) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity"), F.lit(advice).alias("recommendation")))

    rules = keep(
        # fixed texts and thresholds
        rule(c("ib_calls_14d") >= 2, "IB_CALL_SPIKE", "CRITICAL", "Assign retention specialist within 24 hours"),
        rule(c("churn_risk_30d") > 0.6, "HIGH_CHURN_RISK", "HIGH", "Offer discount or free session credit"),
        rule(c("health_score") < 40, "HEALTH_SCORE_CRITICAL", "HIGH", "Proactive outreach + personalized recovery plan"),
        rule(c("first_session_success") < 0.5, "FIRST_SESSION_RISK", "MEDIUM", "Match with top-rated tutor (>4.5 stars)"),
        rule((c("session_velocity") < 1.0) & (c("session_frequency_30d") > 2.0), "SESSION_VELOCITY_DROP", "MEDIUM",
             "Send re-engagement email campaign"),
    )
    return df.withColumn("_a", F.explode(rules)).select(*[k for k in ("entity_id", "entity_type") if k in df.columns], "_a.*")


def threshold_alerts(df: DataFrame) -> DataFrame:
    """The short rule set on predictions: call spike, churn and health thresholds."""
    c = F.col

    def rule(cond: Column, kind: str, severity: str) -> Column:
        return F.when(cond, F.struct(F.lit(kind).alias("alert_type"), F.lit(severity).alias("severity")))

    rules = keep(
        rule(c("ib_call_risk_14d") > 0.7, "churn_risk_ib_calls", "critical"),
        rule(c("churn_risk_30d") > 0.6, "churn_risk_high", "high"),
        rule(c("health_score") < 40, "health_score_critical", "high"),
    )
    return df.withColumn("_a", F.explode(rules)).select(*[k for k in ("entity_id", "entity_type") if k in df.columns], "_a.*")


INFERENCE_TRIGGERS = [
    # fixed values
    "session_completed", "inbound_call", "payment_failed", "subscription_cancelled", "booking_request",
]


def high_risk(df: DataFrame, sources: list[str] | None = None, at_least: int = 80) -> DataFrame:
    rows = df.where(F.col("risk_score") >= at_least)
    return rows.where(F.col("source").isin(sources)) if sources else rows


def render_alerts(alerts: DataFrame) -> DataFrame:
    """Subject and body of an alert message; optional risk_score, explanation and recommendations are used if present."""
    c = F.col
    icon = F.when(c("severity") == "critical", "🚨").when(c("severity") == "warning", "⚠️").otherwise("ℹ️")
    level = F.upper("severity")
    bullets = F.concat_ws("\n", F.transform(F.map_entries("details"), lambda e: F.concat(F.lit("  • "), e.key, F.lit(": "), e.value)))
    bar = F.lit("━" * 40)

    def optional(name: str, build) -> Column:
        return build(c(name)) if name in alerts.columns else F.lit(None).cast("string")

    risk = optional("risk_score", lambda x: F.when(x != 0, F.concat(F.lit("🎯 Risk Score: "), x.cast("string"), F.lit("/100"))))
    why = optional("explanation", lambda x: F.when(x != "", F.concat(F.lit("💡 AI Analysis:\n"), x)))
    steps = optional("recommendations", lambda x: F.when(F.size(x) > 0, F.concat(
        F.lit("✅ Recommended Actions:\n"),
        F.concat_ws("\n", F.transform(x, lambda r, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), r))),
    )))
    body = F.concat_ws(
        "\n", bar, F.concat(icon, F.lit(" Severity: "), level), F.concat(F.lit("📋 Alert Type: "), c("alert_type")),
        F.concat(F.lit("🆔 Entity: "), c("entity_id"), F.lit(" ("), c("entity_type"), F.lit(")")),
        F.concat(F.lit("⏰ Timestamp: "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
        bar, F.lit("📄 Summary:"), c("message"), risk, why, F.lit("📊 Details:"), bullets, steps, bar,
    )
    return alerts.withColumns({"subject": F.concat(icon, F.lit(" "), level, F.lit(": "), c("alert_type")), "body": body})


DEDUP_KEYS = ["alert_type", "entity_id"]


def dedup_gap(alerts: DataFrame, order: list[str], window_us: int = HOUR_US, min_rows: int | None = None,
              slice_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Marks ``is_new``: the alert before it, of the same type and entity, is at least the window away."""
    rows = with_row_halo(alerts, DEDUP_KEYS, "timestamp", order, 1, min_rows, slice_rows, counted)
    w = slice_window(DEDUP_KEYS, "timestamp", order)
    gap = F.unix_micros("timestamp") - F.unix_micros(F.lag("timestamp").over(w))
    return without_halo(rows.withColumn("is_new", F.coalesce(gap >= window_us, F.lit(True))))


def dedup_cooldown(alerts: DataFrame, order: str, window_us: int = HOUR_US, min_rows: int = 100_000,
                   slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The alerts that are sent when each one sent silences its type and entity for the window.

    A key of normal size (at most ``min_rows`` alerts, or 1 / SHARE of all) folds in one pass over its sorted alerts.
    Larger keys go through ``_cooldown_hot``.
    """
    cols = alerts.columns
    us = F.unix_micros("timestamp")
    hot = hot_keys(alerts, DEDUP_KEYS, "timestamp", min_rows, slice_rows)
    on = [alerts[k].eqNullSafe(hot[f"_hot_{k}"]) for k in DEDUP_KEYS]
    rest = alerts.join(F.broadcast(hot), on, "left_anti")
    rows = F.array_sort(F.collect_list(F.struct(us.alias("us"), F.col(order).alias("id"))))
    ids = f"array<{alerts.schema[order].dataType.simpleString()}>"
    empty = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(ids).alias("part"), F.array().cast(f"array<{ids}>").alias("full"))
    # sent ids gather in short arrays: appending copies one of those, not all that was sent before
    full = lambda acc: F.size(acc.part) >= 256
    fold = F.aggregate(rows, empty, lambda acc, r: F.when(
        acc.last.isNull() | (r.us - acc.last >= window_us),
        F.struct(
            r.us.alias("last"), F.when(full(acc), F.array(r.id)).otherwise(F.concat(acc.part, F.array(r.id))).alias("part"),
            F.when(full(acc), F.concat(acc.full, F.array(acc.part))).otherwise(acc.full).alias("full")),
    ).otherwise(acc), lambda acc: F.concat(F.flatten(acc.full), acc.part))
    sent = rest.groupBy(*DEDUP_KEYS).agg(fold.alias("_ids")).select(F.explode("_ids").alias(order))
    small = rest.join(sent, order, "left_semi")
    if hot.isEmpty():
        return small.select(*cols)
    large = alerts.join(F.broadcast(hot), on, "inner")
    return small.select(*cols).unionByName(_cooldown_hot(alerts.sparkSession, large, cols, order, window_us))


def _cooldown_hot(spark: SparkSession, rows: DataFrame, cols: list[str], order: str, window_us: int) -> DataFrame:
    """Cooldown for very large keys, without ever putting one key into one task.

    Time slices are folded on their own for every alert at which an earlier slice could enter them; an entry's
    exit is an entry of a later slice. The entries really used are then found by pointer doubling: log2(slices)
    joins on unique entry ids. Last, every slice is folded once more from its real entry.
    """
    scratch_dir(spark, "cooldown")  # makes sure the checkpoint folder is set
    us = F.unix_micros("timestamp")
    part = F.floor((us - F.col("_lo")) / F.col("_span") * F.col("_parts")).cast("long")
    # a slice is never shorter than the window, so one alert silences at most the next slice
    wide = F.greatest(F.lit(1), F.least(F.col("_parts"), F.floor(F.col("_span") / F.lit(window_us))))
    sliced = rows.withColumn("_parts", wide).withColumn("_slice", part).withColumn("_us", us).drop(*[f"_hot_{k}" for k in DEDUP_KEYS])
    sliced = sliced.select(*cols, "_slice", "_us").checkpoint()
    id_type = sliced.schema[order].dataType
    key_fields = [sliced.schema[k] for k in DEDUP_KEYS]

    def entries(pdf):
        """Each alert an earlier slice can enter at, with the last alert sent after entering there."""
        import numpy as np

        pdf = pdf.sort_values(["_us", order], kind="stable")
        t = pdf["_us"].to_numpy()
        after = np.searchsorted(t, t + window_us, side="left")
        last = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                last[i] = last[after[i]]
        reachable = t < t[0] + window_us
        first_of_time = np.r_[True, t[1:] != t[:-1]]
        # an entry is the first alert at or after (last sent + window); that time lies less than a window past
        # the end of an earlier slice, or the slice is entered at its very first alert
        use = (reachable | (np.r_[np.iinfo(np.int64).min, t[:-1]] < t[0] + window_us)) & first_of_time
        out = pdf.loc[use, [*DEDUP_KEYS, "_slice", "_us"]].copy()
        out["_exit"] = last[use]
        return out

    fields = [*key_fields, T.StructField("_slice", T.LongType()), T.StructField("_us", T.LongType()), T.StructField("_exit", T.LongType())]
    found = sliced.groupBy(*DEDUP_KEYS, "_slice").applyInPandas(entries, T.StructType(fields)).checkpoint()
    # next entry: the first entry of a later slice at or after exit + window
    wanted = found.select(*DEDUP_KEYS, F.col("_us").alias("_from"), (F.col("_exit") + window_us).alias("_at"))
    links = _first_at_or_after(wanted, sliced.select(*DEDUP_KEYS, "_us", "_slice").distinct(), window_us)
    links = links.select(*DEDUP_KEYS, "_from", "_to").checkpoint()
    used = sliced.groupBy(*DEDUP_KEYS).agg(F.min("_us").alias("_us"))
    slices = sliced.agg(F.countDistinct("_slice")).first()[0]
    for _ in range(rounds_for(slices)):
        hop = used.join(links.withColumnRenamed("_from", "_us"), [*DEDUP_KEYS, "_us"]).select(*DEDUP_KEYS, F.col("_to").alias("_us"))
        used = used.unionByName(hop).distinct().checkpoint()
        nxt = links.select(*DEDUP_KEYS, F.col("_from").alias("_to"), F.col("_to").alias("_far"))
        links = links.join(nxt, [*DEDUP_KEYS, "_to"]).select(*DEDUP_KEYS, "_from", F.col("_far").alias("_to")).checkpoint()

    def replay(pdf):
        import numpy as np

        pdf = pdf.sort_values(["_us", order], kind="stable")
        t = pdf["_us"].to_numpy()
        start = np.flatnonzero(pdf["_used"].to_numpy())
        picked, i = [], int(start[0]) if len(start) else len(t)
        while i < len(t):
            picked.append(i)
            i = int(np.searchsorted(t, t[i] + window_us, side="left"))
        return pdf.iloc[picked][[order]]

    marked = sliced.join(used.withColumn("_hit", F.lit(True)), [*DEDUP_KEYS, "_us"], "left").select(
        *DEDUP_KEYS, "_slice", "_us", order, F.coalesce("_hit", F.lit(False)).alias("_used")
    )
    sent = marked.groupBy(*DEDUP_KEYS, "_slice").applyInPandas(replay, T.StructType([T.StructField(order, id_type)]))
    return sliced.select(*cols).join(sent, order, "left_semi")


def _first_at_or_after(wanted: DataFrame, times: DataFrame, width_us: int) -> DataFrame:
    """For each ``_at`` the first ``_us`` of its key at or after it, however far, as ``_to``.

    Per (key, time cell): the first time in the cell at or after ``_at`` when there is one, else the first time of
    the next cell that has any. Cells of a key are few, so the cell table is what looks ahead.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width_us))
    points = times.select(*DEDUP_KEYS, F.col("_us").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_from"))
    asks = wanted.select(*DEDUP_KEYS, F.col("_at").alias("_t"), F.lit(0).alias("_side"), "_from")
    both = asks.unionByName(points).withColumn("_cell", cell("_t"))
    newest = Window.partitionBy(*DEDUP_KEYS, "_cell").orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_in", F.last(F.when(F.col("_side") == 1, F.col("_t")), ignorenulls=True).over(newest))
    asked = here.where("_side = 0").select(*DEDUP_KEYS, "_cell", "_from", "_in")
    cells = both.groupBy(*DEDUP_KEYS, "_cell").agg(F.min(F.when(F.col("_side") == 1, F.col("_t"))).alias("_first"))
    later = Window.partitionBy(*DEDUP_KEYS).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = cells.withColumn("_ahead", F.last("_first", ignorenulls=True).over(later)).drop("_first")
    return (
        asked.join(ahead, [*DEDUP_KEYS, "_cell"]).withColumn("_to", F.coalesce("_in", "_ahead"))
        .where(F.col("_to").isNotNull())
    )


def severity_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def delivery_rate(log: DataFrame, ok: Column) -> DataFrame:
    return log.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("delivered"),
        (ratio(F.count_if(ok), F.count(F.lit(1))) * 100).alias("success_pct"),
    )


def batch_alerts(alerts: DataFrame, order: list[str], per: str = "1 day", max_alerts: int = 100,
                 min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Alerts of one entity and period in messages of at most ``max_alerts``; all alerts are listed.

    Numbers run on over the time slices of a hot entity, so no task lists more than a slice and a message.
    """
    keys = ["entity_id", "period"]
    rows = sliced(alerts.withColumn("period", F.window("timestamp", per).start), ["entity_id"], "timestamp", min_rows, slice_rows)
    rows = rows.withColumn("_one", F.lit(1))
    w = Window.partitionBy(*keys, "_slice").orderBy("timestamp", *order)
    number = F.col("_rn") + F.coalesce("_rn0", F.lit(0))
    numbered = (
        rows.withColumn("_rn", F.row_number().over(w))
        .join(carried_sums(rows, keys, {"_rn0": "_one"}), [*keys, "_slice"], "left")
        .withColumn("part", F.floor((number - 1) / F.lit(max_alerts)).cast("int"))
    )
    item = F.struct("timestamp", *order, "alert_type", "severity")
    return numbered.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("alert_count"), F.array_sort(F.collect_list(item)).alias("alerts")
    )


def digest(alerts: DataFrame, per: str = "1 hour") -> DataFrame:
    return alerts.groupBy(F.window("timestamp", per).start.alias("period"), "severity").agg(F.count(F.lit(1)).alias("n"))


def malformed_rate(validated: DataFrame, ts: str, per: str = "5 minutes") -> DataFrame:
    """Share of rejected records per period, in percent."""
    return validated.groupBy(F.window(ts, per).start.alias("period")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("is_valid")).alias("malformed"),
    ).withColumn("malformed_rate", ratio(F.col("malformed"), F.col("total")) * 100)


ALARM_FIELDS = "alarm STRING, metric STRING, statistic STRING, period_s INT, op STRING, threshold DOUBLE, periods INT"

ALARMS = [
    # fixed values: alarm, metric, statistic, period in seconds, comparison, threshold, periods in a row
    ("ingest-errors", "ingest_errors", "Sum", 300, ">", 50.0, 2),
    ("ingest-throttles", "ingest_throttles", "Sum", 300, ">", 10.0, 1),
    ("ai-errors", "ai_errors", "Sum", 300, ">", 5.0, 2),
    ("high-churn-rate", "HighChurnRiskCount", "Maximum", 300, ">=", 10.0, 2),
    ("low-health-average", "AverageHealthScore", "Average", 900, "<", 60.0, 2),
    ("at-risk-customers", "AtRiskCustomers", "Maximum", 900, ">=", 50.0, 1),
    ("store-read-capacity", "read_capacity", "Sum", 300, ">", 10000.0, 3),
    ("store-write-capacity", "write_capacity", "Sum", 300, ">", 5000.0, 3),
    ("api-4xx", "api_4xx", "Sum", 300, ">", 100.0, 2),
    ("api-5xx", "api_5xx", "Sum", 300, ">", 10.0, 2),
    ("ingest-duration", "ingest_duration_ms", "Average", 300, ">", 5000.0, 3),
    ("iterator-age", "iterator_age_ms", "Maximum", 60, ">", 60000.0, 2),
    ("write-throughput", "write_throughput_exceeded", "Sum", 300, ">", 10.0, 1),
    ("stream-processor-errors", "stream_processor_errors", "Sum", 300, ">", 10.0, 2),
    ("malformed-rate", "malformed_rate", "Average", 300, ">", 5.0, 2),
]


def population_points(states: DataFrame, flags: dict[str, Column], means: dict[str, Column], per: str = "5 minutes") -> DataFrame:
    """Points (metric, timestamp, value) of a population whose members change one at a time.

    ``states``: entity_id, ts, event_id and the state after each event. ``flags`` count the members they hold for, ``means``
    average over all members seen so far. A member's last state of a period counts, less its state before, so each period
    adds its changes; the running sums go over one row a period. Periods without events have no point."""
    parts = {f"_f_{m}": F.when(c, 1.0).otherwise(0.0) for m, c in flags.items()} | {f"_m_{m}": c.cast("double") for m, c in means.items()} | {"_all": F.lit(1.0)}
    last = states.groupBy("entity_id", F.window("ts", per).start.alias("period")).agg(F.max_by(F.struct(*[c.alias(n) for n, c in parts.items()]), F.struct("ts", "event_id")).alias("s"))
    # a member has at most one row a period
    before = Window.partitionBy("entity_id").orderBy("period")
    change = last.withColumn("_b", F.lag("s").over(before)).select("period", *[(F.col(f"s.{n}") - F.coalesce(F.col(f"_b.{n}"), F.lit(0.0))).alias(n) for n in parts])
    up = Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    level = change.groupBy("period").agg(*[F.sum(n).alias(n) for n in parts]).select("period", *[F.sum(n).over(up).alias(n) for n in parts])
    values = [(m, F.col(f"_f_{m}")) for m in flags] + [(m, F.col(f"_m_{m}") / F.col("_all")) for m in means]
    points = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in values]))
    return level.select("period", points.alias("p")).select("p.metric", F.col("period").alias("timestamp"), "p.value")


def alarm_rules(spark: SparkSession, rules: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rules or ALARMS, ALARM_FIELDS)


def evaluate_alarms(points: DataFrame, rules: list[tuple], start: Column, end: Column) -> DataFrame:
    """Alarm state per rule and period for points (metric, timestamp, value).

    Points meet the few rules in a broadcast join of literal rows, are reduced per (alarm, period) before the shuffle,
    and the spine of periods comes from the bounds: a period without data does not breach.
    """
    spark = points.sparkSession
    table = F.broadcast(alarm_rules(spark, rules))
    width = F.col("period_s") * F.lit(1_000_000).cast("long")
    lo, hi = F.unix_micros(start), F.unix_micros(end)
    inside = points.where((F.col("timestamp") >= start) & (F.col("timestamp") < end))
    period = F.floor(F.unix_micros("timestamp") / width) * width
    stats = inside.join(table, "metric").groupBy("alarm", period.alias("period")).agg(
        F.sum("value").alias("Sum"), F.avg("value").alias("Average"), F.max("value").alias("Maximum")
    )
    first = F.floor(lo / width) * width
    last = F.floor((hi - 1) / width) * width
    spine = table.withColumn("period", F.explode(F.sequence(first, last, width)))
    x = F.when(F.col("statistic") == "Sum", F.col("Sum")).when(F.col("statistic") == "Average", F.col("Average")).otherwise(F.col("Maximum"))
    limit, op = F.col("threshold"), F.col("op")
    breach = F.when(op == ">", x > limit).when(op == ">=", x >= limit).when(op == "<", x < limit).otherwise(x <= limit)
    in_row = Window.partitionBy("alarm").orderBy("period")
    # length of the run of breaching periods that ends here
    calm = F.last(F.when(~F.col("breach"), F.col("period")), ignorenulls=True).over(in_row.rowsBetween(Window.unboundedPreceding, 0))
    run = (F.col("period") - F.coalesce("_calm", first - width)) / width
    return (
        spine.join(stats, ["alarm", "period"], "left")
        .withColumn("value", x)
        .withColumn("breach", F.coalesce(breach, F.lit(False)))
        .withColumn("_calm", calm)
        .withColumn("in_alarm", F.col("breach") & (run >= F.col("periods")))
        .select("alarm", F.timestamp_micros("period").alias("period_start"), "value", "breach", "in_alarm")
    )


def latency_stats(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Count, extremes, mean and the sorted[floor(n * p)] percentiles."""
    n = F.col("n")
    ranks = {f"p{p}": F.floor(n * F.lit(p / 100.0)) + 1 for p in (50, 95, 99)}
    v = F.col("value")
    picked = rank_pick(df, group, value, ranks, min=F.min(v), max=F.max(v), avg=F.sum(v * F.col("count")) / F.sum("count"))
    return picked.select(*group, F.col("n").alias("count"), "min", "max", "avg", "p50", "p95", "p99")


def latency_stats_one_based(df: DataFrame, group: list[str], value: str, ok: Column) -> DataFrame:
    """Percentiles at the 1-based index floor(n * p) of the successful requests; none when that index is 0."""
    n = F.col("n")
    return rank_pick(df.where(ok), group, value, {f"p{p}": F.floor(n * F.lit(p / 100.0)) for p in (50, 95, 99)})


def latency_stats_approx(df: DataFrame, group: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """The fast mode: one pass, percentiles within 1 / accuracy of the rank."""
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)
    return df.groupBy(*group).agg(F.count(value).alias("count"), p.alias("p")).select(
        *group, "count", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99")
    )


def request_rates(df: DataFrame, group: list[str], status: str = "status") -> DataFrame:
    s = F.col(status)
    n = F.count(F.lit(1))
    return df.groupBy(*group).agg(
        n.alias("total"), F.count_if(s == 200).alias("success"), F.count_if(s != 200).alias("failed"),
        (ratio(F.count_if(s == 200), n) * 100).alias("success_pct"),
        (ratio(F.count_if(s >= 400), n) * 100).alias("error_pct"),
    )


def partition_skew(df: DataFrame, key: str) -> DataFrame:
    """Rows per partition key: keys, mean, largest, population variance."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("c"))
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.avg("c").alias("mean_rows"), F.max("c").alias("max_rows"), F.var_pop("c").alias("variance")
    )


def error_log(logs: DataFrame, limit: int = 20) -> DataFrame:
    return logs.where(F.col("message").contains("ERROR")).orderBy(F.col("timestamp").desc(), F.col("message")).limit(limit)


def write_by_severity(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").partitionBy("severity").parquet(os.path.join(path, "alerts"))
