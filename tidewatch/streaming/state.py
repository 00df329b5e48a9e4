"""State on streams: the per-entity fold with alerts after each event, pruned windows, cooldown."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.entities import STATE, entity_events, states_after
from tidewatch.operators.ordered import keep_last
from tidewatch.sources.writers import append_state, compact_before, read_log

ENTITY = ["entity_id", "entity_type"]


def raised(calls: Column, health: Column) -> Column:
    """The alerts that a student's state raises, as type and severity."""
    found = F.array(
        F.when(calls >= 3, F.lit("high_ib_call_frequency:warning")),
        F.when(health < 70, F.concat(F.lit("low_health_score:"), F.when(health < 50, "critical").otherwise("warning"))))
    return F.when(F.col("entity_type") == "student", F.filter(found, lambda a: a.isNotNull())).otherwise(F.array().cast("array<string>"))


def states_before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state of every entity as the batches before ``batch_id`` left it; None before there is any."""
    try:
        log = read_log(spark, path)
    except FileNotFoundError:
        return None
    return keep_last(log.where(F.col("_batch") < batch_id), ENTITY, ["_batch"]).drop("_batch")


def fold_batch(batch: DataFrame, batch_id: int, path: str, min_rows: int | None = None, slice_rows: int | None = None, compact_every: int = 100) -> None:
    """Folds one micro-batch into the entities' states: state and alerts after every event below ``path``/events, the
    states it leaves below ``path``/state. A retried batch starts from the same earlier states and replaces its folders.
    States are compacted every so many batches, so a batch reads one row an entity and the batches since."""
    spark = batch.sparkSession
    if batch_id % compact_every == 0:
        compact_before(spark, os.path.join(path, "state"), batch_id, ENTITY)
    rows = entity_events(batch).persist()
    try:
        before = states_before(spark, os.path.join(path, "state"), batch_id)
        if before is not None:
            before = before.join(rows.select(*ENTITY).distinct(), ENTITY, "left_semi")
        after = states_after(rows, before, min_rows, slice_rows)
        folder = os.path.join(path, "events", f"batch={batch_id}")
        after.withColumn("alerts", raised(F.col("ib_calls_14d"), F.col("health_score"))).write.mode("overwrite").parquet(folder)
    finally:
        rows.unpersist()
    newest = spark.read.parquet(folder).groupBy(*ENTITY).agg(F.max_by(F.struct(*STATE), F.struct("ts", "event_id")).alias("s"))
    append_state(newest.select(*ENTITY, "s.*", F.lit(batch_id).cast("long").alias("_batch")), os.path.join(path, "state"), batch_id, ["_batch"], ENTITY)


def fold_entities(events: DataFrame, path: str, checkpoint: str, min_rows: int | None = None, slice_rows: int | None = None):
    """A writer that folds a stream of events batch by batch; an entity with most of a batch's events is many tasks."""
    return events.writeStream.foreachBatch(lambda df, i: fold_batch(df, i, path, min_rows, slice_rows)).option("checkpointLocation", checkpoint)


def read_folded(spark: SparkSession, path: str) -> DataFrame:
    """State and alerts after every event that the stream has folded."""
    return spark.read.parquet(os.path.join(path, "events")).drop("batch")


DAY_MS = 86_400_000
RECENT_COUNTS = [f"{c}_{n}d" for c in ("sessions", "calls") for n in (7, 14, 30)]
RECENT_OUTPUT = "entity_id STRING, numbers ARRAY<BIGINT>"  # day, 1 for a timer's row, the counts: each column costs every row its conversion


class RecentEvents(StatefulProcessor):
    """Daily counts of a customer's last 30 days, and the window counts they make.

    A timer is set for the next day on which a count of days leaves a window. So the windows of a customer who has fallen
    silent go down as the stream's time goes on, and after 30 days nothing is kept of them. The days are one value, so a
    customer's turn is one read and one write of state however many days they have."""

    windows = (7, 14, 30)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.daily = handle.getValueState("daily", "day ARRAY<INT>, sessions ARRAY<BIGINT>, calls ARRAY<BIGINT>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        daily, newest = self._read(), None
        for chunk in rows:
            days = chunk["ts"].to_numpy().astype("datetime64[ns]").astype("int64") // (DAY_MS * 1_000_000)
            kind = chunk["event_type"].to_numpy()
            found, at = np.unique(days, return_inverse=True)
            done, call = (np.bincount(at[kind == t], minlength=len(found)) for t in ("session_completed", "ib_call_logged"))
            for d, s, c in zip(found.tolist(), done.tolist(), call.tolist(), strict=True):
                old = daily.get(d, (0, 0))
                daily[d] = old[0] + s, old[1] + c
            newest = int(found[-1]) if newest is None else max(newest, int(found[-1]))
        yield self._counts(key, daily, newest, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._counts(key, self._read(), timerValues.getCurrentWatermarkInMs() // DAY_MS, 1)

    def _read(self) -> dict[int, tuple[int, int]]:
        """Sessions and calls of each day kept."""
        held = self.daily.get()
        return {d: (s, c) for d, s, c in zip(*held, strict=True)} if held else {}

    def _counts(self, key, daily: dict[int, tuple[int, int]], day: int, timer: int) -> pd.DataFrame:
        newest = max([day, *daily])
        kept = {d: v for d, v in daily.items() if d > newest - max(self.windows)}
        if kept:
            self.daily.update((list(kept), [s for s, _ in kept.values()], [c for _, c in kept.values()]))
            self.handle.registerTimer(min(d + n for d in kept for n in self.windows if d + n > newest) * DAY_MS)
        else:
            self.daily.clear()
        counts = [sum(v[i] for d, v in kept.items() if d > newest - n) for i in (0, 1) for n in self.windows]
        return pd.DataFrame({"entity_id": [str(key[0])], "numbers": [[newest, timer, *counts]]})

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Passes an alert on when the last one sent of its type and entity is at least ``window_us`` old."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "us BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alerts = pd.concat(rows).sort_values(["us", "alert_no"])
        us, sent = alerts["us"].to_numpy(), []
        at = int(np.searchsorted(us, self.last.get()[0] + self.window_us)) if self.last.exists() else 0
        while at < len(us):  # a step for each alert sent, at most one a window
            sent.append(at)
            at = int(np.searchsorted(us, us[at] + self.window_us))
        if sent:
            self.last.update((int(us[sent[-1]]),))
        yield alerts.iloc[sent].assign(alert_type=key[0], entity_id=key[1])[["alert_no", "alert_type", "entity_id", "timestamp"]]

    def close(self) -> None:
        pass


def recent_windows(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Window counts per student from daily state, on a stream: after each batch with events of the student (``cause`` event)
    and on days when counts leave a window (``cause`` timer). State is gone 30 days after a student's last event."""
    rows = (
        events.select(F.col("student_id").cast("string").alias("entity_id"), "ts", "event_type").withWatermark("ts", delay).groupBy("entity_id")
        .transformWithStateInPandas(RecentEvents(), outputStructType=RECENT_OUTPUT, outputMode="Update", timeMode="EventTime")
    )
    n = F.col("numbers")
    cause = F.when(n[1] == 1, "timer").otherwise("event")
    return rows.select("entity_id", n[0].cast("int").alias("day"), cause.alias("cause"), *[n[i].alias(c) for i, c in enumerate(RECENT_COUNTS, 2)])


def cooldown_alerts(alerts: DataFrame, window_us: int = 3_600_000_000) -> DataFrame:
    """De-duplicated alerts (alert_no, alert_type, entity_id, timestamp) on a stream."""
    kind = {f.name: f.dataType.simpleString() for f in alerts.schema.fields}
    out = f"alert_no {kind['alert_no']}, alert_type STRING, entity_id {kind['entity_id']}, timestamp TIMESTAMP"
    rows = alerts.select("alert_type", "entity_id", "alert_no", "timestamp", F.unix_micros("timestamp").alias("us"))
    return rows.groupBy("alert_type", "entity_id").transformWithStateInPandas(
        Cooldown(window_us), outputStructType=out, outputMode="Append", timeMode="None"
    )
