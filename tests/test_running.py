"""State after every row against a plain loop, with hot keys, bursts and ties; the stream's fold against both."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators import entities as E
from tidewatch.operators import telemetry as L
from tidewatch.operators.running import Step, state_after
from tidewatch.streaming import state, windows

T0 = dt.datetime(2024, 1, 1)
HOT = {"min_rows": 40, "slice_rows": 15}
EVENTS = ("event_id long, ts timestamp, event_type string, student_id long, tutor_id long, rating int, health_score double, sessions_last_7_days long, "
          "sessions_last_30_days long, ib_calls_last_14_days long, subject string, balance_status string, demand_score double, supply_score double")


def events(n=400, seed=4, burst=False):
    """Half of all events belong to one student; some share their time; with ``burst`` most lie within one minute."""
    rnd = random.Random(seed)
    maybe = lambda x: x if rnd.random() < 0.6 else None
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=rnd.randrange(60) if burst and rnd.random() < 0.9 else rnd.randrange(0, 900_000, 300))
        kind = rnd.choice(["session_started", "session_completed", "ib_call_logged", "customer_health_update", "supply_demand_update", "other"])
        student = 1 if rnd.random() < 0.5 else rnd.choice([2, 3, None])
        health = kind == "customer_health_update"
        out.append((i, at, kind, student, rnd.choice([7, 7, 8, None]), maybe(rnd.randrange(6)) if kind == "session_completed" else None, maybe(round(rnd.uniform(0, 100), 2)) if health else None,
                    maybe(rnd.randrange(9)) if health else None, maybe(rnd.randrange(30)) if health else None, maybe(rnd.randrange(6)) if health else None, "s1",
                    rnd.choice(["high_demand", "balanced"]) if kind == "supply_demand_update" else None, 5.0, 2.0))
    return out


NEW = (0, 0, 0, 0, 0, 0.0, 100.0)


def known(x):
    return x is not None and x == x


def step(s, entity_type, e):
    s7, s14, s30, c7, c14, avg, health = s
    if e.event_type in ("session_started", "session_completed"):
        s7, s14, s30 = s7 + 1, s14 + 1, s30 + 1
        if entity_type == "tutor" and e.event_type == "session_completed" and known(e.rating):
            avg = (avg * (s30 - 1) + e.rating) / s30
    elif entity_type == "student" and e.event_type == "ib_call_logged":
        c7, c14 = c7 + 1, c14 + 1
    elif entity_type == "student" and e.event_type == "customer_health_update" and known(e.health_score):
        health = e.health_score
        s7 = int(e.sessions_last_7_days) if known(e.sessions_last_7_days) else s7
        s30 = int(e.sessions_last_30_days) if known(e.sessions_last_30_days) else s30
        c14 = int(e.ib_calls_last_14_days) if known(e.ib_calls_last_14_days) else c14
    return s7, s14, s30, c7, c14, avg, health


def plain_states(rows):
    """{(entity, type, event_id): state}, rows in the order they are to be folded."""
    now, out = {}, {}
    for e in rows:
        if e.event_type not in ("session_started", "session_completed", "ib_call_logged", "customer_health_update"):
            continue
        tutor = e.tutor_id if e.event_type.startswith("session") else None
        for who, kind in ((e.student_id, "student"), (tutor, "tutor")):
            if who is not None:
                key = (str(who), kind)
                now[key] = step(now.get(key, NEW), kind, e)
                out[(*key, e.event_id)] = now[key]
    return out


def same(got, want):
    assert len(got) == len(want)
    for r in got:
        s = want[(r.entity_id, r.entity_type, r.event_id)]
        assert tuple(r[m] for m in E.STATE[:5]) == s[:5], r
        assert (r.avg_rating, r.health_score) == pytest.approx(s[5:], rel=1e-9)


@pytest.mark.parametrize("burst", [False, True])
@pytest.mark.parametrize("limits", [{}, HOT, {"min_rows": 1, "slice_rows": 1}])
def test_states_match_a_plain_fold(spark, limits, burst):
    df = spark.createDataFrame(events(burst=burst), EVENTS).repartition(4)
    want = plain_states(sorted(df.collect(), key=lambda e: (e.ts, e.event_id)))
    same(E.states_after(E.entity_events(df), **limits).collect(), want)


@pytest.mark.parametrize("limits", [{}, HOT])
def test_earlier_states_are_carried(spark, limits):
    """The second half of the events goes on from the states that the first half left, late events included."""
    df = spark.createDataFrame(events(), EVENTS)
    rows = df.collect()
    first, second = rows[:200], rows[200:]  # in order of arrival, not of time
    order = sorted(first, key=lambda e: (e.ts, e.event_id)) + sorted(second, key=lambda e: (e.ts, e.event_id))
    want = plain_states(order)
    a = E.states_after(E.entity_events(df.where("event_id < 200")), **limits)
    before = a.groupBy("entity_id", "entity_type").agg(F.max_by(F.struct(*E.STATE), F.struct("ts", "event_id")).alias("s")).select("entity_id", "entity_type", "s.*")
    b = E.states_after(E.entity_events(df.where("event_id >= 200")), before, **limits)
    same(a.unionByName(b).collect(), want)


def test_steps_add_and_overwrite_in_one_row(spark):
    rnd = random.Random(1)
    rows = [(i, T0 + dt.timedelta(seconds=rnd.randrange(500)), rnd.randrange(-3, 4), rnd.choice([None, None, rnd.randrange(100)])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, a long, p long").withColumn("k", F.lit("k"))
    got = {r.id: r.x for r in state_after(df, ["k"], "ts", ["id"], {"x": Step(F.col("a"), F.col("p"), 5)}, min_rows=50, slice_rows=20).collect()}
    x = 5
    for i, _, a, p in sorted(rows, key=lambda r: (r[1], r[0])):
        x = (p if p is not None else x) + a
        assert got[i] == x


@pytest.mark.parametrize("limits", [{}, HOT])
def test_alerts_follow_the_state_after_each_event(spark, limits):
    df = spark.createDataFrame(events(burst=True), EVENTS)
    rows = sorted(df.collect(), key=lambda e: (e.ts, e.event_id))
    now, want = {}, []
    for e in rows:
        if e.student_id is not None:
            now[e.student_id] = s = step(now.get(e.student_id, NEW), "student", e)
            if s[4] >= 3:
                want.append((e.event_id, "high_ib_call_frequency", "warning", str(e.student_id), {"ib_calls_14d": str(s[4]), "health_score": str(float(s[6]))}))
            if s[6] < 70:
                want.append((e.event_id, "low_health_score", "critical" if s[6] < 50 else "warning", str(e.student_id),
                             {"health_score": str(float(s[6])), "sessions_7d": str(s[0]), "ib_calls_14d": str(s[4])}))
        if e.balance_status == "high_demand":
            want.append((e.event_id, "supply_demand_imbalance", "info", "s1", {"balance_status": "high_demand", "demand_score": "5.0", "supply_score": "2.0"}))
    got = [(r.event_id, r.alert_type, r.severity, r.entity_id, r.details) for r in A.detect_after_events(df, **limits).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 200


def stream_of(spark, rows, path, batches):
    """``rows`` as files that are read one a batch."""
    import os

    size = -(-len(rows) // batches)
    for b in range(batches):
        spark.createDataFrame(rows[b * size:(b + 1) * size], EVENTS).coalesce(1).write.parquet(f"{path}/b={b}")
        for f in os.listdir(f"{path}/b={b}"):
            os.utime(f"{path}/b={b}/{f}", (1_700_000_000 + b * 10,) * 2)
    return spark.readStream.schema(EVENTS + ", b int").option("maxFilesPerTrigger", 1).parquet(str(path)).drop("b")


def test_the_stream_folds_like_the_batch(spark, tmp_path):
    """A hot entity on a stream is several tasks in every batch; alerts and states equal the fold over all."""
    rows = sorted(events(), key=lambda r: (r[1], r[0]))
    base = str(tmp_path / "fold")
    windows.run_once(state.fold_entities(stream_of(spark, rows, tmp_path / "in", 4), base, base + "-cp", **HOT))
    df = spark.createDataFrame(rows, EVENTS)
    got = state.read_folded(spark, base)
    want = plain_states(sorted(df.collect(), key=lambda e: (e.ts, e.event_id)))
    same(got.collect(), want)
    # what the stream raised per event is what the batch raises
    raised = {(r.event_id, a) for r in got.where("entity_type = 'student'").collect() for a in r.alerts}
    batch = A.detect_after_events(df.where("event_type IN ('session_started', 'session_completed', 'ib_call_logged', 'customer_health_update')")).where("entity_type = 'student'")
    assert raised == {(r.event_id, f"{r.alert_type}:{r.severity}") for r in batch.collect()}


def test_a_hot_entity_is_several_slices(spark):
    from tidewatch.operators.ordered import sliced

    rows = E.entity_events(spark.createDataFrame(events(), EVENTS))
    cut = sliced(rows, ["entity_id", "entity_type"], "ts", **HOT).where("entity_id = '1'")
    assert cut.select("_slice").distinct().count() > 5
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 2 * HOT["slice_rows"]


def test_compacted_states_go_on_the_same(spark, tmp_path):
    """States are compacted every second batch; a batch that runs again after that starts from the same states."""
    df = spark.createDataFrame(sorted(events(), key=lambda r: (r[1], r[0])), EVENTS)
    parts = [df.orderBy("ts", "event_id").offset(80 * i).limit(80) for i in range(5)]
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    for i, part in enumerate(parts):
        state.fold_batch(part, i, a)
        state.fold_batch(part, i, b, compact_every=2)
        state.fold_batch(part, i, b, compact_every=2)
    assert sorted(state.read_folded(spark, b).collect()) == sorted(state.read_folded(spark, a).collect())
    assert {p.name for p in (tmp_path / "b" / "state" / "base").iterdir()} == {"v=1", "v=3"}


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame(events(), EVENTS)
    base = str(tmp_path / "fold")
    state.fold_batch(df.where("event_id < 200"), 0, base, **HOT)
    state.fold_batch(df.where("event_id >= 200"), 1, base, **HOT)
    once = sorted(state.read_folded(spark, base).collect())
    state.fold_batch(df.where("event_id >= 200"), 1, base, **HOT)
    assert sorted(state.read_folded(spark, base).collect()) == once


@pytest.mark.parametrize("limits", [{}, HOT, {"min_rows": 1, "slice_rows": 1}])
def test_trailing_mean_of_extreme_values(spark, limits):
    """Tiny, huge and infinite values and NaN give what one plain window gives; nothing lingers after they leave."""
    rnd = random.Random(9)
    pick = [2e-11, 2e24, 1e308, float("inf"), float("-inf"), float("nan"), 0.0, 7.5, None]
    rows = [(i, rnd.choice("ab"), T0 + dt.timedelta(seconds=rnd.randrange(0, 4000, 20)), rnd.choice([2e-11, 7.5]) if rnd.random() < 0.8 else rnd.choice(pick)) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, stream_id string, ts timestamp, v double").repartition(3)
    got = {r.id: (r.history, r.baseline) for r in L.trailing_baseline(df, "v", 5, **limits).collect()}
    assert len(got) == len(rows)
    for i, key, ts, _ in rows:
        seen = [0.0 if v is None else v for _, k, at, v in rows if k == key and 0 < (ts - at).total_seconds() <= 300]
        with np.errstate(all="ignore"):
            want = float(np.sum(seen) / len(seen)) if seen else 0.0
        n, mean = got[i]
        assert n == len(seen)
        assert (np.isnan(mean) and np.isnan(want)) or mean == want or mean == pytest.approx(want, rel=1e-9)
