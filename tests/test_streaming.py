import base64
import datetime as dt
import json
import os
import random

import pandas as pd
import pytest

from tidewatch.functions.expr import instant
from tidewatch.plans import views as W
from tidewatch.sources.readers import record_stream
from tidewatch.sources.writers import compact_tutors, read_archive, read_state, read_tutors
from tests.test_running import plain_states, same
from tidewatch.streaming import ingest, state, windows

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def event_files(spark, tmp_path):
    """The small event table as five files in time order, read one per batch."""
    events = W.table(spark, "/root/testdata/sf0.001", "events").toPandas().sort_values(["ts", "event_id"])
    src = tmp_path / "events"
    for i in range(5):
        part = events.iloc[i * 200:(i + 1) * 200]
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(str(src))
        for f in os.listdir(src):
            if f.endswith(".parquet") and not os.path.exists(src / f"seen-{f}"):
                (src / f"seen-{f}").touch()
                os.utime(src / f, (1_700_000_000 + i * 10,) * 2)
    for f in os.listdir(src):
        if f.startswith("seen-"):
            os.unlink(src / f)
    return spark.readStream.schema(events_schema()).option("maxFilesPerTrigger", 1).parquet(str(src)), events


def events_schema():
    from tidewatch.schemas import TABLES

    return TABLES["events"]


def run(stream, spark, tmp_path, name):
    out = str(tmp_path / name)
    windows.run_once(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp"))
    return spark.read.schema(stream.schema).parquet(out)


def test_fold_over_batches_equals_the_fold_over_all(spark, tmp_path, event_files):
    stream, _ = event_files
    base = str(tmp_path / "fold")
    windows.run_once(state.fold_entities(W.mkt_of(stream), base, base + "-cp"))
    want = plain_states(W.mkt_events(spark, "/root/testdata/sf0.001").orderBy("ts", "event_id").collect())
    got = state.read_folded(spark, base).collect()
    same(got, want)
    for r in got:
        alerts = ["high_ib_call_frequency:warning"] if r.ib_calls_14d >= 3 else []
        if r.health_score < 70:
            alerts.append("low_health_score:" + ("critical" if r.health_score < 50 else "warning"))
        assert list(r.alerts) == (alerts if r.entity_type == "student" else [])


def test_cooldown_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    src = tmp_path / "alerts"
    rows = sorted((T0 + dt.timedelta(seconds=rnd.randrange(40_000)), i, rnd.choice("ab")) for i in range(300))
    for b in range(3):
        part = [(i, "t", k, ts) for ts, i, k in rows[b * 100:(b + 1) * 100]]
        spark.createDataFrame(part, "alert_no LONG, alert_type STRING, entity_id STRING, timestamp TIMESTAMP").coalesce(1).write.parquet(str(src / f"b={b}"))
        for f in os.listdir(src / f"b={b}"):
            os.utime(src / f"b={b}" / f, (1_700_000_000 + b * 10,) * 2)
    stream = spark.readStream.schema("alert_no LONG, alert_type STRING, entity_id STRING, timestamp TIMESTAMP, b INT").option("maxFilesPerTrigger", 1).parquet(str(src))
    got = {r.alert_no for r in run(state.cooldown_alerts(stream.drop("b")), spark, tmp_path, "out").collect()}
    want, last = set(), {}
    for ts, i, k in rows:
        if k not in last or (ts - last[k]).total_seconds() >= 3600:
            want.add(i)
            last[k] = ts
    assert got == want


def test_watermark_dedup_passes_the_first_alert(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "t", "a", T0), (2, "t", "a", T0 + dt.timedelta(minutes=5))], "alert_no LONG, alert_type STRING, entity_id STRING, timestamp TIMESTAMP").write.parquet(str(src))
    stream = spark.readStream.schema("alert_no LONG, alert_type STRING, entity_id STRING, timestamp TIMESTAMP").parquet(str(src))
    assert run(windows.dedup_alerts(stream), spark, tmp_path, "out").count() == 1


def test_recent_windows_forget_old_days(spark, tmp_path):
    src = tmp_path / "in"
    days = [0, 1, 25, 40, 41]
    spark.createDataFrame([(9, "session_completed", T0 + dt.timedelta(days=d)) for d in days], "student_id LONG, event_type STRING, ts TIMESTAMP").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("student_id LONG, event_type STRING, ts TIMESTAMP").parquet(str(src))
    base = str(tmp_path / "out")
    windows.run_once(windows.keep_newest(state.recent_windows(stream), base, base + "-cp", ["entity_id"]))
    r = read_state(spark, base, ["day"], ["entity_id"]).first()
    assert (r.sessions_7d, r.sessions_14d, r.sessions_30d) == (2, 2, 3)


def record(kind, sec, **payload):
    text = json.dumps({"event_type": kind, "timestamp": (T0 + dt.timedelta(seconds=sec)).isoformat() + "Z", "payload": payload})
    return base64.b64encode(text.encode()).decode()


def test_ingest_routes_and_survives_a_rerun_of_a_batch(spark, tmp_path):
    src = tmp_path / "records"
    src.mkdir()
    rows = [record("session_completed", i, tutor_id=f"t{i % 3}", tutor_rating=i % 6) for i in range(20)] + ["bm90IGpzb24=", record("nope", 1)]
    for b in range(2):
        part = rows[b * 11:(b + 1) * 11]
        (src / f"{b}.json").write_text("\n".join(json.dumps({"data": d, "event_id": b * 11 + i}) for i, d in enumerate(part)))
        os.utime(src / f"{b}.json", (1_700_000_000 + b,) * 2)
    base, at = str(tmp_path / "out"), instant("2024-02-01 05:00:00")
    ingest.start_ingest(record_stream(spark, str(src), 1), base, base + "/cp", at, once=True).awaitTermination()

    def picture():
        s = read_state(spark, base + "/state", ["ts", "event_id"])
        t = read_tutors(spark, base + "/tutors")
        return (sorted((r.entity_id, r.entity_type) for r in s.collect()), sorted((r.entity_id, r.sessions_completed_count, r.session_rating_sum) for r in t.collect()), read_archive(spark, base + "/archive").count(),
                sorted(r.event_id for r in spark.read.parquet(base + "/quarantine").collect()))

    before = picture()
    assert before[1] == [("t0", 7, 9.0), ("t1", 7, 16.0), ("t2", 6, 21.0)] and before[2] == 22 and before[3] == [20, 21]
    assert len(before[0]) == 20 and {t for _, t in before[0]} == {"event"}
    batch = spark.createDataFrame([(d, 11 + i, None) for i, d in enumerate(rows[11:])], "data STRING, event_id LONG, ts TIMESTAMP")
    ingest.write_batch(batch, 1, base, at)
    assert picture() == before
    compact_tutors(spark, base + "/tutors")
    profile = spark.createDataFrame([(record("tutor_availability_updated", 99, tutor_id="t1", available_slots_this_week=20), 50, None)], "data STRING, event_id LONG, ts TIMESTAMP")
    ingest.write_batch(profile, 2, base)
    ingest.write_batch(spark.createDataFrame([(record("session_completed", 100, tutor_id="t1", tutor_rating=5), 51, None)], "data STRING, event_id LONG, ts TIMESTAMP"), 3, base)
    ingest.write_batch(profile, 2, base)  # a retry keeps its first time
    t1 = read_tutors(spark, base + "/tutors").where("entity_id = 't1'").first()
    assert (t1.sessions_completed_count, t1.session_rating_sum, t1.available_slots_this_week) == (8, 21.0, 20)
    assert read_archive(spark, base + "/archive").count() == 24


def test_daily_counts_match_batch(spark, tmp_path, event_files):
    stream, events = event_files
    base = str(tmp_path / "daily")
    windows.run_once(windows.keep_newest(windows.daily_counts(W.mkt_of(stream)), base, base + "-cp", ["student_id", "day"]))
    got = read_state(spark, base, ["day"], ["student_id", "day"]).agg({"sessions": "sum", "calls": "sum"}).first()
    assert got["sum(sessions)"] == (events.event_type == "purchase").sum() and got["sum(calls)"] == (events.event_type == "error").sum()


def test_version_feed(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame(pd.DataFrame({"k": [1, 2], "v": [1, 2]})).write.parquet(a)
    spark.createDataFrame(pd.DataFrame({"k": [2, 3], "v": [5, 3]})).write.parquet(b)
    assert {(r.k, r.change_type) for r in windows.version_feed(spark, a, b, ["k"]).collect()} == {(1, "REMOVE"), (2, "MODIFY"), (3, "INSERT")}
