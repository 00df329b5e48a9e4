"""Timers on streams: state that ends, alarms that judge silence."""

import datetime as dt
import os
import random
import types

import pandas as pd

from tidewatch.sources.writers import read_state
from tidewatch.streaming import state, windows

T0 = dt.datetime(2024, 1, 1)


def stream_of(spark, batches, schema, path):
    """One file a batch."""
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b={b}")
        for f in os.listdir(f"{path}/b={b}"):
            os.utime(f"{path}/b={b}/{f}", (1_700_000_000 + b * 10,) * 2)
    return spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1).parquet(str(path)).drop("b")


def held(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def test_an_idle_students_state_is_gone_after_30_days(spark, tmp_path):
    """Student 1 is silent from day 1 on; student 2 carries the stream's time on."""
    event = lambda who, day: (who, "session_completed", T0 + dt.timedelta(days=day, hours=5))
    batches = [[event(1, 0), event(1, 1), event(2, 0)], [event(2, 10)], [event(2, 33)], [event(2, 34)]]
    stream = state.recent_windows(stream_of(spark, batches, "student_id long, event_type string, ts timestamp", tmp_path / "in"))
    base = str(tmp_path / "out")
    windows.run_once(windows.keep_newest(stream, base, base + "-cp", ["entity_id"], ["day", "cause"]))
    log = {}
    for r in spark.read.option("recursiveFileLookup", "true").parquet(base).orderBy("day").collect():
        log.setdefault(r.entity_id, []).append((r.cause, r.sessions_7d, r.sessions_14d, r.sessions_30d))
    assert log["1"][0] == ("event", 2, 2, 2) and log["1"][-1] == ("timer", 0, 0, 0)
    assert ("timer", 0, 2, 2) in log["1"]  # on day 10 both days have left the 7 day window
    newest = {r.entity_id: (r.sessions_7d, r.sessions_14d, r.sessions_30d) for r in read_state(spark, base, ["day", "cause"], ["entity_id"]).collect()}
    assert newest == {"1": (0, 0, 0), "2": (2, 2, 3)}
    kept = {r.key.entity_id for r in held(spark, base + "-cp", "daily").collect()}
    assert kept == {"2"}


def test_alarms_on_a_stream_judge_silence(spark, tmp_path):
    """Equal to the batch over all points; an alarm without a single point is calm, and breaches end with silence."""
    import random

    from tidewatch.functions.expr import instant
    from tidewatch.operators import alerts as A
    from tidewatch.streaming import alarms

    rnd = random.Random(2)
    rules = [("sum", "m", "Sum", 120, ">", 12.0, 2), ("mean", "m", "Average", 60, "<", 4.0, 2), ("top", "m", "Maximum", 300, ">=", 9.0, 1), ("silent", "none", "Sum", 60, "<=", 0.0, 1), ("other", "x", "Maximum", 60, ">", 1.0, 3)]
    rows = [(rnd.choice("mmx"), T0 + dt.timedelta(seconds=s), float(rnd.randrange(11))) for s in sorted(rnd.choices([*range(0, 1500), *range(2400, 5000)], k=400))]
    rows += [("mark", T0 + dt.timedelta(seconds=5000 + 600 * k), 1.0) for k in range(3)]
    schema = "metric string, timestamp timestamp, value double"
    parts = [rows[:150], rows[150:300], rows[300:402], rows[402:]]
    stream = alarms.alarm_states(stream_of(spark, parts, schema, tmp_path / "in"), rules, int(T0.replace(tzinfo=dt.UTC).timestamp() * 1e6), "2 minutes")
    out = str(tmp_path / "out")
    windows.run_once(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp"))
    got = {(r.alarm, r.period_start): (r.value, r.breach, r.in_alarm) for r in spark.read.parquet(out).collect()}
    want = {(r.alarm, r.period_start): (r.value, r.breach, r.in_alarm) for r in A.evaluate_alarms(
        spark.createDataFrame(rows, schema), rules, instant("2024-01-01 00:00:00"), instant("2024-01-01 02:00:00")).collect()}
    passed = T0 + dt.timedelta(seconds=5000 + 1200 - 120)
    width = {r[0]: dt.timedelta(seconds=r[3]) for r in rules}
    want = {k: v for k, v in want.items() if k[1] + width[k[0]] <= passed}
    assert got == want and any(v[2] for v in got.values())
    assert all(not v[1] for (a, _), v in got.items() if a == "silent")


class Held:
    """A handle and its state in memory, for one student; counts the calls that would go to the state store."""

    def __init__(self):
        self.calls, self.timers, self.value = 0, [], {}

    def getMapState(self, *_):
        return self

    getValueState = getMapState

    def __getattr__(self, name):
        if name not in ("get", "update", "clear", "registerTimer", "containsKey", "getValue", "updateValue", "removeKey", "iterator"):
            raise AttributeError(name)

        def call(*args):
            self.calls += 1
            return getattr(self, "_" + name)(*args)

        return call

    def _get(self):
        return self.value.get(())

    def _update(self, value):
        self.value[()] = value

    def _clear(self):
        self.value.clear()

    def _registerTimer(self, at):
        self.timers.append(at)

    def _containsKey(self, key):
        return key in self.value

    def _getValue(self, key):
        return self.value[key]

    def _updateValue(self, key, value):
        self.value[key] = value

    def _removeKey(self, key):
        del self.value[key]

    def _iterator(self):
        return iter(list(self.value.items()))


def turn(processor, *chunks):
    """A student's events (kind, day) of one batch, in the chunks that a large batch comes in."""
    frames = [pd.DataFrame({"ts": [T0 + dt.timedelta(days=d, hours=7) for _, d in c], "event_type": [k for k, _ in c]}) for c in chunks]
    (row,) = processor.handleInputRows(("9",), iter(frames), None)
    return row


def test_a_students_turn_costs_as_many_state_calls_with_30_days_as_with_one():
    spent = []
    for days in (1, 30):
        held, processor = Held(), state.RecentEvents()
        processor.init(held)
        for _ in range(2):
            turn(processor, [("session_completed", d) for d in range(days)])
        spent.append(held.calls)
        held.calls = 0
        list(processor.handleExpiredTimer(("9",), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: held.timers[-1]), None))
        spent.append(held.calls)
    assert spent[0] == spent[2] <= 6 and spent[1] <= 3 and spent[3] <= 3


def test_recent_counts_over_batches_and_chunks_equal_plain_counts():
    rnd = random.Random(4)
    base = (T0 - dt.datetime(1970, 1, 1)).days
    held, processor = Held(), state.RecentEvents()
    processor.init(held)
    kept = {}
    for batch in range(12):
        chunks = [[(rnd.choice(["session_completed", "ib_call_logged", "session_started", None]), batch * rnd.choice([4, 9]) + rnd.randrange(12)) for _ in range(rnd.randrange(1, 9))] for _ in range(rnd.randrange(1, 4))]
        row = turn(processor, *chunks)
        for kind, d in (e for c in chunks for e in c):
            kept.setdefault(d, []).append(kind)
        newest = max(kept)
        kept = {d: v for d, v in kept.items() if d > newest - 30}
        want = [sum(v.count(k) for d, v in kept.items() if d > newest - n) for k in ("session_completed", "ib_call_logged") for n in (7, 14, 30)]
        assert row["entity_id"].tolist() == ["9"] and row["numbers"].tolist() == [[newest + base, 0, *want]]
        assert held.timers[-1] == min(d + n for d in kept for n in (7, 14, 30) if d + n > newest) * state.DAY_MS + base * state.DAY_MS
        assert {d - base: (s, c) for d, s, c in zip(*held.value[()], strict=True)} == {d: (v.count("session_completed"), v.count("ib_call_logged")) for d, v in kept.items()}
