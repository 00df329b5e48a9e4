"""Late rows: caught, archived, left out of windows; all rows that the engine's own windows drop are among them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tests.test_timers import T0, stream_of
from tidewatch.sources.writers import read_state
from tidewatch.streaming import late, windows

SCHEMA = "id long, ts timestamp, event_type string"


def arrivals(seed=6, batches=6):
    rnd = random.Random(seed)
    out = []
    for b in range(batches):
        rows = []
        for i in range(60):
            behind = rnd.choice([0, 0, 0, rnd.randrange(8)])
            rows.append((b * 60 + i, T0 + dt.timedelta(hours=max(0.0, b * 3 + rnd.random() * 3 - behind)), rnd.choice(["error", "view"])))
        out.append(rows)
    return out


def test_late_rows_are_caught_and_counted_nowhere(spark, tmp_path):
    batches = arrivals()
    base = str(tmp_path / "late")
    windows.run_once(late.split_late(stream_of(spark, batches, SCHEMA, tmp_path / "a"), base, base + "-cp", counts={"errors": F.col("event_type") == "error"}))
    want, dropped = set(), set()  # behind the watermark of the batch; behind that of the batch before
    marks = [None, None]
    for rows in batches:
        for i, ts, _ in rows:
            end = ts.replace(minute=0, second=0, microsecond=0) + dt.timedelta(hours=1)
            for mark, late_ones in zip(marks, (dropped, want), strict=True):
                if mark is not None and end <= mark - dt.timedelta(hours=1):
                    late_ones.add(i)
        marks = [marks[1], max([t for _, t, _ in rows] + ([marks[1]] if marks[1] else []))]
    got = late.read_late(spark, base)
    assert {r.id for r in got.collect()} == want and len(want) > 10
    assert late.read_archived(spark, base).count() == 360
    mine = {r.period: (r.total, r.errors) for r in late.read_windows(spark, base).collect()}

    def plain(without):
        out = {}
        for i, ts, kind in (r for rows in batches for r in rows):
            if i not in without:
                p = ts.replace(minute=0, second=0, microsecond=0)
                n, e = out.get(p, (0, 0))
                out[p] = (n + 1, e + (kind == "error"))
        return out

    assert mine == plain(want)
    # the engine's own windowed aggregation drops some of them
    stream = stream_of(spark, batches, SCHEMA, tmp_path / "b").withColumn("is_valid", F.col("event_type") != "error")
    out = str(tmp_path / "native")
    windows.run_once(windows.keep_newest(windows.malformed_windows(stream, width="1 hour"), out, out + "-cp", ["period"]))
    native = {r.period: (r.total, r.malformed) for r in read_state(spark, out, ["period"], ["period"]).collect()}
    assert native == plain(dropped) and dropped < want


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    batches, base = arrivals(batches=3), str(tmp_path)
    frames = [spark.createDataFrame(b, SCHEMA) for b in batches]
    split = lambda i: late.split_batch(frames[i], i, base, "ts", 3_600_000_000, 3_600_000_000, {})
    for i in (0, 1, 2):
        split(i)
    once = sorted(late.read_windows(spark, base).collect()), sorted(r.id for r in late.read_late(spark, base).collect())
    split(1)
    split(2)
    assert (sorted(late.read_windows(spark, base).collect()), sorted(r.id for r in late.read_late(spark, base).collect())) == once


def test_rows_without_a_time_are_kept_in_the_archive(spark, tmp_path):
    late.split_batch(spark.createDataFrame([(1, None, "x"), (2, T0, "error")], SCHEMA), 0, str(tmp_path), "ts", 3_600_000_000, 0, {})
    assert late.read_archived(spark, str(tmp_path)).count() == 2 and late.read_windows(spark, str(tmp_path)).count() == 1
