"""Sessions against a plain walk, with hot keys cut within sessions; the stream against the batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tests.test_timers import stream_of
from tidewatch.operators.sessions import sessions
from tidewatch.streaming import windows

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "id long, k string, ts timestamp, v long"


def rows(n=500, seed=3, quiet=0.05):
    """Half of all rows are of one key; gaps are mostly short, some exactly as long as the limit."""
    rnd, out, now = random.Random(seed), [], {"a": 0, "b": 0, "c": 0}
    for i in range(n):
        k = "a" if rnd.random() < 0.5 else rnd.choice("bc")
        now[k] += rnd.choice([300, 301, 299, 900]) if rnd.random() < quiet else rnd.randrange(0, 40)
        out.append((i, k, T0 + dt.timedelta(seconds=now[k]), rnd.randrange(5)))
    return out


def plain(all_rows, gap=300):
    out = []
    for k in {r[1] for r in all_rows}:
        last = None
        for i, _, ts, v in sorted((r for r in all_rows if r[1] == k), key=lambda r: (r[2], r[0])):
            if last is None or (ts - last).total_seconds() > gap:
                out.append([k, ts, ts, 0, 0])
            out[-1][2], out[-1][3], out[-1][4], last = ts, out[-1][3] + 1, out[-1][4] + v, ts
    return sorted(map(tuple, out))


@pytest.mark.parametrize("quiet", [0.0, 0.01, 0.3])
@pytest.mark.parametrize("limits", [{}, {"min_rows": 40, "slice_rows": 10}, {"min_rows": 1, "slice_rows": 1}])
def test_sessions_match_a_plain_walk(spark, limits, quiet):
    all_rows = rows(quiet=quiet)
    df = spark.createDataFrame([*all_rows, (999, "a", None, 1)], SCHEMA).repartition(3)
    got = sessions(df, ["k"], "ts", ["id"], 300_000_000, {"total": F.col("v")}, **limits)
    assert sorted((r.k, r.start, r.last, r.events, r.total) for r in got.collect()) == plain(all_rows)


def test_the_stream_finds_the_same_sessions(spark, tmp_path):
    all_rows = sorted(rows(), key=lambda r: r[2])
    end = all_rows[-1][2]
    batches = [all_rows[i:i + 100] for i in range(0, len(all_rows), 100)] + [[(10_000, "z", end + dt.timedelta(hours=2), 0)]]
    stream = windows.session_windows(stream_of(spark, batches, SCHEMA, tmp_path / "in"), ["k"], "ts", "300 seconds", {"total": F.col("v")}, "1 hour")
    out = str(tmp_path / "out")
    windows.run_once(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp"))
    got = sorted((r.k, r.start, r.last, r.events, r.total) for r in spark.read.parquet(out).collect())
    assert got == plain(all_rows)
