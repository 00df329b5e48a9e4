"""The backward as-of join, earnings and habits against plain loops, with hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import alerts as A
from tidewatch.operators import entities as E
from tidewatch.operators.ordered import asof_backward

T0 = dt.datetime(2024, 1, 1)
HOT = {"min_rows": 40, "slice_rows": 15}


def sides(seed=8, n=400):
    rnd = random.Random(seed)
    at = lambda: T0 + dt.timedelta(seconds=rnd.randrange(0, 6000, 10))
    key = lambda: "hot" if rnd.random() < 0.6 else rnd.choice(["b", "c", None])
    left = [(i, key(), at()) for i in range(n)]
    right = []
    for i in range(n // 4):
        start = at()
        right.append((i, key(), start, float(i), start + dt.timedelta(seconds=rnd.choice([100, 100_000])) if rnd.random() < 0.5 else None))
    return left, right


@pytest.mark.parametrize("until", [None, "ends"])
@pytest.mark.parametrize("limits", [{}, HOT, {"min_rows": 1, "slice_rows": 1}])
def test_asof_backward_finds_the_row_in_force(spark, limits, until):
    left, right = sides()
    ldf = spark.createDataFrame(left, "id int, k string, ts timestamp").repartition(3)
    rdf = spark.createDataFrame(right, "rid int, k string, ts timestamp, rate double, ends timestamp").repartition(3)
    got = {r.id: (r.matched_ts, r.rate) for r in asof_backward(ldf, rdf, ["k"], "ts", ["rate"], ["rid"], until, **limits).collect()}
    assert len(got) == len(left)
    for i, k, ts in left:
        held = max(((t, rid, rate, ends) for rid, rk, t, rate, ends in right if k is not None and rk == k and t <= ts), default=None, key=lambda r: r[:2])
        if held and until and held[3] is not None and ts >= held[3]:
            held = None
        assert got[i] == ((held[0], held[2]) if held else (None, None)), i


@pytest.mark.parametrize("limits", [{}, {"min_rows": 10, "slice_rows": 4}])
def test_sessions_pay_the_rate_in_force(spark, limits):
    now = "2024-01-31 00:00:00"
    day = lambda d: T0 + dt.timedelta(days=d)
    rates = spark.createDataFrame([(1, day(5), 1, 20.0), (1, day(20), 2, 60.0), (2, day(0), 3, 30.0)], "tutor_id long, ts timestamp, event_id long, hourly_rate double")
    done = [(1, day(d), "session_completed", 30, False, False) for d in (2, 5, 10, 20, 25, 26)]
    done += [(1, day(11), "session_completed", 30, True, False), (1, day(12), "session_completed", 30, False, True), (1, day(13), "session_started", None, None, None), (2, day(3), "session_completed", 60, None, None)]
    events = spark.createDataFrame(done, "tutor_id long, ts timestamp, event_type string, duration_min int, was_cancelled boolean, no_show boolean")
    got = {r.tutor_id: tuple(r)[1:] for r in E.tutor_earnings(events, rates, instant(now), **limits).collect()}
    assert got == {1: (110.0, 6, 1, pytest.approx(110 / 6), "growing"), 2: (30.0, 1, 0, 30.0, "declining")}


@pytest.mark.parametrize("limits", [{}, {"min_rows": 10, "slice_rows": 4}])
def test_habits_of_a_student(spark, limits):
    rnd = random.Random(5)
    rows = [(i, T0 + dt.timedelta(hours=rnd.randrange(1, 720)), rnd.choice([1, 1, 2]), rnd.choice([7, 7, 8, 9]), rnd.randrange(6), rnd.randrange(20, 90), rnd.random() < 0.2, rnd.random() < 0.1) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, student_id long, tutor_id long, rating int, duration_min int, was_cancelled boolean, no_show boolean").withColumn("event_type", F.lit("session_completed"))
    got = {r.entity_id: r for r in E.student_habits(events, instant("2024-01-31 00:00:00"), **limits).collect()}
    for s in (1, 2):
        mine = sorted((r for r in rows if r[2] == s), key=lambda r: (r[1], r[0]))
        share = lambda f: sum(map(f, mine)) / len(mine)  # noqa: E731, B023
        assert got[s].sessions_weekend_ratio == pytest.approx(share(lambda r: r[1].weekday() >= 5))
        assert got[s].sessions_evening_ratio == pytest.approx(share(lambda r: r[1].hour >= 18))
        assert got[s].tutor_changed_count_30d == sum(a[3] != b[3] for a, b in zip(mine, mine[1:]))
        assert got[s].unique_tutors_30d == 3 and got[s].no_show_rate_30d == pytest.approx(share(lambda r: r[7]))
        assert got[s].preferred_tutor_ratio == pytest.approx(share(lambda r: r[3] == 7))


def test_population_points_follow_every_change(spark):
    rnd = random.Random(7)
    rows = [(str(rnd.randrange(6)), T0 + dt.timedelta(seconds=rnd.randrange(7200)), i, rnd.randrange(100) * 1.0) for i in range(150)]
    states = spark.createDataFrame(rows, "entity_id string, ts timestamp, event_id long, health double")
    points = A.population_points(states, {"low": F.col("health") < 30}, {"mean": F.col("health")}).collect()
    got = {(p.metric, p.timestamp): p.value for p in points}
    now, periods = {}, {}
    for who, ts, _, health in sorted(rows, key=lambda r: (r[1], r[2])):
        now[who] = health
        periods[ts.replace(minute=ts.minute // 5 * 5, second=0)] = dict(now)
    assert len(got) == 2 * len(periods)
    for p, held in periods.items():
        assert got[("low", p)] == sum(h < 30 for h in held.values())
        assert got[("mean", p)] == pytest.approx(sum(held.values()) / len(held))
