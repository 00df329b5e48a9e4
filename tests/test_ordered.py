"""Ordered operators against brute force, with one key holding most rows and slices forced to be small."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import alerts as A
from tidewatch.operators import entities as E
from tidewatch.operators import ordered as O
from tidewatch.operators import telemetry as L

T0 = dt.datetime(2024, 1, 1)
HOT = {"min_rows": 50, "slice_rows": 20}


def series(seed, n=600, keys=8, span_s=20_000, ties=True):
    """Rows (id, key, ts, v): key 0 holds about half of them, some timestamps are equal."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if rnd.random() < 0.5 else rnd.randrange(1, keys)
        s = rnd.randrange(span_s) if not ties or rnd.random() < 0.8 else rnd.randrange(span_s // 50) * 50
        rows.append((i, key, T0 + dt.timedelta(seconds=s), round(rnd.uniform(0, 100), 2)))
    return pd.DataFrame(rows, columns=["id", "key", "ts", "v"])


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("reach", [1, 9, 30])
def test_row_halo_sees_the_same_rows_as_a_whole_window(spark, seed, reach):
    df = spark.createDataFrame(series(seed))
    w = Window.partitionBy("key").orderBy("ts", "id")
    frame = lambda spec: F.concat_ws(",", F.collect_list(F.col("id").cast("string")).over(spec.rowsBetween(-reach, 0)))
    plain = {r.id: r.ids for r in df.withColumn("ids", frame(w)).collect()}
    cut = O.with_row_halo(df, ["key"], "ts", ["id"], reach, **HOT)
    assert cut.where("_slice > 0").count() > 0
    got = O.without_halo(cut.withColumn("ids", frame(O.slice_window(["key"], "ts", ["id"])))).collect()
    assert len(got) == len(plain)
    assert {r.id: r.ids for r in got} == plain


def test_normal_keys_have_no_halo(spark):
    df = spark.createDataFrame(series(3))
    cut = O.with_row_halo(df, ["key"], "ts", ["id"], 9)
    assert cut.where("_halo OR _slice <> 0").count() == 0 and cut.count() == df.count()


def test_hot_null_key_is_sliced(spark):
    df = spark.createDataFrame(series(4)).withColumn("key", F.nullif("key", F.lit(0)))
    cut = O.sliced(df, ["key"], "ts", **HOT)
    assert cut.count() == df.count() and cut.where("key IS NULL").select("_slice").distinct().count() > 3


@pytest.mark.parametrize("limits", [{}, HOT])
@pytest.mark.parametrize("tolerance_s", [30, 5000])
def test_asof_forward_matches_merge_asof(spark, tolerance_s, limits):
    left, right = series(5, 400), series(6, 200).rename(columns={"id": "rid", "v": "rv"})
    got = O.asof_forward(spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "ts", tolerance_s * 1_000_000, ["rid", "rv"], ["rid"], **limits).toPandas()
    want = pd.merge_asof(left.sort_values(["ts", "id"]), right.sort_values(["ts", "rid"]), on="ts", by="key", direction="forward", tolerance=pd.Timedelta(seconds=tolerance_s))
    a = got.sort_values("id")["rid"].fillna(-1).astype(int).tolist()
    assert a == want.sort_values("id")["rid"].fillna(-1).astype(int).tolist()


def test_asof_takes_an_equal_time(spark):
    left = spark.createDataFrame([(1, "a", T0)], "id INT, key STRING, ts TIMESTAMP")
    right = spark.createDataFrame([(7, "a", T0), (8, "a", T0)], "rid INT, key STRING, ts TIMESTAMP")
    assert O.asof_forward(left, right, ["key"], "ts", 60_000_000, ["rid"], ["rid"]).first().rid == 7


@pytest.mark.parametrize("limits", [{}, HOT])
@pytest.mark.parametrize("minutes", [1, 15, 400])
def test_trailing_baseline_matches_brute_force(spark, minutes, limits):
    pdf = series(7, 500)
    df = spark.createDataFrame(pdf).withColumnsRenamed({"key": "stream_id", "v": "latency_p99"})
    got = {r.id: (r.history, r.baseline) for r in L.trailing_baseline(df, "latency_p99", minutes, **limits).collect()}
    assert len(got) == len(pdf)
    for r in pdf.itertuples():
        past = pdf[(pdf.key == r.key) & (pdf.ts < r.ts) & (pdf.ts >= r.ts - pd.Timedelta(minutes=minutes))]
        assert got[r.id][0] == len(past)
        assert got[r.id][1] == pytest.approx(past.v.mean() if len(past) else 0.0, abs=1e-9)


def test_rank_pick_and_median_are_exact(spark):
    rnd = random.Random(8)
    rows = [(g, rnd.choice([0.0, -3.5, rnd.gauss(0, 50), rnd.lognormvariate(0, 4)])) for g in "abc" for _ in range(rnd.randrange(50, 400))] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE")
    got = {r.g: r for r in A.latency_stats(df, ["g"], "x").collect()}
    medians = {r.g: r.x for r in O.group_median(df, ["g"], ["x"]).collect()}
    assert medians.pop("none") is None and len(medians) == 4
    for g in ("a", "b", "c", "one"):
        xs = sorted(x for k, x in rows if k == g)
        assert (got[g].p50, got[g].p95, got[g].p99) == tuple(xs[int(len(xs) * p)] for p in (0.5, 0.95, 0.99))
        assert medians[g] == pytest.approx(float(np.median(xs)))
    assert "none" not in got


def test_percentile_definitions_differ_by_one(spark):
    df = spark.range(1, 101).select(F.lit("op").alias("op"), F.col("id").cast("double").alias("x"), F.lit(200).alias("status"))
    a = A.latency_stats(df, ["op"], "x").first()
    b = A.latency_stats_one_based(df, ["op"], "x", F.col("status") == 200).first()
    assert (a.p50, a.p95, a.p99) == (51, 96, 100) and (b.p50, b.p95, b.p99) == (50, 95, 99)


def test_approximate_percentiles_are_close(spark):
    df = spark.range(1, 10001).select(F.lit("op").alias("op"), F.col("id").cast("double").alias("x"))
    r = A.latency_stats_approx(df, ["op"], "x").first()
    assert abs(r.p50 - 5000) < 50 and abs(r.p99 - 9900) < 50


def test_exact_rank(spark):
    df = spark.range(3000).withColumn("g", (F.col("id") % 7 == 0).cast("int"))
    key = F.pmod(F.col("id") * 2654435761, F.lit(1 << 32))
    ranked = O.exact_rank(df, ["g"], key, ["id"]).toPandas()
    for g, part in ranked.groupby("g"):
        part = part.assign(k=(part.id * 2654435761) % 2**32).sort_values(["k", "id"])
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and set(part["n"]) == {len(part)}


def _cooldown(pdf, window_s):
    sent = set()
    for _, part in pdf.sort_values(["ts", "id"]).groupby("key"):
        last = None
        for r in part.itertuples():
            if last is None or (r.ts - last).total_seconds() >= window_s:
                sent.add(r.id)
                last = r.ts
    return sent


def _alerts(spark, pdf):
    return spark.createDataFrame(pdf).select(F.col("id").alias("no"), F.lit("t").alias("alert_type"), F.col("key").alias("entity_id"), F.col("ts").alias("timestamp"))


@pytest.mark.parametrize("window_s", [60, 900, 3600])
def test_cooldown_small_keys(spark, window_s):
    pdf = series(9)
    got = {r.no for r in A.dedup_cooldown(_alerts(spark, pdf), "no", window_s * 1_000_000).collect()}
    assert got == _cooldown(pdf, window_s)


@pytest.mark.parametrize(("seed", "window_s", "span_s"), [(10, 60, 20_000), (11, 300, 20_000), (12, 700, 9_000), (13, 50, 400_000), (14, 1000, 8_000)])
def test_cooldown_hot_keys(spark, seed, window_s, span_s):
    pdf = series(seed, 700, keys=4, span_s=span_s)
    got = [r.no for r in A.dedup_cooldown(_alerts(spark, pdf), "no", window_s * 1_000_000, min_rows=100, slice_rows=25).collect()]
    assert len(got) == len(set(got)) and set(got) == _cooldown(pdf, window_s)


def test_cooldown_of_a_regular_series(spark):
    """Equal steps: entry points of different phase never meet again."""
    pdf = pd.DataFrame([(i, 0, T0 + dt.timedelta(seconds=7 * i), 0.0) for i in range(500)], columns=["id", "key", "ts", "v"])
    got = {r.no for r in A.dedup_cooldown(_alerts(spark, pdf), "no", 60_000_000, min_rows=100, slice_rows=30).collect()}
    assert got == _cooldown(pdf, 60)


def test_gap_and_cooldown_differ(spark):
    at = [(1, 0), (2, 40), (3, 70)]
    pdf = pd.DataFrame([(i, 0, T0 + dt.timedelta(minutes=600 + m), 0.0) for i, m in at], columns=["id", "key", "ts", "v"])
    a = _alerts(spark, pdf)
    assert {r.no for r in A.dedup_gap(a, ["no"]).where("is_new").collect()} == {1}
    assert {r.no for r in A.dedup_cooldown(a, "no").collect()} == {1, 3}


@pytest.mark.parametrize("limits", [{}, HOT])
@pytest.mark.parametrize("window_s", [60, 3600])
def test_gap_matches_brute_force(spark, window_s, limits):
    pdf = series(15, span_s=400_000)
    ordered = pdf.sort_values(["ts", "id"])
    gap = ordered.groupby("key")["ts"].diff().dt.total_seconds()
    want = set(ordered[gap.isna() | (gap >= window_s)]["id"])
    rows = A.dedup_gap(_alerts(spark, pdf), ["no"], window_s * 1_000_000, **limits).collect()
    assert len(rows) == len(pdf) and {r.no for r in rows if r.is_new} == want


def _market(spark, seed, n=900):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choice(["session_started", "session_completed", "ib_call_logged", "customer_health_update"])
        who = 0 if rnd.random() < 0.5 else rnd.randrange(1, 6)
        snap = kind == "customer_health_update"
        maybe = lambda x: x if rnd.random() < 0.5 else None
        rows.append((i, T0 + dt.timedelta(seconds=rnd.randrange(30_000)), kind, who, who,
                     rnd.randrange(6) if kind == "session_completed" and rnd.random() < 0.7 else None,
                     float(rnd.randrange(100)) if snap else None, maybe(rnd.randrange(8)) if snap else None,
                     maybe(rnd.randrange(20)) if snap else None, maybe(rnd.randrange(5)) if snap else None))
    schema = ("event_id LONG, ts TIMESTAMP, event_type STRING, student_id LONG, tutor_id LONG, rating INT, health_score DOUBLE, "
              "sessions_last_7_days LONG, sessions_last_30_days LONG, ib_calls_last_14_days LONG")
    return rows, spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("limits", [{}, HOT])
def test_running_rating_matches_the_recurrence(spark, limits):
    rows, df = _market(spark, 16)
    got = {r.tutor_id: (r.sessions, r.running_rating) for r in E.running_rating(df, **limits).collect()}
    state = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        if r[2] in ("session_started", "session_completed"):
            n, avg = state.get(r[4], (0, 0.0))
            n += 1
            if r[2] == "session_completed" and r[5] is not None:
                avg = (avg * (n - 1) + r[5]) / n
            state[r[4]] = (n, avg)
    assert got.keys() == state.keys()
    for k, (n, avg) in state.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(avg, abs=1e-9)


@pytest.mark.parametrize("limits", [{}, HOT])
def test_health_overlay_matches_the_fold(spark, limits):
    from tests.test_running import NEW, step

    rows, df = _market(spark, 17)
    got = {r.student_id: tuple(r)[1:] for r in E.health_overlay(df, **limits).collect()}
    names = ["event_id", "ts", "event_type", "student_id", "tutor_id", "rating", "health_score", "sessions_last_7_days", "sessions_last_30_days", "ib_calls_last_14_days"]
    state = {}
    for e in pd.DataFrame(rows, columns=names).sort_values(["ts", "event_id"]).itertuples():
        state[e.student_id] = step(state.get(e.student_id, NEW), "student", e)
    assert got == {k: (s[0], s[1], s[2], s[3], s[4], s[6]) for k, s in state.items()}


def test_keep_last_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(series(18))
    newest = O.keep_last(df, ["key"], ["ts", "id"])
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    want = series(18).sort_values(["ts", "id"]).groupby("key").tail(1).set_index("key")["id"].to_dict()
    assert {r.key: r.id for r in newest.collect()} == want


@pytest.mark.parametrize("limits", [{}, HOT])
def test_batches_hold_every_alert_once(spark, limits):
    pdf = series(19, span_s=200_000)
    b = A.batch_alerts(_alerts(spark, pdf).withColumn("severity", F.lit("info")), ["no"], "1 day", 7, **limits).collect()
    assert max(r.alert_count for r in b) <= 7
    assert sorted(a.no for r in b for a in r.alerts) == pdf.id.tolist()
    full = {(r.entity_id, r.period): r.part for r in sorted(b, key=lambda r: r.part)}
    assert all(r.alert_count == 7 for r in b if r.part < full[r.entity_id, r.period])


def test_alarm_needs_consecutive_periods(spark):
    minutes = {0: 9.0, 1: 9.0, 2: 9.0, 4: 9.0, 6: 9.0, 7: 9.0}
    points = spark.createDataFrame([("m", T0 + dt.timedelta(minutes=m, seconds=5), v) for m, v in minutes.items()], "metric STRING, timestamp TIMESTAMP, value DOUBLE")
    out = A.evaluate_alarms(points, [("a", "m", "Maximum", 60, ">", 5.0, 2)], instant("2024-01-01 00:00:00"), instant("2024-01-01 00:10:00"))
    rows = out.orderBy("period_start").collect()
    assert [r.breach for r in rows] == [True, True, True, False, True, False, True, True, False, False]
    assert [i for i, r in enumerate(rows) if r.in_alarm] == [1, 2, 7]


def test_baseline_forgets_outliers(spark):
    """One 1e18, one Infinity and one NaN per stream: counted while in reach, gone afterwards."""
    odd = {40: 1e18, 200: float("inf"), 300: float("nan"), 320: float("-inf"), 330: 1e300}
    rows = [(s * 1000 + i, s, T0 + dt.timedelta(seconds=10 * i), odd.get(i, 5.0)) for s in (1, 2) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, stream_id int, ts timestamp, latency_p99 double")
    for limits in ({}, HOT):
        got = {r.id: (r.history, r.baseline) for r in L.trailing_baseline(df, "latency_p99", 5, **limits).collect()}
        for key, s, ts, _ in rows:
            seen = [v for _, t, at, v in rows if t == s and 0 < (ts - at).total_seconds() <= 300]
            with np.errstate(invalid="ignore"):
                want = float(np.mean(seen)) if seen else 0.0
            n, mean = got[key]
            assert n == len(seen) and (np.isnan(mean) if np.isnan(want) else mean == pytest.approx(want, rel=1e-9))


def test_a_burst_is_cut_by_rows(spark):
    """99 % of a key's rows in 1 % of its time: no slice holds over twice the target."""
    rnd = random.Random(5)
    times = [rnd.uniform(500_000, 510_000) if rnd.random() < 0.99 else rnd.uniform(0, 1_000_000) for _ in range(20_000)]
    df = spark.createDataFrame([(i, 0, T0 + dt.timedelta(seconds=t)) for i, t in enumerate(times)], "id int, key int, ts timestamp")
    cut = O.sliced(df, ["key"], "ts", min_rows=1000, slice_rows=500)
    assert cut.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 1000
    order = cut.orderBy("ts", "id").select("_slice").toPandas()["_slice"]
    assert order.is_monotonic_increasing
    w = Window.partitionBy("key").orderBy("ts", "id")
    plain = {r.id: r.was for r in df.withColumn("was", F.lag("id", 9).over(w)).collect()}
    halo = O.with_row_halo(df, ["key"], "ts", ["id"], 9, min_rows=1000, slice_rows=500)
    got = O.without_halo(halo.withColumn("was", F.lag("id", 9).over(O.slice_window(["key"], "ts", ["id"]))))
    assert {r.id: r.was for r in got.collect()} == plain


def test_values_in_a_narrow_range_are_ranked_in_many_parts(spark):
    start = 1_700_000_000_000_000
    df = spark.range(50_000).select(F.lit("a").alias("g"), (F.lit(start) + F.col("id") * 2_000_003).alias("v"))
    outlier = df.unionByName(spark.createDataFrame([("a", 1)], "g string, v long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as the table is, four ranges
    try:
        for rows in (df, outlier):
            sizes = [r["count"] for r in O.dealt_counts(rows, ["g"], "v").groupBy("_part").count().collect()]
            assert len(sizes) == 4 and max(sizes) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranks = O.ranked_values(outlier, ["g"], "v").where("value > 1").agg(F.min(F.col("last_rank") - (F.col("value") - start) / 2_000_003), F.max("n")).first()
    assert ranks[0] == pytest.approx(2, abs=0.01) and ranks[1] == 50_001


def test_latency_stats_with_nan_and_infinity(spark):
    inf, nan = float("inf"), float("nan")
    values = [3.0, nan, 1.0, inf, 2.0, -inf, None, 2.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("c", nan), ("c", nan)], "g string, v double")
    got = {r.g: r for r in A.latency_stats(df, ["g"], "v").collect()}
    a = got["a"]
    assert (a["count"], a.min, a.p50) == (7, -inf, 2.0) and np.isnan(a.max) and np.isnan(a.p99) and np.isnan(a.avg)
    assert (got["b"].p50, got["b"].avg) == (7.0, 7.0) and np.isnan(got["c"].p50)


def test_cooldown_of_many_sent_alerts_is_linear(spark):
    """Every alert is sent: twice the alerts cost about twice the time, and all come back."""
    import time

    def run(n):
        df = spark.range(n).select(
            F.col("id").alias("alert_no"), F.lit("t").alias("alert_type"), F.lit("e").alias("entity_id"), F.timestamp_seconds(F.col("id") * 3600).alias("timestamp"))
        start = time.perf_counter()
        assert A.dedup_cooldown(df, "alert_no").count() == n
        return time.perf_counter() - start

    run(1000)
    assert run(80_000) < 4 * run(40_000)
