"""No caps: long windows, bad page tokens, unknown subjects, long unreadable answers, ties in merges."""

import datetime as dt

from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import entities as E
from tidewatch.operators import insights as I
from tidewatch.operators import scoring as S

T0 = dt.datetime(2024, 1, 31, 12)


def test_ninety_active_days_count_ninety(spark):
    rows = [(1, T0 - dt.timedelta(days=d, hours=1), "login") for d in range(90) for _ in range(2)]
    df = spark.createDataFrame(rows, "customer_id int, ts timestamp, activity string")
    for name, kind in (("status", "string"), ("duration_min", "double"), ("call_seconds", "double"), ("escalated", "boolean"), ("paid", "boolean"), ("amount", "double")):
        df = df.withColumn(name, F.lit(None).cast(kind))
    r = E.window_catalogue(df, instant("2024-01-31 12:00:00"), (7, 62, 63, 64, 90, 200)).first()
    assert [r[f"days_active_{d}d"] for d in (7, 62, 63, 64, 90, 200)] == [7, 62, 63, 64, 90, 90]


def test_a_token_with_a_bad_time_is_ignored(spark):
    rows = [(i, T0 + dt.timedelta(minutes=i)) for i in range(5)]
    df = spark.createDataFrame(rows, "alert_id long, timestamp timestamp")
    for token in (I.page_token("not a time", 3), I.page_token("", 3), "%%%", I.page_token(None, 3)):
        assert [r.alert_id for r in I.page(df, 3, token).collect()] == [4, 3, 2]
    good = I.page_token("2024-01-31 12:03:00.000000", 3)
    assert [r.alert_id for r in I.page(df, 3, good).collect()] == [2, 1, 0]


def test_unknown_subjects_are_listed(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("z", 3.0), ("y", None)], "subject string, supply_demand_ratio double")
    r = E.supply_demand_wide(df, ["a", "b", "c"]).first()
    assert (r.a, r.b, r.c, [x.subject for x in r.other_subjects]) == (1.0, 2.0, None, ["y", "z"])


def test_unreadable_answers_stay_whole(spark):
    text = "no json " * 200
    df = spark.createDataFrame([(text,)], "response string")
    assert S.parse_responses(df).first().explanation == text
    assert S.parse_responses(df, unreadable_chars=10).first().explanation == text[:10]


def test_merge_takes_the_same_row_whatever_the_order(spark):
    rows = [("a", "x"), ("a", "b"), ("c", "q")]
    old = spark.createDataFrame([("c", "kept")], "alert_id string, text string")
    for order in (rows, rows[::-1]):
        got = {(r.alert_id, r.text, r.is_new) for r in I.merge_unique(spark.createDataFrame(order, "alert_id string, text string"), old).collect()}
        assert got == {("a", "b", True), ("c", "kept", True)}  # listed among the new, content known
