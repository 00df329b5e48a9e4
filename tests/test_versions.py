"""The versioned table, and the refresh that reads what it wrote before."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import entities as E
from tidewatch.plans import views as W
from tidewatch.plans.refresh import refresh_table, start_refresh
from tidewatch.sources.versions import Conflict, VersionedTable

SF = "/root/testdata/sf0.001"


def test_versions_follow_each_other(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/t")
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    for k in range(4):
        table.write(spark.range(k + 1), f"r{k}")
    assert [v.number for v in table.versions()] == [0, 1, 2, 3] and table.read().count() == 4 and table.read(1).count() == 2
    table.write(spark.range(9), "r3")  # done already
    assert table.read().count() == 4
    table.vacuum(2)
    assert [v.number for v in table.versions()] == [2, 3] and len(os.listdir(tmp_path / "t" / "data")) == 2


def test_two_writers_cannot_take_one_number(spark, tmp_path):
    a, b = VersionedTable(spark, f"{tmp_path}/t"), VersionedTable(spark, f"{tmp_path}/t")
    a.write(spark.range(1), "start")
    first, second = a.stage(spark.range(2)), b.stage(spark.range(3))
    a.commit(first, "a", 0)
    with pytest.raises(Conflict):
        b.commit(second, "b", 0)
    assert a.read().count() == 2 and a.current().run == "a"


def students(spark):
    return E.student_metrics(W.mkt_events(spark, SF), W.as_of())


STORED = ("churn_risk_14d", "churn_risk_30d", "session_velocity", "segment", "recommendations", "model_version", "prediction_timestamp", "first_session_success_prob")


def counting(df):
    """Predictions that say how often the entity has been scored before."""
    seen = F.coalesce(F.col("churn_risk_14d").cast("double"), F.lit(0.0)) if "churn_risk_14d" in df.columns else F.lit(0.0)
    return W.entity_predictions(df.withColumn("_seen", seen).drop(*STORED)).withColumn("churn_risk_14d", F.col("_seen") + 0.125).drop("_seen")


def test_the_second_run_sees_the_columns_of_the_first(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/entities")
    table.write(students(spark), "load")
    for k in (1, 2):
        refresh_table(table, counting, str(tmp_path), f"r{k}", instant(f"2024-01-3{k - 1} 00:00:00"))
    refresh_table(table, counting, str(tmp_path), "r2", instant("2024-01-31 00:00:00"))  # done already
    rows = table.read().collect()
    assert {float(r.churn_risk_14d) for r in rows} == {0.25} and len(rows) == students(spark).count()
    assert {str(r.prediction_timestamp) for r in rows} == {"2024-01-31 00:00:00"}
    assert {r.run for r in spark.read.parquet(f"{tmp_path}/metrics").collect()} == {"r1", "r2"}


def test_a_killed_run_leaves_the_old_version(spark, tmp_path, monkeypatch):
    from tidewatch.plans import refresh

    table = VersionedTable(spark, f"{tmp_path}/entities")
    table.write(students(spark), "load")
    refresh_table(table, counting, str(tmp_path), "r1", instant("2024-01-30 00:00:00"))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(refresh, "append_points", dies)
        with pytest.raises(KeyboardInterrupt):
            refresh_table(table, counting, str(tmp_path), "r2", instant("2024-01-31 00:00:00"))
    assert table.current().run == "r1" and {float(r.churn_risk_14d) for r in table.read().collect()} == {0.125}
    refresh_table(table, counting, str(tmp_path), "r2", instant("2024-01-31 00:00:00"))
    assert {float(r.churn_risk_14d) for r in table.read().collect()} == {0.25}
    insights = spark.read.parquet(f"{tmp_path}/insights").where("run = 'r2'")
    assert insights.count() == insights.select("entity_id").distinct().count()


def test_the_schedule_goes_on_from_its_own_result(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/entities")
    table.write(students(spark), "load")
    q = start_refresh(table, counting, str(tmp_path), f"{tmp_path}/cp", "1 second")
    try:
        deadline = time.time() + 120
        while table.current().number < 2 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        q.stop()
    v = table.current()
    assert v.number >= 2
    assert {float(r.churn_risk_14d) for r in table.read(v.number).collect()} == {min(0.125 * v.number, 1.0)}
