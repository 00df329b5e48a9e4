import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import telemetry as L
from tidewatch.schemas import TABLES
from tidewatch.sources import readers as R
from tidewatch.sources import writers as Wr

AT = "2024-03-05 07:08:09"


def test_jsonl_is_read_at_any_depth(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (deep / "x.jsonl").write_text('{"n":1}\n{"n":2}\n')
    (tmp_path / "y.jsonl").write_text('{"n":3}\n')
    (tmp_path / "z.txt").write_text("no")
    assert sorted(r.n for r in R.jsonl(spark, str(tmp_path), "n INT").collect()) == [1, 2, 3]
    empty = tmp_path / "empty"
    empty.mkdir()
    (empty / "z.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        R.jsonl(spark, str(empty), "n INT")


def bundle(tmp_path):
    meta = {"read_iops": 60, "write_iops": 40, "total_iops": 100, "avg_latency": 2, "p95_latency": 3, "p99_latency": 5, "bandwidth_mbps": 10,
            "error_rate": 0.01, "access_pattern": "sequential", "queue_depth": 4, "io_size_kb": 8}
    rec = lambda i, **kw: {"insightId": f"i{i}", "deviceId": "d", "timestamp": 1704067200000 + i * 1000, "value": 1.0 * i, "metadata": meta} | kw
    data = {"labeled_data": [rec(1, riskLevel="low", performanceScore=90.0), rec(2, riskLevel="high", performanceScore=10.0)], "unlabeled_data": [rec(3)]}
    (tmp_path / "raw.json").write_text(json.dumps(data))
    return str(tmp_path / "raw.json")


def test_bundle_to_features(spark, tmp_path):
    df = R.telemetry_bundle(spark, bundle(tmp_path))
    assert {(r.insight_id, r.risk_level, r.performance_score) for r in df.collect()} == {("i1", "low", 90.0), ("i2", "high", 10.0), ("i3", "unknown", -1.0)}
    f = L.telemetry_features(df).orderBy("ts").collect()
    assert len(L.TELEMETRY_FEATURES) == 25 and f[0].iops_variance is None and f[0].latency_spike_count == 1 and f[2].trend_score == 1.0
    assert f[0].hour_of_day == 0 and f[0].day_of_week == 0  # 2024-01-01 was a Monday


def test_latest_file_and_roles(spark, tmp_path):
    for i, name in enumerate(["train-1.csv", "train-2.csv", "validation-1.csv", "test-1.csv"]):
        (tmp_path / name).write_text("a\n1\n")
        os.utime(tmp_path / name, (time.time() - 1000 + i * 100,) * 2)
    assert R.latest_file(spark, str(tmp_path)).endswith("test-1.csv")
    assert R.latest_by_role(spark, str(tmp_path))["train"].endswith("train-2.csv")
    with pytest.raises(FileNotFoundError, match="test"):
        os.utime(tmp_path / "test-1.csv")
        (tmp_path / "sub").mkdir()
        (tmp_path / "sub" / "train-9.csv").write_text("a\n")
        R.latest_by_role(spark, str(tmp_path / "sub"))


def test_entity_scan_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([("a", "student"), ("b", "tutor")], "entity_id STRING, entity_type STRING")
    Wr.write_entities(df, str(tmp_path / "e"))
    got = R.entities(spark, str(tmp_path / "e"), "tutor")
    assert [r.entity_id for r in got.collect()] == ["b"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(entity_type" in plan


def test_time_range_reaches_the_scan(spark):
    df = R.table(spark, "/root/testdata/sf0.001/events.parquet", TABLES["events"])
    got = R.time_range(df, "ts", instant("2024-01-05 00:00:00"), instant("2024-01-06 00:00:00"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and 0 < got.count() < df.count()


def test_archive_keeps_leading_zeros_and_replaces_a_retried_batch(spark, tmp_path):
    path = str(tmp_path / "arch")
    rows = spark.createDataFrame([("{bad",), ('{"a":1}',)], "raw STRING")
    for _ in range(2):
        Wr.archive_raw(rows, path, instant(AT), 4)
    Wr.archive_raw(rows, path, instant(AT), 5)
    back = Wr.read_archive(spark, path).collect()
    assert len(back) == 4 and {(r.year, r.month, r.day, r.hour) for r in back} == {("2024", "03", "05", "07")}


def test_state_log_compacts_to_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "state")
    schema = "entity_id STRING, entity_type STRING, ts INT, v INT"
    batches = [[("a", "t", 1, 1), ("a", "t", 2, 2), ("b", "t", 1, 1)], [("a", "t", 3, 3)], [("c", "t", 1, 9)]]
    for i, b in enumerate(batches):
        Wr.append_state(spark.createDataFrame(b, schema), path, i, ["ts"])
    Wr.append_state(spark.createDataFrame(batches[1], schema), path, 1, ["ts"])  # a retry
    now = lambda: {(r.entity_id, r.v) for r in Wr.read_state(spark, path, ["ts"]).collect()}
    assert now() == {("a", 3), ("b", 1), ("c", 9)}
    assert Wr.compact_state(spark, path, ["ts"]) == 2 and now() == {("a", 3), ("b", 1), ("c", 9)}
    Wr.append_state(spark.createDataFrame([("b", "t", 5, 7)], schema), path, 3, ["ts"])
    assert now() == {("a", 3), ("b", 7), ("c", 9)}


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(i, f'say "{i}", ok', "x") for i in range(250)], "id INT, text STRING, segment STRING").coalesce(1)
    Wr.export_json(df, str(tmp_path / "j"), 100)
    assert len([f for f in os.listdir(tmp_path / "j") if f.endswith(".json")]) == 3
    Wr.export_csv(df, str(tmp_path / "c"), ("segment",))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c"))
    assert back.columns == ["id", "text"] and back.where("id = '7'").first().text == 'say "7", ok'
    Wr.export_manifest(spark, str(tmp_path / "m"), "metrics", "exports/", "json", df, instant(AT))
    m = spark.read.json(str(tmp_path / "m" / "manifest")).first()
    assert (m.table_name, m.row_count) == ("metrics", 250)
    Wr.write_jsonl(df, str(tmp_path / "l"))
    Wr.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "l")).count() == spark.read.parquet(str(tmp_path / "p")).count() == 250


def test_split_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, ["train", "validation", "test"][i % 3]) for i in range(9)], "id INT, split STRING")
    Wr.write_splits(df, str(tmp_path))
    for name in ("train", "validation", "test"):
        assert spark.read.option("header", True).csv(str(tmp_path / f"{name}.csv")).count() == 3 == spark.read.json(str(tmp_path / f"{name}.json")).count()


def test_severity_folders_and_runs(spark, tmp_path):
    from tidewatch.operators.alerts import write_by_severity

    a = spark.createDataFrame([("x", "critical"), ("y", "info")], "id STRING, severity STRING")
    write_by_severity(a, str(tmp_path))
    assert sorted(f for f in os.listdir(tmp_path / "alerts") if f.startswith("severity")) == ["severity=critical", "severity=info"]
    pts = spark.createDataFrame([("m", 1.0)], "metric_name STRING, value DOUBLE")
    for _ in range(2):
        Wr.append_points(pts, str(tmp_path / "pts"), "r1")
        Wr.write_insights(pts, str(tmp_path / "ins"), "r1")
    assert spark.read.parquet(str(tmp_path / "pts")).count() == spark.read.parquet(str(tmp_path / "ins")).count() == 1


def test_quarantine_keeps_the_raw_text(spark, tmp_path):
    from tidewatch.operators.validate import decode_records, split_valid, validate_events

    df = spark.createDataFrame([(1, "e2JhZA=="), (2, "eyJhIjoxfQ==")], "event_id LONG, data STRING")
    _, rejected = split_valid(validate_events(decode_records(df)))
    Wr.quarantine(rejected, str(tmp_path / "q"), 0)
    back = spark.read.parquet(str(tmp_path / "q")).orderBy("event_id").collect()
    assert [r.raw for r in back] == ["{bad", '{"a":1}'] and back[0].errors[0].field == "raw_data"


def test_columnar_archive_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, dt.datetime(2024, 3, 5, 7, 8))], "event_id LONG, ts TIMESTAMP").write.parquet(str(src))
    stream = spark.readStream.schema("event_id LONG, ts TIMESTAMP").parquet(str(src))
    Wr.archive_columns(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "ts").trigger(availableNow=True).start().awaitTermination()
    assert os.path.isdir(tmp_path / "out" / "year=2024" / "month=03" / "day=05" / "hour=07")
    assert spark.read.parquet(str(tmp_path / "out")).select(F.count("*")).first()[0] == 1
