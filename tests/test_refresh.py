from tidewatch.functions.expr import instant
from tidewatch.operators import entities as E
from tidewatch.plans import views as W
from tidewatch.plans.refresh import refresh_predictions

SF = "/root/testdata/sf0.001"


def test_one_run_writes_all_three_outputs_and_can_be_repeated(spark, tmp_path):
    students = E.student_metrics(W.mkt_events(spark, SF), W.as_of())
    path = str(tmp_path)
    for _ in range(2):
        refresh_predictions(students, W.entity_predictions, path, "r1", instant("2024-01-31 00:00:00"))
    table = spark.read.parquet(f"{path}/entities/run=r1")
    assert table.count() == students.count() and {"segment", "sessions_7d", "churn_risk_14d", "recommendations"} <= set(table.columns)
    insights = spark.read.parquet(f"{path}/insights")
    assert insights.count() == insights.select("entity_id").distinct().count() >= 2 * students.count()
    points = {r.metric_name: r.value for r in spark.read.parquet(f"{path}/metrics").collect()}
    assert points["TotalCustomersProcessed"] == students.count() and len(points) == 7


def test_unscored_rows_take_the_defaults(spark, tmp_path):
    students = E.student_metrics(W.mkt_events(spark, SF), W.as_of())
    broken = lambda df: W.entity_predictions(df).withColumn("session_velocity", W.F.lit(None).cast("double"))
    refresh_predictions(students, broken, str(tmp_path), "r1", instant("2024-01-31 00:00:00"))
    table = spark.read.parquet(f"{tmp_path}/entities/run=r1")
    assert {(float(r.churn_risk_14d), r.segment) for r in table.collect()} == {(0.5, "at_risk")}
