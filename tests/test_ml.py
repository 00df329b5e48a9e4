import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.expr import instant
from tidewatch.operators import ml as M
from tidewatch.operators import telemetry as L


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        "id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 37 % 101).cast("double").alias("b"),
    )
    risk = F.when(F.col("b") > 75, "critical").when(F.col("b") > 50, "high").when(F.col("b") > 25, "medium").otherwise("low")
    return M.hash_split(df.withColumns({"risk_level": risk, "score": 100 - F.col("b")}), "id").persist()


def test_classifier_learns_the_classes(spark, rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = M.risk_classifier(["a", "b"], rounds=10).fit(train)
    report = M.summary_report(M.class_report(M.confusion(model.transform(test), "label", "prediction"))).first()
    assert report.accuracy > 0.9
    top = M.feature_importance(model, ["a", "b"], spark).first()
    assert top.feature == "b"
    boosted = M.risk_classifier(["a", "b"], boosted=True, rounds=3, depth=3).fit(train)
    assert boosted.transform(test).where("label = prediction").count() > 0.9 * test.count()


def test_regressor_and_tuning(rows):
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    model = M.score_regressor(["a", "b"], "score", rounds=10).fit(train)
    r = M.regression_report(model.transform(test), "score", "prediction").first()
    assert r.rmse < 5 and r.r2 > 0.95
    assert M.tune_regressor(train, ["a", "b"], "score", depths=(2, 4), steps=(0.2,), rounds=3).bestModel.stages[-1].getOrDefault("maxDepth") == 4
    best = M.tune_classifier(train, ["a", "b"], depths=(1, 4), trees=(5,))
    assert min(best.validationMetrics) == best.validationMetrics[1]


def test_five_targets_fall_back_to_defaults(rows):
    labels = {"first_session_success": "y1", "session_velocity": "y2", "churn_risk_14d": "y3", "churn_risk_30d": "y3", "health_score": "score"}
    data = rows.withColumns({"y1": (F.col("b") > 50).cast("double"), "y2": F.col("a") / 7, "y3": (F.col("b") < 30).cast("double")})
    models = M.train_five_targets(data, ["a", "b"], labels)
    broken = data.withColumn("a", F.when(F.col("id") != 5, F.col("a")))
    scored = M.score_five_targets(broken, ["a", "b"], models)
    assert scored.count() == 600
    bad = scored.where("id = 5").first()
    assert (bad.first_session_success, bad.session_velocity, bad.churn_risk_14d, bad.churn_risk_30d, bad.health_score) == (0.5, 0.0, 0.5, 0.5, 50.0)
    good = scored.where("id = 6").first()
    assert 0 <= good.churn_risk_14d <= 1 and 0 <= good.health_score <= 100


def test_metrics_match_the_spark_evaluators(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator

    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("label"), F.when(F.col("id") % 5 == 0, 1.0).otherwise((F.col("id") % 3).cast("double")).alias("prediction"))
    got = M.summary_report(M.class_report(M.confusion(df, "label", "prediction"))).first()
    for mine, theirs in (("accuracy", "accuracy"), ("precision", "weightedPrecision"), ("recall", "weightedRecall"), ("f1", "f1")):
        assert got[mine] == pytest.approx(MulticlassClassificationEvaluator(metricName=theirs).evaluate(df))
    reg = M.regression_report(df, "label", "prediction").first()
    for mine in ("rmse", "mae", "r2"):
        assert reg[mine] == pytest.approx(RegressionEvaluator(labelCol="label", metricName=mine).evaluate(df))
    assert M.area_under_roc(df.where("label < 2"), "label", "prediction") > 0.8


def test_scaling_and_metadata(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "id INT, x DOUBLE, c DOUBLE")
    params = M.scaling_params(df, ["x", "c"])
    assert [(r.x, r.c) for r in M.standardize(df, params, ["x", "c"]).orderBy("id").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    meta = M.feature_metadata(df, {"train": df, "test": df.limit(1)}, {"g": ["x"], "h": ["c"]}).first()
    assert (meta.feature_count, meta.scaler_params.mean, meta.scaler_params.scale, meta.dataset_sizes.test) == (2, [3.0, 5.0], [1.0, 0.0], 1)
    assert len(L.STREAM_FEATURES) == 24


def test_drift(spark):
    a = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    assert M.drift(a, a, ["x"]).first().psi == pytest.approx(0.0)
    moved = M.drift(a, a.select((F.col("x") + 40).alias("x")), ["x"]).first()
    assert moved.psi > 0.5 and moved.mean_actual - moved.mean_expected == pytest.approx(40)
    reports = spark.createDataFrame([("v1", 0.92), ("v2", 0.91), ("v3", 0.88), ("v4", 0.95)], "model string, accuracy double")
    assert {r.model: r.alert for r in M.accuracy_drops(reports).collect()} == {"v1": False, "v2": False, "v3": True, "v4": False}


def test_bin_edges_are_exact(spark):
    rnd = random.Random(4)
    xs = [rnd.choice([1.0, 2.0, rnd.gauss(0, 5)]) for _ in range(501)]
    df = spark.createDataFrame([(x, -x if i % 3 else None) for i, x in enumerate(xs)], "a double, b double")
    got = {r.feature: r.edges for r in M.bin_edges(df, ["a", "b"]).collect()}
    for name, values in (("a", sorted(xs)), ("b", sorted(-x for i, x in enumerate(xs) if i % 3))):
        assert got[name] == [values[-(-len(values) * i // 10) - 1] for i in range(1, 10)]


def test_examples_look_ahead_only_for_labels(spark):
    """Features end at the as-of time, labels begin there: a change of one side's events leaves the other side alone."""
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    kinds = ["session_completed", "ib_call_logged", "customer_health_update"]
    rows = [(i, t0 + dt.timedelta(minutes=rnd.randrange(30 * 1440)), rnd.choice(kinds), rnd.randrange(4), rnd.randrange(6), rnd.randrange(20, 60), float(rnd.randrange(100))) for i in range(600)]
    schema = "event_id long, ts timestamp, event_type string, student_id long, rating int, duration_min int, health_score double"
    as_of = instant("2024-01-15 00:00:00")
    of = lambda r: {x.student_id: x.asDict() for x in M.horizon_examples(spark.createDataFrame(r, schema), [as_of]).collect()}
    cut = dt.datetime(2024, 1, 15)
    whole, past, other = of(rows), of([r for r in rows if r[1] < cut]), of([r for r in rows if r[1] >= cut or r[0] % 2])
    assert len(whole) == 4
    for s, r in whole.items():
        mine = sorted((x for x in rows if x[3] == s), key=lambda x: (x[1], x[0]))
        after = [x for x in mine if cut <= x[1] < cut + dt.timedelta(days=7)]
        done = [x for x in after if x[2] == "session_completed"]
        assert r["y_session_velocity"] == len(done) and r["y_health_score"] == [x[6] for x in after if x[2] == kinds[2]][-1]
        first = done[0][4] or None
        assert r["y_first_session_success"] == (None if first is None else float(first >= 4))
        assert r["sessions_before"] == sum(x[2] == kinds[0] and cut - dt.timedelta(days=14) <= x[1] < cut for x in mine)
        assert all(r[f] == past[s][f] for f in M.EXAMPLE_FEATURES)
        assert all(r[f"y_{t}"] == other[s][f"y_{t}"] for t in ("first_session_success", "session_velocity", "health_score", "churn_risk_30d"))


def test_report_is_written(spark, tmp_path):
    M.save_report(spark.range(1).withColumn("accuracy", F.lit(0.5)), str(tmp_path), "m")
    assert spark.read.json(str(tmp_path / "m-metrics")).first().model == "m"
