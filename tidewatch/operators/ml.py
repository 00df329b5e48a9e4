"""Training data, models and evaluation on Spark ML."""

from __future__ import annotations

import os

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import (
    BinaryClassificationEvaluator,
    MulticlassClassificationEvaluator,
    RegressionEvaluator,
)
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import ratio
from tidewatch.operators.ordered import exact_rank, rank_pick
from tidewatch.operators.scoring import with_prediction_defaults

SPLITS = (0.70, 0.15, 0.15)
NAMES = ("train", "validation", "test")


def portable_hash(key: Column) -> Column:
    """Multiplicative hash of an id onto 0 .. 2**32 - 1, the same in any SQL engine."""
    return F.pmod(F.pmod(key, F.lit(1 << 31)) * F.lit(2654435761), F.lit(1 << 32))


def stratified_split(df: DataFrame, label: str, key: str, order: Column | None = None) -> DataFrame:
    """Adds ``split``: exact 70 / 15 / 15 cuts inside every stratum, in hash order."""
    ranked = exact_rank(df, [label], order if order is not None else portable_hash(F.col(key)), [key])
    n, r = F.col("n"), F.col("rank")
    first, second = F.floor(n * F.lit(SPLITS[0])), F.floor(n * F.lit(SPLITS[0] + SPLITS[1]))
    split = F.when(r <= first, NAMES[0]).when(r <= second, NAMES[1]).otherwise(NAMES[2])
    return ranked.withColumn("split", split).drop("rank", "n")


def hash_split(df: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Adds ``split`` by hash bucket: deterministic, no shuffle, sizes right in expectation."""
    bucket = F.pmod(order if order is not None else portable_hash(F.col(key)), F.lit(10_000))
    a, b = int(SPLITS[0] * 10_000), int((SPLITS[0] + SPLITS[1]) * 10_000)
    return df.withColumn("split", F.when(bucket < a, NAMES[0]).when(bucket < b, NAMES[1]).otherwise(NAMES[2]))


def labelled(df: DataFrame, label: str = "risk_level") -> tuple[DataFrame, DataFrame]:
    known = F.col(label) != "unknown"
    return df.where(known), df.where(~known)


def scaling_params(train: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and population deviation per feature."""
    return train.agg(*[f(c).alias(f"{c}__{n}") for c in features for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def standardize(df: DataFrame, params: DataFrame, features: list[str], epsilon: float | None = None) -> DataFrame:
    """(x - mean) / std with the one-row ``params`` as scalar subqueries; std 0 counts as 1, or ``epsilon`` is added."""
    def scaled(c: str) -> Column:
        mean, std = F.col(f"_p.{c}__mean"), F.col(f"_p.{c}__std")
        divisor = std + F.lit(epsilon) if epsilon is not None else F.when(std == 0, 1.0).otherwise(std)
        return ((F.col(c) - mean) / divisor).alias(c)

    row = params.select(F.struct(*params.columns)).scalar()
    rest = [c for c in df.columns if c not in features]
    return df.withColumn("_p", row).select(*rest, *[scaled(c) for c in features])


def feature_metadata(train: DataFrame, sizes: dict[str, DataFrame], groups: dict[str, list[str]]) -> DataFrame:
    """One row: feature groups, scaler mean and scale in feature order, rows per split."""
    features = [f for g in groups.values() for f in g]
    stats = scaling_params(train, features)
    arrays = stats.select(
        F.array(*[F.col(f"{f}__mean") for f in features]).alias("mean"),
        F.array(*[F.col(f"{f}__std") for f in features]).alias("scale"),
    )
    counts = [sizes[k].agg(F.count(F.lit(1))).scalar().alias(k) for k in sizes]
    group_map = F.create_map(*[x for g, names in groups.items() for x in (F.lit(g), F.array(*[F.lit(n) for n in names]))])
    return arrays.select(
        F.lit(len(features)).alias("feature_count"), group_map.alias("features"),
        F.struct("mean", "scale").alias("scaler_params"), F.struct(*counts).alias("dataset_sizes"),
    )


def encode_codes(column: Column, values: list[str]) -> Column:
    """Fixed integer codes by position; null for an unknown value."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), column) - 1, F.lit(-1)).cast("int")


TIERS = ["budget", "standard", "premium"]  # fixed values, code = position
CHANNELS = ["organic", "paid_google", "paid_facebook", "referral"]
GRADES = ["elementary", "middle", "high", "college"]


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")


def label_indexer(label: str) -> StringIndexer:
    """Alphabetical label encoding."""
    return StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")


def risk_classifier(features: list[str], label: str = "risk_level", boosted: bool = False, rounds: int = 100, depth: int = 5,
                    seed: int = 42) -> Pipeline:
    """Four-class risk model: a forest, or one boosted tree model per class."""
    if boosted:
        tree = GBTClassifier(maxIter=rounds, stepSize=0.2, maxDepth=depth, subsamplingRate=0.8, seed=seed)
        model = OneVsRest(classifier=tree, labelCol="label", featuresCol="features", parallelism=4)
    else:
        model = RandomForestClassifier(numTrees=rounds, maxDepth=depth, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[label_indexer(label), _assembled(features), model])


def score_regressor(features: list[str], target: str, rounds: int = 100, depth: int = 5, seed: int = 42) -> Pipeline:
    tree = GBTRegressor(labelCol=target, maxIter=rounds, stepSize=0.2, maxDepth=depth, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[_assembled(features), tree])


def tune_regressor(train: DataFrame, features: list[str], target: str, depths=(3, 5), steps=(0.1, 0.2), rounds: int = 20):
    """Grid search on a validation share, minimising the root mean squared error."""
    pipeline = score_regressor(features, target, rounds)
    tree = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).addGrid(tree.stepSize, list(steps)).build()
    search = TrainValidationSplit(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"),
        trainRatio=0.8, parallelism=2, seed=42,
    )
    return search.fit(train)


def tune_classifier(train: DataFrame, features: list[str], label: str = "risk_level", depths=(3, 5), trees=(20, 50)):
    """Grid search minimising the multi-class log loss."""
    pipeline = risk_classifier(features, label)
    forest = pipeline.getStages()[-1]
    grid = ParamGridBuilder().addGrid(forest.maxDepth, list(depths)).addGrid(forest.numTrees, list(trees)).build()
    search = TrainValidationSplit(
        estimator=pipeline, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="logLoss"),
        trainRatio=0.8, parallelism=2, seed=42,
    )
    return search.fit(train)


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession, top: int = 10) -> DataFrame:
    """The top features of a tree model."""
    scores = model.stages[-1].featureImportances.toArray().tolist()
    return (
        spark.createDataFrame(list(zip(features, scores, strict=True)), "feature STRING, importance DOUBLE")
        .orderBy(F.desc("importance"), "feature").limit(top)
    )


PROBABILITIES = ["first_session_success", "churn_risk_14d", "churn_risk_30d"]


def train_five_targets(train: DataFrame, features: list[str], labels: dict[str, str]) -> dict[str, PipelineModel]:
    """One model per target on one shared vector. Probability targets are logistic; health is trained on 0..1."""
    data = _assembled(features).transform(train).select("features", *set(labels.values())).persist()
    models = {}
    for target, label in labels.items():
        rows = data.select("features", F.col(label).cast("double").alias("label")).where("label IS NOT NULL")
        if target in PROBABILITIES:
            rows = rows.withColumn("label", (F.col("label") > 0.5).cast("double"))
            models[target] = LogisticRegression(regParam=0.01, maxIter=50).fit(rows)
        elif target == "health_score":
            models[target] = GBTRegressor(maxIter=20, seed=42).fit(rows.withColumn("label", F.col("label") / 100))
        else:
            models[target] = LinearRegression(regParam=0.01).fit(rows)
    data.unpersist()
    return models


def score_five_targets(df: DataFrame, features: list[str], models: dict[str, object]) -> DataFrame:
    """Five predictions per row; a row whose features cannot be scored takes the conservative defaults."""
    out = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    for target, model in models.items():
        scored = model.transform(out)
        if target in PROBABILITIES:
            value = vector_to_array("probability")[1]
        elif target == "health_score":
            value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))) * 100
        else:
            value = F.greatest(F.lit(0.0), F.col("prediction"))
        kept = [c for c in out.columns if c != target]
        out = scored.withColumn("_value", F.when(~F.isnan(value), value)).select(*kept, F.col("_value").alias(target))
    return with_prediction_defaults(out.drop("features"))


def subject_regressions(per_day: DataFrame, subject: str, x: str, y: str) -> DataFrame:
    """A line per subject (slope, intercept, fit), for the supply and demand output; one aggregate for all subjects."""
    return per_day.groupBy(subject).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class from a confusion table, plus the rows it was made of."""
    hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    actual = matrix.groupBy("label").agg(F.sum("n").alias("support"), hit.alias("hits"))
    given = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = actual.join(given, "label", "full_outer").fillna(0)
    p = F.coalesce(ratio(F.col("hits"), F.col("predicted")), F.lit(0.0))
    r = F.coalesce(ratio(F.col("hits"), F.col("support")), F.lit(0.0))
    return joined.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.coalesce(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    )


def summary_report(report: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1."""
    total = F.sum("support")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), total)
    return report.agg(
        ratio(F.sum("hits"), total).alias("accuracy"), weighted("precision").alias("precision"),
        weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("rows"),
    )


def regression_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """RMSE, MAE and R2 in one pass."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (F.lit(1.0) - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"), F.count(y).alias("rows"),
    )


def area_under_roc(df: DataFrame, label: str, score: str) -> float:
    ev = BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=score, metricName="areaUnderROC")
    return ev.evaluate(df.select(F.col(label).cast("double").alias(label), F.col(score).cast("double").alias(score)))


def save_report(report: DataFrame, path: str, name: str) -> None:
    """The evaluation report, from real numbers."""
    report.withColumn("model", F.lit(name)).write.mode("overwrite").json(os.path.join(path, f"{name}-metrics"))


def dataset_profile(df: DataFrame, group: str, ranges: list[str], means: list[str]) -> DataFrame:
    """Rows, share, ranges and means per class."""
    total = df.agg(F.count(F.lit(1))).scalar()
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [f(c).alias(f"{n}_{c}") for c in ranges for n, f in (("min", F.min), ("max", F.max))]
    aggs += [F.avg(c).alias(f"avg_{c}") for c in means]
    return df.groupBy(group).agg(*aggs).withColumn("pct", ratio(F.col("n"), total) * 100)


def stacked(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, x) of every value that is not null."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features]))
    return df.select(cells.alias("_c")).select("_c.feature", "_c.x").where("x IS NOT NULL")


def bin_edges(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """The exact quantiles that cut each feature into ``bins``: (feature, edges), edge i being the value of rank ceil(n i / bins)."""
    ranks = {f"_e{i}": F.ceil(F.col("n") * i / bins) for i in range(1, bins)}
    return rank_pick(stacked(df, features), ["feature"], "x", ranks).select("feature", F.array(*ranks).alias("edges"))


def drift(expected: DataFrame, actual: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """Mean, deviation and population stability index per feature between two tables.

    Bins are cut at exact quantiles of the expected table (a value on an edge lies below it); a bin that one side leaves empty
    counts as a millionth. One row of edges for each feature meets the values, which are counted before they are shuffled."""
    edges = F.broadcast(bin_edges(expected, features, bins).select(F.col("feature").alias("_f"), "edges"))  # a row a feature

    def counted(df: DataFrame, side: str) -> DataFrame:
        cells = stacked(df, features).join(edges, F.col("feature") == F.col("_f"))
        x = F.col("x")
        return cells.groupBy("feature", F.size(F.filter("edges", lambda e: e < x)).alias("bin")).agg(
            F.count(F.lit(1)).alias(f"n_{side}"), F.sum(x).alias(f"s_{side}"), F.sum(x * x).alias(f"q_{side}"))

    every = edges.select(F.col("_f").alias("feature"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    both = every.join(counted(expected, "e"), ["feature", "bin"], "left").join(counted(actual, "a"), ["feature", "bin"], "left").fillna(0)
    totals = both.groupBy("feature").agg(*[F.sum(f"{k}_{s}").alias(f"{k}{s}") for k in "nsq" for s in "ea"])
    p = F.greatest(F.col("n_e") / F.col("ne"), F.lit(1e-6))
    q = F.greatest(F.try_divide(F.col("n_a"), F.col("na")), F.lit(1e-6))
    psi = both.join(totals, "feature").groupBy("feature").agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))
    mean = lambda s: ratio(F.col(f"s{s}"), F.col(f"n{s}"))
    dev = lambda s: F.sqrt(F.greatest(ratio(F.col(f"q{s}"), F.col(f"n{s}")) - mean(s) * mean(s), F.lit(0.0)))
    return totals.join(psi, "feature").select(
        "feature", mean("e").alias("mean_expected"), mean("a").alias("mean_actual"), dev("e").alias("std_expected"), dev("a").alias("std_actual"), "psi")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """All saved reports below a folder, one row for each model version."""
    return spark.read.json(os.path.join(path, "*-metrics"))


def accuracy_drops(reports: DataFrame, limit: float = 0.02) -> DataFrame:
    """Each model version beside the one before it (by name): how much accuracy it lost, and whether that is an alert."""
    before = F.lag("accuracy").over(Window.orderBy("model"))  # a row a version
    lost = F.col("accuracy_before") - F.col("accuracy")
    return reports.select("model", "accuracy", before.alias("accuracy_before")).withColumns({"lost": lost, "alert": F.coalesce(lost > limit, F.lit(False))})


# what happened after the as-of time, by the target it is the label of
OUTCOMES = ["first_session_success", "session_velocity", "churn_risk_14d", "churn_risk_30d", "health_score"]


def horizon_examples(events: DataFrame, as_ofs: list[Column], lookback: int = 14, horizon: int = 7) -> DataFrame:
    """One row for each student and as-of time: what had been seen in the ``lookback`` days before, and as labels what came in
    the ``horizon`` days from then on.

    Labels: whether the first session afterwards was rated 4 or better (none without a rating), sessions a week, whether
    sessions fell to less than half their former pace, whether the student called at least as often as there are days in
    the horizon, and the last health score seen (none without one). Every event meets the as-of times it matters to; one
    shuffle by student and time makes all columns."""
    day = 86_400_000_000
    us = F.unix_micros("ts")
    near = F.filter(F.array(*as_ofs), lambda a: (us >= F.unix_micros(a) - lookback * day) & (us < F.unix_micros(a) + horizon * day))
    rows = events.where(F.col("student_id").isNotNull()).withColumn("as_of", F.explode(near))
    past = F.col("ts") < F.col("as_of")
    of = lambda kind: F.col("event_type") == kind
    age = F.floor((F.unix_micros("as_of") - us) / day)
    done, call, health = of("session_completed"), of("ib_call_logged"), of("customer_health_update") & F.col("health_score").isNotNull()
    at = F.struct("ts", "event_id")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    rated = F.nullif(F.col("rating"), F.lit(0))
    out = rows.groupBy("student_id", "as_of").agg(
        n(done & past & (age < 7)).alias("sessions_7d"), n(done & past).alias("sessions_before"), n(call & past & (age < 7)).alias("calls_7d"), n(call & past).alias("calls_before"),
        F.avg(F.when(done & past, rated)).alias("avg_rating"), F.max(F.when(health & past, F.struct(at, F.col("health_score").alias("v")))).alias("_h0"),
        F.min(F.when(done & past, age)).alias("days_since_last_session"), F.avg(F.when(done & past, F.col("duration_min"))).alias("avg_duration"),
        n(done & ~past).alias("_sessions"), n(call & ~past).alias("_calls"), F.min(F.when(done & ~past, F.struct(at, rated.alias("v")))).alias("_first"),
        F.max(F.when(health & ~past, F.struct(at, F.col("health_score").alias("v")))).alias("_h1"), F.count_if(past).alias("_seen"))
    pace = F.col("_sessions") / horizon
    return out.where("_seen > 0").select(
        "student_id", "as_of", "sessions_7d", "sessions_before", "calls_7d", "calls_before", F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce(F.col("_h0.v"), F.lit(100.0)).alias("health_before"), F.coalesce("days_since_last_session", F.lit(lookback)).alias("days_since_last_session"),
        F.coalesce("avg_duration", F.lit(0.0)).alias("avg_duration"),
        (F.col("_first.v") >= 4).cast("double").alias("y_first_session_success"), (pace * 7).alias("y_session_velocity"),
        (pace < F.col("sessions_before") / lookback / 2).cast("double").alias("y_churn_risk_14d"), (F.col("_calls") >= horizon).cast("double").alias("y_churn_risk_30d"),
        F.col("_h1.v").alias("y_health_score"))


EXAMPLE_FEATURES = ["sessions_7d", "sessions_before", "calls_7d", "calls_before", "avg_rating", "health_before", "days_since_last_session", "avg_duration"]


def holdout_report(train: DataFrame, test: DataFrame, features: list[str] = EXAMPLE_FEATURES) -> DataFrame:
    """The five models, fitted on ``train`` and judged on ``test``: rows with a label, mean squared error of the predictions
    and of the training mean, and for probabilities the area under the curve."""
    models = train_five_targets(train, features, {t: f"y_{t}" for t in OUTCOMES})
    scored = score_five_targets(test.select("student_id", "as_of", F.lit("student").alias("entity_type"), *features, *[f"y_{t}" for t in OUTCOMES]), features, models).persist()
    means = train.agg(*[F.avg(f"y_{t}").alias(t) for t in OUTCOMES]).first()
    rows = None
    for t in OUTCOMES:
        known = scored.where(F.col(f"y_{t}").isNotNull())
        y, p = F.col(f"y_{t}"), F.col(t)
        mean = F.lit(means[t]).cast("double")
        auc = F.lit(area_under_roc(known, f"y_{t}", t)) if t in PROBABILITIES and known.select(y).distinct().count() > 1 else F.lit(None).cast("double")
        one = known.agg(F.lit(t).alias("target"), F.count(F.lit(1)).alias("rows"), F.avg(y).alias("mean_outcome"), F.avg((p - y) * (p - y)).alias("mse"),
                        F.avg((mean - y) * (mean - y)).alias("mse_of_mean")).withColumn("auc", auc)
        rows = one if rows is None else rows.unionByName(one)
    return rows
