"""Telemetry features: rolling statistics, trends, baselines, auto-labels, triggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expr import clamp, fixed, keep
from tidewatch.operators.ordered import (
    group_median,
    hot_keys,
    keep_first,
    slice_window,
    sliced,
    with_row_halo,
    without_halo,
)

MINUTE_US = 60_000_000


def rolling_device_features(df: DataFrame, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Rolling deviation over 10 samples, first difference and error trend per device: one sort for all."""
    keys, tie = ["device_id"], ["insight_id"]
    rows = with_row_halo(df, keys, "ts", tie, 9, min_rows, slice_rows)
    w = slice_window(keys, "ts", tie)
    last10 = w.rowsBetween(-9, 0)
    step = F.col("error_rate") - F.lag("error_rate").over(w)
    out = rows.withColumns({
        "iops_variance": F.stddev_samp("value").over(last10),
        "throughput_variance": F.stddev_samp("throughput").over(last10),
        "io_size_variance": F.stddev_samp("io_size_kb").over(last10),
        "trend_score": F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0)),
        "error_trend": F.when(step > 0.001, 1).when(step < -0.001, -1).otherwise(0),
    })
    return without_halo(out)


def device_anomaly(df: DataFrame) -> DataFrame:
    """|x - device mean| / (device deviation + 1); the statistics are one row per device, joined back."""
    stats = df.groupBy("device_id").agg(
        F.avg("value").alias("device_mean"), F.stddev_samp("value").alias("device_std")
    )
    return df.join(stats, "device_id").withColumn(
        "anomaly_score", F.abs(F.col("value") - F.col("device_mean")) / (F.col("device_std") + 1)
    )


def row_features(df: DataFrame) -> DataFrame:
    """Features that need only their own sample."""
    c = F.col
    return df.withColumns({
        "total_iops": c("iops"), "avg_latency": c("latency"), "bandwidth_mbps": c("throughput"), "io_size_avg": c("io_size_kb"),
        "latency_spike_count": (c("p99_latency") > 2 * c("latency")).cast("int"),
        "hour_of_day": F.hour("ts"),
        "day_of_week": F.weekday("ts"),
        "time_since_last_alert": F.lit(24.0),
        "sequential_access_ratio": F.when(c("access_pattern") == "sequential", 1.0).otherwise(0.0),
        "random_access_ratio": F.when(c("access_pattern") == "sequential", 0.0).otherwise(1.0),
        "iops_per_latency": c("iops") / (c("latency") + 1),
        "load_factor": c("iops") / 15000.0,
        "efficiency_ratio": c("throughput") / (c("iops") + 1),
        "risk_level": F.coalesce("risk_level", F.lit("unknown")),
        "performance_score": F.coalesce("performance_score", F.lit(-1.0)),
    })


FEATURE_GROUPS = {
    # fixed values: the training file's columns by group
    "iops_metrics": ["read_iops", "write_iops", "total_iops", "iops_variance"],
    "latency": ["avg_latency", "p95_latency", "p99_latency", "latency_spike_count"],
    "throughput": ["bandwidth_mbps", "throughput_variance"],
    "error_rates": ["error_rate", "error_trend"],
    "time_based": ["hour_of_day", "day_of_week", "time_since_last_alert"],
    "pattern": ["sequential_access_ratio", "random_access_ratio"],
    "device": ["queue_depth", "io_size_avg", "io_size_variance"],
    "derived": ["iops_per_latency", "anomaly_score", "trend_score", "load_factor", "efficiency_ratio"],
}
TELEMETRY_FEATURES = [name for names in FEATURE_GROUPS.values() for name in names]


def telemetry_features(df: DataFrame, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """The 25 training features with labels and identifiers."""
    full = row_features(rolling_device_features(device_anomaly(df), min_rows, slice_rows))
    return full.select(*TELEMETRY_FEATURES, "risk_level", "performance_score", "insight_id", "device_id", "ts")


def serving_features(df: DataFrame) -> DataFrame:
    """25 features estimated from the 8 raw metrics of one sample; hour and weekday come from the sample's time."""
    iops, lat, err, thr = (F.col(c) for c in ("iops", "latency", "error_rate", "throughput"))
    slow = lat > 10
    return df.withColumns({
        "read_iops": F.floor(iops * 0.6), "write_iops": F.floor(iops * 0.4), "total_iops": iops,
        "iops_variance": F.floor(iops * 0.15),
        "avg_latency": lat, "p95_latency": lat * 2.5, "p99_latency": lat * 5,
        "latency_spike_count": F.when(slow, 3).otherwise(0),
        "bandwidth_mbps": thr, "throughput_variance": F.floor(thr * 0.1),
        "error_trend": F.when(err > 1, 0.5).otherwise(-0.2),
        "hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts"), "time_since_last_alert": F.lit(3600),
        "sequential_access_ratio": F.lit(0.7), "random_access_ratio": F.lit(0.3),
        "io_size_avg": F.lit(128), "io_size_variance": F.lit(32),
        "iops_per_latency": F.when(lat > 0, iops / lat).otherwise(0.0),
        "anomaly_score": err * 2 + F.when(slow, 3.0).otherwise(0.0),
        "trend_score": F.when(iops > 80000, 7).otherwise(3) + F.when(lat > 15, 2).otherwise(0),
        "capacity_utilization": F.least(iops / 150000, F.lit(1.0)),
        "workload_type": F.when(iops > 100000, 2).when(slow, 1).otherwise(0),
    })


SERVING_ORDER = [
    # fixed values: column order of a scoring request, True where two decimals are written
    ("read_iops", False), ("write_iops", False), ("total_iops", False), ("iops_variance", False),
    ("avg_latency", True), ("p95_latency", True), ("p99_latency", True), ("latency_spike_count", False),
    ("bandwidth_mbps", False), ("throughput_variance", False), ("error_rate", True), ("error_trend", True),
    ("hour_of_day", False), ("day_of_week", False), ("time_since_last_alert", False),
    ("sequential_access_ratio", True), ("random_access_ratio", True), ("queue_depth", False),
    ("io_size_avg", False), ("io_size_variance", False), ("iops_per_latency", True), ("anomaly_score", True),
    ("trend_score", True), ("capacity_utilization", True), ("workload_type", False),
]


def feature_csv(df: DataFrame) -> DataFrame:
    """One comma separated text per sample."""
    cells = [fixed(F.col(c).cast("double"), 2, "up") if two else F.col(c).cast("string") for c, two in SERVING_ORDER]
    return df.withColumn("features_csv", F.concat_ws(",", *cells))


def rolling_means(df: DataFrame, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Rolling mean and deviation over 5, 15 and 60 samples per stream, plus rates of change."""
    keys, tie = ["stream_id"], ["metric_id"]
    rows = with_row_halo(df, keys, "ts", tie, 59, min_rows, slice_rows)
    w = slice_window(keys, "ts", tie)

    def last(n: int):
        return w.rowsBetween(-(n - 1), 0)

    lat = F.col("latency_p99")
    rate, previous = lat - F.lag(lat).over(w), F.lag(lat).over(w) - F.lag(lat, 2).over(w)
    out = rows.withColumns({
        "latency_p99_5m_avg": F.avg(lat).over(last(5)),
        "utilization_5m_avg": F.avg("utilization").over(last(5)),
        "latency_p99_5m_std": F.stddev_samp(lat).over(last(5)),
        "latency_p99_15m_avg": F.avg(lat).over(last(15)),
        "latency_p99_1h_avg": F.avg(lat).over(last(60)),
        "latency_p99_rate": rate,
        "utilization_rate": F.col("utilization") - F.lag("utilization").over(w),
        "latency_p99_accel": rate - previous,
    })
    return without_halo(out)


BASELINE_COLUMNS = ["latency_p99", "utilization", "error_rate", "bandwidth_gbps"]


def stream_baselines(df: DataFrame) -> DataFrame:
    """Exact median per stream, one row per stream."""
    medians = group_median(df, ["stream_id"], BASELINE_COLUMNS)
    return medians.select("stream_id", *[F.col(c).alias(f"{c}_baseline") for c in BASELINE_COLUMNS])


def with_baselines(df: DataFrame, baselines: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Baselines joined back. With ``defaults`` a stream without a baseline keeps its rows."""
    joined = df.join(baselines, "stream_id", "left" if defaults else "inner")
    return joined.fillna({f"{k}_baseline": v for k, v in (defaults or {}).items()}) if defaults else joined


def baseline_deltas(df: DataFrame) -> DataFrame:
    c = F.col
    pct = lambda x: F.try_divide(c(x) - c(f"{x}_baseline"), c(f"{x}_baseline")) * 100
    return df.withColumns({
        "latency_p99_delta_pct": pct("latency_p99"),
        "utilization_delta_pct": c("utilization") - c("utilization_baseline"),
        "bandwidth_delta_pct": pct("bandwidth_gbps"),
        "latency_p99_delta_abs": c("latency_p99") - c("latency_p99_baseline"),
    })


def time_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "hour": F.hour("ts"), "day_of_week": F.weekday("ts"),
        "is_weekend": (F.weekday("ts") >= 5).cast("int"),
        "is_business_hours": F.hour("ts").between(8, 18).cast("int"),
    })


def interactions(df: DataFrame) -> DataFrame:
    c = F.col
    load = c("utilization") * 0.4 + clamp(c("latency_p99_delta_pct"), 0.0, 100.0) * 0.3 + c("error_rate") * 1000 * 0.3
    return df.withColumns({
        "latency_x_utilization": c("latency_p99") * c("utilization") / 100,
        "error_x_bandwidth": c("error_rate") * c("bandwidth_gbps"),
        "health_score": F.lit(100) - clamp(load, 0.0, 100.0),
    })


STREAM_FEATURES = [
    # fixed values: training columns of the stream model
    "latency_p99", "utilization", "error_rate", "bandwidth_gbps", "qp_errors",
    "latency_p99_5m_avg", "latency_p99_5m_std", "latency_p99_15m_avg", "latency_p99_1h_avg", "utilization_5m_avg",
    "latency_p99_delta_pct", "latency_p99_delta_abs", "utilization_delta_pct", "bandwidth_delta_pct",
    "latency_p99_rate", "latency_p99_accel", "utilization_rate",
    "hour", "day_of_week", "is_weekend", "is_business_hours",
    "latency_x_utilization", "error_x_bandwidth", "health_score",
]


def stream_features(df: DataFrame) -> DataFrame:
    """All stream features; rows with any missing feature are dropped, as training needs."""
    full = interactions(time_features(baseline_deltas(with_baselines(rolling_means(df), stream_baselines(df)))))
    return full.dropna(subset=STREAM_FEATURES)


def trailing_baseline(df: DataFrame, value: str, minutes: int = 15, min_rows: int | None = None,
                      slice_rows: int | None = None) -> DataFrame:
    """Mean of the stream's values in the ``minutes`` before each row, without the row itself; 0 without history. A missing
    value counts as 0.

    Time is cut into blocks as long as the reach, so a row's interval is the end of the block before and the start of its
    own. Each block holds a copy of the block before it, moved on by the reach: a row's interval is then what has come of
    its own block, and what is still to come of the moved copy. Both are running sums that only ever add, so tiny, huge and
    infinite values and NaN give what one plain window gives, at a cost per row that doesn't depend on the interval. A block
    with very many rows is sliced, and sums are carried into its slices from either side.
    """
    reach = minutes * MINUTE_US
    cols = df.columns
    us = F.unix_micros("ts")
    v = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    own = F.struct(us.alias("_us"), F.floor(us / reach).alias("_block"), F.lit(True).alias("_own"), F.struct(*cols).alias("_row"))
    moved = F.struct((us + reach).alias("_us"), (F.floor(us / reach) + 1).alias("_block"), F.lit(False).alias("_own"), F.lit(None).alias("_row"))
    both = df.select("stream_id", v.alias("_v"), F.explode(F.array(own, moved)).alias("_c")).select("stream_id", "_v", "_c.*")
    keys = ["stream_id", "_block"]
    both = both.withColumns({"ts": F.timestamp_micros("_us"), "_past": F.when(F.col("_own"), F.col("_v")), "_kept": F.when(~F.col("_own"), F.col("_v"))})
    # a block has at most its stream's rows, so blocks are counted for streams with many rows only
    large = hot_keys(df, ["stream_id"], "ts", min_rows, slice_rows)
    counted = both.join(F.broadcast(large), both["stream_id"].eqNullSafe(large["_hot_stream_id"]), "left_semi")
    rows = sliced(both, keys, "ts", min_rows, slice_rows, counted)
    # sums carried into a slice: of the own rows from earlier slices, of the moved rows from later ones
    whole = rows.where("_hot").groupBy(*keys, "_slice").agg(*[f(c).alias(f"_{n}{c}") for c in ("_past", "_kept") for n, f in (("s", F.sum), ("n", F.count))])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "_slice", *[F.sum(f"_{n}{c}").over(w).alias(f"_{n}{c}_in") for c, w in (("_past", earlier), ("_kept", later)) for n in "sn"])
    before = Window.partitionBy(*keys, "_slice").orderBy("_us").rangeBetween(Window.unboundedPreceding, -1)
    still = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_us")).rangeBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_{n}{c}": f(c).over(w) for c, w in (("_past", before), ("_kept", still)) for n, f in (("s", F.sum), ("n", F.count))}).where("_row IS NOT NULL")
    total = inside.join(carried, [*keys, "_slice"], "left")
    add = lambda n: sum((F.coalesce(f"_{n}{c}{x}", F.lit(0)) for c in ("_past", "_kept") for x in ("", "_in")), F.lit(0))
    n = add("n").cast("long")
    return total.select("_row.*", n.alias("history"), F.when(n > 0, add("s") / n).otherwise(0.0).alias("baseline"))


def above_baseline(value: Column, baseline: Column, factor: float = 1.5) -> Column:
    return value > baseline * factor


def needs_analysis(df: DataFrame) -> Column:
    """Any of: busy, slow against the baseline, failing, or moving by more than 20 percent."""
    c = F.col
    return F.coalesce(
        (c("utilization") > 80) | (c("latency_p99") > c("latency_p99_baseline") * 2) | (c("error_rate") > 0.05)
        | (F.abs(c("latency_p99_delta_pct")) > 20),
        F.lit(False),
    )


def looks_normal(df: DataFrame) -> Column:
    c = F.col
    return c("utilization").between(40, 70) & (c("latency_p99") < c("latency_p99_baseline") * 2) & (c("error_rate") < 0.01)


DEFAULT_BASELINE = {"latency_p99": 5.0, "utilization": 60.0, "bandwidth_gbps": 100.0}


def auto_label(df: DataFrame) -> DataFrame:
    """Nine ordered rules give type, risk and confidence; the rest goes to review. Needs the baseline columns."""
    c = F.col
    util, lat, err, qp = c("utilization"), c("latency_p99"), c("error_rate"), c("qp_errors")
    base, rise = c("latency_p99_baseline"), F.try_divide(c("latency_p99") - c("latency_p99_baseline"), c("latency_p99_baseline"))
    share = F.try_divide(c("bandwidth_gbps"), c("bandwidth_gbps_baseline"))

    def label(name: str, risk: Column | int, confidence: float) -> Column:
        risk = F.lit(risk) if isinstance(risk, int) else F.least(F.lit(100), risk)
        return F.struct(F.lit(name).alias("type"), risk.cast("int").alias("risk"), F.lit(confidence).alias("confidence"))

    none = F.struct(F.lit(None).cast("string").alias("type"), F.lit(0).alias("risk"), F.lit(0.0).alias("confidence"))
    rule = (
        F.when(util > 90, label("resource_saturation", 70 + (util - 90) * 3, 0.95))
        .when(qp > 100, label("qp_error_rate_high", 60 + qp / 10, 0.90))
        .when((err > 0.05) & (lat > base * 4), label("rdma_timeout", 95, 0.92))
        .when(rise > 0.5, label("performance_degradation", 60 + rise * 60, 0.85))
        .when(err > 0.02, label("packet_loss_detected", 50 + err * 1000, 0.88))
        .when((rise > 0.3) & (rise <= 0.5), label("latency_spike", 70, 0.80))
        .when(share < 0.7, label("bandwidth_throttling", 60 + (1 - share) * 50, 0.75))
        .when((err > 0.01) & (err <= 0.02), label("connection_instability", 65, 0.82))
        .when((util > 80) | (rise > 0.2) | (err > 0.005), label("anomaly_detected", 55, 0.65))
        .otherwise(none)
    )
    return df.withColumn("_l", rule).withColumns({
        "prediction_type": c("_l.type"), "risk_score": c("_l.risk"), "label_confidence": c("_l.confidence"),
        "needs_review": c("_l.type").isNull() | (c("_l.confidence") < 0.75),
    }).drop("_l")


def label_coverage(labelled: DataFrame) -> DataFrame:
    return labelled.agg(
        F.count(F.lit(1)).alias("rows"), F.count("prediction_type").alias("labelled"),
        (F.avg(F.col("prediction_type").isNotNull().cast("double")) * 100).alias("coverage_pct"),
        F.count_if("needs_review").alias("needs_review"),
    )


def reuse_similar(df: DataFrame, type_col: str = "prediction_type") -> DataFrame:
    """Only the first row of each (stream, type, utilization decade) is scored; the others take its insight.

    Adds ``cache_key``, ``source_metric`` (the row that is scored) and ``reused``.
    """
    keyed = df.withColumn(
        "cache_key",
        F.sha2(F.concat_ws("|", F.col("stream_id").cast("string"), F.coalesce(type_col, F.lit("none")),
                           F.floor(F.col("utilization") / 10).cast("string")), 256),
    )
    first = keep_first(keyed.select("cache_key", "ts", "metric_id"), ["cache_key"], ["ts", "metric_id"])
    scored = first.select("cache_key", F.col("metric_id").alias("source_metric"))
    return keyed.join(scored, "cache_key").withColumn("reused", F.col("source_metric") != F.col("metric_id"))


RULES = [
    # fixed values: test on a sample, points, issue text, advice
    ("high_iops", 20, "High IOPS (%s)", "Scale out storage for node %s"),
    ("high_latency", 25, "High latency (%sms)", "Investigate network congestion on node %s"),
    ("high_errors", 30, "Elevated error rate (%s%%)", "Check hardware health on node %s"),
    ("deep_queue", 15, "Queue saturation (depth: %s)", "Increase queue depth or reduce load on node %s"),
    ("low_throughput", 10, "Low throughput relative to IOPS", "Optimize block size for node %s"),
]


def telemetry_rules(df: DataFrame) -> DataFrame:
    """Points, issues and advice per sample (``device_id``, iops, latency, error_rate, queue_depth, throughput)."""
    c = F.col
    tests = {
        "high_iops": (c("iops") > 100000, c("iops")), "high_latency": (c("latency") > 10, c("latency")),
        "high_errors": (c("error_rate") > 1, c("error_rate")), "deep_queue": (c("queue_depth") > 64, c("queue_depth")),
        "low_throughput": ((c("throughput") < 1000) & (c("iops") > 50000), None),
    }
    node = c("device_id").cast("string")
    points, issues, advice = F.lit(0), [], []
    for name, score, issue, hint in RULES:
        test, shown = tests[name]
        text = F.lit(issue) if shown is None else F.format_string(issue, shown.cast("string"))
        points = points + F.when(test, score).otherwise(0)
        issues.append(F.when(test, F.concat(F.lit("Node "), node, F.lit(": "), text)))
        advice.append(F.when(test, F.format_string(hint, node)))
    return df.withColumns({"points": points, "issues": keep(*issues), "advice": keep(*advice)})


def rules_by_batch(df: DataFrame, batch: Column, order: list[str]) -> DataFrame:
    """Rules over delivery batches (at most a few hundred samples each): points add up, capped at 100."""
    rows = telemetry_rules(df).withColumn("batch_id", batch)
    listed = F.array_sort(F.collect_list(F.struct(*order, "device_id", "issues", "advice")))
    out = rows.groupBy("batch_id").agg(F.least(F.sum("points"), F.lit(100)).cast("int").alias("risk_score"), listed.alias("_r"))
    issues = F.flatten(F.transform("_r", lambda r: r.issues))
    advice = F.flatten(F.transform("_r", lambda r: r.advice))
    return out.select(
        "batch_id", F.element_at("_r", 1).device_id.alias("node_id"), "risk_score",
        F.when(F.size(issues) > 0, F.concat(F.lit("Rules-based analysis detected "), F.size(issues).cast("string"),
                                            F.lit(" issue(s): "), F.concat_ws("; ", issues)))
        .otherwise("All metrics within acceptable thresholds").alias("analysis"),
        F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit("Continue monitoring"))).alias("recommendations"),
        F.lit("rules-based").alias("source"),
    )
