"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidewatch.plans.catalogue import QUERIES
from tidewatch.session import build_session, prepare

HEADLINE = [
    "windowed_features", "window_catalogue", "tutor_feature_agg", "running_rating", "health_overlay",
    "event_validation", "event_items", "insight_kpis", "insight_trend_week", "insight_page", "risk_distribution",
    "telemetry25", "rolling_means", "stream_baseline_delta", "trailing_baseline_15m", "asof_next_alert_1d", "auto_label",
    "student_features46", "recommendations", "generate_insights", "detect_anomalies", "alerts_dedup_gap",
    "alerts_dedup_cooldown", "alarm_eval", "latency_stats_lineitem", "change_feed", "stratified_split_lineitem", "standardize",
]
ROWS_OF = {"latency_stats_lineitem": "lineitem", "stratified_split_lineitem": "lineitem"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = prepare(build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"))
    spark.sparkContext.setLogLevel("ERROR")
    sizes = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("events", "lineitem")}

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])  # warms up the session, not counted
    seconds = {name: min(run(name), run(name)) for name in HEADLINE}
    rate = {name: round(sizes[ROWS_OF.get(name, "events")] / s) for name, s in seconds.items()}
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {k: round(v, 3) for k, v in seconds.items()}, "input_rows_per_sec": rate, "sf": os.path.basename(sf_dir),
    }))


if __name__ == "__main__":
    main()
