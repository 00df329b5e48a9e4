"""Queries that write a table through a sink, read it back through a source, and return what came back; and whole texts."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidewatch.functions import expr as X
from tidewatch.operators import alerts as A
from tidewatch.operators import entities as E
from tidewatch.operators import insights as I
from tidewatch.operators import ml as M
from tidewatch.operators import scoring as S
from tidewatch.operators import telemetry as L
from tidewatch.operators import validate as V
from tidewatch.plans import catalogue as Q
from tidewatch.plans import views as W
from tidewatch.plans.catalogue import NOW, query
from tidewatch.session import scratch_dir
from tidewatch.sources import readers as R
from tidewatch.sources import writers as O
from tidewatch.streaming import windows as SW


@query
def archive_roundtrip(spark, sf):
    """Raw records, valid and malformed, from the archive's hour folders."""
    base = scratch_dir(spark, "archive")
    O.archive_raw(V.decode_records(W.raw_records(spark, sf)), base, F.col("ts"))
    return O.read_archive(spark, base)


@query
def columnar_archive(spark, sf):
    """The events stream as Parquet by event hour, and each hour's rows."""
    base = scratch_dir(spark, "columnar")
    SW.run_once(O.archive_columns(Q._stream(spark, sf), f"{base}/out", f"{base}/checkpoint", "ts"))
    kept = spark.read.schema("year STRING, month STRING, day STRING, hour STRING, event_id LONG, value DOUBLE").parquet(f"{base}/out")
    return Q.rounded(kept.groupBy("year", "month", "day", "hour").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


def _customers(spark, sf):
    """Customers with awkward text: quotes, commas, line ends, nothing at all."""
    k = F.col("c_custkey")
    note = F.when(k % 5 == 0, None).when(k % 5 == 1, F.lit('said "yes", twice')).when(k % 5 == 2, F.lit("two\nlines")).when(k % 5 == 3, F.lit(" spaced ")).otherwise(F.lit("plain"))
    return W.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", note.alias("note"), (k % 7).cast("int").alias("customer_id"), F.lit("s").alias("segment"))


@query
def csv_roundtrip(spark, sf):
    """Customers through the CSV export, without its dropped columns."""
    base = scratch_dir(spark, "csv")
    O.export_csv(_customers(spark, sf), f"{base}/customers.csv", ("customer_id", "segment"))
    return spark.read.schema("c_custkey LONG, c_name STRING, c_acctbal DOUBLE, note STRING").option("header", True).option("escape", '"').option("multiLine", True).csv(f"{base}/customers.csv")


@query
def jsonl_roundtrip(spark, sf):
    """Customers through JSON lines, found by their file name at any depth."""
    base = scratch_dir(spark, "jsonl")
    O.write_jsonl(_customers(spark, sf), f"{base}/a/b")
    return R.jsonl(spark, base, "c_custkey LONG, c_name STRING, c_acctbal DOUBLE, note STRING, customer_id INT, segment STRING", "*.json")


@query
def json_export(spark, sf):
    """The events in JSON files of at most 1000 rows, with the export's manifest beside what its files hold."""
    base = scratch_dir(spark, "export")
    events = W.table(spark, sf, "events")
    O.export_json(events, f"{base}/events", 1000)
    O.export_manifest(spark, base, "events", "events/", "json", events, NOW())
    held = spark.read.schema("event_id LONG, value DOUBLE").json(f"{base}/events").groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    files = held.agg(F.max(F.col("n") <= 1000).alias("within_limit"), F.sum("n").alias("rows"), F.sum("total").alias("total"))
    manifest = spark.read.json(f"{base}/manifest").select("table_name", "prefix", "format", "row_count", F.to_timestamp("export_date").alias("export_date"))
    return Q.rounded(files.join(manifest))


@query
def splits_roundtrip(spark, sf):
    """Train, validation and test sets written as CSV and JSON; the CSV files are found by their role."""
    base = scratch_dir(spark, "splits")
    t = W.telemetry(spark, sf)
    known, _ = M.labelled(L.row_features(t).select("insight_id", "risk_level"))
    split = M.stratified_split(known, "risk_level", "insight_id").select("insight_id", "split")
    O.write_splits(t.join(split, "insight_id").select("insight_id", "value", "risk_level", "split"), base)
    found = R.latest_by_role(spark, base)
    schema, out = "insight_id LONG, value DOUBLE, risk_level STRING", None
    for role in M.NAMES:
        newest = os.path.dirname(found[role])  # all parts of the newest file's folder
        sums = lambda df, kind: df.agg(F.lit(role).alias("split"), F.lit(kind).alias("format"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))  # noqa: E731, B023
        both = sums(spark.read.schema(schema).option("header", True).csv(newest), "csv").unionByName(sums(spark.read.schema(schema).json(f"{base}/{role}.json"), "json"))
        out = both if out is None else out.unionByName(both)
    return Q.rounded(out)


@query
def metadata_roundtrip(spark, sf):
    """Feature groups, scaler and split sizes from the metadata file."""
    base = scratch_dir(spark, "metadata")
    t = W.telemetry(spark, sf)
    groups = {"performance": ["iops", "latency"], "errors": ["error_rate"]}
    O.write_metadata(M.feature_metadata(t, {"train": t.where("insight_id % 10 < 7"), "test": t.where("insight_id % 10 >= 7")}, groups), f"{base}/metadata")
    schema = "feature_count INT, features MAP<STRING, ARRAY<STRING>>, scaler_params STRUCT<mean: ARRAY<DOUBLE>, scale: ARRAY<DOUBLE>>, dataset_sizes STRUCT<train: LONG, test: LONG>"
    m = spark.read.schema(schema).json(f"{base}/metadata")
    one = m.select("feature_count", "features", "dataset_sizes", F.posexplode(F.arrays_zip(F.col("scaler_params.mean").alias("mean"), F.col("scaler_params.scale").alias("scale"))).alias("at", "s"))
    return Q.rounded(one.select("feature_count", F.array_join(F.col("features.performance"), ",").alias("performance"), F.array_join(F.col("features.errors"), ",").alias("errors"),
                                F.col("dataset_sizes.train").alias("train"), F.col("dataset_sizes.test").alias("test"), "at", "s.mean", "s.scale"))


@query
def insight_sink(spark, sf):
    """Insights as the sink holds them after the run was written twice: ids, one row each, times 100 ms apart."""
    base = scratch_dir(spark, "insights")
    for _ in range(2):
        O.write_insights(S.generate_insights(S.recommendations(Q._scored(spark, sf)), NOW()), base, "r1")
    return spark.read.parquet(base).select("entity_id", "entity_type", "timestamp", F.col("related_entity").cast("string").alias("related_entity"), "prediction_type", "risk_score", "run")


@query
def severity_outputs(spark, sf):
    """Critical and warning alerts, each read from its own output."""
    base = scratch_dir(spark, "severity")
    A.write_by_severity(Q._event_alerts(spark, sf), base)
    held = spark.read.parquet(f"{base}/alerts")
    return held.where(F.col("severity").isin("critical", "warning")).select("alert_no", "alert_type", "entity_id", "severity")


@query
def entity_partitions(spark, sf):
    """Tutors from a table of entities by type: only their folder is read."""
    base = scratch_dir(spark, "entities")
    counters = E.entity_counters(W.mkt_events(spark, sf), NOW())
    O.write_entities(counters, base)
    return R.entities(spark, base, "tutor")


@query
def time_range_scan(spark, sf):
    """Events of two days by a range that reaches the scan, through a Snappy table."""
    base = scratch_dir(spark, "range")
    O.write_parquet(W.table(spark, sf, "events").select("event_id", "ts", "event_type"), base)
    return R.time_range(R.table(spark, base), "ts", X.instant("2024-01-10 00:00:00"), X.instant("2024-01-12 00:00:00"))


@query
def bundle_roundtrip(spark, sf):
    """Telemetry through bundles of a thousand records, labelled and unlabelled apart."""
    base = scratch_dir(spark, "bundle")
    t = W.telemetry(spark, sf)
    record = F.struct(
        F.col("insight_id").cast("string").alias("insightId"), F.col("device_id").cast("string").alias("deviceId"), F.unix_millis("ts").alias("timestamp"), "value",
        F.struct(F.col("iops").alias("total_iops"), "read_iops", "write_iops", F.col("latency").alias("avg_latency"), "error_rate").alias("metadata"),
        F.col("risk_level").alias("riskLevel"), F.col("performance_score").alias("performanceScore"))
    known = F.col("risk_level").isNotNull()
    bundles = t.groupBy(F.floor(F.col("insight_id") / 1000).alias("b")).agg(
        F.collect_list(F.when(known, record)).alias("labeled_data"), F.collect_list(F.when(~known, record)).alias("unlabeled_data"))
    bundles.select(F.to_json(F.struct("labeled_data", "unlabeled_data")).alias("value")).write.option("maxRecordsPerFile", 1).text(f"{base}/bundles")
    back = R.telemetry_bundle(spark, f"{base}/bundles")
    return Q.rounded(back.select(F.col("insight_id").cast("long").alias("insight_id"), F.col("device_id").cast("long").alias("device_id"), "ts", "value", "iops", "latency", "error_rate", "risk_level", "performance_score"))


@query
def insight_by_entity(spark, sf):
    """All insights of one entity."""
    return Q.rounded(I.by_key(Q._served(spark, sf), "entity_id", 7))


@query
def source_confidence(spark, sf):
    """Confidence by the name of the source."""
    k = F.col("event_id") % 4
    name = F.when(k == 0, "SageMaker-xgb").when(k == 1, "bedrock/claude").when(k == 2, "rules")
    return W.table(spark, sf, "events").select("event_id", name.alias("source"), S.confidence_of(name).alias("confidence"))


@query
def utc_texts(spark, sf):
    """ISO texts with and without ``Z``, and texts that are no time."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    k = F.col("event_id") % 5
    text = F.when(k == 0, F.concat(stamp, F.lit("Z"))).when(k == 1, stamp).when(k == 2, F.lit("soon")).when(k == 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return W.table(spark, sf, "events").select("event_id", X.utc_text(text).alias("at"))


@query
def feature_csv_text(spark, sf):
    """The whole text of a scoring request."""
    return L.feature_csv(L.serving_features(W.telemetry(spark, sf))).select("insight_id", "features_csv")


@query
def validation_messages(spark, sf):
    """Every error's field, severity and message."""
    v = Q._validated(spark, sf)
    return v.select("event_id", F.concat_ws("; ", F.transform("errors", lambda e: F.concat(e.field, F.lit(":"), e.severity, F.lit(":"), e.message))).alias("errors"))


@query
def short_validation_reasons(spark, sf):
    return V.validate_short(V.decode_records(W.raw_records(spark, sf))).select("event_id", F.array_join("reasons", "; ").alias("reasons"))


@query
def version_feed(spark, sf):
    """The change feed between two written versions of a table."""
    base = scratch_dir(spark, "versions")
    for name, snapshot in zip(("old", "new"), Q._snapshots(spark, sf), strict=True):
        O.write_parquet(snapshot, f"{base}/{name}")
    feed = SW.version_feed(spark, f"{base}/old", f"{base}/new", ["entity_id", "entity_type"])
    return feed.select("entity_id", "entity_type", "change_type", F.col("old_image.demand_score").alias("old_demand"), F.col("new_image.demand_score").alias("new_demand"))


@query
def stream_dedup_first(spark, sf):
    """Alerts of a stream that come in one batch, one for each type and entity."""
    alerts = Q._event_alerts(spark, sf, Q._stream(spark, sf))
    return Q._appended(spark, SW.dedup_alerts(alerts), "dedup").select("alert_type", "entity_id")
