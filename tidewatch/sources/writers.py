"""Sinks. Every writer that a retry may run again writes to a path of its batch, in overwrite mode."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.changes import KEYS
from tidewatch.operators.ordered import keep_last
from tidewatch.operators.validate import merge_tutor_parts, tutor_parts, tutor_state

HOUR_PARTS = {"year": "yyyy", "month": "MM", "day": "dd", "hour": "HH"}


def with_hour(df: DataFrame, at: Column) -> DataFrame:
    """Zero padded UTC partition columns."""
    return df.withColumns({name: F.date_format(at, pattern) for name, pattern in HOUR_PARTS.items()})


def archive_raw(records: DataFrame, path: str, at: Column, batch_id: int | None = None) -> None:
    """Raw text of valid and malformed records alike, as gzip NDJSON by hour of processing."""
    parts = list(HOUR_PARTS)
    out = with_hour(records, at).select(F.col("raw").alias("value"), *parts)
    if batch_id is not None:
        out, parts = out.withColumn("batch", F.lit(batch_id)), [*parts, "batch"]
    writer = out.write.partitionBy(*parts).option("compression", "gzip")
    if batch_id is None:
        writer.mode("append").text(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived records with their partition columns kept as text."""
    schema = "value STRING, year STRING, month STRING, day STRING, hour STRING"
    return spark.read.schema(schema).text(path)


def archive_columns(stream: DataFrame, path: str, checkpoint: str, ts: str):
    """Streaming columnar archive by event hour, one file set per five minutes."""
    hours = with_hour(stream, F.col(ts))
    return (
        hours.writeStream.format("parquet").partitionBy(*HOUR_PARTS).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(processingTime="300 seconds")
    )


def quarantine(rejected: DataFrame, path: str, batch_id: int) -> None:
    """Rejected records with their reasons and the raw text."""
    keep = [c for c in ("event_id", "raw", "event_type", "errors", "ts") if c in rejected.columns]
    rejected.select(*keep).write.mode("overwrite").parquet(os.path.join(path, f"batch={batch_id}"))


def append_state(rows: DataFrame, path: str, batch_id: int, order: list[str], keys: list[str] = KEYS) -> None:
    """Keyed upsert as a log of batches: a batch writes its newest row per key, readers keep the last one.

    The cost of a batch follows the batch, not the table; a retried batch replaces its own folder.
    """
    newest = keep_last(rows, keys, order).withColumn("_batch", F.lit(batch_id).cast("long"))
    newest.write.mode("overwrite").parquet(os.path.join(path, "log", f"b={batch_id}"))


def finished_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished folders below a path."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return [s.getPath().getParent().getName() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "*/_SUCCESS")) or []]


def _state_paths(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """The newest compacted version and the batches after it."""
    bases = [int(n.split("=")[1]) for n in finished_folders(spark, os.path.join(path, "base"))]
    upto = max(bases, default=-1)
    logs = [n for n in finished_folders(spark, os.path.join(path, "log")) if int(n.split("=")[1]) > upto]
    paths = [os.path.join(path, "log", n) for n in logs]
    if bases:
        paths.insert(0, os.path.join(path, "base", f"v={upto}"))
    return paths, max([upto, *[int(n.split("=")[1]) for n in logs]])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the newest version and the batches after it, in one scan; batches may differ in their columns."""
    paths, _ = _state_paths(spark, path)
    if not paths:
        raise FileNotFoundError(f"no state below {path}")
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_state(spark: SparkSession, path: str, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """The current row of every key."""
    return keep_last(read_log(spark, path), keys, ["_batch", *order])


def append_tutors(items: DataFrame, path: str, batch_id: int) -> None:
    """One row per tutor of the batch, beside those of other batches; a retried batch replaces its own folder."""
    tutor_parts(items).write.mode("overwrite").parquet(os.path.join(path, "log", f"b={batch_id}"))


def read_tutors(spark: SparkSession, path: str) -> DataFrame:
    """The current row of every tutor: batches add up."""
    return tutor_state(read_log(spark, path))


def compact_tutors(spark: SparkSession, path: str) -> int:
    """Adds the batches up to a new version beside the old one; readers switch when it is complete."""
    _, upto = _state_paths(spark, path)
    merge_tutor_parts(read_log(spark, path)).write.mode("overwrite").parquet(os.path.join(path, "base", f"v={upto}"))
    return upto


def batch_time(spark: SparkSession, path: str, batch_id: int) -> Column:
    """The time at which a batch was first worked on, written down so that a retry files it under the same hour."""
    folder = os.path.join(path, f"b={batch_id}")
    if f"b={batch_id}" not in finished_folders(spark, path):
        spark.range(1).select(F.unix_micros(F.current_timestamp()).alias("us")).write.mode("overwrite").parquet(folder)
    return F.timestamp_micros(F.lit(spark.read.parquet(folder).first().us))


def compact_state(spark: SparkSession, path: str, order: list[str], keys: list[str] = KEYS) -> int:
    """Writes the current rows as a new version beside the old one; readers switch when it is complete."""
    _, upto = _state_paths(spark, path)
    read_state(spark, path, order, keys).write.mode("overwrite").parquet(os.path.join(path, "base", f"v={upto}"))
    return upto


def compact_before(spark: SparkSession, path: str, batch_id: int, keys: list[str] = KEYS) -> None:
    """Writes the rows that the batches before ``batch_id`` left as a new version, once; a retry of that batch finds it done
    and still starts from the same rows."""
    if batch_id == 0 or f"v={batch_id - 1}" in finished_folders(spark, os.path.join(path, "base")):
        return
    rows = keep_last(read_log(spark, path).where(F.col("_batch") < batch_id), keys, ["_batch"])
    rows.write.mode("overwrite").parquet(os.path.join(path, "base", f"v={batch_id - 1}"))


def write_entities(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def export_json(df: DataFrame, path: str, rows_per_file: int) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).json(path)


def export_csv(df: DataFrame, path: str, drop: tuple[str, ...] = ()) -> None:
    """Header, text quoted with doubled quotes; the header comes from the schema."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}  # kept, as they are part of the text
    df.drop(*drop).write.mode("overwrite").options(**spaces).option("header", True).option("escape", '"').csv(path)


def export_manifest(spark: SparkSession, path: str, table: str, prefix: str, fmt: str, rows: DataFrame, at: Column) -> None:
    one = spark.range(1).select(
        at.alias("export_date"), F.lit(table).alias("table_name"), F.lit(prefix).alias("prefix"), F.lit(fmt).alias("format"),
        rows.agg(F.count(F.lit(1))).scalar().alias("row_count"),
    )
    one.write.mode("overwrite").json(os.path.join(path, "manifest"))


def write_splits(df: DataFrame, path: str, split: str = "split", names: tuple[str, ...] = ("train", "validation", "test")) -> None:
    """Each split as CSV and as JSON records; written from one persisted table, so the split runs once."""
    rows = df.persist()
    for name in names:
        part = rows.where(F.col(split) == name).drop(split)
        export_csv(part, os.path.join(path, f"{name}.csv"))
        part.write.mode("overwrite").json(os.path.join(path, f"{name}.json"))
    rows.unpersist()


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_metadata(row: DataFrame, path: str) -> None:
    row.write.mode("overwrite").json(path)


def append_points(points: DataFrame, path: str, run: str) -> None:
    points.write.mode("overwrite").parquet(os.path.join(path, f"run={run}"))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


def write_insights(insights: DataFrame, path: str, run: str) -> None:
    """Insight rows of one run; a repeated run replaces its own rows."""
    insights.write.mode("overwrite").parquet(os.path.join(path, "entity_type=insight", f"run={run}"))
