"""Sources: every reader declares its schema and stays lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import TELEMETRY_BUNDLE


def files_under(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and modification time of the files below a folder; the contents are never read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        .load(path).select("path", "modificationTime", "length")
    )


def jsonl(spark: SparkSession, path: str, schema: str, pattern: str = "*.jsonl") -> DataFrame:
    """All files of JSON lines below a folder, at any depth, by their name; an error when there is none."""
    if files_under(spark, path, pattern).isEmpty():
        raise FileNotFoundError(f"no {pattern} file below {path}")
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(path)


def telemetry_bundle(spark: SparkSession, path: str) -> DataFrame:
    """A bundle of labelled and unlabelled records as one table; missing labels become ``unknown`` and -1."""
    bundle = spark.read.schema(TELEMETRY_BUNDLE).option("multiLine", True).json(path)
    parts = [bundle.select(F.explode(c).alias("r")).select("r.*") for c in ("labeled_data", "unlabeled_data")]
    return flatten_telemetry(parts[0].unionByName(parts[1], allowMissingColumns=True))


def flatten_telemetry(records: DataFrame) -> DataFrame:
    """Nested records to the telemetry shape of the feature operators."""
    m = lambda name: F.col(f"metadata.{name}")
    return records.select(
        F.col("insightId").alias("insight_id"), F.col("deviceId").alias("device_id"),
        F.timestamp_millis("timestamp").alias("ts"), "value",
        m("total_iops").alias("iops"), m("read_iops").alias("read_iops"), m("write_iops").alias("write_iops"),
        m("avg_latency").alias("latency"), m("p95_latency").alias("p95_latency"), m("p99_latency").alias("p99_latency"),
        m("error_rate").alias("error_rate"), m("queue_depth").alias("queue_depth"), m("bandwidth_mbps").alias("throughput"),
        m("access_pattern").alias("access_pattern"), m("io_size_kb").alias("io_size_kb"),
        F.coalesce("riskLevel", F.lit("unknown")).alias("risk_level"),
        F.coalesce("performanceScore", F.lit(-1.0)).alias("performance_score"),
    )


def latest_file(spark: SparkSession, path: str, pattern: str = "*") -> str:
    found = files_under(spark, path, pattern).agg(F.max_by("path", F.struct("modificationTime", "path"))).first()[0]
    if found is None:
        raise FileNotFoundError(f"no file below {path}")
    return found


def latest_by_role(spark: SparkSession, path: str) -> dict[str, str]:
    """The newest CSV file per role, named by itself or by its folder ``<role>.csv``; train, validation and test must exist."""
    role = F.regexp_extract("path", r"(train|validation|test)[^/]*\.csv(/[^/]*)?$", 1)
    rows = (
        files_under(spark, path, "*.csv").withColumn("role", role).where("role <> ''")
        .groupBy("role").agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).collect()
    )
    found = {r["role"]: r["path"] for r in rows}
    missing = {"train", "validation", "test"} - found.keys()
    if missing:
        raise FileNotFoundError(f"missing dataset files: {', '.join(sorted(missing))}")
    return found


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def entities(spark: SparkSession, path: str, entity_type: str) -> DataFrame:
    """Entities of one type: the table is partitioned by type, so only that folder is listed and read."""
    return spark.read.parquet(path).where(F.col("entity_type") == entity_type)


def time_range(df: DataFrame, ts: str, start, end) -> DataFrame:
    """Rows in [start, end]; on a Parquet table the bounds reach the scan."""
    return df.where(F.col(ts).between(start, end))


def record_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Transport records (column ``data``) as they arrive in a folder."""
    return (
        spark.readStream.schema("data STRING, event_id BIGINT, ts TIMESTAMP")
        .option("maxFilesPerTrigger", max_files).json(path)
    )


def kafka_stream(spark: SparkSession, servers: str, topic: str, max_offsets: int = 100_000) -> DataFrame:
    """Transport records from a broker; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
        .option("startingOffsets", "latest").option("maxOffsetsPerTrigger", max_offsets).load()
        .select(F.col("value").cast("string").alias("data"), F.col("timestamp").alias("arrived"))
    )
