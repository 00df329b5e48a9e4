"""Late rows on a stream: caught behind the watermark, kept in the archive and listed, and left out of windows.

The watermark of a batch is the newest event time of all batches before it, less the allowed delay; a row is late when its
window has ended by then. Stateful operators drop late rows without a trace (by the watermark of the batch before, so none
that isn't caught here), so every batch is split before it is counted. All writes go to folders of the batch; a retried
batch finds the same watermark and replaces them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.writers import finished_folders


def watermark_us(spark: SparkSession, path: str, batch_id: int, delay_us: int) -> int | None:
    """The watermark a batch works under, in microseconds; None in the first one. Each batch leaves the newest time up to and
    with it, so only the last one before is read."""
    seen = _newest_before(spark, path, batch_id)
    return None if seen is None else seen - delay_us


def _newest_before(spark: SparkSession, path: str, batch_id: int) -> int | None:
    done = [int(n.split("=")[1]) for n in finished_folders(spark, os.path.join(path, "times"))]
    last = max((b for b in done if b < batch_id), default=None)
    return None if last is None else spark.read.parquet(os.path.join(path, "times", f"batch={last}")).first().newest


def _start_us(ts: str, width_us: int) -> Column:
    us = F.unix_micros(ts)
    return us - F.pmod(us, F.lit(width_us))


def split_batch(batch: DataFrame, batch_id: int, path: str, ts: str, width_us: int, delay_us: int, counts: dict[str, Column]) -> None:
    """One batch: all rows to ``archive`` with their period, watermark and whether they are late; partial counts of the others
    to ``windows``; the batch's newest time to ``times``. Rows without a time are in no window and never late."""
    spark = batch.sparkSession
    mark = F.lit(watermark_us(spark, path, batch_id, delay_us)).cast("long")
    folder = os.path.join(path, "archive", f"batch={batch_id}")
    start = _start_us(ts, width_us)
    late = F.coalesce(start + width_us <= mark, F.lit(False))
    marked = batch.withColumns({"period": F.timestamp_micros(start), "watermark": F.timestamp_micros(mark), "late": late})
    marked.write.mode("overwrite").partitionBy("late").parquet(folder)
    kept = spark.read.schema(marked.schema).parquet(folder)  # what was written is what counts
    on_time = kept.where(~F.col("late") & F.col("period").isNotNull())
    on_time.groupBy("period").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(n) for n, c in counts.items()]).write.mode("overwrite").parquet(os.path.join(path, "windows", f"batch={batch_id}"))
    before = F.lit(_newest_before(spark, path, batch_id)).cast("long")
    kept.agg(F.greatest(F.max(F.unix_micros(ts)), before).alias("newest")).write.mode("overwrite").parquet(os.path.join(path, "times", f"batch={batch_id}"))


def split_late(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", width_us: int = 3_600_000_000, delay_us: int = 3_600_000_000, counts: dict[str, Column] | None = None):
    """A writer that splits and counts a stream of rows; ``counts`` names conditions to be counted beside the total."""
    return stream.writeStream.foreachBatch(lambda df, i: split_batch(df, i, path, ts, width_us, delay_us, counts or {})).option("checkpointLocation", checkpoint)


def read_late(spark: SparkSession, path: str) -> DataFrame:
    """The late rows, with the batch they came in and the watermark they were behind."""
    return read_archived(spark, path).where("late")


def read_archived(spark: SparkSession, path: str) -> DataFrame:
    """All rows, late or not."""
    return spark.read.parquet(os.path.join(path, "archive")).withColumn("late", F.col("late").cast("boolean"))  # a folder's name


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Counts per period over all batches."""
    parts = spark.read.parquet(os.path.join(path, "windows")).drop("batch")
    return parts.groupBy("period").agg(*[F.sum(c).alias(c) for c in parts.columns if c != "period"])
