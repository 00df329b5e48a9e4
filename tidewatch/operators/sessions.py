"""Session windows: rows of a key that follow each other within a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import slice_window, sliced


def sessions(df: DataFrame, keys: list[str], ts: str, tie: list[str], gap_us: int, sums: dict[str, Column] | None = None,
             min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """One row for each session: keys, ``start``, ``last`` (times of its first and last row), ``events`` and ``sums``. A row
    starts a session when it comes more than ``gap_us`` after the row before it. Rows without a time are in no session.

    Slices of a hot key find their sessions alone. Whether a slice's first session goes on from the slice before is told by
    one row a slice: the start it goes on from is that of the last slice on the way that has a break in it.
    """
    sums = sums or {}
    rows = sliced(df.where(F.col(ts).isNotNull()), keys, ts, min_rows, slice_rows)
    w = slice_window(keys, ts, tie)
    us = F.unix_micros(ts)
    breaks = F.coalesce(us - F.lag(us).over(w) > gap_us, F.lit(True))
    rows = rows.withColumn("_new", breaks.cast("int")).withColumn("_number", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = rows.groupBy(*keys, "_slice", "_hot", "_number").agg(
        F.min(ts).alias("start"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("events"), *[F.sum(c).alias(n) for n, c in sums.items()])
    up = Window.partitionBy(*keys).orderBy("_slice")
    ends = parts.where("_hot").groupBy(*keys, "_slice").agg(
        F.min("start").alias("_from"), F.max("last").alias("_till"), F.max("start").alias("_latest"), F.count(F.lit(1)).alias("_parts"))
    ends = ends.withColumn("_joins", F.coalesce(F.unix_micros("_from") - F.unix_micros(F.lag("_till").over(up)) <= gap_us, F.lit(False)))
    own = F.when(~(F.col("_joins") & (F.col("_parts") == 1)), F.col("_latest"))
    ends = ends.withColumn("_open", F.last(own, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(*keys, "_slice", F.when(F.col("_joins"), F.lag("_open").over(up)).alias("_goes_on"))
    start = F.coalesce(F.when(F.col("_number") == 1, F.col("_goes_on")), F.col("start"))
    whole = parts.join(ends, [*keys, "_slice"], "left").withColumn("start", start)
    return whole.groupBy(*keys, "start").agg(F.max("last").alias("last"), F.sum("events").alias("events"), *[F.sum(n).alias(n) for n in sums])
