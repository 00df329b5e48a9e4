"""Ordered work per key that stays parallel when one key holds a large part of the rows.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a key that is too large is cut
into time slices, and each slice gets the few rows of earlier slices that its frames reach into (its halo).
Keys of normal size keep a single slice and no halo, so they cost what a plain window costs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidewatch.session import staged

# A key is hot when it has more than MIN_ROWS rows; of those the SHARE largest are taken. Any other key then has at
# most MIN_ROWS rows or 1 / SHARE of all, and the table that is broadcast has at most SHARE rows of a key and three
# numbers.
SHARE = 65_536
MIN_ROWS = 2_000_000
SLICE_ROWS = 1_000_000


def hot_keys(df: DataFrame, keys: list[str], ts: str, min_rows: int | None = None,
             slice_rows: int | None = None) -> DataFrame:
    """The hot keys with the number of time slices each is cut into; at most SHARE rows."""
    min_rows = MIN_ROWS if min_rows is None else min_rows
    slice_rows = SLICE_ROWS if slice_rows is None else slice_rows
    us = F.unix_micros(ts)
    return (
        df.groupBy(*[F.col(k).alias(f"_hot_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(us).alias("_lo"), F.max(us).alias("_hi"))
        .where(F.col("_rows") > min_rows)
        .orderBy(F.desc("_rows")).limit(SHARE)
        .select(
            *[f"_hot_{k}" for k in keys],
            "_lo",
            (F.col("_hi") - F.col("_lo") + 1).alias("_span"),
            F.ceil(F.col("_rows") / F.lit(slice_rows)).alias("_parts"),
        )
    )


def sliced(df: DataFrame, keys: list[str], ts: str, min_rows: int | None = None, slice_rows: int | None = None,
           counted: DataFrame | None = None) -> DataFrame:
    """Adds ``_slice`` (0 for keys of normal size) and ``_hot``.

    A hot key is first cut evenly in time. Slices that then hold over twice ``slice_rows``, bursts, are cut again within
    the times that they really span, 16 times finer than rows spread evenly would need, so a burst that fills down to a
    sixteenth of them is still cut to ``slice_rows``.

    ``counted``: where to count rows per key when ``df`` is dear to compute, a table with at least its rows (or some
    of its keys, when those alone decide). Without hot keys the plan drops every branch that is only for them.
    """
    source = df if counted is None else counted
    keys = [k for k in keys if k in source.columns]
    target = SLICE_ROWS if slice_rows is None else slice_rows
    hot = F.broadcast(hot_keys(source, keys, ts, min_rows, slice_rows))
    us = F.unix_micros(ts)
    # rows far before those that were counted share the lowest number
    part = F.greatest(F.floor((us - F.col("_lo")) / F.col("_span") * F.col("_parts")).cast("long"), F.lit(-(1 << 30)).cast("long"))

    def with_hot(rows: DataFrame, how: str) -> DataFrame:
        on = [rows[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys]
        return rows.join(hot, on, how).withColumn("_part", part)

    # at most SHARE bursts, as for the hot keys
    bursts = F.broadcast(
        with_hot(source, "inner").groupBy(*[F.col(f"_hot_{k}").alias(f"_burst_{k}") for k in keys], F.col("_part").alias("_burst"))
        .agg(F.count(F.lit(1)).alias("_rows"), F.min(us).alias("_from"), F.max(us).alias("_till"))
        .where(F.col("_rows") > 2 * target).orderBy(F.desc("_rows")).limit(SHARE)
        .select(*[f"_burst_{k}" for k in keys], "_burst", "_from", (F.col("_till") - F.col("_from") + 1).alias("_width"),
                F.ceil(F.col("_rows") / F.lit(target) * 16).alias("_cuts"))
    )
    rows = with_hot(df, "left")
    within = [rows[k].eqNullSafe(bursts[f"_burst_{k}"]) for k in keys] + [F.col("_part") == F.col("_burst")]
    fine = F.floor((us - F.col("_from")) / F.col("_width") * F.col("_cuts")).cast("long")
    # rows that ``counted`` doesn't have may lie before or after a burst's times
    fine = F.greatest(F.lit(0), F.least(fine, F.col("_cuts") - 1))
    number = F.col("_part") * F.lit(1 << 24) + F.coalesce(fine, F.lit(0))
    return (
        rows.join(bursts, within, "left")
        .withColumn("_slice", F.when(F.col("_parts").isNotNull(), number).otherwise(F.lit(0)).cast("long"))
        .withColumn("_hot", F.col("_parts").isNotNull())
        .drop(*[f"_hot_{k}" for k in keys], *[f"_burst_{k}" for k in keys], "_lo", "_span", "_parts", "_part", "_burst", "_from", "_width", "_cuts")
    )


def slice_offsets(rows: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Per slice of a hot key: rows up to its end (``_cum``) and the next slices with the rows before each."""
    order = Window.partitionBy(*keys).orderBy("_slice")
    return (
        rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_cum", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_before", F.col("_cum") - F.col("_c"))
        .withColumn("_next", F.collect_list(F.struct("_slice", "_before")).over(order.rowsBetween(1, reach)))
    )


def with_row_halo(df: DataFrame, keys: list[str], ts: str, tie: list[str], reach: int, min_rows: int | None = None,
                  slice_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Slices plus the ``reach`` rows before each slice, marked ``_halo``.

    Windows over ``slice_window`` then see the same preceding rows as a window over the whole key, for frames
    of at most ``reach`` rows back. Drop the halo with ``without_halo`` afterwards.
    """
    cols = df.columns
    rows = sliced(df, keys, ts, min_rows, slice_rows, counted)
    hot = rows.where("_hot")
    newest = Window.partitionBy(*keys, "_slice").orderBy(*[F.col(c).desc() for c in [ts, *tie]])
    tail = hot.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= reach)
    halo = (
        tail.join(slice_offsets(hot, keys, reach), [*keys, "_slice"])
        .withColumn("_to", F.explode("_next"))
        .where(F.col("_back") + F.col("_to._before") - F.col("_cum") <= reach)
        .select(*cols, F.col("_to._slice").alias("_slice"), F.lit(True).alias("_halo"))
    )
    return rows.select(*cols, "_slice", F.lit(False).alias("_halo")).unionByName(halo)


def slice_window(keys: list[str], ts: str, tie: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys, "_slice").orderBy(ts, *tie)


def without_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_halo")).drop("_halo", "_slice")


def carried_sums(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """For each slice of a hot key the sums over its earlier slices: ``sums`` maps an output name to a column.

    Joined to running sums inside the slices (rows of other keys find nothing), this continues them over the key.
    """
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where("_hot").groupBy(*keys, "_slice").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return totals.withColumns({n: F.sum(n).over(before) for n in sums})


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], ts: str, tolerance_us: int, right_cols: list[str],
                 right_tie: list[str], min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Each left row with the first right row of the same key at or after it, at most ``tolerance_us`` later.

    Newest first, the last right row seen so far is the next one in time, so one running frame answers every left
    row. A slice of a hot key needs a single row from outside: the first right row of the slices after it.
    """
    l_cols = left.columns
    lhs = left.select(*by, ts, F.lit(0).alias("_side"), F.struct(*l_cols).alias("_row"))
    rhs = right.dropna(subset=by).select(
        *by, ts, F.lit(1).alias("_side"), F.struct(F.col(ts).alias("_at"), *right_cols).alias("_match"),
        F.struct(*right_tie).alias("_tie"),
    )
    rows = sliced(lhs.unionByName(rhs, allowMissingColumns=True), by, ts, min_rows, slice_rows)
    one = F.when(F.col("_side") == 1, F.struct(ts, "_match", "_tie"))
    order = F.when(F.col("_side") == 1, F.struct(ts, "_tie"))
    later = Window.partitionBy(*by).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = (
        rows.where("_hot").groupBy(*by, "_slice").agg(F.min_by(one, order).alias("_f"))
        .withColumn("_f", F.last("_f", ignorenulls=True).over(later)).where("_f IS NOT NULL")
        .select(*by, f"_f.{ts}", F.lit(1).alias("_side"), "_f._match", "_f._tie", "_slice")
    )
    newest = Window.partitionBy(*by, "_slice").orderBy(
        F.col(ts).desc(), F.col("_side").desc(), F.col("_tie").desc()
    ).rowsBetween(Window.unboundedPreceding, 0)
    near = F.unix_micros("_hit._at") - F.unix_micros(F.col(ts)) <= tolerance_us
    return (
        rows.drop("_hot").unionByName(ahead, allowMissingColumns=True)
        .withColumn("_hit", F.last("_match", ignorenulls=True).over(newest))
        .where(F.col("_side") == 0)
        .select(
            "_row.*", F.when(near, F.col("_hit._at")).alias(f"matched_{ts}"),
            *[F.when(near, F.col(f"_hit.{c}")).alias(c) for c in right_cols],
        )
    )


def asof_backward(left: DataFrame, right: DataFrame, by: list[str], ts: str, right_cols: list[str], right_tie: list[str],
                  until: str | None = None, min_rows: int | None = None, slice_rows: int | None = None) -> DataFrame:
    """Each left row with the last right row of the same key at or before it: the one in force, with its time as
    ``matched_<ts>``. ``until``: a column of ``right`` at which a row ends; a left row at or after it has no match, also
    when an older right row would still hold.

    Oldest first, the last right row seen so far is the match. A slice of a hot key needs a single row from outside: the
    last right row of the slices before it."""
    l_cols = left.columns
    lhs = left.select(*by, ts, F.lit(1).alias("_side"), F.struct(*l_cols).alias("_row"))
    held = [F.col(c) for c in right_cols] + ([F.col(until).alias("_until")] if until else [])
    rhs = right.dropna(subset=by).select(
        *by, ts, F.lit(0).alias("_side"), F.struct(F.col(ts).alias("_at"), *held).alias("_match"), F.struct(*right_tie).alias("_tie"))
    rows = sliced(lhs.unionByName(rhs, allowMissingColumns=True), by, ts, min_rows, slice_rows)
    one = F.when(F.col("_side") == 0, F.struct(ts, "_match", "_tie"))
    order = F.when(F.col("_side") == 0, F.struct(ts, "_tie"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = (
        rows.where("_hot").groupBy(*by, "_slice").agg(F.max_by(one, order).alias("_f"))
        .withColumn("_f", F.last("_f", ignorenulls=True).over(earlier)).where("_f IS NOT NULL")
        .select(*by, f"_f.{ts}", F.lit(0).alias("_side"), "_f._match", "_f._tie", "_slice")
    )
    oldest = Window.partitionBy(*by, "_slice").orderBy(ts, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        rows.drop("_hot").unionByName(behind, allowMissingColumns=True)
        .withColumn("_hit", F.last("_match", ignorenulls=True).over(oldest)).where("_side = 1")
    )
    holds = F.coalesce(F.col(ts) < F.col("_hit._until"), F.lit(True)) if until else F.lit(True)
    return found.select("_row.*", *[F.when(holds, F.col(f"_hit.{c}")).alias(n) for c, n in [("_at", f"matched_{ts}"), *[(c, c) for c in right_cols]]])


def dealt_counts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """One row per (group, value ``_v``) with its rows ``_c``, dealt out by ranges, written with the number ``_part`` of its range."""
    counts = (
        df.where(F.col(value).isNotNull()).dropna(subset=group)
        .groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    )
    return staged(counts.repartitionByRange(*group, "_v").withColumn("_part", F.spark_partition_id()), "ranks")


def ranked_values(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """One row per (group, value) with the 1-based ranks it covers and the group size ``n``; values keep their type. Rows
    without a value or with a null in ``group`` are left out.

    Equal values are counted before the first shuffle. The counts are dealt out by ranges of (group, value), cut at sampled
    values, so a group whose values crowd in a narrow part is ranked in many tasks too. They are written once with the number
    of their range; the sum of the ranges before it makes a range's ranks."""
    keys = [*group, "_all"]
    cut = dealt_counts(df, group, value).withColumn("_all", F.lit(1))
    up = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        cut.groupBy(*keys, "_part").agg(F.sum("_c").alias("_bc"))
        .withColumn("_off", F.sum("_bc").over(up) - F.col("_bc"))
        .withColumn("n", F.sum("_bc").over(Window.partitionBy(*keys)))
        .drop("_bc")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(offsets, [*keys, "_part"])
        .withColumn("last_rank", F.col("_off") + F.sum("_c").over(inside))
        .withColumn("first_rank", F.col("last_rank") - F.col("_c") + 1)
        .select(*group, F.col("_v").alias("value"), F.col("_c").alias("count"), "first_rank", "last_rank", "n")
    )


def rank_pick(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column], **more: Column) -> DataFrame:
    """Exact order statistics per group: ``ranks`` maps an output name to a 1-based rank in terms of ``n``.

    ``more``: further aggregates over the rows of ``ranked_values`` (value, count)."""
    ranked = ranked_values(df, group, value)
    picks = [
        F.max(F.when(rank.between(F.col("first_rank"), F.col("last_rank")), F.col("value"))).alias(name)
        for name, rank in ranks.items()
    ]
    return ranked.groupBy(*group).agg(F.max("n").alias("n"), *picks, *[c.alias(name) for name, c in more.items()])


def group_median(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """Exact medians of several columns per group, one row per group, by rank: no task holds a group's values. The columns are
    stacked, so that they share the same shuffles. A group without any value has a row of nulls."""
    named = F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("v")) for v in values]))
    stacked = df.select(*group, named.alias("_s")).select(*group, "_s.name", "_s.v")
    n = F.col("n")
    picked = rank_pick(stacked, [*group, "name"], "v", {"_lo": F.floor((n + 1) / 2), "_hi": F.floor(n / 2) + 1})
    picked = picked.withColumn("_m", (F.col("_lo") + F.col("_hi")) / 2).select(*group, "name", "_m")
    picked = picked.unionByName(df.select(*group).distinct(), allowMissingColumns=True)
    return picked.groupBy(*group).agg(*[F.max(F.when(F.col("name") == v, F.col("_m"))).alias(v) for v in values])


def exact_rank(df: DataFrame, group: list[str], key: Column, tie: list[str], bits: int = 32,
               buckets_log2: int = 14) -> DataFrame:
    """Adds ``rank`` (1-based, by ``key`` then ``tie``) and ``n`` per group, for a key spread over 0 .. 2**bits-1.

    The key's leading bits cut every group into equal parts, so four strata still make thousands of tasks.
    """
    rows = df.withColumn("_k", key).withColumn("_b", F.shiftright("_k", bits - buckets_log2))
    up = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = (
        rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_off", F.sum("_c").over(up) - F.col("_c"))
        .withColumn("n", F.sum("_c").over(Window.partitionBy(*group)))
        .drop("_c")
    )
    inside = Window.partitionBy(*group, "_b").orderBy("_k", *tie)
    return (
        rows.join(offsets, [*group, "_b"])
        .withColumn("rank", F.col("_off") + F.row_number().over(inside))
        .drop("_b", "_off", "_k")
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key; the limit runs on the map side first, so a hot key shuffles one row per task."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    oldest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(oldest)).where("_rn = 1").drop("_rn")


def rounds_for(slices: int) -> int:
    return max(1, math.ceil(math.log2(slices + 1)))
