"""Running state per key: the state after every row, for keys of any size.

A step adds to a number, or overwrites it, or maps it affinely; steps of one kind compose to one step. So every slice of a
key works on its own, the slices' whole steps are chained, and each row gets what was carried into its slice. Keys of
normal size are one slice, and nothing is joined to them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.ordered import slice_window, sliced


@dataclass(frozen=True)
class Step:
    """What a row does to a number: ``put`` (where not null) overwrites it, then ``add`` is added. It starts at ``start``."""

    add: Column
    put: Column
    start: float = 0


@dataclass(frozen=True)
class Affine:
    """What a row does to a number: x -> (x * (n - 1) + value) / n, where ``value`` is not null; ``put`` gives a row that sets
    it instead, before all others of its key. ``n`` and ``value`` may use the numbers that steps made."""

    n: Column
    value: Column
    put: Column


def _running(keys: list[str], ts: str, tie: list[str]):
    return slice_window(keys, ts, tie).rowsBetween(Window.unboundedPreceding, 0)


def state_after(df: DataFrame, keys: list[str], ts: str, tie: list[str], steps: dict[str, Step], affine: dict[str, Affine] | None = None,
                min_rows: int | None = None, slice_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``df`` with one column for each of ``steps`` and ``affine``: the number after that row, rows of a key going by
    (ts, tie). ``counted``: see ``sliced``."""
    affine = affine or {}
    marked = df.withColumns({f"_add_{m}": s.add for m, s in steps.items()} | {f"_put_{m}": s.put for m, s in steps.items()})
    rows = sliced(marked, keys, ts, min_rows, slice_rows, counted)
    w = _running(keys, ts, tie)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_n_{m}": F.sum(f"_add_{m}").over(w) for m in steps})
    # what the last overwrite made of the number, less what had been added up to and with it
    rows = rows.withColumns({f"_d_{m}": F.last(F.col(f"_put_{m}") + F.col(f"_add_{m}") - F.col(f"_n_{m}"), ignorenulls=True).over(w) for m in steps})

    last = F.struct(ts, *tie)
    ends = rows.where("_hot").groupBy(*keys, "_slice").agg(*[F.max_by(F.struct(f"_n_{m}", f"_d_{m}"), last).alias(m) for m in steps])
    whole = ends.withColumns({f"_all_{m}": F.sum(F.col(f"{m}._n_{m}")).over(through) for m in steps})
    # an overwrite within a slice, as seen from the key's first row
    whole = whole.withColumns({f"_off_{m}": F.col(f"{m}._d_{m}") + F.col(f"{m}._n_{m}") - F.col(f"_all_{m}") for m in steps})
    carried = whole.select(*keys, "_slice", *[
        (F.coalesce(F.last(f"_off_{m}", ignorenulls=True).over(earlier), F.lit(s.start)) + F.coalesce(F.last(f"_all_{m}").over(earlier), F.lit(0))).alias(f"_in_{m}")
        for m, s in steps.items()])
    rows = rows.join(carried, [*keys, "_slice"], "left")
    rows = rows.withColumns({m: F.col(f"_n_{m}") + F.coalesce(f"_d_{m}", f"_in_{m}", F.lit(s.start)) for m, s in steps.items()})
    if affine:
        rows = _affine_after(rows, keys, ts, tie, affine)
    return rows.select(*df.columns, *steps, *affine)


def _affine_after(rows: DataFrame, keys: list[str], ts: str, tie: list[str], affine: dict[str, Affine]) -> DataFrame:
    """A row's step is x -> a x + b. Up to a row they compose to A x + B with log A the sum of log a, and B = A * sum(b / A)."""
    w = _running(keys, ts, tie)
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    for m, s in affine.items():
        moves = s.value.isNotNull()
        # the first row of all has n = 1 and nothing before it, so its factor is of no account
        log_a = F.when(moves & (s.n > 1), F.ln((s.n - 1) / s.n)).otherwise(F.lit(0.0))
        b = F.when(moves, s.value / s.n).otherwise(F.coalesce(s.put, F.lit(0.0)))
        rows = rows.withColumns({f"_la_{m}": log_a, f"_b_{m}": b}).withColumn(f"_A_{m}", F.sum(f"_la_{m}").over(w))
        rows = rows.withColumn(f"_B_{m}", F.exp(f"_A_{m}") * F.sum(F.col(f"_b_{m}") * F.exp(-F.col(f"_A_{m}"))).over(w))
    ends = rows.where("_hot").groupBy(*keys, "_slice").agg(*[F.max_by(F.struct(f"_A_{m}", f"_B_{m}"), F.struct(ts, *tie)).alias(f"_e_{m}") for m in affine])
    for m in affine:
        up = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)
        ends = ends.withColumn(f"_s_{m}", F.sum(F.col(f"_e_{m}._A_{m}")).over(up))
        ends = ends.withColumn(f"_t_{m}", F.exp(f"_s_{m}") * F.sum(F.col(f"_e_{m}._B_{m}") * F.exp(-F.col(f"_s_{m}"))).over(up))
    carried = ends.select(*keys, "_slice", *[F.last(f"_t_{m}").over(earlier).alias(f"_x_{m}") for m in affine])
    rows = rows.join(carried, [*keys, "_slice"], "left")
    return rows.withColumns({m: F.exp(f"_A_{m}") * F.coalesce(f"_x_{m}", F.lit(0.0)) + F.col(f"_B_{m}") for m in affine})
