"""Alarms on a stream: a state machine per alarm, driven by timers, so that periods without data are judged as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.alerts import alarm_rules

OUTPUT = "alarm STRING, period_start TIMESTAMP, value DOUBLE, breach BOOLEAN, in_alarm BOOLEAN"
RULE = "metric STRING, statistic STRING, period_s INT, op STRING, threshold DOUBLE, periods INT"
COMPARE = {">": lambda x, limit: x > limit, ">=": lambda x, limit: x >= limit, "<": lambda x, limit: x < limit, "<=": lambda x, limit: x <= limit}


class AlarmMachine(StatefulProcessor):
    """One alarm: sums of its open periods, the next period to judge, and how many periods in a row breach.

    A period is judged when the watermark passes its end; one without data is calm. Rows come in already summed per grid
    cell, so an alarm's work follows the number of cells and not of points."""

    def __init__(self, start_us: int):
        self.start_us = start_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rule = handle.getValueState("rule", RULE)
        self.open = handle.getMapState("open", "period LONG", "total DOUBLE, n LONG, top DOUBLE")
        self.at = handle.getValueState("at", "next LONG, run INT")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rule = initialState.iloc[0]
        self.rule.update((rule.metric, rule.statistic, int(rule.period_s), rule.op, float(rule.threshold), int(rule.periods)))
        width = int(rule.period_s) * 1_000_000
        first = self.start_us // width * width
        self.at.update((first, 0))
        self.handle.registerTimer((first + width) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        width, (following, _) = self.rule.get()[2] * 1_000_000, self.at.get()
        for chunk in rows:
            chunk = chunk.assign(period=chunk["cell"] // width * width)
            sums = chunk[chunk["period"] >= following].groupby("period").agg(total=("total", "sum"), n=("n", "sum"), top=("top", "max"))
            for period, total, n, top in sums.itertuples():
                old = self.open.getValue((int(period),)) if self.open.containsKey((int(period),)) else (0.0, 0, float("-inf"))
                self.open.updateValue((int(period),), (float(old[0] + total), int(old[1] + n), float(max(old[2], top))))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, statistic, period_s, op, threshold, periods = self.rule.get()
        width, (period, run), out = period_s * 1_000_000, self.at.get(), []
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        while period + width <= passed:
            value = None
            if self.open.containsKey((period,)):
                total, n, top = self.open.getValue((period,))
                value = {"Sum": total, "Average": total / n}.get(statistic, top)
                self.open.removeKey((period,))
            breach = value is not None and COMPARE[op](value, threshold)
            run = run + 1 if breach else 0
            out.append((key[0], period, value, breach, run >= periods))
            period += width
        self.at.update((period, run))
        self.handle.registerTimer((period + width) // 1000)
        if out:
            frame = pd.DataFrame(out, columns=["alarm", "period_start", "value", "breach", "in_alarm"])
            frame["period_start"] = pd.to_datetime(frame["period_start"], unit="us")
            frame["value"] = frame["value"].astype("float64")
            yield frame

    def close(self) -> None:
        pass


def alarm_states(points: DataFrame, rules: list[tuple], start_us: int, delay: str = "1 hour") -> DataFrame:
    """State of every alarm and period from ``start_us`` on (microseconds), for a stream of points (metric, timestamp, value).

    Points are summed per metric and grid cell first, in all tasks; a cell is as long as the longest time that divides all
    periods. Rules are the machines' first state, so an alarm whose metric never appears is judged too."""
    from math import gcd

    spark = points.sparkSession
    table = alarm_rules(spark, rules)
    cell = gcd(*[r[3] for r in rules])
    cells = points.withWatermark("timestamp", delay).groupBy("metric", F.window("timestamp", f"{cell} seconds")).agg(
        F.sum("value").alias("total"), F.count("value").alias("n"), F.max("value").alias("top")).where("n > 0")
    mine = cells.select(F.window_time("window").alias("at"), F.unix_micros("window.start").alias("cell"), "metric", "total", "n", "top").join(
        F.broadcast(table.select("alarm", "metric")), "metric").drop("metric")
    return mine.groupBy("alarm").transformWithStateInPandas(
        AlarmMachine(start_us), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime", initialState=table.groupBy("alarm"))
