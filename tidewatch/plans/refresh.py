"""The prediction refresh: score every entity, lay the predictions over the table, write insights and metric points."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tidewatch.operators import scoring as S
from tidewatch.operators.changes import overlay
from tidewatch.sources.versions import VersionedTable
from tidewatch.sources.writers import append_points, batch_time, write_entities, write_insights


def refresh_predictions(entities: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, run: str, run_at: Column) -> None:
    """One run. ``score`` adds the five predictions; a row it cannot score takes the conservative defaults.

    All three outputs come from one persisted scoring pass and go to folders of the run, so a repeated run replaces them.
    """
    scored = S.recommendations(S.with_segment(S.with_prediction_defaults(score(entities)))).persist()
    try:
        stored = S.stored_predictions(scored, run_at).drop("health_score")
        write_entities(overlay(entities, stored), os.path.join(path, "entities", f"run={run}"))
        write_insights(S.generate_insights(scored, run_at), os.path.join(path, "insights"), run)
        append_points(S.metric_points(S.prediction_kpis(scored), run_at), os.path.join(path, "metrics"), run)
    finally:
        scored.unpersist()


def refresh_table(table: VersionedTable, score: Callable[[DataFrame], DataFrame], path: str, run: str, run_at: Column) -> None:
    """One run over the table's current version: predictions are laid over it as its next version, insights and points go to
    folders of the run below ``path``.

    The version is committed last, so a run that dies leaves the old one, and the run that takes its place replaces the
    insights and points it wrote. A run that has been committed is not done again."""
    now = table.current()
    if now is not None and now.run == run:
        return
    entities = table.read(now.number if now else None)
    scored = S.recommendations(S.with_segment(S.with_prediction_defaults(score(entities)))).persist()
    try:
        data = table.stage(overlay(entities, S.stored_predictions(scored, run_at).drop("health_score")))
        write_insights(S.generate_insights(scored, run_at), os.path.join(path, "insights"), run)
        append_points(S.metric_points(S.prediction_kpis(scored), run_at), os.path.join(path, "metrics"), run)
    finally:
        scored.unpersist()
    table.commit(data, run, now.number)
    table.vacuum()


def start_refresh(table: VersionedTable, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, every: str = "1 minute"):
    """Runs the refresh on a schedule: each batch of a clock stream reads the table's current version and writes the next."""
    spark = table.spark
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def run(_, i: int) -> None:
        at = batch_time(spark, os.path.join(path, "times"), i)  # the same at a retry
        refresh_table(table, score, path, f"batch-{i}", at)

    return clock.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(run).start()
