"""Micro-batch ingest: decode, validate, then state log, archive and quarantine from the same batch."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.validate import decode_records, enrich, event_items, normalise_payload, split_valid, validate_events
from tidewatch.sources.writers import append_state, append_tutors, archive_raw, batch_time, quarantine


def write_batch(batch: DataFrame, batch_id: int, path: str, received_at: Column | None = None) -> None:
    """All writes of one batch go to folders of its id, so a retry after a lost executor replaces them.

    Events replace earlier rows of their key; tutor rows are parts that add up over batches."""
    if received_at is None:
        received_at = batch_time(batch.sparkSession, os.path.join(path, "times"), batch_id)
    checked = validate_events(decode_records(batch)).persist()
    valid, rejected = split_valid(checked)
    events = normalise_payload(enrich(valid.drop("ts"), received_at, F.lit(None).cast("string"), F.lit(None).cast("string")))
    try:
        items = event_items(events, received_at)
        append_state(items.where("entity_type <> 'tutor'"), os.path.join(path, "state"), batch_id, ["ts", "event_id"])
        append_tutors(items, os.path.join(path, "tutors"), batch_id)
        archive_raw(checked, os.path.join(path, "archive"), received_at, batch_id)
        quarantine(rejected, os.path.join(path, "quarantine"), batch_id)
    finally:
        checked.unpersist()


def start_ingest(records: DataFrame, path: str, checkpoint: str, received_at: Column | None = None, once: bool = False):
    """Starts the ingest of a record stream; ``once`` works off what is there and stops."""
    writer = (
        records.writeStream.foreachBatch(lambda df, i: write_batch(df, i, path, received_at))
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()
