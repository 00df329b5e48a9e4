"""Keyed state: upserts, partial updates, change feeds between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.ordered import keep_last

KEYS = ["entity_id", "entity_type"]


def upsert(state: DataFrame, batch: DataFrame, order: list[str], keys: list[str] = KEYS) -> DataFrame:
    """Whole-row last write wins: the newest row of each key in the batch replaces the stored one."""
    newest = keep_last(batch, keys, order)
    untouched = state.join(newest.select(*keys), keys, "left_anti")
    return untouched.unionByName(newest, allowMissingColumns=True)


def overlay(entities: DataFrame, updates: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Sets the update's columns where there is an update and keeps every other column."""
    own = [c for c in updates.columns if c not in keys]
    new = updates.select(*keys, F.struct(*own).alias("_new"))
    joined = entities.join(new, keys, "left")
    kept = [c for c in entities.columns if c not in keys and c not in own]
    merged = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}").cast(entities.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        if c in entities.columns else F.col(f"_new.{c}").alias(c)
        for c in own
    ]
    return joined.select(*keys, *kept, *merged)


def change_feed(old: DataFrame, new: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """INSERT, MODIFY and REMOVE between two snapshots, with the old and new image of each changed row."""
    values = [c for c in new.columns if c not in keys]
    image = lambda name: F.struct(*values).alias(name)
    both = old.select(*keys, image("old_image")).join(new.select(*keys, image("new_image")), keys, "full_outer")
    before, after = F.col("old_image"), F.col("new_image")
    kind = (
        F.when(before.isNull(), "INSERT").when(after.isNull(), "REMOVE").when(~before.eqNullSafe(after), "MODIFY")
    )
    return both.withColumn("change_type", kind).where("change_type IS NOT NULL")


def new_images(feed: DataFrame) -> DataFrame:
    """What subscribers receive: the new image, or the old one of a removed row."""
    keys = [c for c in feed.columns if c not in ("old_image", "new_image", "change_type")]
    return feed.select(*keys, "change_type", F.coalesce("new_image", "old_image").alias("image")).select(*keys, "change_type", "image.*")
