"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(app: str = "tidewatch", master: str | None = None, **conf: object) -> SparkSession:
    """A session with the settings the operators expect; on a cluster the master comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), str(value))
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on; leaves sizing (shuffle partitions, memory) to the cluster."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # lookups join a table of one row per key: a hot key's partition is split even if that costs one more shuffle
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for checkpoints and staged tables below ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of this machine: on a cluster the
    executors could not see it, so an unset setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _LOCAL_SCRATCH.setdefault(app, tempfile.mkdtemp(prefix="tidewatch-"))
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(os.path.join(base, "rdd"))
    token = spark.sql("SELECT uuid()").first()[0]
    return os.path.join(base, f"{name}-{token}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back, where several later steps start from it: a lost
    executor costs no recomputation of what came before, and what depends on how rows were dealt out stays as it was."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
