"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    # The last of repeated keys in a JSON object counts, as in most parsers.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Call sites are recorded for every column otherwise, which is slow for long expressions.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app: str = "harborlane", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as the cluster names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    base = tempfile.mkdtemp(prefix="harborlane-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path under the work folder that no earlier run has used."""
    return f"{work_dir(spark)}/harborlane/{label}-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on disk with incremental checkpoints, not on the heap.

    Rows of the state are not counted: for that, each key that is put would be looked up once more.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
