"""The partitioned audit store: appends, erasure and retention by folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from harborlane.operators.audit import check_tenant
from harborlane.sinks import storage

AUDIT_PARTITIONS = ("customer_guid", "event_month")


def append_partitioned(
    df: DataFrame, path: str, columns: tuple[str, ...] = AUDIT_PARTITIONS
) -> None:
    """Append with few files per folder.

    ``rebalance`` groups rows by folder and lets the adaptive planner split a folder that holds a
    large share of the rows over several tasks.
    """
    df.hint("rebalance", *columns).write.mode("append").partitionBy(*columns).parquet(path)


def erase_tenant(spark: SparkSession, paths: list[str], customer_guid: str) -> int:
    """Delete the tenant's folder under every store; returns how many there were.

    An id that could name any other folder is refused before anything is deleted.
    """
    check_tenant(customer_guid)
    return sum(
        storage.delete(spark, f"{path.rstrip('/')}/customer_guid={customer_guid}") for path in paths
    )


def drop_older(spark: SparkSession, path: str, column: str, oldest: str) -> list[str]:
    """Delete the folders ``column=value`` with a value before ``oldest``, under ``path`` and under
    folders of other partition columns, such as the tenants'. Returns their paths below ``path``."""
    prefix, root = f"{column}=", path.rstrip("/")
    dropped = []
    for name in storage.names(spark, root):
        if name.startswith(prefix):
            if name[len(prefix):] < oldest and storage.delete(spark, f"{root}/{name}"):
                dropped.append(name)
        elif "=" in name:
            below = drop_older(spark, f"{root}/{name}", column, oldest)
            dropped += [f"{name}/{found}" for found in below]
    return dropped
