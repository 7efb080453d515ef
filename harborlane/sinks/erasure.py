"""Erasure and retention in the change job's outputs, which lie in a folder a batch.

The job notes which tenants, workspaces and integrations each batch has rows of, so an erasure reads
and rewrites only the folders of batches that hold the tenant. Rows go that carry the tenant's id, or
that name one of its workspaces or integrations, also inside a kept message. A folder is written beside
itself and then put in its own place, so a process that dies in between leaves the old or the new one
and an erasure that is run again ends the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborlane import session
from harborlane.functions.times import instant
from harborlane.operators.audit import check_tenant
from harborlane.operators.changes import message_integration, message_workspace
from harborlane.sinks import storage

# Days a batch is kept by default.
KEEP_DAYS = {
    "events": 7, "requests": 7, "tenants": 7, "counters": 7, "audit": 7, "dead_letters": 30, "alerts": 30,
}


def _of_message(value: Column) -> tuple[Column, Column, Column]:
    """Tenant, workspace and integration of a message."""
    return F.get_json_object(value, "$.customer_guid"), message_workspace(value), message_integration(value)


def _of_row(df: DataFrame) -> tuple[Column, Column, Column]:
    none = F.lit(None).cast("string")
    return tuple(
        F.col(c).cast("string") if c in df.columns else none
        for c in ("customer_guid", "workspace_id", "integration_id")
    )


#: Where a row of each output says whose it is.
OUTPUTS: dict[str, Callable[[DataFrame], tuple[Column, Column, Column]]] = {
    "requests": _of_row,
    "audit": _of_row,
    "events": lambda df: _of_message(F.col("value")),
    "dead_letters": lambda df: _of_message(F.col("original_message")),
    "alerts": lambda df: _of_message(F.get_json_object("value", "$.original_message")),
    "tenants": _of_row,
}


def erase_outputs(
    spark: SparkSession, out: str, customer_guid: str, workspaces: DataFrame, integrations: DataFrame
) -> dict[str, int]:
    """Delete a tenant's rows from all outputs below ``out``; how many folders of each were rewritten.

    ``workspaces`` and ``integrations`` are the tables as they are; what the tenant had earlier is known
    from the batches' notes.
    """
    check_tenant(customer_guid)
    noted = f"{out}/tenants"
    if not storage.exists(spark, noted):
        return dict.fromkeys(OUTPUTS, 0)
    index = spark.read.parquet(noted)
    own = index.where(F.col("customer_guid") == customer_guid)
    spaces = _kept(
        own.select("workspace_id").unionByName(
            workspaces.where(F.col("customer_guid") == customer_guid).select("workspace_id")
        ).dropna().distinct(),
        "erased-workspaces",
    )
    ids = _kept(
        own.select("integration_id").unionByName(
            integrations.join(spaces, "workspace_id", "left_semi")
            .select(F.col("integration_id").cast("string").alias("integration_id"))
        ).dropna().distinct(),
        "erased-integrations",
    )
    left = _without(index, _of_row(index), customer_guid, spaces, ids)
    batches = index.exceptAll(left).select("batch_id").distinct().collect()
    done = dict.fromkeys(OUTPUTS, 0)
    # The notes go last, so an erasure that was broken off finds its batches again.
    for name, owner in OUTPUTS.items():
        for (number,) in batches:
            path = f"{out}/{name}/batch_id={number}"
            if not storage.exists(spark, path):
                continue
            rows = spark.read.parquet(path)
            beside = f"{out}/{name}/.erasing-{number}"
            _without(rows, owner(rows), customer_guid, spaces, ids).write.mode("overwrite").parquet(beside)
            storage.replace(spark, path, beside)
            done[name] += 1
    return done


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = session.fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _without(
    rows: DataFrame, owner: tuple[Column, Column, Column], guid: str, spaces: DataFrame, ids: DataFrame
) -> DataFrame:
    tenant, workspace, integration = owner
    return (
        rows.withColumns({"_tenant": tenant, "_workspace": workspace, "_integration": integration})
        .where(F.coalesce(F.col("_tenant") != guid, F.lit(True)))
        .join(spaces.select(F.col("workspace_id").alias("_workspace")), "_workspace", "left_anti")
        .join(ids.select(F.col("integration_id").alias("_integration")), "_integration", "left_anti")
        .select(*rows.columns)
    )


def drop_old_batches(
    spark: SparkSession, out: str, now, keep_days: dict[str, int] | None = None
) -> dict[str, list[int]]:
    """Delete the outputs of batches whose last message is older than an output's days; the batches.

    The time of a batch is in its metrics, which stay, as totals are made of them.
    """
    keep_days = KEEP_DAYS if keep_days is None else keep_days
    path = f"{out}/metrics"
    if not storage.exists(spark, path):
        return {name: [] for name in keep_days}
    times = spark.read.parquet(path).groupBy("batch_id").agg(F.max("last_message_time").alias("at"))
    now = instant(now) if not isinstance(now, Column) else now
    dropped = {}
    for name, days in keep_days.items():
        old = times.where(F.col("at") < F.timestamp_add("DAY", F.lit(-days), now)).select("batch_id")
        dropped[name] = sorted(
            number for (number,) in old.collect()
            if storage.delete(spark, f"{out}/{name}/batch_id={number}")
        )
    return dropped
