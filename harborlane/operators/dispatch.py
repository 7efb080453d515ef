"""Due runs of all tenants: one plan from schedules to run requests and advanced schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborlane import schemas
from harborlane.functions import conf, trace
from harborlane.operators import schedule

CONF_COLUMNS = [
    "integration_id",
    "integration_type",
    "auth_id",
    "source_access_pt_id",
    "dest_access_pt_id",
]


def is_due(now: Column, integration_type: str | None = None) -> Column:
    """Active, timed, and its next run is not in the future; spelling of the type is ignored."""
    due = (
        (F.col("usr_sch_status") == "active")
        & F.col("schedule_type").isin(schemas.TIMED_SCHEDULES)
        & F.col("utc_next_run").isNotNull()
        & (F.col("utc_next_run") <= now)
    )
    if integration_type is None:
        return due
    return due & (
        conf.workflow_name(F.col("integration_type")) == conf.workflow_name(F.lit(integration_type))
    )


def credentials(auths: DataFrame) -> DataFrame:
    """One map per workspace, folded over its auth rows; on equal keys the later row wins.

    The fold is an aggregate per (workspace, key), so a workspace with very many auth rows is
    reduced before the shuffle; the map holds one entry per distinct key.
    """
    entries = auths.select(
        "workspace_id", "auth_id", F.explode(conf.json_map(F.col("json_data"))).alias("k", "v")
    )
    latest = entries.groupBy("workspace_id", "k").agg(F.max_by("v", "auth_id").alias("v"))
    return latest.groupBy("workspace_id").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("credentials")
    )


def ignored_credentials(auths: DataFrame) -> DataFrame:
    """(workspace_id, auth_id, warning) of the rows ``credentials`` can make nothing of."""
    document = conf.json_map(F.col("json_data"))
    return auths.where(conf.ignored(F.col("json_data"), document)).select(
        "workspace_id", "auth_id", F.lit("credentials ignored").alias("warning")
    )


def with_tenant(integrations: DataFrame, workspaces: DataFrame, how: str = "inner") -> DataFrame:
    """Add ``customer_guid``; with ``left``, rows without a workspace get "unknown"."""
    joined = integrations.join(
        workspaces.select("workspace_id", "customer_guid"), "workspace_id", how
    )
    if how == "inner":
        return joined
    return joined.withColumn("customer_guid", F.coalesce("customer_guid", F.lit("unknown")))


def tenancy(workspaces: DataFrame, auths: DataFrame) -> DataFrame:
    """One row per workspace that has a customer or credentials: customer_guid and credentials.

    Joining these two first leaves a single join from the many rows to their workspace, whose hot
    keys the adaptive skew join can split; two joins in a row on the same key it could not.
    """
    return workspaces.select("workspace_id", "customer_guid").join(
        credentials(auths), "workspace_id", "full_outer"
    )


def base_conf(*extra: str) -> Column:
    fields = {"tenant_id": F.col("workspace_id")}
    fields |= {name: F.col(name) for name in [*CONF_COLUMNS, *extra]}
    return conf.base_conf(**fields)


def due_requests(
    integrations: DataFrame,
    workspaces: DataFrame,
    auths: DataFrame,
    now: Column,
    integration_type: str | None = None,
    frozen_offset: bool = False,
) -> DataFrame:
    """Run requests: conf, run id and the schedule's next time, one row per due integration.

    The rows are dealt out by integration before their conf is made: the join leaves them by
    workspace, or all in the few tasks of the workspaces when Spark broadcasts the integrations.
    """
    due = integrations.where(is_due(now, integration_type))
    rows = (
        due.join(tenancy(workspaces, auths), "workspace_id")
        .where(F.col("customer_guid").isNotNull())
        .repartition("integration_id")
    )
    target = conf.workflow_run_target(F.col("integration_type"))
    parent = trace.traceparent_or_new(
        F.lit(None).cast("string"), F.col("integration_id"), F.col("utc_next_run"), now
    )
    rows = rows.withColumns(
        {"traceparent": parent, "_document": conf.json_map(F.col("json_data"))}
    ).withColumn(
        "_conf",
        conf.merge(
            base_conf("customer_guid", "traceparent"), F.col("_document"), F.col("credentials")
        ),
    )
    return schedule.with_advanced_run(rows, now, frozen_offset).select(
        "integration_id",
        "workspace_id",
        "customer_guid",
        target.alias("dag_id"),
        conf.run_id(
            F.col("workspace_id"), target, "scheduled", now, F.col("integration_id")
        ).alias("trigger_run_id"),
        conf.conf_text(F.col("_conf")).alias("conf"),
        F.col("utc_next_run").alias("due_run"),
        F.col("advanced_run").alias("utc_next_run"),
        F.when(
            conf.ignored(F.col("json_data"), F.col("_document")), F.lit("json_data ignored")
        ).alias("warning"),
    )


def advance_due(
    integrations: DataFrame,
    now: Column,
    integration_type: str | None = None,
    frozen_offset: bool = False,
) -> DataFrame:
    """The integrations table after the dispatch."""
    return schedule.advance(integrations, is_due(now, integration_type), now, frozen_offset)


def manual_request(
    integrations: DataFrame, auths: DataFrame, overrides: DataFrame, now: Column
) -> DataFrame:
    """Requests for the integrations named in ``overrides`` (integration_id, run_config JSON).

    The override document wins over credentials, which win over the stored document.
    """
    asked = overrides.select("integration_id", "run_config")
    rows = asked.join(integrations, "integration_id", "left").join(
        credentials(auths), "workspace_id", "left"
    )
    target = conf.workflow_run_target(F.col("integration_type"))
    rows = rows.withColumns(
        {
            "_document": conf.json_map(F.col("json_data")),
            "_override": conf.json_map(F.col("run_config")),
        }
    ).withColumn(
        "_conf",
        conf.merge(base_conf(), F.col("_document"), F.col("credentials"), F.col("_override")),
    )
    found = F.col("workspace_id").isNotNull()
    return rows.select(
        "integration_id",
        F.when(found, target).alias("dag_id"),
        F.when(
            found, conf.run_id(F.col("workspace_id"), target, "manual", now, F.col("integration_id"))
        ).alias("dag_run_id"),
        F.when(found, conf.conf_text(F.col("_conf"))).alias("conf"),
        F.when(~found, F.lit("integration not found")).alias("error"),
        F.nullif(
            F.concat_ws(
                ", ",
                F.when(conf.ignored(F.col("json_data"), F.col("_document")), F.lit("json_data ignored")),
                F.when(conf.ignored(F.col("run_config"), F.col("_override")), F.lit("run_config ignored")),
            ),
            F.lit(""),
        ).alias("warning"),
    )
