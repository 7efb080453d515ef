"""The change stream: parse, classify, key, deduplicate, and turn creations into run requests.

The parse is one projection over the topic records, used unchanged on a batch and on a stream.
Data errors become columns; nothing in here raises for a bad message.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harborlane import schemas
from harborlane.functions import conf, text, trace
from harborlane.operators import dispatch

# Fixed values.
DEDUP_PREFIX = "dedup:kafka:"
EVENT_OF_OP = {"c": "integration.created", "u": "integration.updated", "d": "integration.deleted"}
LOGGED_EVENTS = [
    "integration.updated",
    "integration.deleted",
    "integration.run.started",
    "integration.run.completed",
    "integration.run.failed",
]

REQUEST_COLUMNS = [
    "integration_id", "workspace_id", "customer_guid", "dag_id", "dag_run_id", "conf",
    "traceparent", "trace_id", "dedup_key",
]

_CORRUPT = "_corrupt"


def _truthy(value: Column) -> Column:
    return F.when(~value.isin("", "0", "false"), value)


def _event_of(op: Column) -> Column:
    found = F.lit(None).cast("string")
    for code, event in EVENT_OF_OP.items():
        found = F.when(op == code, F.lit(event)).otherwise(found)
    return found


def dedup_key(topic: Column, partition: Column, offset: Column, message: Column) -> Column:
    """Change rows: topic, id, source time and op; else the event id; else partition and offset."""
    op = message["__op"]
    change = F.when(
        op.isNotNull()
        & _truthy(message["integration_id"]).isNotNull()
        & _truthy(message["__source_ts_ms"]).isNotNull(),
        F.concat_ws(":", message["integration_id"], message["__source_ts_ms"], op),
    )
    event_id = F.when(message["event_id"] != "", message["event_id"])
    place = F.concat_ws(":", partition.cast("string"), offset.cast("string"))
    return F.concat(
        F.lit(DEDUP_PREFIX), topic, F.lit(":"), F.coalesce(change, event_id, place)
    )


def parse(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Topic records (tombstones dropped) to classified events.

    ``route`` is ``trigger``, ``log`` or ``reject``; rejects carry ``reason``. Columns named in
    ``keep`` go through unchanged.
    """
    message = F.from_json(
        "value", f"{schemas.MESSAGE}, {_CORRUPT} string", {"columnNameOfCorruptRecord": _CORRUPT}
    )
    m = F.col("_m")
    is_change, is_legacy = m["__op"].isNotNull(), m["event_type"].isNotNull()
    malformed = m[_CORRUPT].isNotNull() | ~F.ltrim(F.col("value")).startswith("{")
    event_type = F.when(is_change, _event_of(m["__op"])).otherwise(m["event_type"])
    integration = F.when(is_change, m["integration_id"]).otherwise(m["data"]["integration_id"])
    eligible = F.when(is_change, m["integration_id"].isNotNull()).otherwise(
        (F.coalesce(m["data"]["workflow_type"], F.lit("")) != "")
        & (F.size(F.map_keys(F.coalesce(m["data"]["source_config"], _no_config()))) > 0)
        & (F.size(F.map_keys(F.coalesce(m["data"]["destination_config"], _no_config()))) > 0)
    )
    reason = (
        F.when(malformed, F.lit("malformed json"))
        .when(~is_change & ~is_legacy, F.lit("unknown message format"))
        .when(
            is_change & F.col("event_type").isNull(),
            F.concat(F.lit("unknown operation "), m["__op"]),
        )
        .when(
            (F.col("event_type") != "integration.created")
            & ~F.col("event_type").isin(LOGGED_EVENTS),
            F.concat(F.lit("unknown event type "), F.col("event_type")),
        )
    )
    parent = trace.traceparent_or_new(
        F.col("_header"), F.col("topic"), F.col("partition"), F.col("offset")
    )
    return (
        records.where(F.col("value").isNotNull())
        .withColumns(
            {"_m": message, "_header": trace.header_value(F.col("headers"), "traceparent")}
        )
        .withColumn("event_type", event_type)
        .withColumn("reason", reason)
        .withColumn("traceparent", parent)
        .select(
            "topic",
            "partition",
            "offset",
            "timestamp",
            "value",
            "event_type",
            is_change.alias("is_change"),
            m["__op"].alias("op"),
            m["__source_ts_ms"].try_cast("bigint").alias("source_ts_ms"),
            integration.try_cast("bigint").alias("integration_id"),
            m["workspace_id"].alias("event_workspace_id"),
            F.coalesce(m["data"]["run_id"]).alias("run_ref"),
            m["data"]["source_config"].alias("source_config"),
            m["data"]["destination_config"].alias("destination_config"),
            dedup_key(F.col("topic"), F.col("partition"), F.col("offset"), m).alias("dedup_key"),
            "traceparent",
            trace.trace_id(F.col("traceparent")).alias("trace_id"),
            F.when(F.col("reason").isNotNull(), "reject")
            .when(
                (F.col("event_type") == "integration.created") & F.coalesce(eligible, F.lit(False)),
                "trigger",
            )
            .otherwise("log")
            .alias("route"),
            "reason",
            *keep,
        )
    )


def _no_config() -> Column:
    return F.expr("cast(map() as map<string,variant>)")


def deduplicate(events: DataFrame) -> DataFrame:
    """Batch form: the first delivery of each key by partition and offset.

    The rank limit is applied before the shuffle as well, so a key delivered very often is cut to
    one row per task first.
    """
    order = W.partitionBy("dedup_key").orderBy("partition", "offset")
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def latest_state(events: DataFrame) -> DataFrame:
    """Current row per integration from its changes: newest wins, deleted ones are gone.

    Snapshot rows (``r``) count as states here although they trigger nothing.
    """
    changes = events.where(F.col("is_change") & F.col("integration_id").isNotNull())
    order = W.partitionBy("integration_id").orderBy(
        F.desc("source_ts_ms"), F.desc("offset"), F.desc("partition")
    )
    newest = changes.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return newest.where(F.col("op") != "d").drop("_n")


def route_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("route", "event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


def narrow(
    events: DataFrame, integrations: DataFrame, workspaces: DataFrame, auths: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the three tables that the trigger events of a small batch can need.

    The ids of the batch are the small side of a semi-join, which Spark broadcasts by its size, so
    the tables are scanned but not shuffled. The first result is cached, for its size decides how
    the other two are reduced; unpersist it after use.
    """
    ids = events.where(F.col("route") == "trigger").select("integration_id").distinct()
    stored = integrations.join(ids, "integration_id", "left_semi").persist()
    stored.count()
    spaces = stored.select("workspace_id").distinct()
    return (
        stored,
        workspaces.join(spaces, "workspace_id", "left_semi"),
        auths.join(spaces, "workspace_id", "left_semi"),
    )


def resolve(
    events: DataFrame, integrations: DataFrame, workspaces: DataFrame, auths: DataFrame, now: Column
) -> DataFrame:
    """Trigger events with their conf, or the ``error`` that keeps them from running."""
    return with_request(
        events.where(F.col("route") == "trigger"), integrations, workspaces, auths, now
    )


def with_request(
    events: DataFrame,
    integrations: DataFrame,
    workspaces: DataFrame,
    auths: DataFrame,
    now: Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The run request of each event by its ``integration_id``; ``error`` where there is none.

    The stored row is joined on, so the event's copy of it is never trusted. For a change event
    the stored document also overrides the credentials; a legacy event brings its own source and
    destination settings. The trace header is put back last.
    """
    wanted = events.select(
        "topic", "partition", "offset", "timestamp", "value", "integration_id", "is_change",
        "source_config", "destination_config", "dedup_key", "traceparent", "trace_id", *keep,
    )
    stored = integrations.select("workspace_id", "json_data", *dispatch.CONF_COLUMNS)
    rows = (
        wanted.join(stored, "integration_id", "left")
        .join(dispatch.tenancy(workspaces, auths), "workspace_id", "left")
        .withColumn("customer_guid", F.coalesce("customer_guid", F.lit("unknown")))
    )
    own = conf.merge(F.col("source_config"), F.col("destination_config"))
    rows = (
        rows.withColumn("_document", conf.json_map(F.col("json_data")))
        .withColumn("_override", F.when(F.col("is_change"), F.col("_document")).otherwise(own))
        .withColumn("_trace", conf.base_conf(traceparent=F.col("traceparent")))
        .withColumn(
            "_conf",
            conf.merge(
                dispatch.base_conf(),
                F.col("_document"),
                F.col("credentials"),
                F.col("_override"),
                F.col("_trace"),
            ),
        )
    )
    found = F.col("workspace_id").isNotNull()
    target = conf.workflow_run_target(F.col("integration_type"))
    run_id = F.concat_ws(
        "_",
        conf.run_id(F.col("workspace_id"), target, "manual", now, F.col("integration_id")),
        F.col("partition").cast("string"),
        F.col("offset").cast("string"),
    )
    return rows.select(
        "topic", "partition", "offset", "timestamp", "value", "dedup_key", "traceparent", "trace_id",
        "integration_id", "workspace_id", "customer_guid",
        F.when(found, target).alias("dag_id"),
        F.when(found, run_id).alias("dag_run_id"),
        F.when(found, conf.conf_text(F.col("_conf"))).alias("conf"),
        F.when(~found, F.lit("integration not found")).alias("error"),
        *keep,
    )


def requests(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("error").isNull()).select(*REQUEST_COLUMNS)


def rejects(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """Everything that could not be handled, with the reason: bad messages and lookup misses."""
    columns = ["topic", "partition", "offset", "timestamp", "value", "reason"]
    bad = events.where(F.col("route") == "reject").select(*columns)
    missed = resolved.where(F.col("error").isNotNull()).withColumnRenamed("error", "reason")
    return bad.unionByName(missed.select(*columns))


def message_workspace(value: Column) -> Column:
    """The workspace a message names: top level, else under ``data``, there also as the tenant."""
    found = [F.get_json_object(value, f"$.{p}") for p in ("workspace_id", "data.workspace_id", "data.tenant_id")]
    return F.coalesce(*[_truthy(f) for f in found])


def tenants(events: DataFrame, resolved: DataFrame) -> DataFrame:
    """(customer_guid, workspace_id, integration_id) a batch has rows of, each once: as they were found,
    and, without a customer, as the messages name them."""
    found = resolved.where(F.col("error").isNull()).select(
        "customer_guid", "workspace_id", F.col("integration_id").cast("string").alias("integration_id")
    )
    named = events.select(
        F.lit(None).cast("string").alias("customer_guid"),
        message_workspace(F.col("value")).alias("workspace_id"),
        message_integration(F.col("value")).alias("integration_id"),
    )
    return found.unionByName(named).distinct()


def error_type_of(reason: Column) -> Column:
    return (
        F.when(reason == "malformed json", "ValueError")
        .when(reason == "integration not found", "LookupError")
        .otherwise("KeyError")
    )


def message_integration(value: Column) -> Column:
    """The integration a message names: top level, else under ``data``."""
    top = _truthy(F.get_json_object(value, "$.integration_id"))
    return F.coalesce(top, _truthy(F.get_json_object(value, "$.data.integration_id")))


def dead_letters(rejected: DataFrame, consumer_group: str, now: Column) -> DataFrame:
    """Reject rows in the shape of the dead-letter table.

    The id is 60 bits of the hash of the record's topic and place in it, the same on a rerun.
    """
    named = message_integration(F.col("value"))
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    return rejected.select(
        F.conv(F.substring(F.sha2(place, 256), 1, 15), 16, 10).cast("bigint").alias("dlq_id"),
        named.try_cast("bigint").alias("integration_id"),
        F.col("topic").alias("source_topic"),
        F.lit(consumer_group).alias("consumer_group"),
        F.coalesce(named, F.lit("unknown")).alias("message_key"),
        F.col("value").alias("original_message"),
        error_type_of(F.col("reason")).alias("error_type"),
        F.col("reason").alias("error_message"),
        F.lit(0).alias("retry_count"),
        F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("resolution_notes"),
        F.lit(None).cast("timestamp_ntz").alias("resolved_at"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def alert_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as key and JSON value for an alert topic."""
    value = F.to_json(
        F.struct(
            "original_message",
            F.struct(
                F.col("error_type").alias("type"),
                F.col("error_message").alias("message"),
                F.replace(F.col("created_at").cast("string"), F.lit(" "), F.lit("T")).alias("timestamp"),
            ).alias("error"),
            "retry_count",
            "source_topic",
            "consumer_group",
        )
    )
    return letters.select(F.col("message_key").alias("key"), value.alias("value"))


def trigger_audit(accepted: DataFrame, now: Column) -> DataFrame:
    """One audit event per accepted request, under the customer the workspace belongs to."""
    from harborlane.operators import audit

    return audit.build_events(
        accepted,
        now,
        identity=[F.col("dedup_key"), F.lit("cdc")],
        customer_guid=F.col("customer_guid"),
        event_type=F.lit("integration.cdc_triggered"),
        actor_id=F.lit("kafka-consumer"),
        actor_type=F.lit("system"),
        resource_type=F.lit("integration"),
        resource_id=F.col("integration_id").cast("string"),
        action=F.lit("trigger"),
        outcome=F.lit("success"),
        trace_id=F.col("trace_id"),
        metadata=F.struct("dag_id", "dag_run_id", F.lit("cdc").alias("trigger_source")),
    )


def dead_letter_audit(letters: DataFrame, workspaces_of: DataFrame, now: Column) -> DataFrame:
    """One audit event per dead letter. ``workspaces_of`` maps integration_id to customer_guid;
    letters without a known customer go to the ``system`` tenant."""
    from harborlane.operators import audit

    owned = letters.join(
        workspaces_of.select("integration_id", "customer_guid"), "integration_id", "left"
    )
    return audit.build_events(
        owned,
        now,
        identity=[F.col("dlq_id"), F.col("source_topic"), F.lit("dead_letter")],
        customer_guid=F.coalesce("customer_guid", F.lit("system")),
        event_type=F.lit("message.dead_lettered"),
        actor_id=F.lit("kafka-consumer"),
        actor_type=F.lit("system"),
        resource_type=F.lit("message"),
        resource_id=F.col("message_key"),
        action=F.lit("dead_letter"),
        outcome=F.lit("failure"),
        metadata=F.struct(
            "error_type",
            text.capped(F.col("error_message"), text.AUDIT_ERROR_LIMIT).alias("error_message"),
            "retry_count",
            "source_topic",
        ),
    )


def metrics(events: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row over a batch: messages, failed ones, the last error and the time of the last message."""
    error = F.lit(None).cast("string")
    rows = events.select("timestamp", error.alias("reason")).unionByName(
        rejected.select("timestamp", "reason")
    )
    failed = F.col("reason").isNotNull()
    return rows.agg(
        F.count_if(~failed).alias("messages"),
        F.count_if(failed).alias("failed"),
        F.max(F.when(failed, F.struct("timestamp", "reason"))).alias("last"),
        F.max("timestamp").alias("last_message_time"),
    ).select(
        "messages",
        "failed",
        F.col("last.timestamp").alias("last_error_time"),
        F.col("last.reason").alias("last_error"),
        "last_message_time",
    )


def total_metrics(batches: DataFrame) -> DataFrame:
    """The same row over all batches, from one row of each."""
    error = F.struct("last_error_time", "last_error")
    return batches.agg(
        F.coalesce(F.sum("messages"), F.lit(0)).alias("messages"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed"),
        F.max(F.when(F.col("last_error").isNotNull(), error)).alias("last"),
        F.max("last_message_time").alias("last_message_time"),
    ).select(
        "messages",
        "failed",
        F.col("last.last_error_time").alias("last_error_time"),
        F.col("last.last_error").alias("last_error"),
        "last_message_time",
    )


def health(metrics: DataFrame) -> DataFrame:
    """Stream status from counters (running, last_error, last_message_time)."""
    status = (
        F.when(~F.col("running"), "unhealthy")
        .when(F.col("last_error").isNotNull() & F.col("last_message_time").isNotNull(), "degraded")
        .otherwise("healthy")
    )
    return metrics.withColumn("status", status)
