"""Schemas of the operational tables and of the messages."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.BooleanType(),
    T.TimestampNTZType(),
)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


CUSTOMERS = _table(customer_guid=_S, name=_S, max_integration=_I)
WORKSPACES = _table(workspace_id=_S, customer_guid=_S)
AUTHS = _table(auth_id=_L, workspace_id=_S, auth_type=_S, json_data=_S)
ACCESS_POINTS = _table(access_pt_id=_I, ap_type=_S)
WORKFLOWS = _table(workflow_id=_I, workflow_type=_S)
INTEGRATIONS = _table(
    integration_id=_L,
    workspace_id=_S,
    workflow_id=_I,
    auth_id=_I,
    source_access_pt_id=_I,
    dest_access_pt_id=_I,
    integration_type=_S,
    usr_sch_cron=_S,
    usr_sch_status=_S,
    usr_timezone=_S,
    utc_next_run=_TS,
    utc_sch_cron=_S,
    schedule_type=_S,
    json_data=_S,
    created_at=_TS,
    updated_at=_TS,
)
INTEGRATION_RUNS = _table(
    run_id=_L,
    integration_id=_L,
    dag_run_id=_S,
    started=_TS,
    ended=_TS,
    is_success=_B,
    execution_date=_TS,
)
INTEGRATION_RUN_ERRORS = _table(
    error_id=_L, run_id=_L, error_code=_S, message=_S, task_id=_S, timestamp=_TS
)
DEAD_LETTERS = _table(
    dlq_id=_L,
    integration_id=_L,
    source_topic=_S,
    consumer_group=_S,
    message_key=_S,
    original_message=_S,
    error_type=_S,
    error_message=_S,
    retry_count=_I,
    status=_S,
    resolution_notes=_S,
    resolved_at=_TS,
    created_at=_TS,
    updated_at=_TS,
)
AUDIT_EVENT = _table(
    event_id=_S,
    timestamp=_TS,
    customer_guid=_S,
    event_type=_S,
    actor_id=_S,
    actor_type=_S,
    actor_ip=_S,
    resource_type=_S,
    resource_id=_S,
    action=_S,
    outcome=_S,
    before_state=_S,
    after_state=_S,
    trace_id=_S,
    request_id=_S,
    metadata_json=_S,
)

# The 15 columns an audit page shows; the tenant is the partition, not a column of the page.
AUDIT_PAGE_COLUMNS = [name for name in AUDIT_EVENT.names if name != "customer_guid"]

TOPIC_RECORD = T.StructType(
    [
        T.StructField("key", _S),
        T.StructField("value", _S),
        T.StructField("topic", _S),
        T.StructField("partition", _I),
        T.StructField("offset", _L),
        T.StructField("timestamp", _TS),
        T.StructField(
            "headers",
            T.ArrayType(
                T.StructType([T.StructField("key", _S), T.StructField("value", T.BinaryType())])
            ),
        ),
    ]
)

# Change rows and legacy envelopes in one schema. Loosely typed fields stay text and are cast
# with try_cast, so one bad field never loses the row.
MESSAGE = (
    "integration_id string, workspace_id string, __op string, __source_ts_ms string,"
    " event_id string, event_type string, timestamp string,"
    " data struct<integration_id:string, run_id:string, workflow_type:string,"
    " source_config:map<string,variant>, destination_config:map<string,variant>>"
)

# Fixed values.
SCHEDULE_TYPES = ["daily", "weekly", "monthly", "on_demand", "cdc"]
TIMED_SCHEDULES = ["daily", "weekly", "monthly"]
DEAD_LETTER_STATUSES = ["pending", "retrying", "resolved", "expired"]
RUN_TASKS = ["prepare", "validate", "execute"]
