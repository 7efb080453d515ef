"""Queries over the change stream, the dead letters and the runs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane.functions import trace
from harborlane.operators import changes, deadletter, runs
from harborlane.functions.times import instant as at
from harborlane.plans.registry import query
from harborlane.plans.scheduling import NOW, _DOC, _conf_sql
from harborlane.session import fresh_dir
from harborlane.sinks.buckets import BucketedTable
from harborlane.sources import views
from harborlane.sources.tables import table

LATER = "2024-01-31 00:00:00"


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return changes.parse(views.change_records(spark, folder))


def _unique(spark: SparkSession, folder: str) -> DataFrame:
    return changes.deduplicate(_parsed(spark, folder))


def _resolved(spark: SparkSession, folder: str) -> DataFrame:
    return changes.resolve(
        _unique(spark, folder),
        views.integrations(spark, folder),
        views.workspaces(spark, folder),
        views.auths(spark, folder),
        at(NOW),
    )


@query(
    "changes_parsed",
    views="parsed",
    sql="""select part as partition, off as offset, ev as event_type, op is not null as is_change, op,
      case when op is not null then (epoch_us(ts) // 1000) end as source_ts_ms, target as integration_id,
      case when m = 41 then cast(event_id as varchar) end as run_ref, dkey as dedup_key,
      tp as traceparent, split_part(tp, '-', 2) as trace_id, route, why as reason
    from parsed""",
)
def changes_parsed(spark: SparkSession, folder: str) -> DataFrame:
    return _parsed(spark, folder).select(
        "partition", "offset", "event_type", "is_change", "op", "source_ts_ms", "integration_id",
        "run_ref", "dedup_key", "traceparent", "trace_id", "route", "reason",
    )


@query(
    "changes_unique",
    views="first_parsed",
    sql="select dkey as dedup_key, part as partition, off as offset, route from first_parsed",
)
def changes_unique(spark: SparkSession, folder: str) -> DataFrame:
    return _unique(spark, folder).select("dedup_key", "partition", "offset", "route")


@query(
    "changes_latest",
    views="parsed",
    sql="""with c as (select * from parsed where op is not null
      qualify row_number() over (partition by target order by (epoch_us(ts) // 1000) desc, off desc, part desc) = 1)
    select target as integration_id, op, (epoch_us(ts) // 1000) as source_ts_ms, off as offset from c where op <> 'd'""",
)
def changes_latest(spark: SparkSession, folder: str) -> DataFrame:
    return changes.latest_state(_parsed(spark, folder)).select(
        "integration_id", "op", "source_ts_ms", "offset"
    )


@query(
    "changes_route_counts",
    views="first_parsed",
    sql="""select route, ev as event_type, why as reason, count(*) as n from first_parsed group by 1, 2, 3""",
)
def changes_route_counts(spark: SparkSession, folder: str) -> DataFrame:
    return changes.route_counts(_unique(spark, folder))


_REQUEST_SQL = f"""select integration_id, workspace_id, customer_guid, workflow || '_ondemand' as dag_id,
  workspace_id || '_' || workflow || '_ondemand_manual_20240115_000000_0_' || integration_id || '_'
    || part || '_' || off as dag_run_id,
  {_conf_sql(
      f"case when m = 37 then 'legacy-' || event_id else {_DOC['bucket']} end",
      f"case when m = 37 then 'legacy' else {_DOC['collection']} end",
      _DOC['prefix'], None, 'tp', 'integration_id')} as conf,
  tp as traceparent, split_part(tp, '-', 2) as trace_id, dkey as dedup_key
from resolved where workspace_id is not null"""


@query("changes_requests", views="resolved", sql=_REQUEST_SQL)
def changes_requests(spark: SparkSession, folder: str) -> DataFrame:
    return changes.requests(_resolved(spark, folder))


@query(
    "changes_dead_letters",
    views="first_parsed resolved",
    sql=f"""with bad as (
      select part, off, event_id, m, target, why from first_parsed where route = 'reject'
      union all select part, off, event_id, m, target, 'integration not found' from resolved
        where workspace_id is null),
    b as (select *, case when target = 0 then null else target end as named from bad)
    select cast('0x' || substr(sha256('cdc.integration.events:' || part || ':' || off), 1, 15) as bigint)
        as dlq_id, named as integration_id, 'cdc.integration.events' as source_topic,
      'cdc-consumer' as consumer_group,
      coalesce(cast(named as varchar), 'unknown') as message_key,
      case why when 'malformed json' then 'ValueError' when 'integration not found' then 'LookupError'
        else 'KeyError' end as error_type,
      why as error_message, 0 as retry_count, 'pending' as status, timestamp '{NOW}' as created_at
    from b""",
)
def changes_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    unique = _unique(spark, folder)
    resolved = changes.resolve(
        unique,
        views.integrations(spark, folder),
        views.workspaces(spark, folder),
        views.auths(spark, folder),
        at(NOW),
    )
    letters = changes.dead_letters(changes.rejects(unique, resolved), "cdc-consumer", at(NOW))
    return letters.select(
        "dlq_id", "integration_id", "source_topic", "consumer_group", "message_key", "error_type",
        "error_message", "retry_count", "status", "created_at",
    )


@query(
    "changes_trigger_audit",
    views="resolved",
    sql=f"""select customer_guid, cast(integration_id as varchar) as resource_id,
      'integration.cdc_triggered' as event_type, split_part(tp, '-', 2) as trace_id,
      '{{"dag_id":"' || workflow || '_ondemand","dag_run_id":"' || workspace_id || '_' || workflow
        || '_ondemand_manual_20240115_000000_0_' || integration_id || '_' || part || '_' || off
        || '","trigger_source":"cdc"}}' as metadata_json,
      timestamp '{NOW}' as timestamp, 'success' as outcome
    from resolved where workspace_id is not null""",
)
def changes_trigger_audit(spark: SparkSession, folder: str) -> DataFrame:
    return changes.trigger_audit(changes.requests(_resolved(spark, folder)), at(NOW)).select(
        "customer_guid", "resource_id", "event_type", "trace_id", "metadata_json", "timestamp",
        "outcome",
    )


@query(
    "trace_ids",
    views="parsed",
    sql="""select part as partition, off as offset,
      case when event_id % 4 = 0 then true else false end as had_trace,
      split_part(tp, '-', 2) as trace_id,
      case when event_id % 4 = 0 then md5(cast(event_id as varchar)) end as lenient_id
    from parsed""",
)
def trace_ids(spark: SparkSession, folder: str) -> DataFrame:
    header = trace.header_value(F.col("headers"), "traceparent")
    records = views.change_records(spark, folder).where(F.col("value").isNotNull())
    parent = trace.traceparent_or_new(header, F.col("topic"), F.col("partition"), F.col("offset"))
    return records.select(
        "partition",
        "offset",
        trace.is_traceparent(header).alias("had_trace"),
        trace.trace_id(parent).alias("trace_id"),
        trace.trace_id(header).alias("lenient_id"),
    )


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    return views.dead_letters(spark, folder)


@query(
    "dlq_listing",
    views="letters",
    sql="""select dlq_id, integration_id, status, error_type, created_at from letters
      where status = 'pending' and created_at >= timestamp '2024-01-05 00:00:00'
        and created_at <= timestamp '2024-01-20 00:00:00'
      order by created_at desc, dlq_id desc limit 50 offset 10""",
)
def dlq_listing(spark: SparkSession, folder: str) -> DataFrame:
    page = deadletter.listing(
        _letters(spark, folder),
        status="pending",
        created_after=dt.datetime(2024, 1, 5),
        created_before=dt.datetime(2024, 1, 20),
        offset=10,
    )
    return page.select("dlq_id", "integration_id", "status", "error_type", "created_at")


@query(
    "dlq_documents",
    views="letters",
    sql="""select dlq_id, case when original_message = 'not json' then '"not json"' else
        '{"__op":"c","__source_db":"control","__source_table":"integrations","__source_ts_ms":'
        || (epoch_us(created_at) // 1000) || ',"integration_id":' || target || ',"workspace_id":"ws-'
        || message_key::bigint % 25 || '"}' end as document
      from letters""",
)
def dlq_documents(spark: SparkSession, folder: str) -> DataFrame:
    shown = deadletter.with_document(_letters(spark, folder))
    return shown.select("dlq_id", F.to_json("document").alias("document"))


@query("dlq_stats", views="letters", sql="select status, count(*) as n from letters group by 1")
def dlq_stats(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.counts_by_status(_letters(spark, folder))


@query(
    "dlq_pending",
    views="letters",
    sql="select count(*) as total_pending from letters where status = 'pending'",
)
def dlq_pending(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.total_pending(_letters(spark, folder))


@query(
    "dlq_patterns",
    views="letters",
    sql="""select date_trunc('day', created_at) as window_start, integration_id, error_type, count(*) as n
      from letters group by 1, 2, 3""",
)
def dlq_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.failure_patterns(_letters(spark, folder))


@query(
    "dlq_rates",
    views="letters",
    sql="""with w as (select date_trunc('minute', created_at) - to_minutes(cast(k as int)) as window_start
      from letters, generate_series(0, 59) as g(k))
    select window_start, window_start + interval 60 minute as window_end, count(*) as n
      from w group by 1 having count(*) > 2""",
)
def dlq_rates(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.rates(_letters(spark, folder), "60 minutes", "1 minute", above=2)


def _letter_store(spark: SparkSession, folder: str) -> BucketedTable:
    store = BucketedTable(spark, fresh_dir(spark, "letters"))
    store.create(_letters(spark, folder), "dlq_id", buckets=8)
    return store


@query(
    "dlq_resolved",
    views="letters",
    sql=f"""select dlq_id, case when error_type = 'KeyError' then 'resolved' else status end as status,
      case when error_type = 'KeyError' then 'done' end as resolution_notes,
      case when error_type = 'KeyError' then timestamp '{LATER}' else resolved_at end as resolved_at,
      case when error_type = 'KeyError' then timestamp '{LATER}' else updated_at end as updated_at
    from letters""",
)
def dlq_resolved(spark: SparkSession, folder: str) -> DataFrame:
    store = _letter_store(spark, folder)
    ids = store.read().where(F.col("error_type") == "KeyError").select("dlq_id")
    store.change(ids, lambda rows: deadletter.bulk_transition(rows, ids, "resolved", at(LATER), "done"))
    return store.read().select(
        "dlq_id", "status", "resolution_notes", "resolved_at", "updated_at"
    )


_REPLAY_SQL = """with asked as (select dlq_id from letters union select event_id from events
    where event_type = 'purchase'),
  j as (select a.dlq_id, l.status, l.created_at, l.original_message, l.target, i.integration_id as known from asked a
    left join letters l using (dlq_id) left join integrations i on i.integration_id = l.target),
  o as (select *, case when original_message is null then 'not_found'
      when status = 'resolved' then 'already_resolved'
      when original_message = 'not json' or known is null then 'failed' else 'resolved' end as outcome,
    case when original_message is null or status = 'resolved' then null
      when original_message = 'not json' then 'malformed json'
      when known is null then 'integration not found' end as error_message from j)
"""


def _replayed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    letters = _letters(spark, folder)
    strangers = table(spark, folder, "events").where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("dlq_id")
    )
    ids = letters.select("dlq_id").unionByName(strangers)
    outcomes = deadletter.replay(
        letters,
        ids,
        views.integrations(spark, folder),
        views.workspaces(spark, folder),
        views.auths(spark, folder),
        at(LATER),
    )
    return letters, outcomes


@query(
    "dlq_replayed",
    views="letters integrations",
    sql=_REPLAY_SQL
    + """select dlq_id, outcome, error_message,
      case error_message when 'malformed json' then 'ValueError'
        when 'integration not found' then 'LookupError' end as error_type,
      case when outcome = 'resolved' then 'Automatically resolved via bulk retry' end as notes from o""",
)
def dlq_replayed(spark: SparkSession, folder: str) -> DataFrame:
    return _replayed(spark, folder)[1].drop(*changes.REQUEST_COLUMNS)


@query(
    "dlq_replayed_requests",
    views="letters integrations workspaces creds",
    sql=_REPLAY_SQL.rstrip()
    + f""", r as (select o.dlq_id, o.target, o.created_at, i.*, i.integration_id % 10 as coll, w.customer_guid, c.s3, c.mg,
        '00-' || md5('cdc.integration.events:0:' || dlq_id) || '-'
          || substr(md5('span:cdc.integration.events:0:' || dlq_id), 1, 16) || '-01' as tp
      from o join integrations i on i.integration_id = o.target
      left join workspaces w using (workspace_id) left join creds c using (workspace_id)
      where outcome = 'resolved')
    select integration_id, workspace_id, customer_guid, workflow || '_ondemand' as dag_id,
      workspace_id || '_' || workflow || '_ondemand_manual_20240131_000000_0_' || integration_id || '_0_'
        || dlq_id as dag_run_id,
      {_conf_sql(_DOC['bucket'], _DOC['collection'], _DOC['prefix'], None, 'tp', 'integration_id')} as conf,
      tp as traceparent, split_part(tp, '-', 2) as trace_id,
      'dedup:kafka:cdc.integration.events:' || case when target = 0 then '0:' || dlq_id
        else target || ':' || (epoch_us(created_at) // 1000) || ':c' end as dedup_key from r""",
)
def dlq_replayed_requests(spark: SparkSession, folder: str) -> DataFrame:
    return deadletter.replay_requests(_replayed(spark, folder)[1])


_AFTER_REPLAY_SQL = (
    _REPLAY_SQL
    + f"""select l.dlq_id,
      case outcome when 'failed' then 'pending' when 'resolved' then 'resolved' else l.status end as status,
      case when outcome = 'failed' then l.retry_count + 1 else l.retry_count end as retry_count,
      coalesce(o.error_message, l.error_message) as error_message,
      case when outcome = 'resolved' then timestamp '{LATER}' else l.resolved_at end as resolved_at,
      case when outcome in ('resolved', 'failed') then timestamp '{LATER}' else l.updated_at end as updated_at
    from letters l join o using (dlq_id)"""
)


@query("dlq_after_replay", views="letters integrations", sql=_AFTER_REPLAY_SQL)
def dlq_after_replay(spark: SparkSession, folder: str) -> DataFrame:
    letters, outcomes = _replayed(spark, folder)
    return deadletter.apply_replay(letters, outcomes, at(LATER)).select(
        "dlq_id", "status", "retry_count", "error_message", "resolved_at", "updated_at"
    )


@query("dlq_stored_replay", views="letters integrations", sql=_AFTER_REPLAY_SQL)
def dlq_stored_replay(spark: SparkSession, folder: str) -> DataFrame:
    """The replay's outcome written into a stored table, of which it changes the buckets it names."""
    store, path = _letter_store(spark, folder), fresh_dir(spark, "outcomes")
    _replayed(spark, folder)[1].write.parquet(path)
    outcomes = spark.read.parquet(path)
    store.change(outcomes, lambda rows: deadletter.apply_replay(rows, outcomes, at(LATER)))
    return store.read().select(
        "dlq_id", "status", "retry_count", "error_message", "resolved_at", "updated_at"
    )


@query(
    "dlq_expired",
    views="letters",
    sql="""select dlq_id,
      case when status = 'resolved' and resolved_at < timestamp '2024-02-15 00:00:00' - interval 30 day
          then 'expired'
        when status in ('pending', 'retrying') and created_at < timestamp '2024-02-15 00:00:00' - interval 40 day
          then 'expired' else status end as status
    from letters""",
)
def dlq_expired(spark: SparkSession, folder: str) -> DataFrame:
    now, store = at("2024-02-15 00:00:00"), _letter_store(spark, folder)
    store.change_where(
        deadletter.is_old(now, pending_days=40),
        lambda rows: deadletter.expire(rows, now, pending_days=40),
    )
    return store.read().select("dlq_id", "status")


@query(
    "runs_first_errors",
    views="run_errors",
    sql="""select supplier_run as run_id, task_id, error_code, message from run_errors
      qualify row_number() over (partition by supplier_run, task_id order by seq, error_code, message) <= 20""",
)
def runs_first_errors(spark: SparkSession, folder: str) -> DataFrame:
    return runs.first_errors(views.run_errors(spark, folder, run="l_suppkey"))


_ALL_ERRORS = """pushed as (select run_id, task_id, error_code, message from run_errors
    qualify row_number() over (partition by run_id, task_id order by seq, error_code, message) <= 20),
  states as (select run_id, task_id, 'TASK_' || upper(state) as error_code,
      'Task ''' || task_id || ''' ended in state ''' || state || '''' as message
    from task_states s where state in ('failed', 'upstream_failed') and not exists (
      select 1 from run_errors e where e.run_id = s.run_id and e.task_id = s.task_id)),
  errors as (select * from pushed union all select * from states)
"""


def _run_errors(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_errors(
        views.task_states(spark, folder), views.run_errors(spark, folder), at(LATER)
    )


@query(
    "runs_errors",
    views="run_errors task_states",
    sql=f"with {_ALL_ERRORS} select *, timestamp '{LATER}' as timestamp from errors",
)
def runs_errors(spark: SparkSession, folder: str) -> DataFrame:
    return _run_errors(spark, folder)


@query(
    "runs_closed",
    views="runs run_errors task_states",
    sql=f"""with {_ALL_ERRORS}, n as (select run_id, count(*) as n from errors group by 1)
    select run_id, integration_id, dag_run_id, started, execution_date, timestamp '{LATER}' as ended,
      coalesce(n, 0) = 0 as is_success, coalesce(n, 0) as error_count
    from runs left join n using (run_id)""",
)
def runs_closed(spark: SparkSession, folder: str) -> DataFrame:
    return runs.close_runs(views.runs(spark, folder), _run_errors(spark, folder), at(LATER))


@query(
    "runs_closed_by_name",
    views="runs run_errors task_states",
    sql=f"""with {_ALL_ERRORS}, n as (select run_id, count(*) as n from errors where run_id % 3 <> 0 group by 1)
    select run_id, dag_run_id, coalesce(n, 0) = 0 as is_success, coalesce(n, 0) as error_count
    from runs left join n using (run_id)""",
)
def runs_closed_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Errors that name their run by ``dag_run_id``; a third of them name one that is not recorded."""
    known = views.runs(spark, folder)
    named = _run_errors(spark, folder).join(known.select("run_id", "dag_run_id"), "run_id").withColumn(
        "dag_run_id",
        F.when(F.col("run_id") % 3 == 0, F.concat(F.lit("lost-"), "dag_run_id")).otherwise(F.col("dag_run_id")),
    )
    errors = runs.with_run_id(named.drop("run_id"), known)
    return runs.close_runs(known, errors, at(LATER)).select(
        "run_id", "dag_run_id", "is_success", "error_count"
    )


@query(
    "runs_with_errors",
    views="runs run_errors task_states",
    sql=f"""with {_ALL_ERRORS} select run_id, dag_run_id, task_id, error_code, message
      from runs left join errors using (run_id)""",
)
def runs_with_errors(spark: SparkSession, folder: str) -> DataFrame:
    joined = runs.runs_with_errors(views.runs(spark, folder), _run_errors(spark, folder))
    return joined.select("run_id", "dag_run_id", "task_id", "error_code", "message")


@query(
    "runs_history",
    views="runs",
    sql="""select run_id, dag_run_id, execution_date from runs where ws = 7 and src = 0
      order by execution_date desc, run_id desc""",
)
def runs_history(spark: SparkSession, folder: str) -> DataFrame:
    found = runs.history(views.runs(spark, folder), "ws-7_", "manual", "s3_to_mongo_ondemand")
    return found.select("run_id", "dag_run_id", "execution_date")


@query(
    "runs_id_parts",
    views="runs",
    sql="""select run_id, 'ws-' || ws as run_tenant, 's3_to_mongo_ondemand' as run_workflow,
      case when src = 0 then 'manual' else 'scheduled' end as run_source from runs""",
)
def runs_id_parts(spark: SparkSession, folder: str) -> DataFrame:
    return runs.with_run_id_parts(views.runs(spark, folder)).select(
        "run_id", "run_tenant", "run_workflow", "run_source"
    )


_COUNTED = ["region", "nation", "customer", "supplier", "orders", "lineitem", "events"]


@query(
    "table_counts",
    sql=" union all ".join(
        f"select '{name}' as table_name, count(*) as n from {name}" for name in _COUNTED
    ),
)
def table_counts(spark: SparkSession, folder: str) -> DataFrame:
    return runs.row_counts({name: table(spark, folder, name) for name in _COUNTED})


@query(
    "table_ready",
    sql="select count(*) > 0 as ready from events where cast(ts as date) = date '2024-01-10'",
)
def table_ready(spark: SparkSession, folder: str) -> DataFrame:
    return runs.is_ready(table(spark, folder, "events"), "ts", F.lit("2024-01-10").cast("date"))


def _dag_runs(spark: SparkSession, folder: str) -> DataFrame:
    i, r = F.col("integration_id"), F.col("run_id")
    document = F.concat(
        F.lit('{"customer_guid":"cust-'), (i % 5).cast("string"),
        F.lit('","integration_id":'), i.cast("string"),
        F.lit(',"tenant_id":"ws-'), (i % 25).cast("string"),
        F.lit('","workspace_id":"ws-'), (i % 25).cast("string"),
        F.lit('","traceparent":"00-'), F.md5(r.cast("string")), F.lit('-x-01"}'),
    )
    state = F.when(F.col("is_success").isNull(), "running").when(
        F.col("is_success"), "success"
    ).otherwise("failed")
    return views.runs(spark, folder).select(
        "run_id",
        F.when(r % 10 == 9, "controller").otherwise("s3_to_mongo_ondemand").alias("dag_id"),
        "dag_run_id",
        state.alias("state"),
        document.alias("conf"),
        F.lit("boom").alias("message"),
    )


@query(
    "run_events",
    views="runs",
    sql=f"""select 'cust-' || integration_id % 5 as customer_guid,
      case when is_success is null then 'integration.run.started'
        when is_success then 'integration.run.completed' else 'integration.run.failed' end as event_type,
      cast(integration_id as varchar) as resource_id,
      case when is_success is null then 'start' else 'complete' end as action,
      case when is_success = false then 'failure' else 'success' end as outcome,
      md5(cast(run_id as varchar)) as trace_id,
      '{{"dag_id":"s3_to_mongo_ondemand","dag_run_id":"' || dag_run_id || '"'
        || case when is_success is null then ',"tenant_id":"ws-' || ws || '"' else '' end
        || case when is_success = false then ',"error":"boom"' else '' end || '}}' as metadata_json
    from runs where run_id % 10 <> 9""",
)
def run_events(spark: SparkSession, folder: str) -> DataFrame:
    return runs.run_events(_dag_runs(spark, folder), at(LATER)).select(
        "customer_guid", "event_type", "resource_id", "action", "outcome", "trace_id",
        "metadata_json",
    )


@query(
    "task_events",
    views="runs task_states",
    sql="""select 'cust-' || integration_id % 5 as customer_guid,
      case when state = 'failed' then 'task.' || task_id || '.failed'
        when task_id = 'prepare' then 'auth.accessed' else 'data.destination.written' end as event_type,
      case when state = 'failed' then 'task' when task_id = 'prepare' then 'credentials'
        else 'integration' end as resource_type,
      case when state = 'failed' then task_id when task_id = 'prepare' then 'ws-' || ws
        else cast(integration_id as varchar) end as resource_id,
      case when state = 'failed' then 'execute' when task_id = 'prepare' then 'access' else 'write' end as action,
      case when state = 'failed' then 'failure' else 'success' end as outcome
    from task_states join runs using (run_id)
    where state = 'failed' or (state = 'success' and task_id in ('prepare', 'execute'))""",
)
def task_events(spark: SparkSession, folder: str) -> DataFrame:
    dag = _dag_runs(spark, folder).drop("state")
    tasks = views.task_states(spark, folder).join(dag, "run_id")
    return runs.task_events(tasks, at(LATER)).select(
        "customer_guid", "event_type", "resource_type", "resource_id", "action", "outcome"
    )
