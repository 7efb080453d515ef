"""The operational views once more, as SQL over the driver tables."""

from __future__ import annotations

ZONE_LIST = (
    "['UTC','America/New_York','Europe/London','Asia/Tokyo','Australia/Sydney','America/Phoenix']"
)

_COPIES = "(values (0), (1)) as c(copy)"

_CHANGE_TARGET = "(case when event_id % 7 = 3 then user_id + 100000000 else user_id end)"


def _change_value(op: str) -> str:
    return (
        f"""'{{"integration_id":' || {_CHANGE_TARGET} || ',"workspace_id":"ws-' || user_id % 25"""
        f""" || '","__op":"' || {op} || '","__source_ts_ms":' || (epoch_us(ts) // 1000)"""
        """ || ',"__source_db":"control","__source_table":"integrations"}'"""
    )


_OP = (
    "case event_type when 'signup' then 'c' when 'error' then 'd' when 'click' then 'r' else 'u' end"
)

VIEWS = {
    "customers": """
        select 'cust-' || r_regionkey as customer_guid, r_name as name, 100 as max_integration
        from region""",
    "workspaces": """
        select 'ws-' || n_nationkey as workspace_id, 'cust-' || n_regionkey as customer_guid
        from nation""",
    "integrations": f"""
        select c_custkey as integration_id,
          'ws-' || c_nationkey as workspace_id,
          cast(c_custkey % 3 + 1 as int) as workflow_id,
          c_nationkey as auth_id,
          cast(c_custkey % 2 + 1 as int) as source_access_pt_id,
          3 as dest_access_pt_id,
          ['s3_to_mongo','S3ToMongo','AzureBlobToMongo'][c_custkey % 3 + 1] as integration_type,
          case when c_custkey % 97 = 0 then 'every day'
            when c_custkey % 4 = 0 then '0 ' || (c_custkey // 4) % 24 || ' * * *'
            when c_custkey % 4 = 1 then '0 ' || (c_custkey // 4) % 24 || ' * * ' || (c_custkey // 4) % 7
            when c_custkey % 4 = 2
              then '0 ' || (c_custkey // 4) % 24 || ' ' || (1 + (c_custkey // 4) % 31) || ' * *'
          end as usr_sch_cron,
          case when c_acctbal < 0 then 'paused' else 'active' end as usr_sch_status,
          case when c_custkey % 89 = 0 then 'Mars/Base'
            else {ZONE_LIST}[(c_custkey // 96) % 6 + 1] end as usr_timezone,
          case when c_custkey % 50 <> 0
            then timestamp '2024-01-15 00:00:00' + to_hours(cast(c_custkey % 1440 - 720 as int)) end
            as utc_next_run,
          ['daily','weekly','monthly','on_demand'][c_custkey % 4 + 1] as schedule_type,
          case when c_custkey % 19 = 0 then '[1,2]' when c_custkey % 17 = 0 then '{{bad'
            when c_custkey % 13 = 0 then null
            else '{{"mongo_collection":"coll_' || c_custkey % 10 || '","s3_bucket":"bucket-'
              || c_nationkey || '","s3_prefix":"in/' || c_custkey || '/"}}' end as json_data,
          c_custkey % 19 <> 0 and c_custkey % 17 <> 0 and c_custkey % 13 <> 0 as has_doc,
          case when c_custkey % 3 = 2 then 'azure_blob_to_mongo' else 's3_to_mongo' end as workflow,
          timestamp '2023-01-01 00:00:00' + to_days(cast(c_custkey % 365 as int)) as created_at,
          case when c_custkey % 97 <> 0 and c_custkey % 4 < 3 then (c_custkey // 4) % 24 end as hh,
          case when c_custkey % 97 <> 0 and c_custkey % 4 = 1 then (c_custkey // 4) % 7 end as dow,
          case when c_custkey % 97 <> 0 and c_custkey % 4 = 2 then 1 + (c_custkey // 4) % 31 end as dom
        from customer""",
    "auths": """
        select s_suppkey as auth_id, 'ws-' || s_nationkey as workspace_id,
          case when s_suppkey % 2 = 0 then 's3' else 'mongo' end as auth_type,
          case when s_suppkey % 2 = 0 and s_suppkey % 11 <> 0 then s_suppkey end as s3,
          case when s_suppkey % 2 = 1 and s_suppkey % 11 <> 0 then s_suppkey end as mg
        from supplier""",
    "creds": """
        select 'ws-' || s_nationkey as workspace_id,
          max(case when s_suppkey % 2 = 0 and s_suppkey % 11 <> 0 then s_suppkey end) as s3,
          max(case when s_suppkey % 2 = 1 and s_suppkey % 11 <> 0 then s_suppkey end) as mg
        from supplier group by 1""",
    "runs": """
        select o_orderkey as run_id, o_custkey as integration_id,
          'ws-' || o_custkey % 25 || '_s3_to_mongo_ondemand_'
            || (case when o_orderkey % 2 = 0 then 'manual' else 'scheduled' end) || '_'
            || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_0_' || o_orderkey as dag_run_id,
          o_orderdate + to_minutes(cast(o_orderkey % 1440 as int)) as started,
          case when o_orderstatus <> 'P' then o_orderdate
            + to_minutes(cast(o_orderkey % 1440 as int))
            + to_seconds(cast(cast(floor(o_totalprice) as bigint) % 9000 as int)) end as ended,
          case when o_orderstatus <> 'P' then o_orderstatus = 'O' end as is_success,
          o_orderdate as execution_date,
          o_custkey % 25 as ws, o_orderkey % 2 as src
        from orders""",
    "run_errors": """
        select l_orderkey as run_id, l_suppkey as supplier_run,
          ['prepare','validate','execute'][l_linenumber % 3 + 1] as task_id,
          case when l_linestatus = 'O' then 'DATA_ERROR' else 'VALIDATION_ERROR' end as error_code,
          'part ' || l_partkey || ' supplier ' || l_suppkey || ' line ' || l_linenumber || ' cents '
            || cast(round(l_extendedprice * 100) as bigint) as message,
          l_linenumber as seq
        from lineitem where l_returnflag = 'R'""",
    "task_states": """
        select o_orderkey as run_id, t.task_id,
          case when t.task_id = 'prepare' and o_orderkey % 11 = 0 then 'failed'
            when t.task_id = 'validate' and o_orderkey % 11 = 0 then 'upstream_failed'
            when t.task_id = 'validate' and o_orderkey % 7 = 0 then 'failed'
            when t.task_id = 'execute' and (o_orderkey % 11 = 0 or o_orderkey % 7 = 0)
              then 'upstream_failed'
            when t.task_id = 'execute' and o_orderkey % 5 = 0 then 'failed'
            else 'success' end as state
        from orders, (values ('prepare'), ('validate'), ('execute')) as t(task_id)""",
    "deliveries": f"""
        select *, cast(event_id % 3 as int) as part, event_id + copy * 1000000000 as off,
          event_id % 50 as m,
          case when event_id % 50 in (23, 43) then null when event_id % 50 in (37, 41) then null
            else {_OP} end as op,
          case when event_id % 50 = 37 then user_id
            when event_id % 50 in (23, 41, 43) then null
            else {_CHANGE_TARGET} end as target
        from events join {_COPIES} on copy = 0 or event_id % 10 = 0
        where event_id % 50 <> 11""",
    "parsed": """
        select *, 'cdc.integration.events:' || part || ':' || off as place,
          case when m = 37 then 'integration.created' when m = 41 then 'integration.run.completed'
            when op = 'c' then 'integration.created' when op = 'u' then 'integration.updated'
            when op = 'd' then 'integration.deleted' end as ev,
          case when m = 23 then 'malformed json' when m = 43 then 'unknown message format'
            when op = 'r' then 'unknown operation r' end as why,
          case when m in (37, 41) then 'dedup:kafka:cdc.integration.events:evt-' || event_id
            when m in (23, 43) or target = 0 then 'dedup:kafka:cdc.integration.events:' || part || ':' || off
            else 'dedup:kafka:cdc.integration.events:' || target || ':' || (epoch_us(ts) // 1000) || ':' || op
            end as dkey,
          case when m in (23, 43) or op = 'r' then 'reject'
            when m = 37 or op = 'c' then 'trigger' else 'log' end as route,
          case when event_id % 4 = 0
            then '00-' || md5(cast(event_id as varchar)) || '-' || substr(md5('s' || event_id), 1, 16) || '-01'
            else '00-' || md5('cdc.integration.events:' || part || ':' || off) || '-'
              || substr(md5('span:cdc.integration.events:' || part || ':' || off), 1, 16) || '-01'
            end as tp
        from deliveries""",
    "first_parsed": """
        select * from parsed
        qualify row_number() over (partition by dkey order by part, off) = 1""",
    "resolved": """
        select p.*, i.workspace_id, i.integration_id, i.has_doc, i.integration_type, i.auth_id,
          i.source_access_pt_id, i.workflow, i.integration_id % 10 as coll,
          w.customer_guid, c.s3, c.mg
        from first_parsed p
        left join integrations i on i.integration_id = p.target
        left join workspaces w using (workspace_id)
        left join creds c using (workspace_id)
        where p.route = 'trigger'""",
    "letters": f"""
        select event_id as dlq_id, case when event_id % 9 <> 0 then user_id end as integration_id,
          'cdc.integration.events' as source_topic, 'cdc-consumer' as consumer_group,
          cast(user_id as varchar) as message_key,
          case when event_id % 5 = 0 then 'not json' else {_change_value("'c'")} end
            as original_message,
          ['ValueError','KeyError','TypeError'][event_id % 3 + 1] as error_type,
          'failed on ' || event_id as error_message, cast(event_id % 4 as int) as retry_count,
          ['pending','retrying','resolved','expired'][event_id % 4 + 1] as status,
          cast(null as varchar) as resolution_notes,
          case when event_id % 4 = 2 then ts + interval 1 hour end as resolved_at,
          ts as created_at, ts as updated_at,
          {_CHANGE_TARGET} as target
        from events where event_type = 'error'""",
    "raw_audit": f"""
        select 'ev-' || lpad(cast(event_id as varchar), 12, '0') as event_id, ts as timestamp,
          case when event_id % 40 = 3 then 'unknown' when event_id % 40 = 5 then ''
            when event_id % 40 = 7 then 'bad guid!' else 'cust-' || user_id % 5 end as customer_guid,
          case event_type when 'signup' then 'auth.created'
            when 'purchase' then 'data.destination.written' when 'error' then 'integration.run.failed'
            when 'click' then 'integration.run.started' else 'auth.accessed' end as event_type,
          'user-' || user_id as actor_id, 'user' as actor_type, cast(null as varchar) as actor_ip,
          'integration' as resource_type, cast(user_id as varchar) as resource_id,
          event_type as action,
          case when value >= 100 then 'failure' else 'success' end as outcome,
          '{{"user":"u' || user_id || '","password":"[REDACTED]","nested":{{"api_key":"[REDACTED]","ok":true}}}}'
            as before_state,
          case when event_id % 25 = 0 then substr('{{"note":"' || repeat('x', 1500), 1, 1024) || '...[TRUNCATED]'
            else '{{"tokens":["[REDACTED]"],"bucket":"b' || user_id || '"}}' end as after_state,
          'trace-' || user_id % 500 as trace_id, cast(null as varchar) as request_id,
          props as metadata_json, copy, strftime(ts, '%Y-%m') as event_month
        from events join {_COPIES} on copy = 0 or event_id % 10 = 0""",
    "stored_audit": """
        select * from raw_audit
        where copy = 0 and customer_guid not in ('unknown', '', 'bad guid!')""",
    "files": """
        select conv_id % 10 as run_id, 'bucket-' || conv_id % 3 as bucket,
          conv_id * 7 + turn as n,
          'in/' || conv_id || '/' || turn || case when (conv_id * 7 + turn) % 13 = 5 then '/'
            when (conv_id * 7 + turn) % 13 = 7 then '.csv' else '.json' end as key,
          conv_id, turn, role, text
        from conversations""",
    "landed": """
        select *,
          case when n % 13 in (5, 7) then 'skipped' when n % 11 in (3, 4, 5, 7) then 'error'
            else 'processed' end as status,
          case when n % 13 in (5, 7) then null when n % 11 in (3, 4) then 'JSON parse error in ' || key
            when n % 11 = 5 then 'Unexpected data type in ' || key
            when n % 11 = 7 then 'Error processing ' || key || ': record is not an object' end as error,
          case when n % 13 in (5, 7) or n % 11 in (3, 4, 5, 6) then 0
            when n % 11 = 7 or n % 2 = 0 then 2 else 1 end as size
        from files""",
}

_NEEDS = {
    "parsed": ["deliveries"],
    "first_parsed": ["parsed"],
    "resolved": ["first_parsed", "integrations", "workspaces", "creds"],
    "stored_audit": ["raw_audit"],
    "landed": ["files"],
}


def compose(sql: str, views: list[str]) -> str:
    """Put the views a statement needs in front of it as common table expressions."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        add(name)
    body = sql.strip()
    if not ordered:
        return body
    head = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in ordered)
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def next_after(base: str, kind: str, hour: str, dow: str, dom: str) -> str:
    """SQL for the first run strictly after ``base`` on the same clock."""
    day = f"(date_trunc('day', {base}) + to_hours(cast({hour} as int)))"
    ahead = f"cast((({dow} + 6) % 7 - (isodow({base}) - 1) + 7) % 7 as int)"
    week = f"({day} + to_days({ahead}))"

    def month(m: int) -> str:
        first = f"(date_trunc('month', {base}) + interval {m} month)"
        at = f"({first} + to_days(cast({dom} - 1 as int)) + to_hours(cast({hour} as int)))"
        return f"case when month({at}) = month({first}) and {at} > {base} then {at} end"

    return f"""case {kind}
      when 'daily' then case when {day} > {base} then {day} else {day} + interval 1 day end
      when 'weekly' then case when {week} > {base} then {week} else {week} + interval 7 day end
      when 'monthly' then coalesce({month(0)}, {month(1)}, {month(2)}) end"""


def local_of(utc: str, zone: str) -> str:
    return f"timezone({zone}, timezone('UTC', {utc}))"


def utc_of(local: str, zone: str) -> str:
    return f"timezone('UTC', timezone({zone}, {local}))"
