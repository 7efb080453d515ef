"""Queries over schedules: forecast, dispatch, normalisation, zones, backfill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane.functions import conf, zones
from harborlane.operators import backfill, dispatch, forecast, runs, schedule
from harborlane.functions.times import instant as at, seconds_between
from harborlane.plans.registry import query
from harborlane.plans.view_sql import ZONE_LIST, local_of, next_after, utc_of
from harborlane.sources import views
from harborlane.sources.tables import find, page

NOW = "2024-01-15 00:00:00"
START = dt.datetime(2024, 1, 29)
DAYS = 10
THRESHOLD = 8


def _forecast(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.hourly_forecast(views.integrations(spark, folder), START, DAYS, THRESHOLD)


_FORECAST_SQL = f"""with active as (select * from integrations where usr_sch_status = 'active'),
hours as (select unnest(generate_series(timestamp '{START}', timestamp '{START}' + interval {DAYS * 24 - 1} hour,
  interval 1 hour)) as timestamp),
by_day as (select hh, count(*) as n from active where schedule_type = 'daily' and hh is not null group by 1),
by_week as (select hh, (dow + 6) % 7 as wd, count(*) as n from active where dow is not null group by 1, 2),
by_month as (select hh, dom, count(*) as n from active where dom is not null group by 1, 2),
f0 as (select h.timestamp, coalesce(d.n, 0) as daily_runs, coalesce(w.n, 0) as weekly_runs,
    coalesce(m.n, 0) as monthly_runs,
    cast(floor((select count(*) from active) * 0.05) as bigint) as ondemand_potential
  from hours h
  left join by_day d on d.hh = hour(h.timestamp)
  left join by_week w on w.hh = hour(h.timestamp) and w.wd = isodow(h.timestamp) - 1
  left join by_month m on m.hh = hour(h.timestamp) and m.dom = day(h.timestamp)),
forecast as (select timestamp, daily_runs + weekly_runs + monthly_runs as total_dag_runs, daily_runs,
    weekly_runs, monthly_runs, ondemand_potential,
    daily_runs + weekly_runs + monthly_runs >= {THRESHOLD} as is_hotspot,
    {THRESHOLD} as hotspot_threshold from f0)
"""

_SPOTS_SQL = f"""{_FORECAST_SQL.rstrip()},
spots as (select timestamp, total_dag_runs,
  case when isodow(timestamp) = 1 and hour(timestamp) = 0
      then 'Monday midnight: daily + weekly + monthly convergence'
    when day(timestamp) = 1 and hour(timestamp) = 0
      then 'First of month midnight: daily + monthly convergence'
    when isodow(timestamp) = 1 then 'Monday: daily + weekly convergence'
    when daily_runs > hotspot_threshold * 0.8 then 'High daily traffic: ' || daily_runs || ' integrations'
    else 'High traffic: ' || total_dag_runs || ' runs' end as reason,
  case when isodow(timestamp) = 1 and hour(timestamp) = 0 then 'Apply ±5 second jitter to randomize triggers'
      || '|Stagger triggers with 100ms interval between integrations|Scale workers to 50+ with KEDA'
    when day(timestamp) = 1 and hour(timestamp) = 0
      then 'Apply ±5 second jitter|Use exponential backoff for batch triggering'
    when isodow(timestamp) = 1 then 'Apply ±3 second jitter|Stagger weekly triggers'
    when daily_runs > hotspot_threshold * 0.8
      then 'Consider distributing integrations across more hours|Apply jitter to prevent exact-time clustering'
    else 'Apply standard jitter and staggering' end as suggestions
  from forecast where is_hotspot)
"""


@query(
    "schedule_counts",
    views="integrations",
    sql="""with active as (select * from integrations where usr_sch_status = 'active')
    select 'daily' as kind, -1 as day, cast(hh as int) as hour, count(*) as n from active
      where schedule_type = 'daily' and hh is not null group by 3
    union all select 'weekly', cast((dow + 6) % 7 as int), cast(hh as int), count(*) from active
      where dow is not null group by 2, 3
    union all select 'monthly', cast(dom as int), cast(hh as int), count(*) from active
      where dom is not null group by 2, 3
    union all select 'unplaced', -1, -1, count(*) from active where hh is null having count(*) > 0
    union all select 'all', -1, -1, count(*) from active""",
)
def schedule_counts(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.schedule_counts(views.integrations(spark, folder))


@query("forecast_hourly", views="integrations", sql=_FORECAST_SQL + "select * from forecast")
def forecast_hourly(spark: SparkSession, folder: str) -> DataFrame:
    return _forecast(spark, folder)


@query("forecast_hotspots", views="integrations", sql=_SPOTS_SQL + "select * from spots")
def forecast_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    spots = forecast.classify_hotspots(_forecast(spark, folder))
    return spots.withColumn("suggestions", F.array_join("mitigation_suggestions", "|")).drop(
        "mitigation_suggestions"
    )


@query(
    "forecast_statistics",
    views="integrations",
    sql=_FORECAST_SQL
    + """select count(*) as total_hours, round(avg(total_dag_runs), 6) as average_runs_per_hour,
      max(total_dag_runs) as max_runs_per_hour, min(total_dag_runs) as min_runs_per_hour,
      count(*) filter (where is_hotspot) as hotspot_hours,
      round(count(*) filter (where is_hotspot) * 100.0 / count(*), 6) as hotspot_percentage,
      (select min(timestamp) from forecast where total_dag_runs = (select max(total_dag_runs) from forecast))
        as peak_hour
    from forecast""",
)
def forecast_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.statistics(_forecast(spark, folder)).withColumns(
        {c: F.round(c, 6) for c in ("average_runs_per_hour", "hotspot_percentage")}
    )


@query(
    "forecast_summary",
    views="integrations",
    sql=_SPOTS_SQL
    + f"""select count(*) as hotspots_count, min(timestamp) as next_hotspot,
      (select total_dag_runs from spots order by timestamp limit 1) as next_total_dag_runs,
      (select reason from spots order by timestamp limit 1) as next_reason,
      (select timestamp from spots order by total_dag_runs desc, timestamp limit 1) as highest_load,
      max(total_dag_runs) as highest_total_dag_runs,
      (select reason from spots order by total_dag_runs desc, timestamp limit 1) as highest_reason,
      round(date_diff('second', timestamp '2024-01-28 13:40:00', min(timestamp)) / 3600.0, 1) as hours_until
    from spots""",
)
def forecast_summary(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.summary(_forecast(spark, folder), at("2024-01-28 13:40:00"))


@query(
    "forecast_imminent",
    views="integrations",
    sql=_FORECAST_SQL
    + """select * from forecast where is_hotspot and total_dag_runs > 9
      and timestamp >= timestamp '2024-01-29 00:00:00' and timestamp < timestamp '2024-01-29 02:00:00'""",
)
def forecast_imminent(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.imminent_overload(_forecast(spark, folder), at("2024-01-29 00:00:00"), above=9)


@query(
    "worker_demand",
    views="integrations",
    sql=f"""select count(*) as due, cast(least(50, greatest(2, ceil(count(*) / 5.0))) as bigint) as workers
    from integrations where usr_sch_status = 'active' and schedule_type <> 'on_demand'
      and utc_next_run between timestamp '{NOW}' and timestamp '{NOW}' + interval 24 hour""",
)
def worker_demand(spark: SparkSession, folder: str) -> DataFrame:
    return forecast.worker_demand(views.integrations(spark, folder), at(NOW))


_DUE = f"""usr_sch_status = 'active' and schedule_type in ('daily','weekly','monthly')
  and utc_next_run <= timestamp '{NOW}'"""


@query(
    "due_integrations",
    views="integrations",
    sql=f"""select integration_id, workspace_id, schedule_type, utc_next_run from integrations
      where {_DUE} and workflow = 's3_to_mongo'""",
)
def due_integrations(spark: SparkSession, folder: str) -> DataFrame:
    due = dispatch.is_due(at(NOW), "S3ToMongo")
    return views.integrations(spark, folder).where(due).select(
        "integration_id", "workspace_id", "schedule_type", "utc_next_run"
    )


@query(
    "due_with_tenant",
    views="integrations workspaces",
    sql=f"""select integration_id, workspace_id, customer_guid from integrations
      join workspaces using (workspace_id) where {_DUE}""",
)
def due_with_tenant(spark: SparkSession, folder: str) -> DataFrame:
    due = views.integrations(spark, folder).where(dispatch.is_due(at(NOW)))
    return dispatch.with_tenant(due, views.workspaces(spark, folder)).select(
        "integration_id", "workspace_id", "customer_guid"
    )


@query(
    "integrations_listing",
    views="integrations",
    sql="""select integration_id, workspace_id, schedule_type from integrations
      where workspace_id = 'ws-3' order by integration_id limit 20 offset 5""",
)
def integrations_listing(spark: SparkSession, folder: str) -> DataFrame:
    found = find(views.integrations(spark, folder), workspace_id="ws-3")
    return page(found, "integration_id", limit=20, offset=5).select(
        "integration_id", "workspace_id", "schedule_type"
    )


@query(
    "integration_lookup",
    views="integrations",
    sql="""select integration_id, workspace_id, usr_timezone, json_data from integrations
      where integration_id = 42""",
)
def integration_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return find(views.integrations(spark, folder), integration_id=42).select(
        "integration_id", "workspace_id", "usr_timezone", "json_data"
    )


@query(
    "workspace_credentials",
    views="creds",
    sql="""select workspace_id, 's3_access_key' as k, '"ak-' || s3 || '"' as v from creds where s3 is not null
    union all select workspace_id, 's3_secret_key', '"sk-' || s3 || '"' from creds where s3 is not null
    union all select workspace_id, 'mongo_password', '"pw-' || mg || '"' from creds where mg is not null
    union all select workspace_id, 'mongo_uri', '"mongodb://user' || mg || ':p%40ss@host' || mg
      || '.example.com:27017/db"' from creds where mg is not null""",
)
def workspace_credentials(spark: SparkSession, folder: str) -> DataFrame:
    folded = dispatch.credentials(views.auths(spark, folder))
    return folded.select("workspace_id", F.explode("credentials").alias("k", "v")).withColumn(
        "v", F.to_json("v")
    )


def _conf_sql(
    bucket: str, collection: str, prefix: str, guid: str | None, tp: str | None, ident: str
) -> str:
    """SQL for the conf text, keys in order; the document's parts may be null."""
    entries = [
        "'\"auth_id\":' || auth_id",
        f"',\"customer_guid\":\"' || {guid} || '\"'" if guid else None,
        "',\"dest_access_pt_id\":3'",
        f"',\"integration_id\":' || {ident}",
        "',\"integration_type\":\"' || integration_type || '\"'",
        f"coalesce(',\"mongo_collection\":\"' || {collection} || '\"', '')",
        "coalesce(',\"mongo_password\":\"pw-' || mg || '\"', '')",
        "coalesce(',\"mongo_uri\":\"mongodb://user' || mg || ':p%40ss@host' || mg"
        " || '.example.com:27017/db\"', '')",
        "coalesce(',\"s3_access_key\":\"ak-' || s3 || '\"', '')",
        f"coalesce(',\"s3_bucket\":\"' || {bucket} || '\"', '')",
        f"coalesce(',\"s3_prefix\":\"' || {prefix} || '\"', '')",
        "coalesce(',\"s3_secret_key\":\"sk-' || s3 || '\"', '')",
        "',\"source_access_pt_id\":' || source_access_pt_id",
        "',\"tenant_id\":\"' || workspace_id || '\"'",
        f"',\"traceparent\":\"' || {tp} || '\"'" if tp else None,
    ]
    return "'{' || " + " || ".join(e for e in entries if e) + " || '}'"


_DOC = {
    "bucket": "case when has_doc then 'bucket-' || auth_id end",
    "collection": "case when has_doc then 'coll_' || integration_id % 10 end",
    "prefix": "case when has_doc then 'in/' || integration_id || '/' end",
}

_ZONE = "case when usr_timezone = 'Mars/Base' then 'UTC' else usr_timezone end"
_ADVANCED = f"""based as (select *, {_ZONE} as z,
    case when schedule_type in ('weekly','monthly') then coalesce(utc_next_run, timestamp '{NOW}')
      else timestamp '{NOW}' end as base
  from integrations),
lb as (select *, {local_of('base', 'z')} as base_local from based),
nl as (select *, {next_after('base_local', 'schedule_type', 'hh', 'dow', 'dom')} as next_local,
  {next_after('base', 'schedule_type', 'hh', 'dow', 'dom')} as next_frozen from lb),
adv as (select *, case when usr_timezone <> 'Mars/Base' and next_local is not null
    then {utc_of('next_local', 'z')} else utc_next_run end as advanced,
  coalesce(next_frozen, utc_next_run) as advanced_frozen from nl)
"""


@query(
    "dispatch_requests",
    views="integrations workspaces creds",
    sql=f"""with {_ADVANCED},
    due as (select a.*, w.customer_guid, c.s3, c.mg,
        a.integration_id || ':' || cast(a.utc_next_run as varchar) || ':{NOW}' as ident
      from adv a join workspaces w using (workspace_id) left join creds c using (workspace_id)
      where {_DUE} and workflow = 's3_to_mongo'),
    tp as (select *, '00-' || md5(ident) || '-' || substr(md5('span:' || ident), 1, 16) || '-01' as tp from due)
    select integration_id, workspace_id, customer_guid, 's3_to_mongo_ondemand' as dag_id,
      workspace_id || '_s3_to_mongo_ondemand_scheduled_20240115_000000_0_' || integration_id as trigger_run_id,
      {_conf_sql(**_DOC, guid='customer_guid', tp='tp', ident='integration_id')} as conf,
      utc_next_run as due_run, advanced as utc_next_run,
      case when json_data is not null and not has_doc then 'json_data ignored' end as warning
    from tp""",
)
def dispatch_requests(spark: SparkSession, folder: str) -> DataFrame:
    return dispatch.due_requests(
        views.integrations(spark, folder),
        views.workspaces(spark, folder),
        views.auths(spark, folder),
        at(NOW),
        "s3_to_mongo",
    )


@query(
    "dispatch_advanced",
    views="integrations",
    sql=f"""with {_ADVANCED}
    select integration_id, case when {_DUE} then advanced else utc_next_run end as utc_next_run,
      case when {_DUE} then advanced_frozen else utc_next_run end as frozen_next_run
    from adv""",
)
def dispatch_advanced(spark: SparkSession, folder: str) -> DataFrame:
    table, now = views.integrations(spark, folder), at(NOW)
    frozen = dispatch.advance_due(table, now, frozen_offset=True).select(
        "integration_id", F.col("utc_next_run").alias("frozen_next_run")
    )
    moved = dispatch.advance_due(table, now).select("integration_id", "utc_next_run")
    return moved.join(frozen, "integration_id")


@query(
    "manual_requests",
    views="integrations creds",
    sql=f"""select integration_id, workflow || '_ondemand' as dag_id,
      workspace_id || '_' || workflow || '_ondemand_manual_20240115_000000_0_' || integration_id as dag_run_id,
      {_conf_sql(f"case when integration_id % 7 = 0 then {_DOC['bucket']} else 'override-' || integration_id end",
                 _DOC['collection'], _DOC['prefix'], None, None, 'integration_id')} as conf,
      cast(null as varchar) as error,
      nullif(concat_ws(', ', case when json_data is not null and not has_doc then 'json_data ignored' end,
        case when integration_id % 7 = 0 then 'run_config ignored' end), '') as warning
    from integrations left join creds using (workspace_id)""",
)
def manual_requests(spark: SparkSession, folder: str) -> DataFrame:
    table = views.integrations(spark, folder)
    overrides = table.select(
        "integration_id",
        # The first of a repeated key does not count; every seventh override is no document.
        F.when(F.col("integration_id") % 7 == 0, "{bad").otherwise(F.concat(
            F.lit('{"s3_bucket":"first","s3_bucket":"override-'), F.col("integration_id").cast("string"), F.lit('"}')
        )).alias("run_config"),
    )
    return dispatch.manual_request(table, views.auths(spark, folder), overrides, at(NOW))


@query(
    "schedule_normalised",
    views="integrations",
    sql=f"""with z as (select *, {_ZONE} as z, schedule_type <> 'on_demand' and usr_sch_cron is not null as timed
      from integrations),
    l as (select *, {local_of(f"timestamp '{NOW}'", 'z')} as lnow from z),
    n as (select *, {next_after('lnow', 'schedule_type', 'hh', 'dow', 'dom')} as nlocal from l),
    u as (select *, case when usr_timezone <> 'Mars/Base' and timed and nlocal is not null
      then {utc_of('nlocal', 'z')} end as nrun from n)
    select integration_id, nrun as utc_next_run,
      case when nrun is null then null
        when schedule_type = 'daily' then '0 ' || hour(nrun) || ' * * *'
        when schedule_type = 'weekly' then '0 ' || hour(nrun) || ' * * ' || isodow(nrun) % 7
        else '0 ' || hour(nrun) || ' ' || day(nrun) || ' * *' end as utc_sch_cron,
      case when usr_timezone = 'Mars/Base' then 'invalid timezone' when not timed then null
        when hh is null then 'unparsed cron' end as sch_error
    from u""",
)
def schedule_normalised(spark: SparkSession, folder: str) -> DataFrame:
    return schedule.normalise(views.integrations(spark, folder), at(NOW)).select(
        "integration_id", "utc_next_run", "utc_sch_cron", "sch_error"
    )


@query(
    "schedule_updated",
    views="integrations",
    sql=f"""with z as (select *, 'Asia/Tokyo' as z,
        usr_sch_cron is not null and schedule_type <> 'on_demand' as again from integrations),
    l as (select *, {local_of(f"timestamp '{NOW}'", 'z')} as lnow from z),
    n as (select *, {next_after('lnow', 'schedule_type', 'hh', 'dow', 'dom')} as nlocal from l),
    u as (select *, case when again and nlocal is not null then {utc_of('nlocal', 'z')} end as nrun from n)
    select integration_id, z as usr_timezone,
      case when again then nrun else utc_next_run end as utc_next_run,
      timestamp '{NOW}' as updated_at,
      case when again and hh is null then 'unparsed cron' end as sch_error
    from u""",
)
def schedule_updated(spark: SparkSession, folder: str) -> DataFrame:
    table = views.integrations(spark, folder)
    updates = table.select(
        "integration_id",
        F.lit("Asia/Tokyo").alias("usr_timezone"),
        F.array(F.lit("usr_timezone")).alias("changed"),
    )
    return schedule.apply_updates(table, updates, at(NOW)).select(
        "integration_id", "usr_timezone", "utc_next_run", "updated_at", "sch_error"
    )


_JAN = "date_trunc('year', started)"


def _offset_sql(local: str) -> str:
    return f"(date_diff('second', {utc_of(local, 'zone')}, {local}) / 3600.0)"


@query(
    "zone_conversion",
    views="runs",
    sql=f"""with t as (select run_id, started, {ZONE_LIST}[run_id % 6 + 1] as zone from runs),
    a as (select *, timezone(zone, started) as later from t),
    b as (select *, timezone(zone, later - interval 1 hour) = started as is_ambiguous,
      timezone(zone, later) <> started as is_nonexistent, timezone('UTC', later) as later_utc from a),
    c as (select *, case when is_ambiguous then later_utc - interval 1 hour else later_utc end as utc,
      least({_offset_sql(_JAN)}, {_offset_sql(f"({_JAN} + interval 6 month)")}) as standard from b)
    select run_id, utc, later_utc as utc_second, is_ambiguous, is_nonexistent,
      case when is_nonexistent then started + interval 1 hour else started end as forward,
      case when is_nonexistent then started - interval 1 hour else started end as backward,
      case when not is_nonexistent then started end as strict,
      date_diff('second', utc, started) / 3600.0 as offset_hours,
      date_diff('second', utc, started) / 3600.0 <> standard as is_dst,
      timezone('Asia/Tokyo', timezone('UTC', utc)) as in_tokyo
    from c""",
)
def zone_conversion(spark: SparkSession, folder: str) -> DataFrame:
    zone = F.element_at(
        F.array(*[F.lit(z) for z in views.ZONES]), (F.col("run_id") % 6 + 1).cast("int")
    )
    t = views.runs(spark, folder).select("run_id", "started", zone.alias("zone"))
    local, z = F.col("started"), F.col("zone")
    return t.select(
        "run_id",
        zones.to_utc(local, z).alias("utc"),
        zones.to_utc(local, z, second=True).alias("utc_second"),
        zones.is_ambiguous(local, z).alias("is_ambiguous"),
        zones.is_nonexistent(local, z).alias("is_nonexistent"),
        zones.repair_gap(local, z).alias("forward"),
        zones.repair_gap(local, z, "shift_backward").alias("backward"),
        zones.repair_gap(local, z, "raise").alias("strict"),
        zones.offset_hours(local, z).alias("offset_hours"),
        zones.is_dst(local, z).alias("is_dst"),
        zones.from_utc(zones.to_utc(local, z), F.lit("Asia/Tokyo")).alias("in_tokyo"),
    )


_NOON = "(timestamp '2024-01-01 12:00:00' + to_days(cast(d as int)))"


@query(
    "zone_transitions",
    views="integrations",
    sql=f"""with zones as (select distinct usr_timezone as zone from integrations where usr_timezone <> 'Mars/Base'),
    probes as (select zone, d, {_NOON} as started from zones, generate_series(0, 365) as g(d)),
    s as (select *, {utc_of('started', 'zone')} as utc, {_offset_sql('started')} <>
      least({_offset_sql(_JAN)}, {_offset_sql(f"({_JAN} + interval 6 month)")}) as dst from probes),
    p as (select *, lag(dst) over (partition by zone order by d) as was from s)
    select zone, max(case when not was and dst then utc end) as spring_forward,
      max(case when was and not dst then utc end) as fall_back from p group by zone""",
)
def zone_transitions(spark: SparkSession, folder: str) -> DataFrame:
    used = views.integrations(spark, folder).select(F.col("usr_timezone").alias("zone")).where(
        zones.is_known_zone("usr_timezone")
    )
    return zones.dst_transitions(used, 2024)


@query(
    "workflow_names",
    views="integrations",
    sql="""select integration_id, workflow || '_ondemand' as target,
      case when usr_timezone = 'Mars/Base' then false else true end as zone_ok from integrations""",
)
def workflow_names(spark: SparkSession, folder: str) -> DataFrame:
    return views.integrations(spark, folder).select(
        "integration_id",
        conf.workflow_run_target(F.col("integration_type")).alias("target"),
        zones.is_known_zone("usr_timezone").alias("zone_ok"),
    )


_STEP = "case schedule_type when 'weekly' then 7 when 'monthly' then 30 else 1 end"
_MISSED = f"""s as (select *, greatest(utc_next_run, timestamp '{NOW}' - interval 7 day) as start, {_STEP} as step
  from integrations where utc_next_run < timestamp '{NOW}'),
c as (select *, cast(ceil(date_diff('second', start, timestamp '{NOW}') / (step * 86400.0)) as bigint) as cnt from s),
m as (select *, unnest(generate_series(greatest(cnt - 7, 0), cnt - 1)) as i from c),
missed as (select *, start + to_days(cast(i * step as int)) as missed_run from m)
"""
_SKIP = f"""case when usr_sch_status <> 'active' then 'inactive'
  when utc_next_run <= timestamp '{NOW}' - interval 8 day then 'too old' end"""


@query(
    "backfill_missed",
    views="integrations",
    sql=f"with {_MISSED} select integration_id, schedule_type, missed_run from missed",
)
def backfill_missed(spark: SparkSession, folder: str) -> DataFrame:
    return backfill.missed_runs(views.integrations(spark, folder), at(NOW)).select(
        "integration_id", "schedule_type", "missed_run"
    )


@query(
    "backfill_skipped",
    views="integrations",
    sql=f"""select {_SKIP} as reason, count(*) as n from integrations
      where utc_next_run is not null and {_SKIP} is not null group by 1""",
)
def backfill_skipped(spark: SparkSession, folder: str) -> DataFrame:
    return backfill.skipped(views.integrations(spark, folder), at(NOW))


@query(
    "backfill_plan",
    views="integrations",
    sql=f"""with {_MISSED},
    p as (select integration_id, workspace_id, schedule_type, missed_run,
        row_number() over (order by integration_id, missed_run) - 1 as position
      from missed where {_SKIP} is null),
    b as (select *, position // 10 as batch, (position % 10) * 100 as stagger_ms,
        cast((integration_id * 2654435761) % 11 - 5 as int) as jitter from p),
    o as (select *, case when batch <= 5 then cast(5 * (pow(2, batch) - 1) as bigint)
        else 155 + 120 * (batch - 5) end as start_offset from b)
    select integration_id, workspace_id, schedule_type, missed_run, position, batch, start_offset, jitter,
      stagger_ms,
      timestamp '{NOW}' + to_seconds(start_offset + jitter) + to_milliseconds(stagger_ms) as trigger_at,
      missed_run + to_seconds(jitter) as jittered_run
    from o""",
)
def backfill_plan(spark: SparkSession, folder: str) -> DataFrame:
    return backfill.plan(views.integrations(spark, folder), at(NOW))


@query(
    "backfill_jitter_by_load",
    views="integrations",
    sql=_FORECAST_SQL.rstrip()
    + f""", {_MISSED},
    h as (select hour(timestamp) as hr, max(total_dag_runs) as load from forecast group by 1),
    w as (select missed.integration_id, missed_run, coalesce(load, 0) as hour_load,
        case when load > 500 then 10 when load > 300 then 5 else 0 end as width
      from missed left join h on hr = hour(missed_run))
    select integration_id, missed_run, hour_load,
      cast((integration_id * 2654435761) % (2 * width + 1) - width as int) as jitter from w""",
)
def backfill_jitter_by_load(spark: SparkSession, folder: str) -> DataFrame:
    missed = backfill.missed_runs(views.integrations(spark, folder), at(NOW)).select(
        "integration_id", "missed_run"
    )
    return backfill.jitter_by_load(missed, _forecast(spark, folder), at(NOW))


@query(
    "backfill_metrics",
    views="runs integrations",
    sql="""select i.workflow as integration_type,
      case when r.is_success is null then 'running' when r.is_success then 'success' else 'failed' end as status,
      count(*) as runs, count(*) filter (where ended is null) as pending,
      count(*) filter (where date_diff('second', started, ended) <= 60) as le_60,
      count(*) filter (where date_diff('second', started, ended) <= 300) as le_300,
      count(*) filter (where date_diff('second', started, ended) <= 600) as le_600,
      count(*) filter (where date_diff('second', started, ended) <= 1800) as le_1800,
      count(*) filter (where date_diff('second', started, ended) <= 3600) as le_3600,
      count(*) filter (where date_diff('second', started, ended) <= 7200) as le_7200
    from runs r join integrations i using (integration_id) group by 1, 2""",
)
def backfill_metrics(spark: SparkSession, folder: str) -> DataFrame:
    types = views.integrations(spark, folder).select(
        "integration_id", conf.workflow_name(F.col("integration_type")).alias("integration_type")
    )
    done = views.runs(spark, folder).select(
        "integration_id",
        F.when(F.col("is_success").isNull(), "running")
        .when(F.col("is_success"), "success")
        .otherwise("failed")
        .alias("status"),
        seconds_between(F.col("started"), F.col("ended")).alias("duration_seconds"),
    )
    return backfill.metrics(done.join(types, "integration_id"))


def _opened(spark: SparkSession, folder: str) -> DataFrame:
    requests = dispatch.due_requests(
        views.integrations(spark, folder),
        views.workspaces(spark, folder),
        views.auths(spark, folder),
        at(NOW),
    )
    return runs.open_runs(requests, at(NOW), run="trigger_run_id")


@query(
    "runs_opened",
    views="integrations",
    sql=f"""select integration_id,
      workspace_id || '_' || workflow || '_ondemand_scheduled_20240115_000000_0_' || integration_id as dag_run_id,
      timestamp '{NOW}' as started, cast(null as timestamp) as ended, false as is_success,
      timestamp '{NOW}' as execution_date
    from integrations where {_DUE}""",
)
def runs_opened(spark: SparkSession, folder: str) -> DataFrame:
    return _opened(spark, folder).drop("run_id")


@query(
    "runs_opened_ids",
    views="integrations",
    sql=f"""select cast(1 as bigint) as lowest, count(*) as highest, count(*) as ids, count(*) as n
    from integrations where {_DUE}""",
)
def runs_opened_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _opened(spark, folder).agg(
        F.min("run_id").alias("lowest"),
        F.max("run_id").alias("highest"),
        F.count_distinct("run_id").alias("ids"),
        F.count(F.lit(1)).alias("n"),
    )


@query(
    "prepare_errors",
    views="integrations workspaces creds",
    sql=f"""select integration_id as run_id, 'prepare' as task_id, 'PREPARE_ERROR' as error_code,
      'Prepare failed: s3_bucket is required in configuration' as message, 1 as seq
    from integrations where {_DUE} and not has_doc""",
)
def prepare_errors(spark: SparkSession, folder: str) -> DataFrame:
    requests = dispatch.due_requests(
        views.integrations(spark, folder),
        views.workspaces(spark, folder),
        views.auths(spark, folder),
        at(NOW),
    )
    return runs.prepare_errors(requests.withColumn("run_id", F.col("integration_id")))
