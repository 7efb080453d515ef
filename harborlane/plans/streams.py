"""Queries that run the streaming jobs over the events table until it is read, and return a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane import schemas
from harborlane.functions.times import instant as at
from harborlane.plans.operations import _REQUEST_SQL
from harborlane.plans.registry import query
from harborlane.plans.scheduling import NOW
from harborlane.session import fresh_dir
from harborlane.sinks import erasure, storage
from harborlane.sources import views
from harborlane.streaming import jobs


def _change_job(spark: SparkSession, folder: str, **options) -> str:
    out = fresh_dir(spark, "changes")

    def lookups() -> jobs.Lookups:
        return jobs.Lookups(
            views.integrations(spark, folder),
            views.workspaces(spark, folder),
            views.auths(spark, folder),
        )

    records = views.change_records_of(views.event_stream(spark, folder))
    jobs.change_job(records, lookups, out, f"{out}/checkpoint", at(NOW), **options).awaitTermination()
    return out


# A repeat has the same key and content but its own offset, and a stream keeps whichever it meets
# first, so the columns made from the offset are left out of the comparison.
_STABLE = ["integration_id", "workspace_id", "customer_guid", "dag_id", "dedup_key"]


@query(
    "stream_change_requests",
    views="resolved",
    sql=f"select {', '.join(_STABLE)} from ({_REQUEST_SQL})",
)
def stream_change_requests(spark: SparkSession, folder: str) -> DataFrame:
    out = _change_job(spark, folder)
    return spark.read.parquet(f"{out}/requests").select(*_STABLE)


@query(
    "stream_tenant_erased",
    views="resolved",
    sql=f"""select 'requests' as output, {', '.join(_STABLE)} from ({_REQUEST_SQL}) where customer_guid <> 'cust-1'
      union all select 'audit', integration_id, null, customer_guid, null, null from ({_REQUEST_SQL})
        where customer_guid <> 'cust-1'""",
)
def stream_tenant_erased(spark: SparkSession, folder: str) -> DataFrame:
    """What the change job leaves of the requests and audit events, when a tenant is erased after it."""
    out = _change_job(spark, folder)
    erasure.erase_outputs(
        spark, out, "cust-1", views.workspaces(spark, folder), views.integrations(spark, folder)
    )
    requests = spark.read.parquet(f"{out}/requests").select(F.lit("requests").alias("output"), *_STABLE)
    audit = spark.read.parquet(f"{out}/audit").select(
        F.lit("audit").alias("output"),
        F.col("resource_id").cast("bigint").alias("integration_id"),
        "customer_guid",
    )
    return requests.unionByName(audit, allowMissingColumns=True)


@query(
    "stream_alerts",
    views="first_parsed resolved",
    sql=f"""with bad as (
      select target, why from first_parsed where route = 'reject'
      union all select target, 'integration not found' from resolved where workspace_id is null)
    select coalesce(cast(case when target = 0 then null else target end as varchar), 'unknown') as key,
      case why when 'malformed json' then 'ValueError' when 'integration not found' then 'LookupError'
        else 'KeyError' end as error_type,
      why as error_message, '{NOW.replace(" ", "T")}' as at, '0' as retry_count,
      'cdc.integration.events' as source_topic, 'cdc-consumer' as consumer_group
    from bad""",
)
def stream_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """The alerts a change job sends, as a topic gets them; sent once, though the job is asked twice."""
    sent = fresh_dir(spark, "sent")

    def notify(alerts: DataFrame) -> None:
        alerts.write.mode("append").parquet(sent)

    out = _change_job(spark, folder, notify=notify)
    for name in storage.names(spark, f"{out}/alerts"):
        if name.startswith("batch_id="):
            jobs.deliver(spark, out, int(name.removeprefix("batch_id=")), notify)
    fields = {
        "error_type": "error.type", "error_message": "error.message", "at": "error.timestamp",
        "retry_count": "retry_count", "source_topic": "source_topic", "consumer_group": "consumer_group",
    }
    return spark.read.schema("key string, value string").parquet(sent).select(
        "key", *[F.get_json_object("value", f"$.{path}").alias(name) for name, path in fields.items()]
    )


@query(
    "stream_change_counters",
    views="first_parsed resolved",
    sql="""select route, ev as event_type, why as reason, count(*) as n from first_parsed group by 1, 2, 3
      union all select 'dead letters', null, null, (select count(*) from first_parsed where route = 'reject')
        + (select count(*) from resolved where workspace_id is null)""",
)
def stream_change_counters(spark: SparkSession, folder: str) -> DataFrame:
    out = _change_job(spark, folder)
    counted = spark.read.parquet(f"{out}/counters").drop("batch_id")
    letters = spark.read.schema(schemas.DEAD_LETTERS).parquet(f"{out}/dead_letters").agg(
        F.lit("dead letters").alias("route"),
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("string").alias("reason"),
        F.count(F.lit(1)).alias("n"),
    )
    total = counted.groupBy("route", "event_type", "reason").agg(F.sum("n").alias("n"))
    return total.unionByName(letters)


@query(
    "stream_change_health",
    views="first_parsed resolved",
    sql="""with e as (select ts, why from first_parsed where route = 'reject'
        union all select ts, 'integration not found' from resolved where workspace_id is null),
      l as (select * from e order by ts desc, why desc limit 1)
    select (select count(*) from first_parsed) as messages, (select count(*) from e) as failed,
      (select ts from l) as last_error_time, (select why from l) as last_error,
      (select max(ts) from first_parsed) as last_message_time, false as running, 'unhealthy' as status""",
)
def stream_change_health(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.health(spark, _change_job(spark, folder), running=False)


def _audit_job(spark: SparkSession, folder: str, out: str, checkpoint: str, **options) -> None:
    events = views.audit_events_of(views.event_stream(spark, folder))
    jobs.audit_job(
        events, f"{out}/store", f"{out}/{checkpoint}-rejects", f"{out}/{checkpoint}", at(NOW), **options
    ).awaitTermination()


@query("stream_audit_store", views="stored_audit", sql="select * exclude (copy) from stored_audit")
def stream_audit_store(spark: SparkSession, folder: str) -> DataFrame:
    out = fresh_dir(spark, "audit")
    _audit_job(spark, folder, out, "checkpoint")
    return jobs.audit_store(spark, f"{out}/store").read()


@query(
    "stream_audit_replayed",
    views="stored_audit",
    sql="select * exclude (copy) from stored_audit where customer_guid <> 'cust-1'",
)
def stream_audit_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """The topic read by one job, read again from its start by a job with another checkpoint, merged,
    and a tenant erased."""
    out = fresh_dir(spark, "audit-again")
    for checkpoint in ("first", "second"):
        _audit_job(spark, folder, out, checkpoint, fanout=2)
    store = jobs.audit_store(spark, f"{out}/store")
    store.merge(fanout=2)
    store.erase(customer_guid="cust-1")
    return store.read()


@query(
    "stream_letter_rates",
    sql="""with w as (select date_trunc('minute', ts) - to_minutes(cast(k as int)) as window_start
      from events, generate_series(0, 4) as g(k) where event_type = 'error'),
    r as (select window_start, window_start + interval 5 minute as window_end, count(*) as n from w
      group by 1 having count(*) > 1)
    select * from r where window_end <= (select max(ts) - interval 10 minute from events
      where event_type = 'error')""",
)
def stream_letter_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Only windows the watermark has passed are out when the stream has read everything."""
    out = fresh_dir(spark, "rates")
    letters = (
        views.event_stream(spark, folder)
        .where(F.col("event_type") == "error")
        .select(F.col("ts").alias("created_at"))
    )
    jobs.rate_job(letters, f"{out}/rates", f"{out}/checkpoint", above=1).awaitTermination()
    return spark.read.parquet(f"{out}/rates").select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"),
        "n",
    )
