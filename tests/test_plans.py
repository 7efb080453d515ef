"""The plans that make the jobs hold at scale."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from harborlane import schemas
from harborlane.functions import conf
from harborlane.functions.times import instant
from harborlane.operators import audit, changes, deadletter, dispatch, forecast, runs
from harborlane.plans import catalog, operations, transfer
from harborlane.sinks import documents, partitions
from harborlane.sources import views
from harborlane.streaming import jobs

FOLDER = "/root/testdata/sf0.01"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = sorted(name for name in catalog.queries() if not name.startswith(("stream_", "source_", "sink_versions")))


# The schedule counts and the hours of a forecast.
HINTED = {
    "forecast_hourly", "forecast_hotspots", "forecast_statistics", "forecast_summary",
    "forecast_imminent", "backfill_jitter_by_load",
}


@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_joins_no_python_and_only_bounded_hints(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.queries()[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert operator not in plan, plan
    assert ("BroadcastExchange" in plan) == (name in HINTED)


def test_a_filter_on_confs_makes_each_once_and_not_in_the_join(spark):
    integrations = spark.createDataFrame(
        [
            (1, "ws-1", 7, 1, 3, "S3ToMongo", "0 5 * * *", "active", "UTC", dt.datetime(2024, 1, 1), "daily", '{"s3_bucket":"b","mongo_collection":"c"}'),
            (2, "ws-1", 7, 1, 3, "S3ToMongo", "0 5 * * *", "active", "UTC", dt.datetime(2024, 1, 1), "daily", "{bad"),
            (3, "ws-2", 7, 1, 3, "S3ToMongo", "0 5 * * *", "active", "UTC", dt.datetime(2024, 1, 1), "daily", '{"s3_bucket":"b"}'),
        ],
        "integration_id long, workspace_id string, auth_id int, source_access_pt_id int, dest_access_pt_id int,"
        " integration_type string, usr_sch_cron string, usr_sch_status string, usr_timezone string,"
        " utc_next_run timestamp_ntz, schedule_type string, json_data string",
    )
    workspaces = spark.createDataFrame([("ws-1", "cust-1"), ("ws-2", "cust-2")], "workspace_id string, customer_guid string")
    auths = spark.createDataFrame([(7, "ws-2", '{"mongo_collection":""}')], "auth_id long, workspace_id string, json_data string")
    requests = dispatch.due_requests(integrations, workspaces, auths, instant("2024-01-15 00:00:00"))
    errors = runs.prepare_errors(requests.withColumn("run_id", F.col("integration_id")))
    assert {r["run_id"]: r["message"].split()[2] for r in errors.collect()} == {2: "s3_bucket", 3: "mongo_collection"}
    plan = errors._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert plan.count("StructsToJsonEvaluator") == 1, plan
    assert not any("map_concat" in line for line in lines if "Join" in line), plan
    # Made of rows dealt out by integration, whatever the join leaves in a task.
    at = {x: next(i for i, line in enumerate(lines) if x in line) for x in ("StructsToJson", "RepartitionByExpression", "Join")}
    assert at["StructsToJson"] < at["RepartitionByExpression"] < at["Join"], plan


def test_a_filter_on_a_conf_parses_its_documents_once(spark):
    df = spark.createDataFrame([('{"a":1,"x":2}',), ('{"x":1}',)], "j string")
    merged = conf.conf_text(conf.merge(conf.base_conf(x=F.lit(1)), conf.json_map(F.col("j"))))
    found = df.where(merged == '{"a":1,"x":2}')
    assert found.count() == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_changes_of_stores_pair_nothing(spark):
    """What is made of the rows of some buckets; the queries return the stored result."""
    letters = operations._letters(spark, FOLDER)
    ids, now = letters.select("dlq_id").limit(5), instant("2024-02-01 00:00:00")
    stored = transfer._stored(spark, FOLDER)
    match = F.try_element_at("fields", F.lit("segment")).cast("string") == "BUILDING"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            deadletter.bulk_transition(letters, ids, "resolved", now),
            deadletter.expire(letters, now),
            documents.delete_matching(stored, match),
            documents.merged(stored, documents.fold(transfer._incoming(spark, FOLDER))),
        ):
            plan = plan_of(df)
            for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "BroadcastExchange"):
                assert operator not in plan, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_small_batch_does_not_shuffle_the_tables(spark, work):
    path = f"{work}/integrations"
    views.integrations(spark, FOLDER).write.parquet(path)
    events = changes.parse(views.change_records(spark, FOLDER)).limit(50)
    events.write.parquet(f"{work}/events")
    stored, workspaces, auths = changes.narrow(
        spark.read.parquet(f"{work}/events"),
        spark.read.parquet(path),
        views.workspaces(spark, FOLDER),
        views.auths(spark, FOLDER),
    )
    cached = plan_of(stored)
    semi = cached[cached.index("LeftSemi") - 40:]
    assert "BroadcastHashJoin" in semi and "SortMergeJoin" not in cached
    for frame in (workspaces, auths):
        assert "BroadcastHashJoin" in plan_of(frame) and "SortMergeJoin" not in plan_of(frame)
    stored.unpersist()


def test_a_replay_reads_the_letters_once(spark):
    plan = plan_of(catalog.queries()["dlq_replayed_requests"](spark, FOLDER))
    # Letters, ids of letters, ids of strangers; nothing is joined back by the letter's id.
    assert len(re.findall(r"FileScan[^\n]*events", plan)) == 3


def test_rank_limits_apply_before_the_shuffle(spark):
    events = changes.parse(views.change_records(spark, FOLDER))
    for df in (
        runs.first_errors(views.run_errors(spark, FOLDER)),
        changes.deduplicate(events),
        changes.latest_state(events),
    ):
        plan = plan_of(df)
        partial = re.search(r"WindowGroupLimit .*Partial", plan)
        assert partial and partial.start() > plan.index("Exchange hashpartitioning")


def test_counts_are_partial_and_read_two_columns(spark):
    plan = plan_of(forecast.schedule_counts(views.integrations(spark, FOLDER)))
    assert "partial_count" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in plan


def test_a_tenant_page_reads_that_tenant_only(spark, work):
    store = audit.unique(audit.accepted(audit.clean(views.audit_events(spark, FOLDER), instant("2024-02-01 00:00:00"))))
    partitions.append_partitioned(store, work)
    test = audit.store_filter("cust-2", outcome="failure", from_ts=dt.datetime(2024, 1, 3))
    query = audit.page(jobs.read_store(spark, work), test)._jdf.queryExecution()
    plan = spark._jvm.PythonSQLUtils.explainString(query, "formatted")
    assert "TakeOrderedAndProject" in plan
    lines = dict(line.split(": ", 1) for line in plan.splitlines() if ": " in line)
    assert "customer_guid" in lines["PartitionFilters"] and "event_month" in lines["PartitionFilters"]
    pushed = lines["PushedFilters"]
    assert "EqualTo(outcome,failure)" in pushed and "GreaterThanOrEqual(timestamp" in pushed


def test_a_batch_reads_only_the_partitions_it_touches(spark, work):
    cleaned = audit.clean(views.audit_events(spark, FOLDER), instant("2024-02-01 00:00:00"))
    store = audit.unique(audit.accepted(cleaned))
    partitions.append_partitioned(store, work)
    batch = store.where(F.col("customer_guid") == "cust-1")
    fresh = audit.not_stored(batch, jobs.read_store(spark, work))
    assert fresh.count() == 0
    plan = plan_of(fresh)
    scan = plan[plan.index(work.rsplit("/", 1)[1]) - 400 :]
    assert "dynamicpruning" in scan or "cust-1" in scan


def test_a_hot_workspace_is_split(spark, work):
    """A third of the integrations in one workspace, with no side small enough to broadcast."""
    table = spark.range(0, 300_000, 1, 8).select(
        F.col("id").alias("integration_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000).cast("string").alias("workspace_id"),
        F.lit(1).alias("workflow_id"), F.lit(1).alias("auth_id"), F.lit(1).alias("source_access_pt_id"),
        F.lit(1).alias("dest_access_pt_id"), F.lit("S3ToMongo").alias("integration_type"),
        F.lit("0 2 * * *").alias("usr_sch_cron"), F.lit("active").alias("usr_sch_status"),
        F.lit("UTC").alias("usr_timezone"), instant("2024-01-01 00:00:00").alias("utc_next_run"),
        F.lit("0 2 * * *").alias("utc_sch_cron"), F.lit("daily").alias("schedule_type"),
        F.concat(F.lit('{"a":"'), F.sha2(F.col("id").cast("string"), 512), F.lit('"}')).alias("json_data"),
        F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
    table.write.parquet(f"{work}/integrations")
    table = spark.read.parquet(f"{work}/integrations")
    ws = spark.range(5000).select(
        F.col("id").cast("string").alias("workspace_id"), F.lit("cust").alias("customer_guid")
    )
    auths = spark.createDataFrame([(1, "0", "s3", '{"b":1}')], schemas.AUTHS)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1m",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        due = dispatch.due_requests(table, ws, auths, instant("2024-01-15 00:00:00"))
        due = due.select("integration_id", "trigger_run_id", "conf")
        assert len(due.select("integration_id").collect()) == 300_000
        counted = due.where(F.length("conf") > 0)
        counted.foreachPartition(lambda rows: None)
        plan = plan_of(counted)
        rows = counted.agg(F.count(F.lit(1))).collect()[0][0]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert rows == 300_000
    assert "SortMergeJoin(skew=true)" in plan
