"""The operational tables as views over the driver tables.

Every view is a projection, so it scales with the table under it and pushes its filters and
columns into the scan. The views are written once more as SQL in ``plans/view_sql.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborlane import schemas
from harborlane.functions.times import compact_text, epoch_millis, instant
from harborlane.sources.tables import table

# Fixed values.
ZONES = [
    "UTC",
    "America/New_York",
    "Europe/London",
    "Asia/Tokyo",
    "Australia/Sydney",
    "America/Phoenix",
]
DAY_ZERO = "2024-01-15 00:00:00"


def _pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(*parts: Column | str) -> Column:
    return F.concat(
        *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").select(
        _text("cust-", F.col("r_regionkey")).alias("customer_guid"),
        F.col("r_name").alias("name"),
        F.lit(100).alias("max_integration"),
    )


def workspaces(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").select(
        _text("ws-", F.col("n_nationkey")).alias("workspace_id"),
        _text("cust-", F.col("n_regionkey")).alias("customer_guid"),
    )


def integrations(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("c_custkey")
    q = F.expr("c_custkey div 4")
    hour, dow, dom = q % 24, q % 7, 1 + q % 31
    kind = _pick(i % 4, ["daily", "weekly", "monthly", "on_demand"])
    cron = (
        F.when(i % 97 == 0, F.lit("every day"))
        .when(i % 4 == 0, _text("0 ", hour, " * * *"))
        .when(i % 4 == 1, _text("0 ", hour, " * * ", dow))
        .when(i % 4 == 2, _text("0 ", hour, " ", dom, " * *"))
    )
    document = (
        F.when(i % 19 == 0, F.lit("[1,2]"))
        .when(i % 17 == 0, F.lit("{bad"))
        .when(i % 13 == 0, F.lit(None).cast("string"))
        .otherwise(
            _text(
                '{"mongo_collection":"coll_', i % 10,
                '","s3_bucket":"bucket-', F.col("c_nationkey"),
                '","s3_prefix":"in/', i, '/"}',
            )
        )
    )
    created = F.timestamp_add("DAY", (i % 365).cast("int"), instant("2023-01-01 00:00:00"))
    return table(spark, folder, "customer").select(
        i.alias("integration_id"),
        _text("ws-", F.col("c_nationkey")).alias("workspace_id"),
        (i % 3 + 1).cast("int").alias("workflow_id"),
        F.col("c_nationkey").alias("auth_id"),
        (i % 2 + 1).cast("int").alias("source_access_pt_id"),
        F.lit(3).alias("dest_access_pt_id"),
        _pick(i % 3, ["s3_to_mongo", "S3ToMongo", "AzureBlobToMongo"]).alias("integration_type"),
        cron.alias("usr_sch_cron"),
        F.when(F.col("c_acctbal") < 0, "paused").otherwise("active").alias("usr_sch_status"),
        F.when(i % 89 == 0, F.lit("Mars/Base"))
        .otherwise(_pick(F.expr("c_custkey div 96") % 6, ZONES))
        .alias("usr_timezone"),
        F.when(
            i % 50 != 0,
            F.timestamp_add("HOUR", (i % 1440 - 720).cast("int"), instant(DAY_ZERO)),
        ).alias("utc_next_run"),
        cron.alias("utc_sch_cron"),
        kind.alias("schedule_type"),
        document.alias("json_data"),
        created.alias("created_at"),
        created.alias("updated_at"),
    )


def auths(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    document = (
        F.when(s % 11 == 0, F.lit("{oops"))
        .when(
            s % 2 == 0,
            _text('{"s3_access_key":"ak-', s, '","s3_secret_key":"sk-', s, '"}'),
        )
        .otherwise(
            _text(
                '{"mongo_uri":"mongodb://user', s, ":p%40ss@host", s,
                '.example.com:27017/db","mongo_password":"pw-', s, '"}',
            )
        )
    )
    return table(spark, folder, "supplier").select(
        s.alias("auth_id"),
        _text("ws-", F.col("s_nationkey")).alias("workspace_id"),
        _pick(s % 2, ["s3", "mongo"]).alias("auth_type"),
        document.alias("json_data"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    started = F.timestamp_add("MINUTE", (o % 1440).cast("int"), F.col("o_orderdate"))
    length = (F.floor("o_totalprice") % 9000).cast("int")
    finished = F.col("o_orderstatus") != "P"
    return table(spark, folder, "orders").select(
        o.alias("run_id"),
        F.col("o_custkey").alias("integration_id"),
        _text(
            "ws-", F.col("o_custkey") % 25,
            "_s3_to_mongo_ondemand_", _pick(o % 2, ["manual", "scheduled"]),
            "_", compact_text(F.col("o_orderdate")), "_0_", o,
        ).alias("dag_run_id"),
        started.alias("started"),
        F.when(finished, F.timestamp_add("SECOND", length, started)).alias("ended"),
        F.when(finished, F.col("o_orderstatus") == "O").alias("is_success"),
        F.col("o_orderdate").alias("execution_date"),
    )


def run_errors(spark: SparkSession, folder: str, run: str = "l_orderkey") -> DataFrame:
    """Pushed errors; ``run`` picks the column that plays the run, for longer error lists."""
    return (
        table(spark, folder, "lineitem")
        .where(F.col("l_returnflag") == "R")
        .select(
            F.col(run).alias("run_id"),
            _pick(F.col("l_linenumber") % 3, schemas.RUN_TASKS).alias("task_id"),
            F.when(F.col("l_linestatus") == "O", "DATA_ERROR")
            .otherwise("VALIDATION_ERROR")
            .alias("error_code"),
            _text(
                "part ", F.col("l_partkey"), " supplier ", F.col("l_suppkey"),
                " line ", F.col("l_linenumber"),
                " cents ", F.round(F.col("l_extendedprice") * 100).cast("bigint"),
            ).alias("message"),
            F.col("l_linenumber").alias("seq"),
        )
    )


def task_states(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("run_id")
    prepare, validate, execute = o % 11 == 0, o % 7 == 0, o % 5 == 0
    t = F.col("task_id")
    state = (
        F.when((t == "prepare") & prepare, "failed")
        .when((t == "validate") & prepare, "upstream_failed")
        .when((t == "validate") & validate, "failed")
        .when((t == "execute") & (prepare | validate), "upstream_failed")
        .when((t == "execute") & execute, "failed")
        .otherwise("success")
    )
    return (
        table(spark, folder, "orders")
        .select(
            F.col("o_orderkey").alias("run_id"),
            F.explode(F.array(*[F.lit(x) for x in schemas.RUN_TASKS])).alias("task_id"),
        )
        .withColumn("state", state)
    )


def _twice_every_tenth(events: DataFrame) -> DataFrame:
    """Every tenth event is delivered twice; ``copy`` is 0 or 1."""
    copies = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return events.select("*", F.explode(copies).alias("copy"))


def change_value(op: Column) -> Column:
    """The message an event stands for."""
    e, u = F.col("event_id"), F.col("user_id")
    target = F.when(e % 7 == 3, u + 100000000).otherwise(u)
    millis = epoch_millis(F.col("ts"))
    return _text(
        '{"integration_id":', target, ',"workspace_id":"ws-', u % 25,
        '","__op":"', op, '","__source_ts_ms":', millis,
        ',"__source_db":"control","__source_table":"integrations"}',
    )


def change_records_of(events: DataFrame) -> DataFrame:
    """Topic records of the change stream from an events frame, batch or stream."""
    e, u = F.col("event_id"), F.col("user_id")
    op = (
        F.when(F.col("event_type") == "signup", "c")
        .when(F.col("event_type") == "error", "d")
        .when(F.col("event_type") == "click", "r")
        .otherwise("u")
    )
    legacy = _text(
        '{"event_type":"integration.created","event_id":"evt-', e,
        '","timestamp":"2024-01-01T00:00:00","data":{"integration_id":', u,
        ',"workflow_type":"S3ToMongo","source_config":{"s3_bucket":"legacy-', e,
        '"},"destination_config":{"mongo_collection":"legacy"}}}',
    )
    finished = _text(
        '{"event_type":"integration.run.completed","event_id":"evt-', e,
        '","timestamp":"2024-01-01T00:00:00","data":{"run_id":', e, "}}",
    )
    value = (
        F.when(e % 50 == 11, F.lit(None).cast("string"))
        .when(e % 50 == 23, F.lit("{broken"))
        .when(e % 50 == 37, legacy)
        .when(e % 50 == 41, finished)
        .when(e % 50 == 43, F.lit('{"some_field":1}'))
        .otherwise(change_value(op))
    )
    parent = (
        F.when(
            e % 4 == 0,
            _text("00-", F.md5(e.cast("string")), "-",
                  F.substring(F.md5(_text("s", e)), 1, 16), "-01"),
        )
        .when(e % 4 == 1, F.lit("bad"))
    )
    header = F.array(
        F.struct(F.lit("traceparent").alias("key"), parent.cast("binary").alias("value"))
    )
    return _twice_every_tenth(events).select(
        u.cast("string").alias("key"),
        value.alias("value"),
        F.lit("cdc.integration.events").alias("topic"),
        (e % 3).cast("int").alias("partition"),
        (e + F.col("copy") * 1000000000).alias("offset"),
        F.col("ts").alias("timestamp"),
        F.when(parent.isNotNull(), header).alias("headers"),
    )


def change_records(spark: SparkSession, folder: str) -> DataFrame:
    return change_records_of(table(spark, folder, "events"))


def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    status = _pick(e % 4, schemas.DEAD_LETTER_STATUSES)
    return (
        table(spark, folder, "events")
        .where(F.col("event_type") == "error")
        .select(
            e.alias("dlq_id"),
            F.when(e % 9 != 0, u).alias("integration_id"),
            F.lit("cdc.integration.events").alias("source_topic"),
            F.lit("cdc-consumer").alias("consumer_group"),
            u.cast("string").alias("message_key"),
            F.when(e % 5 == 0, F.lit("not json"))
            .otherwise(change_value(F.lit("c")))
            .alias("original_message"),
            _pick(e % 3, ["ValueError", "KeyError", "TypeError"]).alias("error_type"),
            _text("failed on ", e).alias("error_message"),
            (e % 4).cast("int").alias("retry_count"),
            status.alias("status"),
            F.lit(None).cast("string").alias("resolution_notes"),
            F.when(status == "resolved", F.timestamp_add("HOUR", F.lit(1), F.col("ts"))).alias(
                "resolved_at"
            ),
            F.col("ts").alias("created_at"),
            F.col("ts").alias("updated_at"),
        )
    )


def audit_events_of(events: DataFrame) -> DataFrame:
    """Audit events before the ingest job: duplicates, bad tenants and secrets included."""
    e, u = F.col("event_id"), F.col("user_id")
    tenant = (
        F.when(e % 40 == 3, "unknown")
        .when(e % 40 == 5, "")
        .when(e % 40 == 7, "bad guid!")
        .otherwise(_text("cust-", u % 5))
    )
    kind = (
        F.when(F.col("event_type") == "signup", "auth.created")
        .when(F.col("event_type") == "purchase", "data.destination.written")
        .when(F.col("event_type") == "error", "integration.run.failed")
        .when(F.col("event_type") == "click", "integration.run.started")
        .otherwise("auth.accessed")
    )
    before = _text(
        '{"user":"u', u, '","password":"p', e, '","nested":{"api_key":', e, ',"ok":true}}'
    )
    after = F.when(
        e % 25 == 0, _text('{"note":"', F.repeat(F.lit("x"), 1500), '"}')
    ).otherwise(_text('{"tokens":["a","b"],"bucket":"b', u, '"}'))
    return _twice_every_tenth(events).select(
        _text("ev-", F.lpad(e.cast("string"), 12, "0")).alias("event_id"),
        F.col("ts").alias("timestamp"),
        tenant.alias("customer_guid"),
        kind.alias("event_type"),
        _text("user-", u).alias("actor_id"),
        F.lit("user").alias("actor_type"),
        F.lit(None).cast("string").alias("actor_ip"),
        F.lit("integration").alias("resource_type"),
        u.cast("string").alias("resource_id"),
        F.col("event_type").alias("action"),
        F.when(F.col("value") >= 100, "failure").otherwise("success").alias("outcome"),
        before.alias("before_state"),
        after.alias("after_state"),
        _text("trace-", u % 500).alias("trace_id"),
        F.lit(None).cast("string").alias("request_id"),
        F.col("props").alias("metadata_json"),
    )


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    return audit_events_of(table(spark, folder, "events"))


def audit_records(spark: SparkSession, folder: str) -> DataFrame:
    """The audit events as topic records: ISO times in several offsets, and some broken messages."""
    events = table(spark, folder, "events")
    e = F.col("event_id")
    wall = F.timestamp_add("HOUR", F.when(e % 3 == 1, 2).when(e % 3 == 2, -5).otherwise(0), F.col("ts"))
    offset = F.when(e % 3 == 1, "+02:00").when(e % 3 == 2, "-0500").otherwise("Z")
    value = F.to_json(
        F.struct(
            e.cast("string").alias("event_id"),
            F.when(
                e % 19 != 0, F.concat(F.replace(wall.cast("string"), F.lit(" "), F.lit("T")), offset)
            ).alias("timestamp"),
            _text("cust-", F.col("user_id") % 5).alias("customer_guid"),
            F.col("event_type"),
            F.col("props").alias("metadata_json"),
        )
    )
    return events.select(
        F.when(e % 17 == 0, "{cut").otherwise(value).alias("value"),
        e.alias("offset"),
        F.timestamp_add("HOUR", F.lit(1), F.col("ts")).alias("timestamp"),
    )


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = table(spark, folder, "events").schema
    # The pattern matches the table whether it is one file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/events.parque[t]")


def landing_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects as the landing job takes them: bucket, key and whole content.

    A turn of a conversation is a file: some hold an object, some a list of two, some are broken,
    some hold a bare value, some are folders or another format.
    """
    c, t = F.col("conv_id"), F.col("turn")
    record = F.to_json(
        F.struct(c.alias("conv_id"), t.alias("turn"), F.col("role"), F.col("text"))
    )
    n = c * 7 + t
    key = _text(
        "in/", c, "/", t,
        F.when(n % 13 == 5, "/").when(n % 13 == 7, ".csv").otherwise(".json"),
    )
    content = (
        F.when(n % 13 == 5, F.lit(""))
        .when(n % 11 == 3, F.concat(record, F.lit(" trailing")))
        .when(n % 11 == 4, F.concat(record, F.lit("\n"), record))
        .when(n % 11 == 5, F.lit("17"))
        .when(n % 11 == 6, F.lit("[]"))
        .when(n % 11 == 7, F.concat(F.lit("["), record, F.lit(",3]")))
        .when(n % 2 == 0, F.concat(F.lit("["), record, F.lit(","), record, F.lit("]")))
        .otherwise(record)
    )
    return table(spark, folder, "conversations").select(
        (c % 10).alias("run_id"),
        _text("bucket-", c % 3).alias("bucket"),
        key.alias("key"),
        content.alias("content"),
    )
