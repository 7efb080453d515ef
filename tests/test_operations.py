from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from harborlane import schemas
from harborlane.functions.times import instant
from harborlane.operators import audit, changes, deadletter, runs
from tests.test_schedules import integration, table

def now():
    return instant("2024-02-01 00:00:00")

TOPIC = "kafka"


def records(spark, *values, first=42):
    rows = [
        (None, v if v is None or isinstance(v, str) else json.dumps(v), TOPIC, 0, first + i, None, None)
        for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, schemas.TOPIC_RECORD)


CREATED = {"__op": "c", "integration_id": 123, "__source_ts_ms": 1711234567890, "workspace_id": "ws-1"}


@pytest.mark.parametrize(
    "value,key,route,reason",
    [
        (CREATED, "123:1711234567890:c", "trigger", None),
        ({"__op": "c", "integration_id": 123}, "0:42", "trigger", None),
        ({"__op": "c"}, "0:42", "log", None),
        ({"__op": "u", "integration_id": 5, "__source_ts_ms": 1}, "5:1:u", "log", None),
        ({"__op": "r", "integration_id": 5, "__source_ts_ms": 1}, "5:1:r", "reject", "unknown operation r"),
        ({"event_id": "abc-123-def", "event_type": "integration.run.started"}, "abc-123-def", "log", None),
        ({"event_id": "", "event_type": "x.y"}, "0:42", "reject", "unknown event type x.y"),
        ({"some_field": 1}, "0:42", "reject", "unknown message format"),
        ("{broken", "0:42", "reject", "malformed json"),
        ("[1]", "0:42", "reject", "malformed json"),
        ("17", "0:42", "reject", "malformed json"),
        ({"event_id": "e", "event_type": "integration.created", "data": {"integration_id": 1}}, "e", "log", None),
        (
            {"event_id": "e", "event_type": "integration.created",
             "data": {"integration_id": 1, "workflow_type": "w", "source_config": {"a": 1}, "destination_config": {"b": 2}}},
            "e", "trigger", None,
        ),
        ({"event_id": "e", "event_type": "integration.created", "data": [1]}, "e", "reject", "malformed json"),
        ({"__op": "c", "integration_id": "abc", "__source_ts_ms": 7}, "abc:7:c", "trigger", None),
    ],
)
def test_classification(spark, value, key, route, reason):
    row = changes.parse(records(spark, value)).first()
    assert row["dedup_key"] == f"dedup:kafka:{TOPIC}:{key}"
    assert (row["route"], row["reason"]) == (route, reason)


def test_tombstones_are_dropped_and_repeats_kept_once(spark):
    events = changes.parse(records(spark, None, CREATED, CREATED, {"x": 1}, {"x": 1}))
    assert events.count() == 4
    kept = changes.deduplicate(events).orderBy("offset").collect()
    assert [r["offset"] for r in kept] == [43, 45, 46]


def test_latest_state(spark):
    def change(i, op, ts):
        return {"__op": op, "integration_id": i, "__source_ts_ms": ts}

    events = changes.parse(
        records(spark, change(1, "c", 1), change(1, "u", 3), change(1, "u", 2), change(2, "c", 1),
                change(2, "d", 2), change(3, "r", 5), change(4, "d", 1), change(4, "c", 9))
    )
    got = {r["integration_id"]: (r["op"], r["source_ts_ms"]) for r in changes.latest_state(events).collect()}
    assert got == {1: ("u", 3), 3: ("r", 5), 4: ("c", 9)}


@pytest.fixture
def lookups(spark):
    return (
        table(
            spark,
            integration(123, json_data='{"s3_bucket":"stored","s3_access_key":"mine"}'),
            integration(1, json_data='{"s3_bucket":"stored"}'),
        ),
        spark.createDataFrame([("ws-1", "cust-1")], schemas.WORKSPACES),
        spark.createDataFrame([(1, "ws-1", "s3", '{"s3_access_key":"auth","s3_bucket":"auth"}')], schemas.AUTHS),
    )


def test_requests_precedence_and_misses(spark, lookups):
    legacy = {
        "event_id": "e", "event_type": "integration.created",
        "data": {"integration_id": 1, "workflow_type": "w", "source_config": {"s3_bucket": "event", "traceparent": "no"},
                 "destination_config": {"s3_bucket": "target", "n": {"deep": 1}}},
    }
    events = changes.parse(records(spark, CREATED, legacy, CREATED | {"integration_id": 999}))
    resolved = changes.resolve(events, *lookups, now())
    got = {r["integration_id"]: r for r in changes.requests(resolved).collect()}
    assert sorted(got) == [1, 123]
    stored, legacy_conf = json.loads(got[123]["conf"]), json.loads(got[1]["conf"])
    assert stored["s3_access_key"] == "mine" and stored["s3_bucket"] == "stored"
    assert legacy_conf["s3_access_key"] == "auth" and legacy_conf["s3_bucket"] == "target"
    assert legacy_conf["n"] == {"deep": 1} and legacy_conf["traceparent"] == got[1]["traceparent"]
    assert got[123]["dag_run_id"].startswith("ws-1_s3_to_mongo_ondemand_manual_20240201_000000_0_123_")
    letters = changes.dead_letters(changes.rejects(events, resolved), "group", now()).collect()
    assert [(r["integration_id"], r["message_key"], r["error_message"], r["status"]) for r in letters] == [
        (999, "999", "integration not found", "pending")
    ]
    event = changes.trigger_audit(changes.requests(resolved), now()).where("resource_id = '123'").first()
    assert event["customer_guid"] == "cust-1" and json.loads(event["metadata_json"])["trigger_source"] == "cdc"


@pytest.mark.parametrize(
    "message,expected",
    [
        ({"integration_id": 42}, (42, "42")),
        ({"data": {"integration_id": 7}}, (7, "7")),
        ({"integration_id": 0, "data": {"integration_id": 7}}, (7, "7")),
        ({"data": {}}, (None, "unknown")),
        ({"integration_id": "not-a-number"}, (None, "not-a-number")),
    ],
)
def test_dead_letter_identity(spark, message, expected):
    events = changes.parse(records(spark, message | {"event_type": "never.heard"}))
    none = changes.resolve(events, *_empty_lookups(spark), now())
    row = changes.dead_letters(changes.rejects(events, none), "g", now()).first()
    assert (row["integration_id"], row["message_key"]) == expected
    alert = changes.alert_messages(changes.dead_letters(changes.rejects(events, none), "g", now())).first()
    body = json.loads(alert["value"])
    assert body["error"]["type"] == "KeyError" and body["consumer_group"] == "g" and body["retry_count"] == 0


def _empty_lookups(spark):
    return (
        spark.createDataFrame([], schemas.INTEGRATIONS),
        spark.createDataFrame([], schemas.WORKSPACES),
        spark.createDataFrame([], schemas.AUTHS),
    )


def test_dead_letter_audit_finds_the_customer(spark):
    events = changes.parse(records(spark, CREATED | {"__op": "x"}, "{bad"))
    letters = changes.dead_letters(
        changes.rejects(events, changes.resolve(events, *_empty_lookups(spark), now())), "g", now()
    )
    owners = spark.createDataFrame([(123, "cust-1")], "integration_id long, customer_guid string")
    got = changes.dead_letter_audit(letters, owners, now()).collect()
    assert sorted(r["customer_guid"] for r in got) == ["cust-1", "system"]
    assert {r["event_type"] for r in got} == {"message.dead_lettered"}


def letters(spark, *rows):
    full = [
        dict.fromkeys(schemas.DEAD_LETTERS.names)
        | {"dlq_id": i + 1, "status": "pending", "retry_count": 3, "source_topic": TOPIC,
           "error_type": "ValueError", "error_message": "Simulated processing error",
           "message_key": "k", "created_at": dt.datetime(2024, 1, 1 + i), "updated_at": dt.datetime(2024, 1, 1)}
        | row
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame(
        [tuple(r[n] for n in schemas.DEAD_LETTERS.names) for r in full], schemas.DEAD_LETTERS
    )


def test_listing(spark):
    df = letters(spark, {"integration_id": 1}, {"integration_id": 2}, {"status": "resolved"}, {}, {"integration_id": 1})
    ids = lambda d: [r["dlq_id"] for r in d.collect()]
    assert ids(deadletter.listing(df)) == [5, 4, 3, 2, 1]
    assert ids(deadletter.listing(df, limit=2, offset=1)) == [4, 3]
    assert ids(deadletter.listing(df, status="resolved")) == [3]
    assert ids(deadletter.listing(df, integration_id=1)) == [5, 1]
    between = deadletter.listing(df, created_after=dt.datetime(2024, 1, 2), created_before=dt.datetime(2024, 1, 3))
    assert ids(between) == [3, 2]
    for bad in ({"limit": 0}, {"limit": 201}, {"status": "lost"}):
        with pytest.raises(ValueError):
            deadletter.listing(df, **bad)
    assert {r["status"]: r["n"] for r in deadletter.counts_by_status(df).collect()} == {"pending": 4, "resolved": 1}
    assert deadletter.total_pending(df).first()[0] == 4


def test_get_parses_the_message(spark):
    df = letters(spark, {"original_message": '{"a":[1]}'}, {"original_message": "plain"})
    shown = deadletter.with_document(df).orderBy("dlq_id").select(F.to_json("document").alias("d")).collect()
    assert [r["d"] for r in shown] == ['{"a":[1]}', '"plain"']
    assert deadletter.get(df, 2).count() == 1 and deadletter.get(df, 99).count() == 0


def test_transitions(spark):
    df = letters(spark, {}, {}, {})
    ids = spark.createDataFrame([(1,), (1,), (99,)], "dlq_id long")
    rows = deadletter.bulk_transition(df, ids, "resolved", now(), "fixed").orderBy("dlq_id").collect()
    assert [(r["status"], r["resolution_notes"], r["resolved_at"] is None) for r in rows] == [
        ("resolved", "fixed", False), ("pending", None, True), ("pending", None, True),
    ]
    retried = deadletter.transition(df, F.col("dlq_id") == 2, "retrying", now(), increment_retry=True)
    assert [r["retry_count"] for r in retried.orderBy("dlq_id").collect()] == [3, 4, 3]
    nothing = deadletter.bulk_transition(df, ids.limit(0), "resolved", now())
    assert nothing.where("status = 'resolved'").count() == 0


def test_replay(spark, lookups):
    df = letters(
        spark,
        {"original_message": json.dumps(CREATED)},
        {"original_message": "not json"},
        {"original_message": json.dumps(CREATED | {"integration_id": 999})},
        {"original_message": json.dumps(CREATED), "status": "resolved"},
        {"original_message": json.dumps(CREATED | {"__op": "u"})},
        {"original_message": json.dumps(CREATED)},
    )
    ids = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 77)], "dlq_id long")
    outcomes = deadletter.replay(df, ids, *lookups, now())
    started = deadletter.replay_requests(outcomes).collect()
    assert [(r["integration_id"], r["dag_run_id"][-4:]) for r in started] == [(123, "_0_1")]
    assert json.loads(started[0]["conf"])["tenant_id"] == started[0]["workspace_id"]
    got = {r["dlq_id"]: r["outcome"] for r in outcomes.collect()}
    assert got == {1: "resolved", 2: "failed", 3: "failed", 4: "already_resolved", 5: "resolved", 77: "not_found"}
    after = {r["dlq_id"]: r for r in deadletter.apply_replay(df, outcomes, now()).collect()}
    assert (after[1]["status"], after[1]["retry_count"]) == ("resolved", 3)
    assert (after[2]["status"], after[2]["retry_count"], after[2]["error_message"]) == ("pending", 4, "malformed json")
    assert after[3]["error_type"] == "LookupError"
    assert after[6]["updated_at"] == dt.datetime(2024, 1, 1) and len(after) == 6


def test_expiry(spark):
    df = letters(
        spark,
        {"status": "resolved", "resolved_at": dt.datetime(2024, 1, 1)},
        {"status": "resolved", "resolved_at": dt.datetime(2024, 1, 20)},
        {"created_at": dt.datetime(2023, 10, 1)},
        {"created_at": dt.datetime(2023, 12, 1), "status": "retrying"},
    )
    got = deadletter.expire(df, now()).orderBy("dlq_id").collect()
    assert [r["status"] for r in got] == ["expired", "resolved", "expired", "retrying"]


def test_rates(spark):
    rows = [{"created_at": dt.datetime(2024, 1, 1, 0, 0, s)} for s in range(11)]
    hot = deadletter.rates(letters(spark, *rows, {"created_at": dt.datetime(2024, 1, 2)})).collect()
    assert len(hot) == 5 and {r["n"] for r in hot} == {11}


def test_health(spark):
    df = spark.createDataFrame(
        [(True, None, None), (True, "e", None), (True, "e", dt.datetime(2024, 1, 1)), (False, None, None)],
        "running boolean, last_error string, last_message_time timestamp_ntz",
    )
    assert [r["status"] for r in changes.health(df).collect()] == ["healthy", "healthy", "degraded", "unhealthy"]


RUN = "run_id long, dag_run_id string, started timestamp_ntz, ended timestamp_ntz, is_success boolean"
ERR = "run_id long, task_id string, error_code string, message string, seq int"
STATE = "run_id long, task_id string, state string"


def close(spark, states, pushed):
    all_runs = spark.createDataFrame([(i, f"r{i}", None, None, False) for i in (1, 2)], RUN)
    errors = runs.run_errors(
        spark.createDataFrame(states, STATE), spark.createDataFrame(pushed, ERR), now()
    )
    closed = {r["run_id"]: r for r in runs.close_runs(all_runs, errors, now()).collect()}
    return closed, sorted((r["task_id"], r["error_code"]) for r in errors.where("run_id = 1").collect())


@pytest.mark.parametrize(
    "states,pushed,expected,success",
    [
        (["success", "failed", "upstream_failed"], [("validate", "VALIDATION_ERROR")],
         [("execute", "TASK_UPSTREAM_FAILED"), ("validate", "VALIDATION_ERROR")], False),
        (["failed", "success", "success"], [], [("prepare", "TASK_FAILED")], False),
        (["success"] * 3, [("execute", "DATA_ERROR")], [("execute", "DATA_ERROR")], False),
        (["success"] * 3, [], [], True),
    ],
)
def test_closing_runs(spark, states, pushed, expected, success):
    rows = [(1, t, s) for t, s in zip(schemas.RUN_TASKS, states)] + [(1, "cleanup", "failed")]
    closed, errors = close(spark, rows, [(1, t, c, "m", 1) for t, c in pushed])
    assert errors == expected and closed[1]["is_success"] is success
    assert closed[2]["is_success"] is True and closed[2]["ended"] is not None


def test_error_caps(spark):
    pushed = [(1, "execute", "C" * 150, f"{i:02d}" + "x" * 3000, i) for i in range(25)]
    rows = runs.first_errors(spark.createDataFrame(pushed + [(1, "prepare", None, None, 1)], ERR)).collect()
    execute = [r for r in rows if r["task_id"] == "execute"]
    assert len(execute) == 20 and max(r["message"][:2] for r in execute) == "19"
    assert {(len(r["error_code"]), len(r["message"])) for r in execute} == {(100, 2000)}
    assert [(r["error_code"], r["message"]) for r in rows if r["task_id"] == "prepare"] == [("UNKNOWN", "")]


def test_opened_runs_number_a_hot_integration(spark):
    requests = spark.createDataFrame(
        [(7 if i % 3 else i, f"run-{i}") for i in range(1000)] + [(None, "none")],
        "integration_id long, dag_run_id string",
    )
    opened = runs.open_runs(requests, now(), first_id=101)
    ids = sorted(r["run_id"] for r in opened.collect())
    assert ids == list(range(101, 1101))


def test_prepare_errors(spark):
    df = spark.createDataFrame(
        [(1, '{"s3_bucket":"b","mongo_collection":"c"}'), (2, '{"mongo_collection":"c"}'), (3, '{"s3_bucket":"b"}'), (4, "{}")],
        "run_id long, conf string",
    )
    got = {r["run_id"]: r["message"] for r in runs.prepare_errors(df).collect()}
    assert got == {
        2: "Prepare failed: s3_bucket is required in configuration",
        3: "Prepare failed: mongo_collection is required in configuration",
        4: "Prepare failed: s3_bucket is required in configuration",
    }


def test_run_and_task_events(spark):
    conf = json.dumps({"customer_guid": "cust-1", "integration_id": 5, "tenant_id": "ws-1", "traceparent": "00-abc"})
    dag = [("s3_to_mongo_ondemand", "r1", s, conf, "boom") for s in ("running", "success", "failed", "queued")]
    dag.append(("controller", "r2", "failed", conf, None))
    schema = "dag_id string, dag_run_id string, state string, conf string, message string"
    got = runs.run_events(spark.createDataFrame(dag, schema), now()).collect()
    assert sorted(r["event_type"] for r in got) == [
        "integration.run.completed", "integration.run.failed", "integration.run.started",
    ]
    assert {r["trace_id"] for r in got} == {"abc"} and len({r["event_id"] for r in got}) == 3
    tasks = [("d_ondemand", "r", t, s, conf, "e" * 900) for t, s in
             (("prepare", "success"), ("validate", "success"), ("execute", "failed"), ("find_due_integrations", "success"))]
    tasks.append(("d_ondemand", "r", "cleanup", "success", None, None))
    got = runs.task_events(spark.createDataFrame(tasks, "dag_id string, dag_run_id string, task_id string, state string, conf string, message string"), now()).collect()
    by = {r["event_type"]: r for r in got}
    assert sorted(by) == ["auth.accessed", "auth.cleared", "integration.dispatched", "task.execute.failed"]
    assert len(json.loads(by["task.execute.failed"]["metadata_json"])["error"]) == 500
    assert by["auth.cleared"]["customer_guid"] == "unknown"
    assert by["integration.dispatched"]["resource_id"] == "d_ondemand"


def event(i, **values):
    row = dict.fromkeys(schemas.AUDIT_EVENT.names) | {
        "event_id": f"e{i:03d}", "customer_guid": "cust-1", "timestamp": dt.datetime(2024, 1, 1, 0, i),
        "event_type": "integration.created", "actor_id": "bob", "outcome": "success",
    } | values
    return tuple(row[n] for n in schemas.AUDIT_EVENT.names)


def store(spark, *rows):
    return audit.accepted(audit.clean(spark.createDataFrame(list(rows), schemas.AUDIT_EVENT), now()))


def test_pages_cover_everything_once(spark):
    df = store(spark, *[event(i) for i in range(23)], *[event(i, customer_guid="cust-2") for i in range(5)])
    seen, cursor = [], None
    while True:
        rows, cursor, more = audit.read_page(df, audit.store_filter("cust-1"), cursor, 10)
        seen += [r["event_id"] for r in rows]
        assert "customer_guid" not in rows[0] and list(rows[0]) == schemas.AUDIT_PAGE_COLUMNS
        if not more:
            break
    assert seen == [f"e{i:03d}" for i in range(23)] and cursor is None
    exact, cursor, more = audit.read_page(df, audit.store_filter("cust-2"), None, 5)
    assert len(exact) == 5 and cursor is None and not more
    late = audit.store_filter("cust-1", from_ts=dt.datetime(2024, 1, 1, 0, 5), to_ts=dt.datetime(2024, 1, 1, 0, 7))
    assert len(audit.read_page(df, late)[0]) == 3
    with pytest.raises(ValueError):
        audit.page(df, late, limit=501)


def test_clean_fills_missing_fields(spark):
    row = store(spark, event(1, timestamp=None, actor_id=None, before_state='{"token":"x"}')).first()
    assert row["timestamp"] == dt.datetime(2024, 2, 1) and row["actor_id"] == "" and row["event_month"] == "2024-02"
    assert row["before_state"] == '{"token":"[REDACTED]"}'


def test_lifecycle(spark):
    df = store(
        spark, event(1), event(2, event_type="auth.updated"), event(3, event_type="integration.deleted"),
        event(4, timestamp=dt.datetime(2025, 12, 1)),
    )
    later = instant("2026-02-01 00:00:00")
    actors = [r["actor_id"] for r in audit.pseudonymise(df, later).orderBy("event_id").collect()]
    assert len(actors[0]) == 64 and actors[1:] == ["bob"] * 3
    assert [r["tier"] for r in audit.with_tier(df, later).orderBy("event_id").collect()] == ["expired"] * 3 + ["hot"]
    keep = spark.createDataFrame([("cust-1", 100)], "customer_guid string, keep_days int")
    assert audit.with_retention(df, keep, later).count() == 1
    assert audit.with_retention(df, keep.limit(0), later, 10_000).count() == 4


def test_rejected_messages_keep_their_whole_text(spark):
    long = '{"password":"x","note":"' + "y" * 3000
    records = spark.createDataFrame([(long,), ('{"customer_guid":"c","event_id":"1"}',)], "value string")
    cleaned = audit.clean(audit.from_topic(records), now())
    raw = audit.rejected(cleaned).first()["raw"]
    assert raw.endswith("y" * 3000) and len(raw) > 3000
    assert "raw" not in audit.accepted(cleaned).columns and audit.accepted(cleaned).count() == 1
