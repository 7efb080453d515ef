"""Streams with a file source, stopped and started again in the middle."""

from __future__ import annotations

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from harborlane import schemas
from harborlane.functions.times import instant
from harborlane.operators import audit
from harborlane.sinks import erasure, segments, storage
from harborlane.sources import topics
from harborlane.streaming import jobs
from tests.test_operations import CREATED, event
from tests.test_schedules import integration, table


def put(spark, path, *values, first=0):
    rows = [
        (None, v if v is None or isinstance(v, str) else json.dumps(v), "t", 0, first + i, dt.datetime(2024, 1, 1), None)
        for i, v in enumerate(values)
    ]
    spark.createDataFrame(rows, schemas.TOPIC_RECORD).coalesce(1).write.mode("append").parquet(path)


def lookups(spark):
    return jobs.Lookups(
        table(spark, integration(123, json_data='{"s3_bucket":"b"}')),
        spark.createDataFrame([("ws-1", "cust-1")], schemas.WORKSPACES),
        spark.createDataFrame([], schemas.AUTHS),
    )


def run_changes(spark, work, **options):
    query = jobs.change_job(
        topics.file_topic(spark, f"{work}/in"), lambda: lookups(spark), f"{work}/out",
        f"{work}/checkpoint", instant("2024-02-01 00:00:00"), **options,
    )
    query.awaitTermination()
    return query


def test_change_job_over_a_restart(spark, work):
    other = CREATED | {"__source_ts_ms": 5}
    put(spark, f"{work}/in", CREATED, CREATED, None, "{bad", {"x": 1})
    first = run_changes(spark, work)
    assert jobs.counters(first) == {"read": 5, "deduplicated": 1}
    # The same message again after the restart is dropped; a new one and a miss go through.
    put(spark, f"{work}/in", CREATED, other, CREATED | {"integration_id": 9}, first=100)
    run_changes(spark, work)
    requests = spark.read.parquet(f"{work}/out/requests")
    assert [r["dedup_key"] for r in requests.orderBy("batch_id").collect()] == [
        "dedup:kafka:t:123:1711234567890:c", "dedup:kafka:t:123:5:c",
    ]
    letters = spark.read.parquet(f"{work}/out/dead_letters")
    assert sorted(r["error_message"] for r in letters.collect()) == [
        "integration not found", "malformed json", "unknown message format",
    ]
    assert spark.read.parquet(f"{work}/out/alerts").count() == 3
    assert spark.read.parquet(f"{work}/out/audit").count() == 2
    health = jobs.health(spark, f"{work}/out", running=True).first()
    assert (health["messages"], health["failed"], health["status"]) == (5, 3, "degraded")
    assert health["last_message_time"] == dt.datetime(2024, 1, 1)
    assert jobs.health(spark, f"{work}/none", running=True).first()["status"] == "healthy"


def test_a_batch_written_twice_counts_once(spark, work):
    put(spark, f"{work}/in", CREATED)
    run_changes(spark, work)
    # Without the commit of the last batch, the restart runs it again.
    from harborlane.sinks import storage

    for name in storage.names(spark, f"{work}/checkpoint/commits"):
        storage.delete(spark, f"{work}/checkpoint/commits/{name}")
    run_changes(spark, work)
    assert spark.read.parquet(f"{work}/out/requests").count() == 1


def test_a_failing_alert_does_not_stop_the_batch(spark, work):
    seen = []

    def notify(alerts):
        seen.extend(r["key"] for r in alerts.collect())
        raise OSError("broker is down")

    put(spark, f"{work}/in", CREATED | {"integration_id": 9}, "{bad")
    run_changes(spark, work, notify=notify)
    assert sorted(seen) == ["9", "unknown"]
    assert spark.read.parquet(f"{work}/out/dead_letters").count() == 2


def test_alerts_are_sent_once_and_later_if_they_failed(spark, work):
    sent, down = [], [True]

    def notify(alerts):
        if down[0]:
            raise OSError("broker is down")
        sent.extend(r["key"] for r in alerts.collect())

    put(spark, f"{work}/in", CREATED | {"integration_id": 9})
    run_changes(spark, work, notify=notify)
    assert sent == [] and storage.names(spark, f"{work}/out/alerts_waiting")
    down[0] = False
    put(spark, f"{work}/in", CREATED | {"integration_id": 8, "__source_ts_ms": 2}, first=10)
    run_changes(spark, work, notify=notify)
    assert sorted(sent) == ["8", "9"]
    # The last batch once more, as after a restart before its commit.
    for name in storage.names(spark, f"{work}/checkpoint/commits"):
        storage.delete(spark, f"{work}/checkpoint/commits/{name}")
    run_changes(spark, work, notify=notify)
    assert sorted(sent) == ["8", "9"]


def test_erasure_and_retention_of_the_outputs(spark, work):
    other = CREATED | {"integration_id": 124, "workspace_id": "ws-2", "__source_ts_ms": 7}
    put(spark, f"{work}/in", CREATED, other, "{bad")
    two = jobs.Lookups(
        table(spark, integration(123, json_data='{"s3_bucket":"b"}'), integration(124, workspace_id="ws-2")),
        spark.createDataFrame([("ws-1", "cust-1"), ("ws-2", "cust-2")], schemas.WORKSPACES),
        spark.createDataFrame([], schemas.AUTHS),
    )
    run = lambda: jobs.change_job(
        topics.file_topic(spark, f"{work}/in"), lambda: two, f"{work}/out", f"{work}/checkpoint",
        instant("2024-02-01 00:00:00"),
    ).awaitTermination()
    run()
    put(spark, f"{work}/in", other | {"__source_ts_ms": 8}, first=50)
    put(spark, f"{work}/in", CREATED | {"__op": "x", "workspace_id": "ws-1", "integration_id": None}, first=70)
    run()
    assert not any(n.startswith("batch_id") for n in storage.names(spark, f"{work}/out/resolved"))
    done = erasure.erase_outputs(spark, f"{work}/out", "cust-1", two.workspaces, two.integrations)
    assert done["requests"] >= 1
    text = ""
    for name in erasure.OUTPUTS:
        rows = spark.read.parquet(f"{work}/out/{name}").collect()
        text += "".join(map(str, rows))
        assert rows or name in ("alerts",)
    for trace in ("cust-1", "ws-1", "123"):
        assert trace not in text.replace("17112345", "").replace("1711234567890", ""), trace
    assert "ws-2" in text and "{bad" in text
    again = erasure.erase_outputs(spark, f"{work}/out", "cust-1", two.workspaces, two.integrations)
    assert set(again.values()) == {0}
    with pytest.raises(ValueError):
        erasure.erase_outputs(spark, f"{work}/out", "../x", two.workspaces, two.integrations)
    early = erasure.drop_old_batches(spark, f"{work}/out", dt.datetime(2024, 1, 9))
    assert early["events"] and early["audit"] and not early["dead_letters"]
    late = erasure.drop_old_batches(spark, f"{work}/out", dt.datetime(2024, 3, 1))
    assert late["dead_letters"] and not late["events"]
    assert jobs.health(spark, f"{work}/out", running=False).first()["messages"] >= 4


def test_the_clock_is_asked_once_a_batch(spark, work):
    hours = iter(range(1, 10))

    def now():
        return instant(dt.datetime(2024, 2, 1, next(hours)))

    put(spark, f"{work}/in", CREATED)
    query = lambda: jobs.change_job(
        topics.file_topic(spark, f"{work}/in"), lambda: lookups(spark), f"{work}/out", f"{work}/checkpoint", now
    ).awaitTermination()
    query()
    put(spark, f"{work}/in", CREATED | {"__source_ts_ms": 6}, first=10)
    query()
    ids = sorted(r["dag_run_id"] for r in spark.read.parquet(f"{work}/out/requests").collect())
    assert "20240201_010000" in ids[0] and "20240201_020000" in ids[1]


def test_handler_sees_the_batch(spark, work):
    put(spark, f"{work}/in", CREATED, {"__op": "u", "integration_id": 1, "__source_ts_ms": 1})
    run_changes(spark, work, handler=lambda batch: batch.where(F.col("route") != "trigger"))
    assert spark.read.schema("dedup_key string").parquet(f"{work}/out/requests").count() == 0
    assert spark.read.parquet(f"{work}/out/events").count() == 1


def test_audit_job_stores_each_event_once(spark, work):
    def deliver(*rows):
        frame = spark.createDataFrame(list(rows), schemas.AUDIT_EVENT)
        frame.coalesce(1).write.mode("append").parquet(f"{work}/in")

    def run():
        stream = spark.readStream.schema(schemas.AUDIT_EVENT).parquet(f"{work}/in")
        jobs.audit_job(
            stream, f"{work}/store", f"{work}/rejects", f"{work}/checkpoint", instant("2024-02-01 00:00:00")
        ).awaitTermination()
        return jobs.audit_store(spark, f"{work}/store").read()

    # A first batch without a single usable event must not break the next one.
    deliver(event(0, customer_guid="unknown"))
    assert run().count() == 0
    deliver(event(1, before_state='{"password":"x"}'), event(1, before_state='{"password":"x"}'), event(2), event(2, customer_guid="cust-2"))
    assert run().count() == 3
    deliver(event(2), event(3), event(4, customer_guid="no good"))
    stored = run()
    assert stored.count() == 4
    assert stored.where("event_id = 'e001'").first()["before_state"] == '{"password":"[REDACTED]"}'
    rejects = spark.read.parquet(f"{work}/rejects")
    assert sorted(r["reject_reason"] for r in rejects.collect()) == ["invalid tenant", "missing tenant"]


def audit_stream(spark, work, checkpoint="checkpoint", **options):
    stream = spark.readStream.schema(schemas.AUDIT_EVENT).parquet(f"{work}/in")
    jobs.audit_job(
        stream, f"{work}/store", f"{work}/rejects", f"{work}/{checkpoint}", instant("2024-02-01 00:00:00"),
        **options,
    ).awaitTermination()
    return jobs.audit_store(spark, f"{work}/store")


def deliver(spark, work, *rows):
    frame = spark.createDataFrame(list(rows), schemas.AUDIT_EVENT)
    frame.coalesce(1).write.mode("append").parquet(f"{work}/in")


def reads_of(monkeypatch):
    """The segments a job has read to look events up, call by call."""
    seen, read = [], segments.SegmentedStore.read

    def noted(self, without=None, **values):
        seen.append([n for n in self.segments() if n != without])
        return read(self, without, **values)

    monkeypatch.setattr(segments.SegmentedStore, "read", noted)
    return seen


def test_batches_of_a_day_do_not_read_the_store(spark, work, monkeypatch):
    """Restarts, and repeats within a day: state alone tells them, however much is stored."""
    seen = reads_of(monkeypatch)
    for i in range(5):
        deliver(spark, work, *[event(10 * i + k) for k in range(6)], event(0))
        store = audit_stream(spark, work)
    assert seen == []
    stored = store.read()
    assert stored.count() == 30 == stored.select("event_id").distinct().count()


def test_a_late_replay_by_a_new_checkpoint_stores_nothing_twice(spark, work, monkeypatch):
    for i in range(3):
        deliver(spark, work, event(i), event(10 + i, customer_guid="cust-2"))
        store = audit_stream(spark, work)
    seen = reads_of(monkeypatch)
    deliver(spark, work, event(57))
    store = audit_stream(spark, work, "other")  # reads the whole folder again
    assert len(seen) == 1
    assert sorted(r["event_id"] for r in store.read().collect()) == sorted(
        [f"e{i:03}" for i in (0, 1, 2, 10, 11, 12, 57)]
    )


def test_a_replay_is_looked_up_by_keys_before_it_is_cleaned(spark, work, monkeypatch):
    deliver(spark, work, event(1), event(2), event(2, customer_guid="cust-2"))
    audit_stream(spark, work)
    seen, not_stored = [], audit.not_stored

    def noted(batch, store, folders=None):
        seen.append(batch.columns)
        found = not_stored(batch, store, folders)
        # The folders' size is known, so the stored keys are not shuffled by folder, a task each.
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [customer_guid" in plan and "hashpartitioning(customer_guid#" in plan, plan
        assert not re.search(r"hashpartitioning\(customer_guid#\d+, event_month#\d+, \d+\), ENSURE", plan.split("InMemoryRelation")[0]), plan
        return found

    monkeypatch.setattr(audit, "not_stored", noted)
    secret = {"before_state": '{"password":"x"}'}
    deliver(spark, work, event(1), event(3, **secret), event(1, customer_guid="cust-2", **secret), event(4, customer_guid=""))
    store = audit_stream(spark, work, "other")
    assert seen == [["customer_guid", "event_month", "event_id"]]
    rows = {(r["customer_guid"], r["event_id"]): r["before_state"] for r in store.read().collect()}
    assert store.read().count() == len(rows) == 5
    assert rows["cust-1", "e003"] == rows["cust-2", "e001"] == '{"password":"[REDACTED]"}'
    assert spark.read.parquet(f"{work}/rejects").count() == 1
    audit_stream(spark, work, "third")  # a replay with nothing new
    assert store.read().count() == 5
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows") == "false"


def test_a_replay_after_a_day_is_looked_up(spark, work, monkeypatch):
    deliver(spark, work, event(1), event(2))
    audit_stream(spark, work)
    monkeypatch.setattr(jobs, "DEDUP_HOURS", -1)  # as if the day were over
    seen = reads_of(monkeypatch)
    deliver(spark, work, event(3))
    store = audit_stream(spark, work)
    assert len(seen) == 1 and store.read().count() == 3


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_what_may_be_stored_already(spark, zone):
    arrived = dt.datetime(2024, 7, 2, 12, tzinfo=dt.timezone.utc)
    began = int(arrived.timestamp())
    hours = [1, 0, -0.5, -2, -22, -24, -2000]
    rows = [(dt.datetime(2024, 7, 2, 12) + dt.timedelta(hours=h), arrived) for h in hours]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame(rows, "at timestamp_ntz, arrived timestamp")
        test = lambda start, filled: [r[0] for r in frame.select(
            jobs.may_be_stored(F.col("at"), F.col("arrived"), start, filled)).collect()]
        # A new checkpoint over an empty store; over one with rows; one that has run for long.
        assert test(began, False) == [False] * 7
        assert test(began, True) == [False] + [True] * 6
        assert test(began - 100 * 3600, False) == [False] * 5 + [True] * 2
        assert test(began - 100 * 3600, True) == [False] * 5 + [True] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_a_repeated_batch_replaces_its_segment(spark, work):
    deliver(spark, work, event(1), event(2))
    audit_stream(spark, work)
    deliver(spark, work, event(2), event(3))
    store = audit_stream(spark, work)
    names = store.segments()
    # Without the commit of the last batch with rows, the restart runs it again.
    last = max(int(name.rsplit("-", 1)[1]) for name in names)
    for log, first in (("commits", last), ("offsets", last + 1)):
        for name in storage.names(spark, f"{work}/checkpoint/{log}"):
            number = name.lstrip(".").removesuffix(".crc")
            if number.isdigit() and int(number) >= first:
                storage.delete(spark, f"{work}/checkpoint/{log}/{name}")
    store = audit_stream(spark, work)
    assert store.read().count() == 3 and set(names) <= set(store.segments())


def test_segments_are_merged_by_levels(spark, work):
    for i in range(7):
        deliver(spark, work, event(i), event(i, customer_guid="cust-2"))
        store = audit_stream(spark, work, fanout=2)
    store.merge(fanout=2)
    names = store.segments()
    assert len(names) <= 4 and any(n.startswith("m2-") for n in names)
    assert store.read().count() == 14 and store.read(customer_guid="cust-2").count() == 7
    # The erased tenant is in no file, listed or not, and the next batches go on.
    store.erase(customer_guid="cust-2")
    left = spark.read.parquet(f"{work}/store/data")
    assert left.where("customer_guid = 'cust-2'").count() == 0
    assert store.read().count() == 7
    for bad in ("../..", "", "a/b", "*", None):
        with pytest.raises(ValueError):
            store.erase(customer_guid=bad)
    deliver(spark, work, event(58), event(3))
    assert audit_stream(spark, work, fanout=2).read().count() == 8


def test_a_merge_overtaken_by_an_erasure_has_no_effect(spark, work, monkeypatch):
    store = jobs.audit_store(spark, f"{work}/store")
    rows = spark.createDataFrame([event(1), event(2, customer_guid="cust-2")], schemas.AUDIT_EVENT)
    for i in range(2):
        store.write(rows.withColumn("event_month", F.lit("2024-01")), f"b-{i}")
    write = store._write

    def slow(df, name):
        write(df, name)
        jobs.audit_store(spark, f"{work}/store").erase(customer_guid="cust-2")

    monkeypatch.setattr(store, "_write", slow)
    assert store.merge(fanout=2) == []
    assert [r["customer_guid"] for r in store.read().collect()] == ["cust-1"] * 2
    assert spark.read.parquet(f"{work}/store/data").where("customer_guid = 'cust-2'").count() == 0


def test_rate_job(spark, work):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=10 * i),) for i in range(12)] + [(start + dt.timedelta(hours=1),)]
    spark.createDataFrame(rows, "created_at timestamp_ntz").coalesce(1).write.parquet(f"{work}/in")
    stream = spark.readStream.schema("created_at timestamp_ntz").parquet(f"{work}/in")
    jobs.rate_job(stream, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    hot = spark.read.parquet(f"{work}/out").orderBy("window_start").collect()
    assert len(hot) == 4 and {r["n"] for r in hot} == {12}
