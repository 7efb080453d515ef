"""Structured Streaming jobs over the batch transforms.

Offsets and state are checkpointed, and every write of a micro-batch can be repeated: batch
outputs replace their own folder or segment. So a restart neither loses nor repeats a message, and no
claim or lease is needed while one is worked on. Infrastructure errors fail the batch and Spark runs it
again; data errors are rows.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from harborlane import schemas, session
from harborlane.functions.times import instant, seconds_between
from harborlane.operators import audit, changes, deadletter
from harborlane.sinks import segments, storage
from harborlane.sinks.partitions import AUDIT_PARTITIONS

logger = logging.getLogger(__name__)

#: A key is kept for the delay of the watermark and the watermark's own lag, a day in all.
DEDUP_WINDOW = "12 hours"
DEDUP_HOURS = 24
#: An event's own time may be so far ahead of the clock that it arrives by.
CLOCK_SKEW_HOURS = 1
RATE_DELAY = "10 minutes"


@dataclass
class Lookups:
    """The tables a change event is resolved against."""

    integrations: DataFrame
    workspaces: DataFrame
    auths: DataFrame


def deduplicate(events: DataFrame, within: str = DEDUP_WINDOW) -> DataFrame:
    """Drop repeats of a key for a day after it was first handled.

    The clock is the arrival of the batch, as the time to live of a handled key is. So no message
    is ever late and dropped for that, and keys leave the state a day after they arrived.
    """
    return (
        events.withColumn("_arrived", F.current_timestamp())
        .withWatermark("_arrived", within)
        .dropDuplicatesWithinWatermark(["dedup_key"])
        .drop("_arrived")
    )


def clock(now: Column | Callable[[], Column]) -> Column:
    """The time of a batch: fixed, or asked for at each batch in a stream that runs for long."""
    return now() if callable(now) else now


def start(writer: DataStreamWriter, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def change_job(
    records: DataFrame,
    lookups: Callable[[], Lookups],
    out: str,
    checkpoint: str,
    now: Column | Callable[[], Column],
    consumer_group: str = "cdc-consumer",
    handler: Callable[[DataFrame], DataFrame] | None = None,
    notify: Callable[[DataFrame], None] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """The change stream to requests, dead letters, audit events and counters.

    ``lookups`` is called for each batch, so a batch sees the tables as they are then. A handler
    gets the classified events of a batch and returns the ones to go on with. ``notify`` gets the
    dead letters as key and JSON value, for an alert topic (``topics.sender``); the table is written
    before, and a failing alert is logged, does not hold up the batch, and is sent with a later one. A
    batch that is run again sends nothing a second time. ``now`` may be a function, which is asked once
    a batch.

    ``tenants`` of each batch are written too, so what a tenant left is found without reading the rest
    (``sinks.erasure``).
    """
    session.use_rocksdb(records.sparkSession)
    events = deduplicate(changes.parse(records))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def write(name: str, frame: DataFrame) -> str:
            path = f"{out}/{name}/batch_id={batch_id}"
            frame.write.mode("overwrite").parquet(path)
            return path

        # Everything else is made from the written events, so the state is read once per batch and
        # all outputs agree on the delivery that was kept, also when executors are lost.
        chosen = handler(batch) if handler else batch
        wanted = spark.read.schema(chosen.schema).parquet(write("events", chosen))
        if wanted.isEmpty():  # as in the batch that only moves the watermark on
            return
        tables, time = lookups(), clock(now)
        stored, workspaces, auths = changes.narrow(
            wanted, tables.integrations, tables.workspaces, tables.auths
        )
        # Written once and read back: the tables may change while the outputs are written, and a lost
        # executor must not have some of them made from other rows.
        fresh = changes.resolve(wanted, stored, workspaces, auths, time)
        at = write("resolved", fresh)
        stored.unpersist()
        resolved = spark.read.schema(fresh.schema).parquet(at)
        requests = changes.requests(resolved)
        rejected = changes.rejects(wanted, resolved)
        letters = changes.dead_letters(rejected, consumer_group, time)
        write("requests", requests)
        write("audit", changes.trigger_audit(requests, time))
        write("dead_letters", letters)
        write("alerts", changes.alert_messages(letters))
        write("counters", changes.route_counts(wanted))
        write("metrics", changes.metrics(wanted, rejected))
        write("tenants", changes.tenants(wanted, resolved))
        storage.delete(spark, at)  # it holds credentials, and the outputs are there
        if notify:
            deliver(spark, out, batch_id, notify)

    return start(events.writeStream.foreachBatch(handle), checkpoint, available_now)


def deliver(
    spark: SparkSession, out: str, batch_id: int, notify: Callable[[DataFrame], None]
) -> list[int]:
    """Send the alerts of a batch, and of earlier ones that could not be sent; the batches sent now.

    A batch is marked as sent right after, and as waiting if sending fails. Only a process that dies
    between sending and marking sends again.
    """
    waiting = [int(n) for n in storage.names(spark, f"{out}/alerts_waiting") if n.isdigit()]
    sent = []
    for number in sorted({*waiting, batch_id}):
        if storage.exists(spark, f"{out}/alerts_sent/{number}"):
            continue
        try:
            notify(spark.read.schema("key string, value string").parquet(f"{out}/alerts/batch_id={number}"))
        except Exception:
            logger.exception("alerts of batch %s were not delivered", number)
            if number not in waiting:
                storage.create_new(spark, f"{out}/alerts_waiting/{number}")
            continue
        storage.create_new(spark, f"{out}/alerts_sent/{number}")
        storage.delete(spark, f"{out}/alerts_waiting/{number}")
        sent.append(number)
    return sent


AUDIT_STORE = T.StructType([*schemas.AUDIT_EVENT.fields, T.StructField("event_month", T.StringType())])


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """Audit events in folders of their tenant and month; the schema is given, so nothing is inferred."""
    return spark.read.schema(AUDIT_STORE).parquet(store)


def audit_store(spark: SparkSession, root: str) -> segments.SegmentedStore:
    """The store the audit job writes: a segment a batch, merged as they come to be many."""
    return segments.SegmentedStore(spark, root, AUDIT_STORE, AUDIT_PARTITIONS)


def _since(spark: SparkSession, path: str, filled: Callable[[], bool]) -> tuple[int, bool]:
    """When a reader with state of its own began, in seconds, and whether the store had rows then;
    noted once in a file."""
    if not storage.exists(spark, path):
        storage.create_new(spark, path, f"{int(time.time())} {int(filled())}")
    began, had = storage.content(spark, path).split()
    return int(began), had == "1"


def may_be_stored(at: Column, arrived: Column, began: int, filled: bool) -> Column:
    """Whether an event of the time ``at`` could have been stored by a delivery the state does not know.

    The state knows every delivery since ``began`` of the last ``DEDUP_HOURS``. An event is delivered
    after its own time, give or take the skew of clocks; so what is younger than that was not delivered
    before, and if the store was empty at first, nothing was before ``began``.
    """
    day, skew = DEDUP_HOURS * 3600, CLOCK_SKEW_HOURS * 3600
    seconds = F.unix_seconds(arrived)
    own = seconds_between(instant("1970-01-01 00:00:00"), at)
    older = F.when(seconds >= began + day, own < seconds - day + skew).otherwise(F.lit(False))
    return older | (own < began + skew) if filled else older


def audit_job(
    events: DataFrame,
    store: str,
    rejects: str,
    checkpoint: str,
    now: Column | Callable[[], Column],
    available_now: bool = True,
    fanout: int = segments.FANOUT,
) -> StreamingQuery:
    """Audit events to the store, each once; events without a usable tenant to the rejects.

    The ids of the last day are state, by tenant and id, so a batch meets earlier ones without reading
    the store. Only events that are old when they come, in a replay of old messages or in the first day
    of a new checkpoint over a store with rows, are looked up in the folders of their tenant and month.
    A batch is a segment of the store, which a repeated batch replaces; before it writes its own, it
    merges those of the batches before it where there are ``fanout``.
    """
    spark = events.sparkSession
    session.use_rocksdb(spark)
    target = audit_store(spark, store)
    arrived = events.withColumn("_arrived", F.current_timestamp())
    usable = audit.tenant_error(F.col("customer_guid")).isNull()
    # No tenant's id holds a slash, so the keys of rejected rows, one each, are no event's.
    event_key = F.concat_ws("/", "customer_guid", F.coalesce("event_id", F.lit("")))
    key = F.when(usable, event_key).otherwise(F.uuid())
    once = (
        arrived.withColumn("_key", key)
        .withWatermark("_arrived", DEDUP_WINDOW)
        .dropDuplicatesWithinWatermark(["_key"])
        .drop("_key")
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reader = json.loads(storage.content(spark, f"{checkpoint}/metadata"))["id"]
        name = f"b-{reader}-{batch_id:010d}"
        began, filled = _since(
            spark, f"{store}/_readers/{reader}", lambda: any(n != name for n in target.segments())
        )
        target.merge(fanout, open_=name)
        at = clock(now)
        batch = audit.keyed(batch, at).persist()
        held = [batch]
        try:
            if batch.isEmpty():  # as in the batch that only moves the watermark on
                return
            audit.clean(audit.rejected(batch), at).drop("_arrived").write.mode("overwrite").parquet(
                f"{rejects}/batch_id={batch_id}"
            )
            fresh = batch.where(F.col("reject_reason").isNull())
            doubtful = may_be_stored(F.col("timestamp"), F.col("_arrived"), began, filled)
            asked = fresh.where(doubtful)
            held.append(folders := audit.touched(asked).persist())
            if not folders.isEmpty():
                # By keys alone, and before they are cleaned: of a replay most are stored already.
                keys = asked.select(*audit.STORED_KEY)
                unknown = audit.not_stored(keys, target.read(without=name), folders).persist()
                held.append(unknown)
                fresh = fresh.where(~doubtful)
                if not unknown.isEmpty():
                    fresh = fresh.unionByName(audit.of_keys(asked, unknown))
            target.write(audit.accepted(audit.clean(fresh, at)), name)
        finally:
            for frame in held:
                frame.unpersist()

    return start(once.writeStream.foreachBatch(handle), checkpoint, available_now)


def rate_job(
    letters: DataFrame,
    out: str,
    checkpoint: str,
    above: int = deadletter.RATE_LIMIT,
    delay: str = RATE_DELAY,
    available_now: bool = True,
) -> StreamingQuery:
    """Sliding five-minute windows with too many dead letters, emitted once they are complete."""
    session.use_rocksdb(letters.sparkSession)
    timed = letters.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark(
        "created_at", delay
    )
    rates = deadletter.rates(timed, above=above)
    return start(
        rates.writeStream.outputMode("append").format("parquet").option("path", out),
        checkpoint,
        available_now,
    )


METRICS = (
    "messages bigint, failed bigint, last_error_time timestamp_ntz, last_error string,"
    " last_message_time timestamp_ntz"
)


def health(spark: SparkSession, out: str, running: bool) -> DataFrame:
    """Totals of a change job over all its batches, from what they wrote, and its status."""
    path = f"{out}/metrics"
    batches = (
        spark.read.schema(METRICS).parquet(path)
        if storage.exists(spark, path)
        else spark.createDataFrame([], METRICS)
    )
    return changes.health(
        changes.total_metrics(batches).withColumn("running", F.lit(running))
    )


def counters(query: StreamingQuery) -> dict[str, int]:
    """Rows read and repeats dropped by a query, summed over the progress Spark still holds."""
    read = dropped = 0
    for progress in query.recentProgress:
        read += progress.numInputRows
        for operator in progress.stateOperators:
            dropped += int(operator.customMetrics.get("numDroppedDuplicateRows", 0))
    return {"read": read, "deduplicated": dropped}
