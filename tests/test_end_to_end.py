"""From a due schedule to a closed run, with files on disk in between."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from harborlane import schemas
from harborlane.functions.times import instant
from harborlane.operators import dispatch, landing, runs
from harborlane.sinks import documents as docs
from harborlane.sinks.versions import VersionedTable
from harborlane.sources import files
from tests.test_schedules import integration


def test_due_schedule_to_closed_run(spark, work, tmp_path):
    late = dt.datetime(2024, 1, 15, 2)
    start, end = instant("2024-01-15 03:00:00"), instant("2024-01-15 03:05:00")
    source = tmp_path / "bucket"
    for i, name in enumerate(("Alice", "Bob", "Charlie")):
        (source / "good").mkdir(parents=True, exist_ok=True)
        (source / "good" / f"{i}.json").write_text(json.dumps({"id": i, "name": name}))
    (source / "bad").mkdir()
    (source / "bad" / "0.json").write_text('{"id": 1}')
    (source / "bad" / "1.json").write_text('{"id":')

    def conf(prefix, **more):
        return json.dumps({"s3_bucket": "bucket", "s3_prefix": prefix, "mongo_collection": "people"} | more)

    integrations = VersionedTable(spark, f"{work}/integrations")
    rows = [
        integration(1, cron="0 2 * * *", utc_next_run=late, json_data=conf("good/")),
        integration(2, cron="0 2 * * *", utc_next_run=late, json_data=conf("bad/")),
        integration(3, cron="0 2 * * *", utc_next_run=late, json_data='{"s3_prefix":"x/"}'),
        integration(4, cron="0 2 * * *", utc_next_run=dt.datetime(2024, 1, 16, 2), json_data=conf("good/")),
    ]
    integrations.commit(spark.createDataFrame(rows, schemas.INTEGRATIONS))
    workspaces = spark.createDataFrame([("ws-1", "cust-1")], schemas.WORKSPACES)
    auths = spark.createDataFrame([], schemas.AUTHS)

    requests = dispatch.due_requests(integrations.read(), workspaces, auths, start)
    requests.write.parquet(f"{work}/requests")
    requests = spark.read.parquet(f"{work}/requests")
    integrations.commit(dispatch.advance_due(integrations.read(), start))
    assert dispatch.due_requests(integrations.read(), workspaces, auths, start).count() == 0

    opened = runs.open_runs(requests, start, run="trigger_run_id")
    opened.write.parquet(f"{work}/runs")
    opened = spark.read.parquet(f"{work}/runs")
    assert opened.count() == 3
    active = opened.select("run_id", "integration_id").join(requests, "integration_id")
    prepare = runs.prepare_errors(active)

    prefix = F.get_json_object("conf", "$.s3_prefix")
    folder = active.join(prepare.select("run_id"), "run_id", "left_anti").select(
        "run_id", F.rtrim(prefix, F.lit("/")).alias("folder")
    )
    read = files.whole_text(spark, str(source)).withColumn(
        "folder", F.element_at(F.split("path", "/"), -2)
    )
    owned = read.join(folder, "folder")
    parsed = landing.parse_objects(landing.objects_from(owned, F.col("run_id")))
    assert docs.append(landing.documents(parsed, start), f"{work}/people") == 4

    pushed = prepare.withColumn("seq", F.col("seq").cast("string")).unionByName(landing.data_errors(parsed))
    failed = prepare.select("run_id")
    states = opened.select("run_id", F.explode(F.array(*[F.lit(t) for t in schemas.RUN_TASKS])).alias("task_id")).join(
        failed.withColumn("failed", F.lit(True)), "run_id", "left"
    ).select(
        "run_id", "task_id",
        F.when(F.col("failed") & (F.col("task_id") == "prepare"), "failed")
        .when(F.col("failed"), "upstream_failed").otherwise("success").alias("state"),
    )
    errors = runs.run_errors(states, pushed, end)
    closed = {r["integration_id"]: r for r in runs.close_runs(opened, errors, end).collect()}
    assert {i: r["is_success"] for i, r in closed.items()} == {1: True, 2: False, 3: False}
    assert {i: r["error_count"] for i, r in closed.items()} == {1: 0, 2: 1, 3: 3}
    names = spark.read.parquet(f"{work}/people").select(F.variant_get("document", "$.name", "string").alias("n"), "run_id")
    assert {r["n"] for r in names.collect()} == {"Alice", "Bob", "Charlie", None}
