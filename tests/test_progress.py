"""Stream counters over more batches than Spark keeps the progress of."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from harborlane.session import use_rocksdb
from harborlane.streaming import jobs, progress


def event(batch, read, dropped):
    state = SimpleNamespace(customMetrics={"numDroppedDuplicateRows": str(dropped)}, numRowsDroppedByWatermark=1)
    return SimpleNamespace(progress=SimpleNamespace(
        id="q-1", batchId=batch, numInputRows=read, stateOperators=[state]))


def test_totals_of_300_batches(spark, work):
    log = progress.ProgressLog(spark, f"{work}/progress")
    assert progress.totals(spark, f"{work}/progress").collect() == []
    for batch in range(300):
        log.onQueryProgress(event(batch, 10 + batch, 2))
    log.onQueryProgress(event(299, 309, 2))  # run again after a restart
    (total,) = progress.totals(spark, f"{work}/progress").collect()
    assert tuple(total) == ("q-1", 300, sum(range(10, 310)), 600, 300)


def test_a_stream_is_noted(spark, work):
    use_rocksdb(spark)
    log = progress.ProgressLog(spark, f"{work}/progress")
    spark.streams.addListener(log)
    try:
        for i in range(3):
            spark.range(5).select((F.col("id") % 3 + 3 * i).cast("string").alias("dedup_key")).coalesce(1).write.mode(
                "append").parquet(f"{work}/in")
            stream = spark.readStream.schema("dedup_key string").parquet(f"{work}/in")
            once = jobs.deduplicate(stream)
            jobs.start(once.writeStream.format("noop"), f"{work}/checkpoint").awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    finally:
        spark.streams.removeListener(log)
    (total,) = progress.totals(spark, f"{work}/progress").collect()
    assert (total.read, total.deduplicated) == (15, 6) and total.batches >= 3
