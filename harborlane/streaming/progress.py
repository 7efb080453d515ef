"""Counters of streams from every progress they report, not only from those Spark keeps.

A listener notes each batch's progress in a small file of its own, which a repeated batch does not
write again; the totals are read from the files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from harborlane.sinks import storage

NOTED = "query string, batch bigint, read bigint, deduplicated bigint, late bigint"


class ProgressLog(StreamingQueryListener):
    """Notes the progress of all queries of a session below ``folder``.

    Add it with ``spark.streams.addListener`` before the queries start.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        states = progress.stateOperators
        note = {
            "query": str(progress.id),
            "batch": progress.batchId,
            "read": progress.numInputRows,
            "deduplicated": sum(int(s.customMetrics.get("numDroppedDuplicateRows", 0)) for s in states),
            "late": sum(s.numRowsDroppedByWatermark for s in states),
        }
        try:
            storage.create_new(
                self.spark, f"{self.folder}/{note['query']}-{note['batch']:012d}.json", json.dumps(note)
            )
        except storage.Taken:  # the batch ran again
            pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def totals(spark: SparkSession, folder: str) -> DataFrame:
    """(query, batches, read, deduplicated, late) over all batches noted."""
    if not storage.exists(spark, folder):
        return spark.createDataFrame([], NOTED.replace("batch ", "batches "))
    return (
        spark.read.schema(NOTED).json(folder)
        .groupBy("query")
        .agg(
            F.count(F.lit(1)).alias("batches"),
            *[F.sum(name).alias(name) for name in ("read", "deduplicated", "late")],
        )
    )
