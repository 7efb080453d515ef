"""Topics: readers for the change stream and the audit stream, and a writer for alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane import schemas


def broker_topic(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    """A topic from its earliest offset, as the record columns all jobs expect."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("includeHeaders", True)
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        "partition",
        "offset",
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "headers",
    )


def file_topic(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same records from parquet files that keep arriving in a folder."""
    return (
        spark.readStream.schema(schemas.TOPIC_RECORD)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def without_tombstones(records: DataFrame) -> DataFrame:
    return records.where(F.col("value").isNotNull())


def sender(servers: str, topic: str, **options: str) -> Callable[[DataFrame], None]:
    """Writes rows of key and value to a topic, acknowledged by all its replicas."""

    def send(messages: DataFrame) -> None:
        (
            messages.select("key", "value").write.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("kafka.acks", "all").options(**options).save()
        )

    return send
