"""Document writes: append, upsert by key, update, delete.

A stored document is a map of its top-level fields, so a merge works field by field and a field
that holds null is told apart from a field that is missing.

``upsert``, ``update_first`` and ``delete_matching`` make a whole new store; ``upsert_into``,
``update_first_in`` and ``delete_in`` change a table in buckets and write those they touch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from harborlane import session
from harborlane.functions import conf
from harborlane.sinks.buckets import BucketedTable


def append(docs: DataFrame, path: str, max_records_per_file: int = 1_000_000) -> int:
    """Append and return how many rows were written, counted while writing."""
    seen = Observation()
    counted = docs.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("append").option("maxRecordsPerFile", max_records_per_file).parquet(path)
    return seen.get["rows"]


def keyed(docs: DataFrame, key_field: str = "_id") -> DataFrame:
    """doc_key and fields of each document (variant); the key is null where it is missing."""
    fields = F.col("document").try_cast(conf.VARIANT_MAP)
    return docs.withColumn("fields", fields).withColumn(
        "doc_key", F.try_element_at("fields", F.lit(key_field)).try_cast("string")
    )


def keyless(docs: DataFrame, key_field: str = "_id") -> DataFrame:
    """Documents that an upsert has to reject."""
    return keyed(docs, key_field).where(F.col("doc_key").isNull()).select(*docs.columns)


def fold(incoming: DataFrame) -> DataFrame:
    """One set of fields per key from (doc_key, fields, seq): later documents win field by field.

    The fold is an aggregate per key and field, so a key with very many documents is reduced
    before the shuffle.
    """
    entries = incoming.where(F.col("doc_key").isNotNull()).select(
        "doc_key", "seq", F.explode("fields").alias("k", "v")
    )
    latest = entries.groupBy("doc_key", "k").agg(F.max_by("v", "seq").alias("v"))
    return latest.groupBy("doc_key").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("fields")
    )


def upsert(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after merging ``incoming`` (doc_key, fields, seq) into it.

    ``change`` tells inserted from updated from untouched rows.
    """
    return merged(stored, fold(incoming))


def merged(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """The same for documents that are folded already, one a key."""
    new = folded.select("doc_key", F.col("fields").alias("_new"))
    joined = stored.select("doc_key", "fields").join(new, "doc_key", "full_outer")
    change = (
        F.when(F.col("_new").isNull(), "unchanged")
        .when(F.col("fields").isNull(), "inserted")
        .otherwise("updated")
    )
    return joined.select(
        "doc_key",
        conf.merge(F.col("fields"), F.col("_new")).alias("fields"),
        change.alias("change"),
    )


def change_counts(upserted: DataFrame) -> DataFrame:
    return upserted.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def _counted(rows: DataFrame, seen: Observation | None, name: str, test: Column) -> DataFrame:
    return rows if seen is None else rows.observe(seen, F.count_if(test).alias(name))


def update_first(
    stored: DataFrame, match: Column, changes: Column, seen: Observation | None = None
) -> DataFrame:
    """Set fields on one matching document, the one with the smallest key.

    The chosen key is a single row, so broadcasting it is bounded. ``seen`` gets the number of
    ``modified`` documents when the result is written.
    """
    chosen = stored.where(match).agg(F.min("doc_key").alias("doc_key")).withColumn(
        "_hit", F.lit(True)
    )
    marked = stored.join(F.broadcast(chosen), "doc_key", "left")
    marked = _counted(marked, seen, "modified", F.coalesce("_hit", F.lit(False)))
    return marked.withColumn(
        "fields",
        F.when(F.col("_hit"), conf.merge(F.col("fields"), changes)).otherwise(F.col("fields")),
    ).drop("_hit")


def delete_matching(
    stored: DataFrame, match: Column, seen: Observation | None = None
) -> DataFrame:
    """The store without the matching rows; a test that is null matches nothing.

    ``seen`` gets the number of ``deleted`` rows when the result is written.
    """
    gone = F.coalesce(match, F.lit(False))
    return _counted(stored, seen, "deleted", gone).where(~gone)


def upsert_into(store: BucketedTable, incoming: DataFrame) -> dict[str, int]:
    """Merge ``incoming`` (doc_key, fields, seq) into a stored (doc_key, fields); the number of
    ``inserted`` and ``updated`` documents.

    The folded documents are written once: they say which buckets are touched, and are merged.
    """
    spark = incoming.sparkSession
    path = session.fresh_dir(spark, "upsert")
    folded = fold(incoming)
    folded.write.parquet(path)
    new = spark.read.schema(folded.schema).parquet(path)
    seen = Observation()

    def make(rows: DataFrame) -> DataFrame:
        counts = [F.count_if(F.col("change") == c).alias(c) for c in ("inserted", "updated")]
        return merged(rows, new).observe(seen, *counts).drop("change")

    before = store.version()
    after = store.change(new, make)
    return dict(seen.get) if after > before else {"inserted": 0, "updated": 0}


def update_first_in(store: BucketedTable, match: Column, changes: Column) -> int:
    """Set fields on the matching document with the smallest key; how many there were, 0 or 1."""
    first = store.read().where(match).agg(F.min("doc_key").alias("doc_key"))
    key = first.first()["doc_key"]
    if key is None:
        return 0
    hit = F.col("doc_key") == key
    store.change(
        store.spark.createDataFrame([(key,)], "doc_key string"),
        lambda rows: rows.withColumn(
            "fields", F.when(hit, conf.merge(F.col("fields"), changes)).otherwise(F.col("fields"))
        ),
    )
    return 1


def delete_in(store: BucketedTable, match: Column) -> int:
    """Delete the matching rows, whatever the table's columns; how many there were."""
    seen = Observation()
    before = store.version()
    after = store.change_where(match, lambda rows: delete_matching(rows, match, seen))
    return seen.get["deleted"] if after > before else 0
