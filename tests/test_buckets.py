"""Tables in hash buckets: what a change reads, writes and shares, and two writers."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from harborlane.sinks import documents as docs, storage
from harborlane.sinks.buckets import BucketedTable, Conflict


@pytest.fixture
def table(spark, work):
    store = BucketedTable(spark, work)
    rows = spark.range(200).select("id", (F.col("id") % 7).alias("n"), F.lit("x").alias("t"))
    assert store.create(rows, "id", buckets=16) == 1
    return store


def bucket(store, key):
    frame = store.spark.createDataFrame([(key,)], "id bigint")
    return frame.select(store.state().bucket()).first()[0]


def test_a_change_writes_only_the_buckets_it_touches(spark, table):
    before = table.state()
    keys = spark.createDataFrame([(5,), (5,), (77,)], "id bigint")
    seen = []

    def make(rows):
        seen.extend(rows.inputFiles())
        return rows.withColumn("t", F.when(F.col("id").isin(5, 77), "y").otherwise(F.col("t")))

    assert table.change(keys, make) == 2
    touched = {bucket(table, 5), bucket(table, 77)}
    after = table.state()
    assert {b for b in range(16) if before.folders.get(b) != after.folders.get(b)} == touched
    # Not read either, and the files of the rest are those of version 1.
    assert all(any(f"_bucket={b}/" in f for b in touched) for f in seen)
    shared = set(table.read(1).inputFiles()) & set(table.read(2).inputFiles())
    assert len(shared) == 16 - len(touched)
    assert {r.id for r in table.read().where("t = 'y'").collect()} == {5, 77}
    assert table.read(1).where("t = 'y'").count() == 0 and table.read().count() == 200
    assert table.change(keys.limit(0), make) == 2


def test_rows_come_and_go(spark, table):
    none = table.change_where(F.col("n") == 99, lambda rows: rows.limit(0))
    assert none == 1
    table.change_where(F.col("n") >= 0, lambda rows: rows.where("id < 3"))
    assert sorted(r.id for r in table.read().collect()) == [0, 1, 2]
    table.change(spark.createDataFrame([(0,), (1,), (2,)], "id bigint"), lambda rows: rows.limit(0))
    assert table.read().count() == 0 and table.state().folders == {}
    new = spark.createDataFrame([(None, 1, "null"), (900, 2, None)], "id bigint, n bigint, t string")
    table.change(new, lambda rows: rows.unionByName(new))
    assert {r.id for r in table.read().collect()} == {None, 900}
    assert table.drop_before(table.version()) >= 2
    assert table.read().count() == 2 and table.read().columns == ["id", "n", "t"]


def test_a_change_may_not_move_rows_elsewhere(spark, table):
    folders = storage.names(spark, f"{table.root}/data")
    with pytest.raises(ValueError, match="bucket"):
        table.change(spark.createDataFrame([(5,)], "id bigint"), lambda rows: rows.withColumn("id", F.col("id") + 1))
    assert storage.names(spark, f"{table.root}/data") == folders and table.version() == 1


def test_writers_of_different_buckets_both_count(spark, work, table):
    other, a = BucketedTable(spark, work), 5
    b = next(i for i in range(200) if bucket(table, i) != bucket(table, a))

    def meanwhile(key, value):
        def make(rows):
            if value == "late":
                other.change(spark.createDataFrame([(b,)], "id bigint"), lambda r: r.withColumn("t", F.lit("first")))
            return rows.withColumn("t", F.lit(value))
        return table.change(spark.createDataFrame([(key,)], "id bigint"), make)

    assert meanwhile(a, "late") == 3
    found = {r.id: r.t for r in table.read().collect()}
    assert found[a] == "late" and found[b] == "first"
    # The same bucket: the later one fails and leaves nothing.
    folders = storage.names(spark, f"{work}/data")
    with pytest.raises(Conflict):
        meanwhile(b, "late")
    assert {r.id: r.t for r in table.read().collect()}[b] == "first"
    assert len(storage.names(spark, f"{work}/data")) == len(folders) + 1
    with pytest.raises(Conflict):
        other.create(spark.range(3), "id")


def documents(spark, *texts):
    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(texts)], "seq bigint, t string")
    return docs.keyed(rows.select("seq", F.parse_json("t").alias("document")))


def test_documents(spark, work):
    store = BucketedTable(spark, work)
    store.create(documents(spark, *[{"_id": i, "a": i} for i in range(50)]).select("doc_key", "fields"), "doc_key", 8)
    incoming = documents(spark, {"_id": 3, "b": 1}, {"_id": 3, "b": None, "c": 2}, {"_id": "new"}, {"a": 1})
    assert docs.upsert_into(store, incoming) == {"inserted": 1, "updated": 1}
    assert docs.upsert_into(store, incoming.limit(0)) == {"inserted": 0, "updated": 0}
    held = {r.doc_key: json.loads(r.d) for r in store.read().select("doc_key", F.to_json("fields").alias("d")).collect()}
    assert len(held) == 51 and held["3"] == {"_id": 3, "a": 3, "b": None, "c": 2} and held["new"] == {"_id": "new"}
    text = lambda name: F.try_element_at("fields", F.lit(name)).cast("string")
    version = store.version()
    mark = F.create_map(F.lit("hit"), F.parse_json(F.lit("true")))
    assert docs.update_first_in(store, text("a").isin("12", "30"), mark) == 1
    assert docs.update_first_in(store, text("a") == "nothing", mark) == 0
    assert [r.doc_key for r in store.read().where(text("hit") == "true").collect()] == ["12"]
    changed = {b for b, f in store.state().folders.items() if store.state(version).folders[b] != f}
    assert len(changed) == 1
    assert docs.delete_in(store, text("a").cast("int") < 10) == 10
    assert docs.delete_in(store, text("a") == "nothing") == 0
    assert store.read().count() == 41


def test_a_store_without_an_exclusive_create_is_refused(spark, work, monkeypatch):
    """A file system that only looks before it writes would let two writers of a version through."""
    monkeypatch.setattr(storage, "EXCLUSIVE", set())
    with pytest.raises(ValueError, match="file is not known"):
        storage.create_new(spark, f"{work}/marker", "x")
    # One that knows the conditional create is asked for it; the local one does not know it.
    monkeypatch.setattr(storage, "CONDITIONAL", {"file"})
    with pytest.raises(Exception, match="(?i)conditional"):
        storage.create_new(spark, f"{work}/marker", "x")
    assert not storage.exists(spark, f"{work}/marker")
