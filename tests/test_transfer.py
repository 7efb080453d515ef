from __future__ import annotations

import csv
import datetime as dt
import io
import json
import random

import pytest
from pyspark.sql import Observation, functions as F

from harborlane.functions import conf
from harborlane.functions.times import instant
from harborlane.operators import landing, runs
from harborlane.sinks import documents as docs
from harborlane.sinks import partitions, storage
from harborlane.sinks.versions import VersionedTable
from harborlane.sources import delimited, files, objects as store
from harborlane.sources.tables import find, page


def objects(spark, contents):
    rows = [(1, "b", key, content) for key, content in contents.items()]
    return spark.createDataFrame(rows, "run_id int, bucket string, key string, content string")


def land(spark, contents):
    parsed = landing.parse_objects(objects(spark, contents))
    stats = landing.transfer_stats(parsed).drop("run_id").first().asDict()
    loaded = landing.documents(parsed, instant("2024-01-01 00:00:00"))
    return parsed, stats, loaded


def test_object_and_array_files(spark):
    _, stats, loaded = land(spark, {"a.json": '{"id":1}', "b.json": '[{"id":2},{"id":3}]'})
    assert stats == {"objects": 2, "skipped": 0, "files_processed": 2, "records_read": 3, "records_written": 3, "errors": 0}
    rows = loaded.select(F.variant_get("document", "$.id", "int").alias("id"), "*").collect()
    assert sorted((r["id"], r["_source_key"]) for r in rows) == [(1, "a.json"), (2, "b.json"), (3, "b.json")]
    assert {r["_import_timestamp"] for r in rows} == {dt.datetime(2024, 1, 1)}
    assert len({r["document_id"] for r in rows}) == 3


def test_a_bad_file_is_counted_and_the_rest_continue(spark):
    parsed, stats, loaded = land(
        spark,
        {
            "good.json": '{"id":1}', "broken.json": '{"id":', "lines.json": '{"id":1}\n{"id":2}',
            "extra.json": '[{"id":1}] tail', "scalar.json": '"text"', "empty.json": "",
            "mixed.json": '[{"id":1},2]', "none.json": "[]", "two.json": '{"id":1},{"id":2}',
            "folder/": "", "data.csv": "a,b", "null.json": None,
        },
    )
    assert stats == {"objects": 12, "skipped": 2, "files_processed": 2, "records_read": 3, "records_written": 1, "errors": 8}
    assert loaded.count() == 1
    reported = landing.data_errors(parsed)
    assert reported.count() == 7 and reported.where("message like 'Unexpected%'").count() == 0
    kept = runs.first_errors(reported)
    assert {r["error_code"] for r in kept.collect()} == {"DATA_ERROR"}
    reasons = {r["key"]: r["error"].split(" in ")[0].split(":")[-1].strip() for r in landing.rejects(parsed).collect()}
    assert reasons["scalar.json"] == "Unexpected data type" and reasons["mixed.json"] == "record is not an object"


def test_whitespace_and_nesting(spark):
    _, stats, loaded = land(spark, {"a.json": ' \n\t{"a":{"b":[1,2]}}\n', "b.json": '\n [ {"x":"]"} ]\n'})
    assert stats["errors"] == 0 and loaded.count() == 2


def test_no_objects(spark):
    parsed = landing.parse_objects(objects(spark, {"x": "y"}).limit(0))
    assert landing.transfer_stats(parsed).count() == 0


def test_landing_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, name in enumerate(("Alice", "Bob", "Charlie")):
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps({"id": i, "name": name, "text": "é\n"}))
    (tmp_path / "in" / "bad.json").write_bytes(b'{"id": 1, "name": "\xff\xfe"')
    (tmp_path / "in" / "note.txt").write_text("no")
    read = files.whole_text(spark, str(tmp_path))
    parsed = landing.parse_objects(landing.objects_from(read, F.lit(7)))
    stats = landing.transfer_stats(parsed).first()
    assert (stats["files_processed"], stats["records_written"], stats["errors"], stats["skipped"]) == (3, 3, 1, 1)
    loaded = landing.documents(parsed, instant("2024-01-01 00:00:00"))
    assert {r["n"] for r in loaded.select(F.variant_get("document", "$.name", "string").alias("n")).collect()} == {
        "Alice", "Bob", "Charlie",
    }


def test_source_presence(spark):
    wanted = spark.createDataFrame([(1, "b", "in/"), (2, "b", "out/"), (3, "c", "")], "run_id int, bucket string, prefix string")
    listed = objects(spark, {"in/x/1.json": "", "in/2.json": "", "other": ""})
    got = {r["run_id"]: (r["files"], r["has_objects"]) for r in landing.source_presence(wanted, listed).collect()}
    assert got == {1: (2, True), 2: (0, False), 3: (0, False)}


def test_sink_rules(spark):
    rows = [
        '{"id":1,"name":"a"}', '{"name":"a","value":1.5}', '{"id":"1","name":2}',
        '{"id":1,"name":"a","timestamp":"2024-01-01","metadata":{}}', '{"id":1,"name":"a","metadata":[],"timestamp":"x"}',
    ]
    df = spark.createDataFrame([(r,) for r in rows], "j string").select(F.parse_json("j").alias("document"))
    got = [r["violations"] for r in landing.conforming(df, landing.RECORD_RULES).collect()]
    assert got == [
        [], ["id is required", "value must be int"], ["id must be int", "name must be string"], [],
        ["timestamp must be date", "metadata must be object"],
    ]


def test_unique_index(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), ("a", 2)], "k string, o int")
    got = {(r["k"], r["o"]): r["is_first"] for r in landing.first_per_key(df, ["k"], "o").collect()}
    assert got == {("a", 3): False, ("a", 1): True, ("b", 2): True, ("a", 2): False}


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n   \n{"a":3}\n')
    (tmp_path / "b.jsonl").write_text('{"a":4}\nnot json\n')
    read = files.read_json_lines(spark, str(tmp_path), "a int").cache()
    assert sorted(r["a"] for r in read.where("_corrupt is null").collect()) == [1, 2, 3, 4]
    assert [r["_corrupt"] for r in read.where("_corrupt is not null").collect()] == ["not json"]


def test_csv(spark, tmp_path):
    (tmp_path / "h.csv").write_text('name,age\nAlice,30\n"B, ""b""\nnext",25\n')
    (tmp_path / "t.tsv").write_text("x\ty\n")
    named = files.read_csv(spark, str(tmp_path), multiline=True, suffix=".csv").collect()
    assert [r.asDict() for r in named] == [{"name": "Alice", "age": "30"}, {"name": 'B, "b"\nnext', "age": "25"}]
    plain = files.read_csv(spark, str(tmp_path), "\t", has_header=False, suffix=".tsv").collect()
    assert [r["row"] for r in plain] == [["x", "y"]]


def test_text_bytes_and_listing(spark, tmp_path):
    (tmp_path / "u.txt").write_text("grüße", encoding="utf-8")
    (tmp_path / "l.lat").write_text("grüße", encoding="latin-1")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    where = str(tmp_path)
    got = {r["path"].rsplit("/", 1)[1]: r["content"] for r in files.read_text(spark, where, suffix=".txt").collect()}
    assert got == {"u.txt": "grüße", "bad.txt": None}
    assert files.read_text(spark, where, "iso-8859-1", ".lat").first()["content"] == "grüße"
    assert files.read_bytes(spark, where, ".lat").first()["content"] == "grüße".encode("latin-1")
    with pytest.raises(ValueError):
        files.read_text(spark, where, "cp037")
    listing = files.list_objects(spark, where)
    assert listing.count() == 3 and set(listing.columns) == {"path", "length", "modificationTime"}
    assert files.list_and_filter(spark, where, ".txt").count() == 2
    assert files.list_and_filter(spark, where).count() == 3
    assert files.list_objects(spark, where, limit=2).count() == 2
    assert files.list_and_filter(spark, where, ".none").count() == 0
    bucket, key = files.split_location(F.lit("s3a://bucket/a/b.json"))
    assert tuple(spark.range(1).select(bucket, key).first()) == ("bucket", "a/b.json")


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "u.txt").write_text("x")
    plan = files.list_objects(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in plan


def test_manifest(spark):
    manifest = spark.createDataFrame([("a",), ("b",)], "path string")
    listing = spark.createDataFrame([("b",), ("c",)], "path string")
    assert [r[0] for r in files.missing_objects(manifest, listing).collect()] == ["a"]
    assert [r[0] for r in files.existing_objects(manifest, listing).collect()] == ["b"]


def test_find(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "i int, k string")
    assert find(df, k="x").count() == 2 and find(df, k=None).count() == 3 and find(df, 1, k="x").count() == 1


def stored(spark, *rows):
    df = spark.createDataFrame([(r, i) for i, r in enumerate(rows)], "j string, seq int")
    return docs.keyed(df.withColumn("document", F.try_parse_json("j")))


def fields(df):
    return {r["doc_key"]: json.loads(r["f"]) for r in df.select("doc_key", conf.conf_text(F.col("fields")).alias("f")).collect()}


def test_upsert(spark):
    current = stored(spark, '{"_id":"a","x":1,"y":1}', '{"_id":"b","x":1}')
    new = stored(spark, '{"_id":"a","x":2,"z":5}', '{"_id":"a","x":3,"y":null}', '{"_id":7,"n":1}', '{"x":1}', "[1]")
    merged = docs.upsert(current, new)
    assert fields(merged) == {"a": {"_id": "a", "x": 3, "y": None, "z": 5}, "b": {"_id": "b", "x": 1}, "7": {"_id": 7, "n": 1}}
    assert {r["change"]: r["n"] for r in docs.change_counts(merged).collect()} == {"updated": 1, "unchanged": 1, "inserted": 1}
    assert docs.keyless(new).count() == 2


def test_update_and_delete(spark):
    df = stored(spark, '{"_id":"b","x":1}', '{"_id":"a","x":1}', '{"_id":"c"}').select("doc_key", "fields")
    match = F.try_element_at("fields", F.lit("x")).cast("int") == 1
    changed = fields(docs.update_first(df, match, conf.base_conf(x=F.lit(9))))
    assert (changed["a"]["x"], changed["b"]["x"]) == (9, 1)
    assert sorted(fields(docs.delete_matching(df, match))) == ["c"]


def test_append_counts_rows(spark, work):
    assert docs.append(spark.range(2500), work, max_records_per_file=1000) == 2500
    assert docs.append(spark.range(5), work) == 5
    assert spark.read.parquet(work).count() == 2505


def test_versions(spark, work):
    target = VersionedTable(spark, work)
    with pytest.raises(ValueError):
        target.read()
    assert target.commit(spark.range(10)) == 1
    assert target.commit(target.read().where("id > 3")) == 2
    assert (target.read().count(), target.read(1).count()) == (6, 10)
    # A version without its marker does not count, and its folder is written anew.
    spark.range(99).write.parquet(f"{work}/v{3:010d}")
    assert target.read().count() == 6
    assert target.commit(target.read().limit(1)) == 3 and target.read().count() == 1
    with pytest.raises(Exception, match="already exists"):
        storage.create_new(spark, f"{work}/_versions/{3:010d}")
    assert target.drop_before(3) == 2 and target.read().count() == 1


def test_partitioned_store(spark, work):
    df = spark.range(100).select(
        F.when(F.col("id") < 90, "hot").otherwise("cold").alias("customer_guid"),
        F.when(F.col("id") % 2 == 0, "2024-01").otherwise("2024-02").alias("event_month"), "id",
    )
    partitions.append_partitioned(df, f"{work}/a")
    partitions.append_partitioned(df, f"{work}/b")
    assert spark.read.parquet(f"{work}/a").count() == 100
    assert partitions.erase_tenant(spark, [f"{work}/a", f"{work}/b", f"{work}/none"], "hot") == 2
    left = spark.read.parquet(f"{work}/a")
    assert left.count() == 10 and left.where("customer_guid = 'hot'").count() == 0
    assert partitions.drop_older(spark, f"{work}/a/customer_guid=cold", "event_month", "2024-02") == ["event_month=2024-01"]
    assert spark.read.parquet(f"{work}/a").count() == 5
    for bad in ("../..", "", "a/b", "hot\n", "*", None):
        with pytest.raises(ValueError):
            partitions.erase_tenant(spark, [f"{work}/a"], bad)
    assert spark.read.parquet(f"{work}/a").count() == 5
    partitions.append_partitioned(df, f"{work}/c")
    assert sorted(partitions.drop_older(spark, f"{work}/c", "event_month", "2024-02")) == [
        "customer_guid=cold/event_month=2024-01", "customer_guid=hot/event_month=2024-01",
    ]
    assert spark.read.parquet(f"{work}/c").count() == 50


def test_two_writers(spark, work):
    """Both start from version 1; the one that comes second changes nothing."""
    first, second = VersionedTable(spark, work), VersionedTable(spark, work)
    first.commit(spark.range(10))
    start = second.version()
    assert first.commit(spark.range(3), after=start) == 2
    with pytest.raises(Exception, match="already exists"):
        second.commit(spark.range(99), after=start)
    assert first.read().count() == 3 and first.version() == 2
    assert len([n for n in storage.names(spark, work) if n.startswith("v")]) == 2


def test_awkward_files(spark, tmp_path):
    (tmp_path / "my file+100%.json").write_text('{"a": 1}')
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9")
    (tmp_path / "plain.txt").write_bytes(b"cafe")
    listed = {r["path"] for r in files.list_objects(spark, str(tmp_path)).collect()}
    read = {r["path"]: r["content"] for r in files.whole_text(spark, str(tmp_path)).collect()}
    assert set(read) == listed and any(p.endswith("/my file+100%.json") for p in read)
    ascii_ = {r["path"].split("/")[-1]: r["content"] for r in files.read_text(spark, str(tmp_path), "US-ASCII", ".txt").collect()}
    assert ascii_ == {"latin.txt": None, "plain.txt": "cafe"}


def test_json_lines_leaves_the_schema_alone(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.jsonl").write_text('{"a": 1}\nbad\n')
    schema = T.StructType([T.StructField("a", T.LongType())])
    for _ in range(2):
        rows = files.read_json_lines(spark, str(tmp_path), schema).collect()
        assert sorted((r["a"], r["_corrupt"]) for r in rows if r["a"]) == [(1, None)] and len(rows) == 2
    assert schema.names == ["a"]


def test_null_keys_and_no_prefix(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, o int")
    got = {r["o"]: r["is_first"] for r in landing.first_per_key(df, ["k"], "o").collect()}
    assert got == {1: True, 2: False, 3: True}
    runs = spark.createDataFrame([(1, "b", None), (2, "b", "x/"), (3, "c", None)], "run_id int, bucket string, prefix string")
    objects = spark.createDataFrame([("b", "x/1"), ("b", "y")], "bucket string, key string")
    rows = landing.source_presence(runs, objects).collect()
    assert {r["run_id"]: r["files"] for r in rows} == {1: 2, 2: 1, 3: 0}


def test_csv_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3,"a ""b"",\nc",5,6\n\n4\n,""\n')
    (tmp_path / "b.csv").write_text("y,x\r\n20,10\r\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("x,y\n")
    rows = delimited.read_csv_records(spark, str(tmp_path)).collect()
    got = [(r["path"][-5:], r["line"], r["record"], r["extra"]) for r in rows]
    assert sorted(got, key=lambda g: g[:2]) == [
        ("a.csv", 2, {"x": "1", "y": "2"}, []),
        ("a.csv", 3, {"x": "3", "y": 'a "b",\nc'}, ["5", "6"]),
        ("a.csv", 6, {"x": "4", "y": None}, []),
        ("a.csv", 7, {"x": "", "y": ""}, []),
        ("b.csv", 2, {"x": "10", "y": "20"}, []),
    ]


@pytest.mark.parametrize("block, files_", [("13b", 5), ("100b", 12), ("64m", 40)])
def test_csv_as_a_standard_parser_reads_it(spark, tmp_path, block, files_):
    """Files of random quotes, delimiters and line ends, cut into blocks of any size."""
    rng = random.Random(files_)
    pieces = ['"', '"', '""', "a", "bc", "d e", ";", ";", "\n", "\r\n", '"\n', ';"', '";', "\u00fc", "\U0001f600"]
    expected, listed = {}, {}
    for i in range(files_):
        quoted = i % 4 > 0  # every fourth file has no line break inside quotes
        body = "".join(rng.choices(pieces if quoted else [p for p in pieces if '"' not in p], k=rng.randrange(1, 60)))
        text = rng.choice(["x;y;z\n", 'x;"y ""1"" z";x\n', '"x\n1";y\n', "\n"]) + body.rstrip("\r\n") + ";e"
        (tmp_path / f"{i:02}.csv").write_bytes(text.encode())
        listed[i] = [row for row in csv.reader(io.StringIO(text), delimiter=";")]
        expected[i] = [
            ({k: v for k, v in row.items() if k is not None}, row.get(None, []))
            for row in csv.DictReader(io.StringIO(text), delimiter=";")
        ]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        records = delimited.read_csv_records(spark, str(tmp_path), ";")
        rows = delimited.read_csv_lists(spark, str(tmp_path), ";")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    got, lists = {i: [] for i in expected}, {i: [] for i in expected}
    for r in records.orderBy("path", "line").collect():
        got[int(r.path[-6:-4])].append((r.record, r.extra))
    for r in rows.orderBy("path", "line").collect():
        lists[int(r.path[-6:-4])].append(r["values"])
    assert got == expected
    assert lists == listed


def test_one_large_csv_file_is_read_by_many_tasks(spark, tmp_path):
    lines = [f'{i},"text {i}",5" pipe' for i in range(20_000)]
    lines[7000] = '7000,"over\n' + "many lines\n" * 3000 + '",end'
    (tmp_path / "large.csv").write_text("n,t,u\n" + "\n".join(lines) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        read = spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions()
        rows = delimited.read_csv_records(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    found = {int(r.record["n"]): r for r in rows.collect()}
    assert read > 10 and len(found) == 20_000 and found[19_999].line == 20_001 + 3001
    assert found[5].record == {"n": "5", "t": "text 5", "u": '5" pipe'}
    assert found[7000].record["t"].count("\n") == 3001 and found[7000].record["u"] == "end"


@pytest.mark.parametrize("delimiter", ["||", "", '"', "\n"])
def test_a_delimiter_is_one_character(spark, tmp_path, delimiter):
    with pytest.raises(ValueError):
        delimited.read_csv_lists(spark, str(tmp_path), delimiter)


def test_csv_fields_of_very_many_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('t,u\n"' + 'x""' * 200_000 + '",2\n' + '"a",' * 30_000 + '\n')
    first, second = delimited.read_csv_records(spark, str(tmp_path)).orderBy("line").collect()
    assert first.record == {"t": 'x"' * 200_000, "u": "2"} and len(second.extra) == 29_999


def test_every_object_is_listed_and_read(spark, tmp_path):
    contents = {
        "_a.json": b"{}", ".b.json": b"[]", "empty.json": b"", "my file+%41.json": b'{"x":1}', "n\u00e4me.json": b"\xe4",
        "_hidden/deep/c.json": b"1", "plain/d.json": b"2",
    }
    rows = [(f"{tmp_path}/in/{name}", bytearray(value)) for name, value in contents.items()]
    assert store.write_all(spark.createDataFrame(rows, "path string, content binary")).count() == 7
    (tmp_path / "in" / "plain" / ".d.json.crc").write_bytes(b"crc")
    (tmp_path / "in" / "none").mkdir()
    listing = store.list_all(spark, f"{tmp_path}/in")
    found = {r["path"].removeprefix(f"file:{tmp_path}/in/"): r["length"] for r in listing.collect()}
    assert found == {name: len(value) for name, value in contents.items()}
    assert listing.where("modificationTime is null").isEmpty()
    read = {r["path"]: bytes(r["content"]) for r in store.read_all_bytes(listing).collect()}
    assert sorted(read.values()) == sorted(contents.values())

    def text(encoding):
        rows = store.read_all_text(listing, encoding).collect()
        return {r["path"].removeprefix(f"file:{tmp_path}/in/"): r["content"] for r in rows}

    assert text("utf-8")["n\u00e4me.json"] is None and text("utf-8")["empty.json"] == ""
    assert text("windows-1252")["n\u00e4me.json"] == "\u00e4"
    with pytest.raises(LookupError):
        store.read_all_text(listing, "no such set")
    documents = files.read_json_files(spark, f"{tmp_path}/in", complete=True).collect()
    assert len(documents) == 7 and sum(r["document"] is not None for r in documents) == 5
    assert files.list_objects(spark, f"{tmp_path}/in", complete=True).count() == 7
    assert files.list_and_filter(spark, f"{tmp_path}/in", "c.json", complete=True).count() == 1
    # Both listings call a visible object the same.
    usual = {r["path"] for r in files.whole_text(spark, f"{tmp_path}/in", ".json").collect()}
    assert usual < set(read)


def test_an_empty_folder_has_no_objects(spark, tmp_path):
    assert store.list_all(spark, str(tmp_path)).isEmpty()


def test_changes_count_what_they_touch(spark, work):
    stored = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "doc_key string, n int").withColumn(
        "fields", conf.base_conf(n=F.col("n"))
    )
    deleted, modified = Observation(), Observation()
    docs.delete_matching(stored, F.col("n") > 0, deleted).select("doc_key").write.parquet(f"{work}/left")
    assert deleted.get == {"deleted": 2}
    changed = docs.update_first(stored, F.col("n") > 0, conf.base_conf(m=F.lit(1)), modified)
    changed.select("doc_key").write.parquet(f"{work}/changed")
    assert modified.get == {"modified": 1}


def test_pages_have_bounds(spark):
    rows = spark.range(30)
    assert [r["id"] for r in page(rows, "id", limit=2, offset=3).collect()] == [3, 4]
    for wrong in ({"limit": 0}, {"limit": 1001}, {"offset": -1}):
        with pytest.raises(ValueError):
            page(rows, "id", **wrong)
