"""Queries over landing, sources, sinks and endpoint columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane.functions import conf, text, uris
from harborlane.functions.times import instant as at
from harborlane.operators import dispatch, landing
from harborlane.plans.registry import query
from harborlane.session import fresh_dir
from harborlane.sinks import documents as docs
from harborlane.sinks.buckets import BucketedTable
from harborlane.sinks.versions import VersionedTable
from harborlane.sources import delimited, files, objects, views
from harborlane.sources.tables import find, table

NOW = "2024-02-01 00:00:00"


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    return landing.parse_objects(views.landing_objects(spark, folder))


@query(
    "landing_stats",
    views="landed",
    sql="""select run_id, count(*) as objects, count(*) filter (where status = 'skipped') as skipped,
      count(*) filter (where status = 'processed') as files_processed, cast(sum(size) as bigint) as records_read,
      cast(sum(case when status = 'processed' then size else 0 end) as bigint) as records_written,
      count(*) filter (where status = 'error') as errors
    from landed group by 1""",
)
def landing_stats(spark: SparkSession, folder: str) -> DataFrame:
    return landing.transfer_stats(_parsed(spark, folder))


@query(
    "landing_documents",
    views="landed",
    sql=f"""select sha256(bucket || chr(1) || key || chr(1) || i) as document_id, run_id, conv_id, turn, role, text,
      bucket as _source_bucket, key as _source_key, timestamp '{NOW}' as _import_timestamp
    from (select *, unnest(generate_series(0, size - 1)) as i from landed where status = 'processed')""",
)
def landing_documents(spark: SparkSession, folder: str) -> DataFrame:
    landed = landing.documents(_parsed(spark, folder), at(NOW))

    def field(name: str, kind: str):
        return F.variant_get("document", f"$.{name}", kind).alias(name)

    return landed.select(
        "document_id", "run_id", field("conv_id", "bigint"), field("turn", "bigint"),
        field("role", "string"), field("text", "string"),
        "_source_bucket", "_source_key", "_import_timestamp",
    )


@query(
    "landing_rejects",
    views="landed",
    sql="select run_id, bucket, key, error from landed where status = 'error'",
)
def landing_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return landing.rejects(_parsed(spark, folder))


@query(
    "landing_data_errors",
    views="landed",
    sql="""select run_id, 'execute' as task_id, 'DATA_ERROR' as error_code, error as message, key as seq
      from landed where status = 'error' and error not like 'Unexpected%'""",
)
def landing_data_errors(spark: SparkSession, folder: str) -> DataFrame:
    return landing.data_errors(_parsed(spark, folder))


@query(
    "landing_key_filter",
    views="files",
    sql="""select coalesce(why, 'wanted') as outcome, count(*) as n from (select case when key like '%/' then 'folder'
      when key not like '%.json' then 'format' end as why from files) group by 1""",
)
def landing_key_filter(spark: SparkSession, folder: str) -> DataFrame:
    objects = views.landing_objects(spark, folder)
    return objects.groupBy(
        F.coalesce(landing.skip_reason(F.col("key")), F.lit("wanted")).alias("outcome")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "landing_source_presence",
    views="files",
    sql="""select r.conv_id as run_id, count(f.key) as files, count(f.key) > 0 as has_objects
      from (select distinct conv_id from conversations) r
      left join files f on f.bucket = 'bucket-' || (r.conv_id + r.conv_id // 5) % 3
        and f.key like 'in/' || r.conv_id || '/%' group by 1""",
)
def landing_source_presence(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("conv_id")
    wanted = table(spark, folder, "conversations").select(c).distinct().select(
        c.alias("run_id"),
        F.concat(F.lit("bucket-"), ((c + F.expr("conv_id div 5")) % 3).cast("string")).alias("bucket"),
        F.concat(F.lit("in/"), c.cast("string"), F.lit("/")).alias("prefix"),
    )
    return landing.source_presence(wanted, views.landing_objects(spark, folder))


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for the sink rules: some lack the name, some have a text id, some a bad date."""
    d = F.col("doc_id")
    made = F.concat(
        F.lit('{"id":'),
        F.when(d % 7 == 0, F.concat(F.lit('"'), d.cast("string"), F.lit('"'))).otherwise(
            (d % 50).cast("string")
        ),
        F.when(d % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit(',"name":'), F.to_json(F.struct(F.col("source").alias("s")))
        )),
        F.when(d % 3 == 0, F.lit(',"timestamp":"soon"')).otherwise(
            F.lit(',"timestamp":"2024-01-01T00:00:00"')
        ),
        F.lit("}"),
    )
    named = F.regexp_replace(made, r'"name":\{"s":("[^"]*")\}', r'"name":$1')
    return table(spark, folder, "documents").select(
        "doc_id", F.parse_json(named).alias("document")
    )


@query(
    "landing_validation",
    sql="""select doc_id, concat_ws('|', case when doc_id % 7 = 0 then 'id must be int' end,
        case when doc_id % 5 = 0 then 'name is required' end,
        case when doc_id % 3 = 0 then 'timestamp must be date' end) as problems from documents""",
)
def landing_validation(spark: SparkSession, folder: str) -> DataFrame:
    checked = landing.conforming(_records(spark, folder), landing.RECORD_RULES)
    return checked.select("doc_id", F.array_join("violations", "|").alias("problems"))


@query(
    "landing_unique",
    sql="""select doc_id, row_number() over (partition by lang, source order by doc_id) = 1 as is_first
      from documents""",
)
def landing_unique(spark: SparkSession, folder: str) -> DataFrame:
    keyed = table(spark, folder, "documents").select("doc_id", "lang", "source")
    return landing.first_per_key(keyed, ["lang", "source"], "doc_id").select("doc_id", "is_first")


@query(
    "documents_find",
    sql="select doc_id, n_chars from documents where lang = 'fr' and source = 'src0'",
)
def documents_find(spark: SparkSession, folder: str) -> DataFrame:
    return find(table(spark, folder, "documents"), lang="fr", source="src0").select(
        "doc_id", "n_chars"
    )


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c_custkey")
    made = F.concat(
        F.lit('{"_id":"'), c.cast("string"), F.lit('","name":"'), F.col("c_name"),
        F.lit('","segment":"'), F.col("c_mktsegment"), F.lit('"}'),
    )
    fields = table(spark, folder, "customer").select(conf.json_map(made).alias("fields"))
    return fields.select(F.element_at("fields", "_id").cast("string").alias("doc_key"), "fields")


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    o = F.col("o_orderkey")
    made = F.concat(
        F.lit('{"_id":"'),
        F.when(o % 4 == 0, F.concat(F.lit("new-"), F.col("o_custkey").cast("string"))).otherwise(
            F.col("o_custkey").cast("string")
        ),
        F.lit('","last":'), o.cast("string"),
        F.when(o % 3 == 0, F.lit(',"segment":null')).otherwise(F.lit("")),
        F.lit("}"),
    )
    orders = table(spark, folder, "orders").select(
        o.alias("seq"),
        F.parse_json(F.when(o % 10 == 9, F.lit('{"last":1}')).otherwise(made)).alias("document"),
    )
    return docs.keyed(orders)


_UPSERT_SQL = """with inc as (select case when o_orderkey % 4 = 0 then 'new-' else '' end || o_custkey as doc_key,
    max(o_orderkey) as last, count(*) filter (where o_orderkey % 3 = 0) as nulls
  from orders where o_orderkey % 10 <> 9 group by 1),
u as (select coalesce(cast(c_custkey as varchar), doc_key) as doc_key, c_name as name, last,
    case when coalesce(nulls, 0) > 0 then 'null' when c_mktsegment is not null then '"' || c_mktsegment || '"' end
      as segment,
    case when doc_key is null then 'unchanged' when c_custkey is null then 'inserted' else 'updated' end as change
  from customer full outer join inc on doc_key = cast(c_custkey as varchar))
"""


def _document_columns(rows: DataFrame, *more: str) -> DataFrame:
    def field(name: str):
        return F.try_element_at("fields", F.lit(name))

    return rows.select(
        "doc_key",
        field("name").cast("string").alias("name"),
        field("last").cast("bigint").alias("last"),
        F.to_json(field("segment")).alias("segment"),
        *more,
    )


def _document_store(spark: SparkSession, folder: str) -> BucketedTable:
    store = BucketedTable(spark, fresh_dir(spark, "documents"))
    store.create(_stored(spark, folder), "doc_key", buckets=8)
    return store


@query("sink_upsert", sql=_UPSERT_SQL + "select * from u")
def sink_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return _document_columns(docs.upsert(_stored(spark, folder), _incoming(spark, folder)), "change")


@query("sink_stored_upsert", sql=_UPSERT_SQL + "select * exclude (change) from u")
def sink_stored_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The upsert into a stored table, twice: the second finds all as it is to be."""
    store = _document_store(spark, folder)
    for _ in range(2):
        docs.upsert_into(store, _incoming(spark, folder))
    return _document_columns(store.read())


@query("sink_upsert_counts", sql=_UPSERT_SQL + "select change, count(*) as n from u group by 1")
def sink_upsert_counts(spark: SparkSession, folder: str) -> DataFrame:
    return docs.change_counts(docs.upsert(_stored(spark, folder), _incoming(spark, folder)))


@query(
    "sink_keyless",
    sql="select o_orderkey as seq from orders where o_orderkey % 10 = 9",
)
def sink_keyless(spark: SparkSession, folder: str) -> DataFrame:
    return docs.keyless(_incoming(spark, folder)).select("seq")


@query(
    "sink_update_first",
    sql="""select cast(c_custkey as varchar) as doc_key, case when cast(c_custkey as varchar) = (select min(cast(c_custkey as varchar))
      from customer where c_mktsegment = 'BUILDING') then 'yes' end as flag from customer""",
)
def sink_update_first(spark: SparkSession, folder: str) -> DataFrame:
    store = _document_store(spark, folder)
    match = F.element_at("fields", "segment").cast("string") == "BUILDING"
    docs.update_first_in(store, match, conf.base_conf(flag=F.lit("yes")))
    return store.read().select(
        "doc_key", F.try_element_at("fields", F.lit("flag")).cast("string").alias("flag")
    )


@query(
    "sink_delete",
    sql="select cast(c_custkey as varchar) as doc_key from customer where c_mktsegment <> 'BUILDING'",
)
def sink_delete(spark: SparkSession, folder: str) -> DataFrame:
    store = _document_store(spark, folder)
    match = F.try_element_at("fields", F.lit("segment")).cast("string") == "BUILDING"
    docs.delete_in(store, match)
    return store.read().select("doc_key")


@query(
    "sink_versions",
    sql="""select c_mktsegment, 2 as version, count(*) as n from customer where c_acctbal >= 0 group by 1""",
)
def sink_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Two versions of a table; the second is the first without the rows in debt."""
    target = VersionedTable(spark, fresh_dir(spark, "versions"))
    target.commit(table(spark, folder, "customer"))
    number = target.commit(docs.delete_matching(target.read(), F.col("c_acctbal") < 0))
    return target.read().groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "version", F.lit(number)
    )


@query(
    "source_json_lines",
    sql="select event_id, user_id, event_type, value, cast(null as varchar) as _corrupt from events",
)
def source_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "jsonl")
    table(spark, folder, "events").select("event_id", "user_id", "event_type", "value").write.json(
        path
    )
    return files.read_json_lines(
        spark, path, "event_id bigint, user_id bigint, event_type string, value double"
    )


@query(
    "source_csv",
    sql="""select cast(doc_id as varchar) as doc_id, lang, source, cast(n_chars as varchar) as n_chars, text
      from documents""",
)
def source_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "csv")
    table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "n_chars", "text"
    ).write.option("header", True).option("sep", ";").option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).option("emptyValue", '""').csv(path)
    return files.read_csv(spark, path, ";", multiline=True)


@query(
    "source_csv_rows",
    sql="""select cast(o_orderkey as varchar) as first, o_orderpriority as last, 3 as width from orders""",
)
def source_csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_dir(spark, "tsv")
    table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority"
    ).write.option("sep", "\t").csv(path)
    rows = files.read_csv(spark, path, "\t", has_header=False)
    return rows.select(
        F.element_at("row", 1).alias("first"),
        F.element_at("row", -1).alias("last"),
        F.size("row").alias("width"),
    )


def _written_batches(spark: SparkSession, folder: str) -> str:
    """Whole-file JSON lists on disk: one file per 50 documents."""
    path = fresh_dir(spark, "whole")
    lists = (
        table(spark, folder, "documents")
        .select(F.expr("doc_id div 50").alias("batch"), F.struct("doc_id", "lang").alias("r"))
        .groupBy("batch")
        .agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("value"))
    )
    lists.write.partitionBy("batch").text(path)
    return path


@query(
    "source_json_files",
    sql="""select doc_id // 50 as batch, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id
      from documents group by 1""",
)
def source_json_files(spark: SparkSession, folder: str) -> DataFrame:
    read = files.read_json_files(spark, _written_batches(spark, folder), suffix=".txt")
    batch = F.regexp_extract("path", "batch=([0-9]+)", 1).cast("bigint")
    ids = F.transform(
        F.col("document").cast("array<variant>"),
        lambda v: F.variant_get(v, "$.doc_id", "bigint"),
    )
    return read.select(
        batch.alias("batch"),
        F.size(ids).cast("bigint").alias("n"),
        F.array_min(ids).alias("first_id"),
        F.array_max(ids).alias("last_id"),
    )


@query(
    "source_all_objects",
    sql="""with b as (select doc_id // 50 as batch, count(*) as n, sum(length(lang) + length(cast(doc_id as varchar)) + 21)
        as size from documents where lang is not null group by 1),
      o as (select *, case batch % 5 when 0 then '_b ' || batch || '.json' when 1 then '.b' || batch || '.json'
        when 2 then 'empty ' || batch || '.json' when 3 then 'a+b%20' || batch || '.json'
        else batch || '.json' end as name from b)
    select '_part=' || batch // 20 as folder, name, case when batch % 5 = 2 then 0 else size + n + 1 end as length,
      case when batch % 5 = 2 then 'error' else 'processed' end as status,
      case when batch % 5 <> 2 then n end as records,
      case when batch % 5 = 2 then 'JSON parse error in ' || name end as error from o""",
)
def source_all_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Objects with hidden names, spaces, encoded characters or no content are listed and landed."""
    root = fresh_dir(spark, "objects")
    batch = F.col("batch").cast("string")
    name = (
        F.when(F.col("batch") % 5 == 0, F.concat(F.lit("_b "), batch))
        .when(F.col("batch") % 5 == 1, F.concat(F.lit(".b"), batch))
        .when(F.col("batch") % 5 == 2, F.concat(F.lit("empty "), batch))
        .when(F.col("batch") % 5 == 3, F.concat(F.lit("a+b%20"), batch))
        .otherwise(batch)
    )
    made = (
        table(spark, folder, "documents")
        .where(F.col("lang").isNotNull())
        .select(F.expr("doc_id div 50").alias("batch"), F.struct("doc_id", "lang").alias("r"))
        .groupBy("batch")
        .agg(F.to_json(F.array_sort(F.collect_list("r"))).alias("value"))
        .select(
            F.concat(
                F.lit(f"{root}/_part="), F.expr("batch div 20").cast("string"), F.lit("/"), name,
                F.lit(".json"),
            ).alias("path"),
            F.when(F.col("batch") % 5 == 2, F.lit("")).otherwise(F.col("value")).cast("binary").alias("content"),
        )
    )
    objects.write_all(made).write.format("noop").mode("overwrite").save()
    listing = objects.list_all(spark, root)
    read = objects.read_all_text(listing).join(listing.select("path", "length"), "path")
    bucket, key = files.split_location(F.col("path"))
    landed = landing.parse_objects(
        read.select(bucket.alias("bucket"), key.alias("key"), "content", "length")
    )
    return landed.select(
        F.element_at(F.split("key", "/"), -2).alias("folder"),
        F.element_at(F.split("key", "/"), -1).alias("name"),
        "length",
        "status",
        F.when(F.col("status") == "processed", F.size("records")).cast("bigint").alias("records"),
        F.regexp_replace("error", "in .*/", "in ").alias("error"),
    )


@query(
    "source_text_and_bytes",
    sql="""select doc_id // 50 as batch, true as same, true as sized from documents group by 1""",
)
def source_text_and_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Every file read as text and as bytes gives the same content, and the listed length fits."""
    path = _written_batches(spark, folder)
    as_text = files.read_text(spark, path, "UTF-8", ".txt")
    as_bytes = files.read_bytes(spark, path, ".txt").select(
        "path", F.decode("content", "UTF-8").alias("decoded")
    )
    listed = files.list_and_filter(spark, path, ".txt").join(
        files.list_objects(spark, path).select("path", "length"), "path"
    )
    return (
        as_text.join(as_bytes, "path")
        .join(listed, "path")
        .select(
            F.regexp_extract("path", "batch=([0-9]+)", 1).cast("bigint").alias("batch"),
            (F.col("content") == F.col("decoded")).alias("same"),
            (F.octet_length("content") == F.col("length")).alias("sized"),
        )
    )


@query(
    "source_missing_objects",
    sql="""with b as (select distinct doc_id // 50 as batch from documents)
      select batch, false as found from (select batch + 1000000 as batch from b)
      union all select batch, true from b""",
)
def source_missing_objects(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest with one wrong key for every right one."""
    path = _written_batches(spark, folder)
    listing = files.list_objects(spark, path).select(
        F.regexp_extract("path", "batch=([0-9]+)", 1).cast("bigint").alias("batch")
    )
    batches = table(spark, folder, "documents").select(
        F.expr("doc_id div 50").alias("batch")
    ).distinct()
    manifest = batches.unionByName(batches.select((F.col("batch") + 1000000).alias("batch")))
    missing = files.missing_objects(manifest, listing, "batch").withColumn("found", F.lit(False))
    found = files.existing_objects(manifest, listing, "batch").withColumn("found", F.lit(True))
    return missing.unionByName(found)


@query(
    "endpoint_uris",
    sql="""select s_suppkey as auth_id, case when s_suppkey % 2 = 0 then 'mongodb+srv' else 'mongodb' end as scheme,
      'host' || s_suppkey || '.example.com' as host,
      cast(case when s_suppkey % 2 = 0 then null when s_suppkey % 3 = 0 then 27017 else 27000 + s_suppkey % 100 end as int) as port,
      case when s_suppkey % 5 = 0 then null else 'user ' || s_suppkey end as username,
      case when s_suppkey % 5 = 0 then null else 'p@s:' || s_suppkey end as password,
      case when s_suppkey % 7 = 0 then 'default' else 'db' || s_suppkey end as database,
      case when s_suppkey % 11 = 0 then 'other' else 'admin' end as auth_source,
      case when s_suppkey % 11 = 0 then 'rs' || s_suppkey end as replica_set,
      s_suppkey % 11 = 0 as use_ssl,
      case when s_suppkey % 2 = 0 then 'mongodb+srv' else 'mongodb' end || '://'
        || case when s_suppkey % 5 = 0 then '' else 'user%20' || s_suppkey || ':[REDACTED]@' end
        || 'host' || s_suppkey || '.example.com'
        || case when s_suppkey % 2 = 1 and s_suppkey % 3 <> 0 then ':' || (27000 + s_suppkey % 100) else '' end
        || '/' || case when s_suppkey % 7 = 0 then '' else 'db' || s_suppkey end
        || case when s_suppkey % 11 = 0 then '?authSource=other&replicaSet=rs' || s_suppkey || '&tls=true' else '' end
        as redacted
    from supplier""",
)
def endpoint_uris(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    n = s.cast("string")
    uri = F.concat(
        F.when(s % 2 == 0, "mongodb+srv").otherwise("mongodb"),
        F.lit("://"),
        F.when(s % 5 == 0, "").otherwise(
            F.concat(F.lit("user%20"), n, F.lit(":p%40s%3A"), n, F.lit("@"))
        ),
        F.lit("host"), n, F.lit(".example.com"),
        F.when(
            (s % 2 == 1) & (s % 3 != 0), F.concat(F.lit(":"), (27000 + s % 100).cast("string"))
        ).otherwise(""),
        F.lit("/"),
        F.when(s % 7 == 0, "").otherwise(F.concat(F.lit("db"), n)),
        F.when(
            s % 11 == 0, F.concat(F.lit("?authSource=other&replicaSet=rs"), n, F.lit("&tls=true"))
        ).otherwise(""),
    )
    parts = uris.document_store_endpoint(F.col("uri"))
    return (
        table(spark, folder, "supplier")
        .select(s.alias("auth_id"), uri.alias("uri"))
        .select("auth_id", parts.alias("p"), text.redact_uri_password(F.col("uri")).alias("redacted"))
        .select("auth_id", "p.*", "redacted")
        .drop("error")
    )


@query(
    "object_store_uris",
    views="integrations",
    sql="""select integration_id, case when integration_id % 3 <> 0 then 'bucket-' || auth_id end as bucket,
      case when integration_id % 3 <> 0 then 'in/' || integration_id || '/' end as prefix,
      case when integration_id % 3 = 0 then 'unsupported scheme' end as error from integrations""",
)
def object_store_uris(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("integration_id")
    uri = F.concat(
        F.when(i % 3 == 0, "gs").otherwise("s3"),
        F.lit("://bucket-"), F.col("auth_id").cast("string"),
        F.lit("/in/"), i.cast("string"), F.lit("/"),
    )
    parsed = views.integrations(spark, folder).select(
        "integration_id", uris.object_store_location(uri).alias("p")
    )
    return parsed.select("integration_id", "p.*")


@query(
    "workspace_customers",
    views="integrations workspaces",
    sql="""select integration_id, coalesce(w.customer_guid, 'unknown') as customer_guid from integrations i
      left join (select * from workspaces where customer_guid <> 'cust-3') w using (workspace_id)""",
)
def workspace_customers(spark: SparkSession, folder: str) -> DataFrame:
    known = views.workspaces(spark, folder).where(F.col("customer_guid") != "cust-3")
    return dispatch.with_tenant(views.integrations(spark, folder), known, "left").select(
        "integration_id", "customer_guid"
    )


@query(
    "source_csv_records",
    sql="""select 'a' as file, cast(c_custkey as varchar) as c_custkey,
        case when c_custkey % 5 = 0 then c_name || ' "x"' || chr(10) || '5" rod, red' else c_name || ' 5" pipe' end as c_name,
        case when c_custkey % 3 > 0 then c_mktsegment end as c_mktsegment,
        case when c_custkey % 3 = 2 then c_custkey || '|' else '' end as extra from customer where c_acctbal >= 0
      union all select 'b', cast(c_custkey as varchar), c_name, null, '' from customer where c_acctbal < 0""",
)
def source_csv_records(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose headers differ, with quotes inside fields, line breaks inside quotes and lines of any
    width, each file cut into many blocks."""
    path = fresh_dir(spark, "csv-records")
    customers = table(spark, folder, "customer")
    key, name = F.col("c_custkey").cast("string"), F.col("c_name")
    folded = F.concat(F.lit('"'), name, F.lit(' ""x""\n5"" rod, red"'))
    odd = F.when(F.col("c_custkey") % 5 == 0, folded).otherwise(F.concat(name, F.lit(' 5" pipe')))
    segment = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    extra = F.when(F.col("c_custkey") % 3 == 2, F.concat(key, F.lit(",")))
    for file, owing, header, columns in (
        ("a", False, "c_custkey,c_name,c_mktsegment", [key, odd, segment, extra]),
        ("b", True, "c_name,c_custkey", [name, key]),
    ):
        lines = customers.where((F.col("c_acctbal") < 0) == owing).select(
            F.lit(1).alias("part"), F.concat_ws(",", *columns).alias("line")
        )
        first = spark.createDataFrame([(0, header)], "part int, line string")
        # One file, its header first.
        first.unionAll(lines).repartition(1).sortWithinPartitions("part").select("line").write.text(
            f"{path}/{file}"
        )
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        rows = delimited.read_csv_records(spark, path, suffix=".txt")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return rows.select(
        F.regexp_extract("path", "/(.)/[^/]*$", 1).alias("file"),
        *[
            F.try_element_at("record", F.lit(c)).alias(c)
            for c in ("c_custkey", "c_name", "c_mktsegment")
        ],
        F.array_join("extra", "|").alias("extra"),
    )
