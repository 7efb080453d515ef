"""Landing: JSON objects to documents with lineage, one bad file never touching the others.

Input is one row per object: run_id, bucket, key and whole content. All three outputs, documents,
rejects and statistics, come from one parse.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harborlane.functions import conf
from harborlane.sources import files

SUFFIX = ".json"


def objects_from(whole_files: DataFrame, run_id: Column) -> DataFrame:
    """Landing input from a whole-file read (path, content)."""
    bucket, key = files.split_location(F.col("path"))
    return whole_files.select(
        run_id.alias("run_id"), bucket.alias("bucket"), key.alias("key"), "content"
    )


def is_wanted(key: Column, suffix: str = SUFFIX) -> Column:
    """Not a folder, and of the right format."""
    return ~key.endswith("/") & key.endswith(suffix)


def skip_reason(key: Column, suffix: str = SUFFIX) -> Column:
    return F.when(key.endswith("/"), "folder").when(~key.endswith(suffix), "format")


def parse_objects(objects: DataFrame, suffix: str = SUFFIX) -> DataFrame:
    """Add ``records`` (array of variants), ``status`` and ``error`` to each object.

    The content is parsed as the only element of a list, which also rejects text after the
    document, as in a JSON Lines file with the wrong name. A list is parsed into its elements, so
    the size limit of a variant holds per record and not per file.
    """
    key = F.col("key")
    wrapped = F.concat(F.lit("["), F.col("content"), F.lit("]"))
    head, one, many = F.col("_head"), F.col("_one"), F.col("_many")
    first = F.regexp_extract("content", r"^\s*(\S)", 1)
    parsed = (
        objects.withColumn("skipped", skip_reason(key, suffix))
        .withColumn("_head", F.when(F.col("skipped").isNull(), first))
        # Columns of their own, so each file is parsed once.
        .withColumns(
            {
                "_one": F.when(head != "[", F.from_json(wrapped, "array<variant>")),
                "_many": F.when(head == "[", F.from_json(wrapped, "array<array<variant>>")),
            }
        )
    )
    records = F.when((head == "{") & (F.size(one) == 1), one).when(
        F.size(many) == 1, F.try_element_at(many, F.lit(1))
    )
    objects_only = F.forall("records", lambda r: r.try_cast(conf.VARIANT_MAP).isNotNull())
    parsed = parsed.withColumn("records", records).withColumn("_objects_only", objects_only)
    scalar = (head != "{") & (F.size(one) == 1)
    # Messages users see.
    error = (
        F.when(F.col("skipped").isNotNull(), F.lit(None))
        .when(F.col("_objects_only"), F.lit(None))
        .when(
            F.col("records").isNotNull(),
            F.concat(F.lit("Error processing "), key, F.lit(": record is not an object")),
        )
        .when(scalar, F.concat(F.lit("Unexpected data type in "), key))
        .otherwise(F.concat(F.lit("JSON parse error in "), key))
    )
    status = (
        F.when(F.col("skipped").isNotNull(), "skipped")
        .when(F.col("error").isNotNull(), "error")
        .otherwise("processed")
    )
    return (
        parsed.withColumn("error", error)
        .withColumn("status", status)
        .drop("_head", "_one", "_many", "_objects_only")
    )


def documents(parsed: DataFrame, now: Column) -> DataFrame:
    """One row per record with its lineage; the id repeats when the same file is read again."""
    rows = parsed.where(F.col("status") == "processed").select(
        "run_id", "bucket", "key", F.posexplode("records").alias("position", "document")
    )
    return rows.select(
        F.sha2(
            F.concat_ws("\u0001", "bucket", "key", F.col("position").cast("string")), 256
        ).alias("document_id"),
        "run_id",
        "document",
        now.alias("_import_timestamp"),
        F.col("bucket").alias("_source_bucket"),
        F.col("key").alias("_source_key"),
    )


def rejects(parsed: DataFrame) -> DataFrame:
    """Files that were not loaded, with the reason."""
    return parsed.where(F.col("status") == "error").select("run_id", "bucket", "key", "error")


def data_errors(parsed: DataFrame) -> DataFrame:
    """Rejects as errors of the execute task. A bare value is counted but not reported as one."""
    return (
        rejects(parsed)
        .where(~F.col("error").startswith("Unexpected data type"))
        .select(
            "run_id",
            F.lit("execute").alias("task_id"),
            F.lit("DATA_ERROR").alias("error_code"),
            F.col("error").alias("message"),
            F.col("key").alias("seq"),
        )
    )


def transfer_stats(parsed: DataFrame) -> DataFrame:
    """Per run: objects listed and skipped, files processed, records read and written, errors."""
    size = F.coalesce(F.when(F.col("records").isNotNull(), F.size("records")), F.lit(0))
    done = F.col("status") == "processed"
    return parsed.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("objects"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(done).alias("files_processed"),
        F.sum(size).alias("records_read"),
        F.sum(F.when(done, size).otherwise(0)).alias("records_written"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )


def source_presence(runs: DataFrame, objects: DataFrame) -> DataFrame:
    """Per run whether its bucket and prefix hold any object.

    ``runs`` has run_id, bucket and prefix; no prefix means the whole bucket. Keys are cut to the prefix lengths that are asked for
    in their bucket (a key has at most 1024 characters) and counted per prefix before the join, so
    a large bucket is reduced in every task and runs never meet its objects in pairs.
    """
    runs = runs.withColumn("prefix", F.coalesce("prefix", F.lit("")))
    lengths = runs.groupBy("bucket").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    cut = objects.join(lengths, "bucket").select(
        "bucket", "key", F.explode("lengths").alias("length")
    )
    counts = (
        cut.where(F.length("key") >= F.col("length"))
        .select("bucket", F.col("key").substr(F.lit(1), F.col("length")).alias("prefix"))
        .groupBy("bucket", "prefix")
        .agg(F.count(F.lit(1)).alias("files"))
    )
    n = F.coalesce("files", F.lit(0)).cast("bigint")
    return runs.join(counts, ["bucket", "prefix"], "left").select(
        "run_id", n.alias("files"), (n > 0).alias("has_objects")
    )


# What the two sink collections demand, as field -> (type, required).
RECORD_RULES = {
    "id": ("int", True),
    "name": ("string", True),
    "value": ("int", False),
    "timestamp": ("date", False),
    "metadata": ("object", False),
}
IMPORT_RULES = {
    "source_bucket": ("string", True),
    "source_key": ("string", True),
    "imported_at": ("date", True),
    "data": ("array", False),
}


def violations(document: Column, rules: dict[str, tuple[str, bool]]) -> Column:
    """Array of the rules a document breaks.

    JSON has no date type, so a date is text that reads as a timestamp.
    """

    def of(field: str, kind: str, required: bool) -> Column:
        value = F.try_variant_get(document, f"$.{field}", "variant")
        shape = F.schema_of_variant(value)
        fits = {
            "int": shape == "BIGINT",
            "string": shape == "STRING",
            "object": shape.startswith("OBJECT"),
            "array": shape.startswith("ARRAY"),
            "date": (shape == "STRING")
            & F.try_variant_get(document, f"$.{field}", "string").try_cast("timestamp").isNotNull(),
        }[kind]
        absent = F.when(value.isNull(), F.lit(f"{field} is required")) if required else None
        wrong = F.when(value.isNotNull() & ~fits, F.lit(f"{field} must be {kind}"))
        return wrong if absent is None else F.coalesce(absent, wrong)

    return F.array_compact(F.array(*[of(f, k, r) for f, (k, r) in rules.items()]))


def conforming(docs: DataFrame, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """Add ``violations``; empty means the sink takes the document."""
    return docs.withColumn("violations", violations(F.col("document"), rules))


def first_per_key(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Add ``is_first``: true for the row a unique index would keep, by ``order``.

    The keeper of each key is a partial aggregate; joining it back has one row per key on that
    side, so the rows of a hot key can be split instead of meeting in one window. ``order`` must
    be unique within a key. As in a unique index, nulls are equal to each other.
    """
    names = [f"_key_{i}" for i in range(len(key))]
    keepers = df.groupBy(*[F.col(k).alias(n) for k, n in zip(key, names)]).agg(
        F.min(order).alias("_keeper")
    )
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names)]
    return (
        df.join(keepers, same, "left")
        .withColumn("is_first", F.col(order) == F.col("_keeper"))
        .drop("_keeper", *names)
    )
