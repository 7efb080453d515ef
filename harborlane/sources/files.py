"""Object-store readers. A path may be local, ``s3a://`` or ``abfss://``.

Whole-file formats give one row per file, ``path`` and content, so a bad file is one row that
the landing job rejects without touching the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from harborlane.sources import delimited, objects
from harborlane.sources.paths import plain_path

CORRUPT = "_corrupt"

# What Spark's decoder knows.
DECODABLE = ["US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"]


def whole_text(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """path and content of every file, UTF-8."""
    reader = spark.read.option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.text(path, wholetext=True).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content")
    )


def read_json_files(
    spark: SparkSession, path: str, suffix: str = ".json", complete: bool = False
) -> DataFrame:
    """Whole-file JSON: ``document`` is null where the file does not parse.

    ``complete`` reads every object, also those Spark's sources leave out: empty ones, and names that
    begin with ``_`` or ``.``.
    """
    if complete:
        found = objects.read_all_text(list_and_filter(spark, path, suffix, complete=True))
    else:
        found = whole_text(spark, path, suffix)
    return found.withColumn("document", F.try_parse_json("content"))


def read_json_lines(
    spark: SparkSession, path: str, schema: str | T.StructType, suffix: str = ""
) -> DataFrame:
    """JSON Lines with a schema; blank lines are skipped, bad lines are kept in ``_corrupt``."""
    struct = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    reader = (
        spark.read.schema(T.StructType([*struct.fields, T.StructField(CORRUPT, T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("recursiveFileLookup", True)
    )
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.json(path)


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    has_header: bool = True,
    multiline: bool = False,
    suffix: str = "",
) -> DataFrame:
    """Untyped CSV: named string columns with a header, one array column without.

    With a header the files have one shape; ``delimited.read_csv_records`` reads files of any. There
    ``multiline`` allows line breaks inside quotes, at the price of one task per file. Without a header
    rows are as wide as they are, and an empty line has no fields.
    """
    if not has_header:
        rows = delimited.read_csv_lists(spark, path, delimiter, suffix)
        return rows.select(F.col("values").alias("row"))
    reader = (
        spark.read.option("sep", delimiter)
        .option("header", True)
        .option("inferSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("recursiveFileLookup", True)
    )
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.csv(path)


def read_bytes(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(path)


def read_text(
    spark: SparkSession, path: str, encoding: str = "UTF-8", suffix: str = ""
) -> DataFrame:
    """path and text of every file in the given character set; null where UTF-8 or US-ASCII is not
    valid."""
    charset = encoding.upper()
    if charset not in DECODABLE:
        raise ValueError(f"Spark cannot decode {encoding}; objects.read_all_text can")
    raw = F.col("content")
    if charset == "UTF-8":
        decoded = F.try_validate_utf8(raw.cast("string"))
    elif charset == "US-ASCII":
        # ASCII is UTF-8 in which every character is one byte below 128.
        valid = F.try_validate_utf8(raw.cast("string"))
        decoded = F.when(F.char_length(valid) == F.octet_length(raw), valid)
    else:
        decoded = F.decode(raw, charset)
    return read_bytes(spark, path, suffix).select("path", decoded.alias("content"))


def list_objects(
    spark: SparkSession, path: str, limit: int = 0, complete: bool = False
) -> DataFrame:
    """Listing without reading content; all objects unless a limit is asked for.

    Names that begin with ``_`` or ``.`` and empty objects are only in it if it is to be ``complete``.
    """
    if complete:
        listing = objects.list_all(spark, path)
    else:
        listing = read_bytes(spark, path).select("path", "length", "modificationTime")
    return listing.orderBy("path").limit(limit) if limit else listing


def list_and_filter(
    spark: SparkSession, path: str, suffix: str = "", limit: int = 0, complete: bool = False
) -> DataFrame:
    """Keys that end with the suffix. As in a paged listing, the limit applies before the filter."""
    listing = list_objects(spark, path, limit, complete).select("path")
    return listing.where(F.col("path").endswith(suffix)) if suffix else listing


def missing_objects(manifest: DataFrame, listing: DataFrame, on: str = "path") -> DataFrame:
    """Manifest keys that the listing does not have."""
    return manifest.join(listing.select(on), on, "left_anti")


def existing_objects(manifest: DataFrame, listing: DataFrame, on: str = "path") -> DataFrame:
    return manifest.join(listing.select(on), on, "left_semi")


def split_location(path: Column) -> tuple[Column, Column]:
    """Bucket (or container) and key of an object path."""
    rest = F.regexp_replace(path, r"^[a-z0-9+.\-]+:/*", "")
    return F.substring_index(rest, "/", 1), F.regexp_replace(rest, r"^[^/]*/", "")
