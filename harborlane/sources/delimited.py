"""CSV files of any size and width, cut into records in parallel.

A quote begins a quoted field only as the field's first character; in a quoted field delimiters and line
ends are text and a doubled quote is one quote; what stands between its last quote and the delimiter is
added to it. So whether a line end ends a record depends on all quotes before it. Files are cut in two
steps, by lines that are read once and written to the shared folder:

* each line tells whether it ends inside a quoted field if it begins outside one, and if it begins inside
  one. Files without a line of the first kind, nearly all, have a record a line, in as many tasks as they
  have blocks;
* in the others the states are passed on, by windows of a block's lines, without their texts, and then
  of a file's blocks; lines that belong together are joined, the other lines stay where they are.

No task holds more than a block and the records that begin in it. A record has its file's path and the
``line`` it begins on, from 1, by which a file's records are ordered. Lines end with a line feed, which
a carriage return may come before. Empty lines are no records. A quoted field that is not closed goes on
to the end of the file, without its last line end. A byte order mark at a file's begin is left out. The delimiter is one character.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, WindowSpec, functions as F

from harborlane import session
from harborlane.sources.paths import plain_path

#: The inside of a quoted field; no alternatives in a loop, so long texts need no deep stack.
_INSIDE = '[^"]*+(?:""[^"]*+)*+'


def _field(sep: str) -> str:
    """A whole field: quoted and closed, or not quoted."""
    return f'(?:"{_INSIDE}"[^{sep}]*+|(?!")[^{sep}]*+)'


def _open_ends(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether the line ends inside a quoted field, if it begins outside, and inside, of one."""
    rest = f'(?:{_field(sep)}{sep})*+"{_INSIDE}\\z'
    quoted = line.contains('"')
    outside = quoted & line.rlike(f"^{rest}")
    inside = ~quoted | line.rlike(f'^{_INSIDE}\\z') | line.rlike(f'^{_INSIDE}"[^{sep}]*+{sep}{rest}')
    return outside, inside


def _class(delimiter: str) -> str:
    if len(delimiter) != 1 or delimiter in '"\r\n':
        raise ValueError(f"a delimiter is one character, no quote and no line end: {delimiter!r}")
    return f"\\u{ord(delimiter):04x}" if ord(delimiter) < 1 << 16 else re.escape(delimiter)


def fields(record: Column, delimiter: str) -> Column:
    """The fields of a record; none of an empty one."""
    sep = _class(delimiter)
    # With a delimiter before it, every field begins with one.
    found = F.regexp_extract_all(
        F.concat(F.lit(delimiter), record), F.lit(f'{sep}((?:"{_INSIDE}(?:"[^{sep}]*+)?+|[^{sep}]*+))'), F.lit(1)
    )
    text = F.transform(found, lambda f: F.when(f.startswith('"'), F.concat(
        F.replace(F.regexp_extract(f, f'^"({_INSIDE})', 1), F.lit('""'), F.lit('"')),
        F.regexp_extract(f, f'(?s)^"{_INSIDE}"(.*)$', 1),
    )).otherwise(f))
    plain = F.split(record, re.escape(delimiter), -1)
    return F.when(record == "", F.array().cast("array<string>")).when(
        record.contains('"'), text
    ).otherwise(plain)


def _lines(spark: SparkSession, path: str, sep: str, suffix: str) -> DataFrame:
    """path, block, at, value, outside, inside: every line, in the order of block and at."""
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    outside, inside = _open_ends(F.col("value"), sep)
    lines = reader.text(path).select(
        plain_path(F.col("_metadata.file_path")).alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        # A task reads a block's lines one after the other.
        F.monotonically_increasing_id().alias("at"),
        "value",
        outside.alias("outside"),
        inside.alias("inside"),
    )
    written = session.fresh_dir(spark, "csv-lines")
    lines.write.parquet(written)
    return spark.read.schema(lines.schema).parquet(written)


def _joined(lines: DataFrame) -> DataFrame:
    """path, block, at, first_block, first_at, open: the lines of records of more than one line, with the
    record's first line, and whether a quoted field is still open after the line.

    A line's effect on the state, outside or inside of a quoted field, is to keep it, to change it, or
    to set it; so the state after it follows from the last line that sets it and the number of changes
    since. The same holds for blocks.
    """
    sets = F.col("outside") == F.col("inside")
    changes = (F.col("outside") & ~F.col("inside")).cast("int")

    def effects(frame: DataFrame, upto: WindowSpec) -> DataFrame:
        """Add ``value``, what the last setting line up to here sets, and ``turns``, the changes since."""
        total = F.sum("changes").over(upto)
        return (
            frame.withColumn("_total", total)
            .withColumn("value", F.last(F.when(F.col("sets"), F.col("to")), True).over(upto))
            .withColumn("_then", F.last(F.when(F.col("sets"), F.col("_total")), True).over(upto))
            .withColumn("turns", F.col("_total") - F.coalesce("_then", F.lit(0)))
        )

    def state(start: Column) -> Column:
        odd = F.col("turns") % 2 == 1
        return F.coalesce(F.col("value"), start) != odd

    block = W.partitionBy("path", "block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    own = effects(
        lines.select(
            "path", "block", "at", sets.alias("sets"), F.col("outside").alias("to"),
            F.when(sets, 0).otherwise(changes).alias("changes"),
        ),
        block,
    ).select("path", "block", "at", "value", "turns")
    # The effect of a block is that of its last line's.
    ends = own.groupBy("path", "block").agg(
        F.max_by(F.struct("value", "turns"), "at").alias("e")
    ).select(
        "path", "block", F.col("e.value").isNotNull().alias("sets"),
        (F.coalesce("e.value", F.lit(False)) != (F.col("e.turns") % 2 == 1)).alias("to"),
        F.when(F.col("e.value").isNull(), F.col("e.turns") % 2).otherwise(0).alias("changes"),
    )
    file = W.partitionBy("path").orderBy("block")
    begins = effects(ends, file.rowsBetween(W.unboundedPreceding, -1)).select(
        F.col("path"), F.col("block"), F.coalesce(state(F.lit(False)), F.lit(False)).alias("begin")
    )
    after = own.join(begins, ["path", "block"]).withColumn("open", state(F.col("begin")))
    before = F.coalesce(
        F.lag("open").over(W.partitionBy("path", "block").orderBy("at")), F.col("begin")
    )
    marked = after.withColumn("more", before).where(F.col("open") | F.col("more"))
    # A line that goes on belongs to the last line before it that does not.
    here = F.when(~F.col("more"), F.col("at"))
    marked = marked.withColumn("first_at", F.last(here, True).over(block))
    opened = marked.groupBy("path", "block").agg(F.max(here).alias("last_at"))
    earlier = file.rowsBetween(W.unboundedPreceding, -1)
    known = F.when(F.col("last_at").isNotNull(), F.struct("block", "last_at"))
    opened = opened.withColumn("earlier", F.last(known, True).over(earlier)).select("path", "block", "earlier")
    return marked.join(opened, ["path", "block"]).select(
        "path", "block", "at", "open",
        F.when(F.col("first_at").isNull(), F.col("earlier.block")).otherwise(F.col("block")).alias("first_block"),
        F.coalesce("first_at", "earlier.last_at").alias("first_at"),
    )


def read_csv_lists(
    spark: SparkSession, path: str, delimiter: str = ",", suffix: str = ".csv"
) -> DataFrame:
    """path, line and values of every record of the files below ``path``, headers included."""
    sep = _class(delimiter)
    lines = _lines(spark, path, sep, suffix)
    ended = F.rtrim(F.col("value"), F.lit("\r"))
    folded = lines.where("outside").select("path").distinct()
    # A file's lines before a block; a file has few blocks next to its lines.
    blocks = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift")
    )
    if folded.isEmpty():
        records = lines.select("path", "block", "at", ended.alias("record"))
    else:
        plain = lines.join(folded, "path", "left_anti").select("path", "block", "at", ended.alias("record"))
        some = lines.join(folded, "path", "left_semi")
        marked = some.join(_joined(some), ["path", "block", "at"], "left")
        single = marked.where(F.col("first_at").isNull()).select("path", "block", "at", ended.alias("record"))
        parts = F.sort_array(F.collect_list(F.struct("block", "at", "value", "open")))
        whole = F.array_join(F.col("parts.value"), "\n")
        closed = ~F.element_at("parts", -1)["open"]
        multiple = (
            marked.where(F.col("first_at").isNotNull())
            .groupBy("path", F.col("first_block").alias("block"), F.col("first_at").alias("at"))
            .agg(parts.alias("parts"))
            .select(
                "path", "block", "at",
                F.when(closed, F.rtrim(whole, F.lit("\r"))).otherwise(whole).alias("record"),
            )
        )
        records = plain.unionByName(single).unionByName(multiple)
    return records.join(blocks, ["path", "block"]).select(
        "path", (F.col("at") + F.col("shift")).alias("line"), fields(F.col("record"), delimiter).alias("values")
    )


def read_csv_records(
    spark: SparkSession, path: str, delimiter: str = ",", suffix: str = ".csv"
) -> DataFrame:
    """CSV files whose headers may differ: path, line, record and extra of every record.

    ``record`` maps the names of the file's own header, its first line, to text, null where the record is
    too short; ``extra`` holds the fields beyond the header. Of repeated names the last counts.
    """
    rows = read_csv_lists(spark, path, delimiter, suffix)
    headers = rows.where(F.col("line") == 1).select("path", F.col("values").alias("header"))
    rows = rows.where((F.col("line") > 1) & (F.size("values") > 0)).join(headers, "path")
    n = F.size("header")
    pairs = F.zip_with(
        "header", F.slice("values", F.lit(1), n), lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    )
    # A name that stands twice keeps its last place.
    last = F.filter(pairs, lambda p, i: ~F.exists(
        F.slice("header", i + 2, n), lambda later: later == p.getField("k")
    ))
    return rows.select(
        "path",
        "line",
        F.map_from_entries(last).alias("record"),
        F.slice("values", n + 1, F.size("values")).alias("extra"),
    )
