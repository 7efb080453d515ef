"""Removal of lines that many documents share, with levelled sorted runs of line hashes.

A line's key is the line without surrounding ASCII white space, A-Z in lower case. Keys are held as
128-bit hashes. A run is a table of (key, documents, texts) in hash buckets, each one file sorted by key;
batches of documents come in one after the other:

* the keys of a batch are counted, each once per document;
* keys that an earlier run alone shows to be frequent are settled: the batch is merge-joined with the
  runs, which are read in their order without being sorted or dealt out again, and loses those keys; so
  a line that a third of all documents share costs later batches nothing;
* what is left becomes a run of level 0, and when a level has ``fanout`` runs, they are merged into
  one run of the next level, counts added, and their tables and files dropped. The last ones go when
  the frequent keys are written.

A key's total is the sum over the runs, which is below the true count only for settled keys. The
documents then drop the lines of all keys with a total of ``min_docs`` or more. The lines meet the
keys in a join, but for those of the most common keys, at most ``COMMON`` by count, which are sent to
all tasks: a key with so many lines would meet them in one.

Equal texts are handled once: the lines of a text, not of a document, meet the runs, and the number
of documents with that text is carried as a weight. No step needs an id of the rows, so null and
repeated ids are no matter: every row is a document, and repeated rows count as many as they are. A
null or empty text is one empty line, whose key is too short to be dropped. Extra columns are kept
by ``drop_lines`` whatever they are called.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborlane import session
from harborlane.llm.common import ASCII_SPACE, LOWER, UPPER, stored
from harborlane.sinks import storage

MIN_DOCS, MIN_CHARS = 10, 1
BATCHES, FANOUT = 4, 3
#: A key that holds this part of all lines is common; there are no more of them than this.
COMMON = 1000
#: Buckets of one file count as sorted.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


@contextmanager
def ordered_buckets(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ORDERED, "false")
    spark.conf.set(ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.set(ORDERED, before)


class LineRuns:
    """The runs, each a bucketed and sorted table in the shared folder."""

    def __init__(self, spark, buckets: int | None = None, fanout: int = FANOUT):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.fanout = fanout
        self.levels: list[list[str]] = []

    def add(self, counts: DataFrame, min_docs: int) -> None:
        """Take in the (key, documents) of a batch, without the keys that are settled."""
        # Only here: sorted tables one after the other, as a merge reads them, are not sorted.
        with ordered_buckets(self.spark):
            for run in self.runs():
                settled = run.where(F.col("documents") >= min_docs)
                counts = counts.join(settled.hint("merge"), "key", "left_anti")
            name = self._written(counts)
        self._put(name, 0)

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def totals(self) -> DataFrame:
        """(key, documents, texts) over all runs."""
        return self._merged([name for level in self.levels for name in level])

    def drop(self) -> None:
        """Drop all runs; what was read from them and not written is gone."""
        for level in self.levels:
            self._drop(level)
        self.levels = []

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._put(self._written(self._merged(old)), level + 1)
            self._drop(old)

    def _merged(self, names: list[str]) -> DataFrame:
        """The sums by key of several runs. They are read as plain files: a union of bucketed tables
        passes for bucketed itself, but has a partition for each bucket of each table, so equal keys
        would not meet."""
        runs = [
            self.spark.read.schema(self.spark.table(name).schema).parquet(f"{self._folder()}/{name}")
            for name in names
        ]
        union = runs[0]
        for run in runs[1:]:
            union = union.unionByName(run)
        counts = [name for name in union.columns if name != "key"]
        return union.groupBy("key").agg(*[F.sum(name).alias(name) for name in counts])

    def _written(self, counts: DataFrame) -> str:
        name = f"harborlane_run_{uuid.uuid4().hex}"
        (
            counts.repartition(self.buckets, "key")
            .write.bucketBy(self.buckets, "key")
            .sortBy("key")
            .option("path", f"{self._folder()}/{name}")
            .saveAsTable(name)
        )
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            storage.delete(self.spark, f"{self._folder()}/{name}")

    def _folder(self) -> str:
        return f"{session.work_dir(self.spark)}/harborlane/llm-line-runs"


def text_lines(docs: DataFrame, text: str, min_chars: int, batches: int) -> DataFrame:
    """One row per different text: its hash, number of documents, batch, and its lines' keys.

    A line whose key is too short has a null key.
    """
    key = F.transform(
        lines_of(F.col("text")),
        lambda line: F.when(
            F.char_length(line_key(line)) >= min_chars, F.unhex(F.md5(line_key(line)))
        ),
    )
    return (
        docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"))
        .select(F.unhex(F.md5("text")).alias("text_id"), key.alias("keys"))
        .groupBy("text_id")
        .agg(F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
        .withColumn("batch", F.pmod(F.xxhash64("text_id"), F.lit(batches)))
    )


def dropped_positions(
    docs: DataFrame,
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """(text_id, positions): the lines, counted from 0, that each different text loses."""
    texts = stored(text_lines(docs, text, min_chars, batches), "line-keys")
    runs = LineRuns(docs.sparkSession, fanout=fanout)
    for batch in range(batches):
        runs.add(
            texts.where(F.col("batch") == batch)
            .select("copies", F.explode(F.array_distinct("keys")).alias("key"))
            .where(F.col("key").isNotNull())
            .groupBy("key")
            .agg(F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("texts")),
            min_docs,
        )
    frequent = stored(runs.totals().where(F.col("documents") >= min_docs), "frequent-lines")
    runs.drop()
    return _positions(texts, frequent)


def _positions(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(text_id, positions) of the lines with a key in ``frequent``, those of common keys apart."""
    lines = texts.agg(F.sum(F.size("keys"))).first()[0] or 0
    # Each common key stands in so many different texts that there are at most COMMON of them.
    common = frequent.where(F.col("texts") * COMMON >= lines).select("key")
    rare = frequent.where(F.col("texts") * COMMON < lines).select("key")
    placed = texts.select("text_id", F.posexplode("keys").alias("position", "key")).where(
        F.col("key").isNotNull()
    )
    marked = placed.join(F.broadcast(common.withColumn("common", F.lit(True))), "key", "left")
    found = marked.where("common").select("text_id", "position").unionAll(
        marked.where(F.col("common").isNull()).join(rare.hint("merge"), "key").select("text_id", "position")
    )
    return found.groupBy("text_id").agg(F.sort_array(F.collect_list("position")).alias("positions"))


def drop_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` as (row, lines, dropped, kept): the whole input row as a struct, its lines, how many
    are dropped, and the text of the others joined by line feeds."""
    positions = dropped_positions(docs, text, **options)
    row = docs.select(
        F.struct("*").alias("row"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("text_id"),
    )
    body = F.coalesce(F.col("row")[text], F.lit(""))
    lines = lines_of(F.col("row")[text])
    # The runs of lines between two dropped ones, so the work is linear in a text's lines.
    between = F.zip_with(
        F.concat(F.array(F.lit(-1)), "positions"),
        F.concat("positions", F.array(F.size(lines))),
        lambda before, after: F.slice(lines, before + 2, after - before - 1),
    )
    kept = F.array_join(F.flatten(between), "\n")
    return row.join(positions, "text_id", "left").select(
        "row",
        F.size(lines).cast("bigint").alias("lines"),
        F.coalesce(F.size("positions"), F.lit(0)).cast("bigint").alias("dropped"),
        F.when(F.col("positions").isNull(), body).otherwise(kept).alias("kept"),
    )
