"""A partitioned store that grows by segments, and is merged, erased and read through a list of them.

A segment is a folder ``data/segment=NAME`` with the rows of one write, partitioned by the store's
columns below it. A write has a name, so a repeated write replaces its own rows and nothing else.
Merging writes the rows of several segments into one and lists it in place of them; the list is a
numbered file that only one writer can create, so a merge that was overtaken by another, or by an
erasure, has no effect. Segments that were replaced stay until the next merge, for readers that have
listed them.

Merges go by levels: ``fanout`` segments of a level make one of the next, so a row is written again as
often as the store has levels, and readers meet few segments, whatever their number once was. The
folders of a partition value are found by name in every segment; nothing else is listed to read or
erase them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, types as T

from harborlane.sinks import storage

FANOUT = 8
SUCCESS = "_SUCCESS"


@dataclass
class Listing:
    """A state of the store: its merged segments, and written ones that are in a merged one."""

    number: int = 0
    merged: list[str] = field(default_factory=list)
    replaced: list[str] = field(default_factory=list)

    def text(self) -> str:
        return json.dumps({"merged": self.merged, "replaced": self.replaced})


class SegmentedStore:
    def __init__(
        self, spark: SparkSession, root: str, schema: str | T.StructType, partition_by: tuple[str, ...]
    ):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        self.partition_by = partition_by

    def write(self, df: DataFrame, name: str) -> None:
        """Add a segment; one of that name is replaced. Names of merged segments begin with ``m``."""
        if not name.replace("-", "").isalnum() or name.startswith("m"):
            raise ValueError(f"not a segment name: {name!r}")
        self._write(df, name)

    def read(self, without: str | None = None, **values: str) -> DataFrame:
        """All rows, or those of the first partition columns' values; of the folders of those only.

        ``without`` leaves out one written segment.
        """
        names = [name for name in self.segments() if name != without]
        return self._frame(names, values)

    def segments(self) -> list[str]:
        """Names of the segments that hold the rows now."""
        # Listed before the list is read: what a merge replaces in between is in both or in neither.
        there = self._written()
        listing = self.listing()
        fresh = [n for n in there if n not in listing.replaced and self._complete(n)]
        return sorted(fresh) + listing.merged

    def listing(self) -> Listing:
        names = [n for n in storage.names(self.spark, f"{self.root}/_lists") if n.isdigit()]
        if not names:
            return Listing()
        text = storage.content(self.spark, f"{self.root}/_lists/{max(names)}")
        return Listing(int(max(names)), **json.loads(text))

    def merge(self, fanout: int = FANOUT, open_: str | None = None) -> list[str]:
        """Merge segments, where a level has ``fanout`` of them; names of those made.

        ``open_`` is a segment that may yet be written again.
        """
        made = []
        while True:
            listing = self.listing()
            fresh = [n for n in self.segments() if not n.startswith("m") and n != open_]
            level, some = 1, fresh
            while len(some) < fanout:
                some = [n for n in listing.merged if n.startswith(f"m{level}-")]
                if not some:
                    return made
                level += 1
            name = f"m{level}-{uuid.uuid4().hex}"
            self._write(self._frame(some, {}), name)
            rest = [n for n in listing.merged if n not in some]
            if not self._commit(listing, [*rest, name], [n for n in some if not n.startswith("m")]):
                storage.delete(self.spark, self._path(name))
                return made
            made.append(name)

    def erase(self, **values: str) -> int:
        """Delete the folders of the first partition columns' values in every segment, listed or not;
        how many there were.

        A merge that read rows of theirs before cannot be listed any more afterwards, and if one was
        listed meanwhile, its folders are deleted too.
        """
        below, count = self._below(values), 0
        if not below:
            raise ValueError("an erasure names what it erases")
        while True:
            listing = self.listing()
            for name in self._folders():
                count += storage.delete(self.spark, f"{self._path(name)}/{below}")
            if self._commit(listing, listing.merged, [], drop=False):
                return count

    def _commit(self, old: Listing, merged: list[str], replaced: list[str], drop: bool = True) -> bool:
        """List ``merged`` as the merged segments, unless another list came after ``old``. The segments
        ``old`` had as replaced, and merged ones that are not listed any more, go."""
        gone = old.replaced if drop else []
        new = Listing(old.number + 1, merged, [n for n in old.replaced if n not in gone] + replaced)
        try:
            storage.create_new(self.spark, f"{self.root}/_lists/{new.number:010d}", new.text())
        except storage.Taken:
            return False
        if drop:
            known = {*merged, *old.merged}
            for name in self._folders():
                if name in gone or (name.startswith("m") and name not in known):
                    storage.delete(self.spark, self._path(name))
        return True

    def _folders(self) -> list[str]:
        names = storage.names(self.spark, f"{self.root}/data")
        return [n.removeprefix("segment=") for n in names if n.startswith("segment=")]

    def _written(self) -> list[str]:
        return [n for n in self._folders() if not n.startswith("m")]

    def _complete(self, name: str) -> bool:
        return storage.exists(self.spark, f"{self._path(name)}/{SUCCESS}")

    def _path(self, name: str) -> str:
        return f"{self.root}/data/segment={name}"

    def _below(self, values: dict[str, str]) -> str:
        if list(values) != list(self.partition_by[: len(values)]):
            raise ValueError(f"the store is partitioned by {self.partition_by}")
        for value in values.values():
            # Spark writes other characters of a value in another way, and dots could leave the folder.
            if not value or not value.replace("-", "").replace("_", "").isalnum() or not value.isascii():
                raise ValueError(f"not a plain value: {value!r}")
        return "/".join(f"{column}={value}" for column, value in values.items())

    def _frame(self, names: list[str], values: dict[str, str]) -> DataFrame:
        below = self._below(values)
        paths = [f"{self._path(n)}/{below}".rstrip("/") for n in names]
        if below:
            paths = [path for path in paths if storage.exists(self.spark, path)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*paths).select(*self.schema.names)

    def _write(self, df: DataFrame, name: str) -> None:
        """With few files per folder: ``rebalance`` groups rows by folder and lets the adaptive planner
        split a folder that holds a large share of the rows over several tasks."""
        (
            df.select(*self.schema.names).hint("rebalance", *self.partition_by)
            .write.mode("overwrite").partitionBy(*self.partition_by).parquet(self._path(name))
        )
