"""Tables in hash buckets of their key, of which a change writes only those it touches.

A version is a numbered file that says for each bucket which folder holds it. A commit writes the
buckets it changes into a folder of its own and lists it for them; the others stay where they are, not
read and not copied, and both versions share them. Only one writer can create a version's file. If
another came first but changed other buckets, the commit goes on after it; if it changed one of the
same, the commit fails and leaves nothing behind.

Rows with equal keys are in one bucket. A null key has a bucket like any other.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from harborlane.sinks import storage

BUCKETS = 64
_BUCKET = "_bucket"


class Conflict(Exception):
    """Another writer has changed a bucket since it was read."""


@dataclass
class Version:
    """Where the rows of a version are: by bucket, a folder below ``data``."""

    number: int
    key: str
    buckets: int
    schema: T.StructType
    folders: dict[int, str]

    def text(self) -> str:
        return json.dumps({
            "key": self.key, "buckets": self.buckets, "schema": json.loads(self.schema.json()),
            "folders": self.folders,
        })

    def bucket(self, key: Column | str | None = None) -> Column:
        """The bucket of a key, by default of the table's own."""
        key = F.col(self.key) if key is None else key
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")


class BucketedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, df: DataFrame, key: str, buckets: int = BUCKETS) -> int:
        """Version 1, of all rows; fails if the table is there."""
        empty = Version(0, key, buckets, df.schema, {})
        return self._commit(empty, range(buckets), df)

    def version(self) -> int:
        """Number of the current version; 0 before the table is created."""
        names = storage.names(self.spark, f"{self.root}/_versions")
        return max((int(n) for n in names if n.isdigit()), default=0)

    def state(self, version: int | None = None) -> Version:
        number = self.version() if version is None else version
        if not number:
            raise ValueError(f"no table under {self.root}")
        held = json.loads(storage.content(self.spark, self._marker(number)))
        folders = {int(bucket): folder for bucket, folder in held["folders"].items()}
        return Version(number, held["key"], held["buckets"], T.StructType.fromJson(held["schema"]), folders)

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; the files of those only."""
        return self._read(self.state(version), buckets)

    def change(self, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the buckets of the keys in ``touched`` by what ``make`` makes of their rows.

        ``touched`` has the key's column; only different buckets of it come to the driver.
        """
        base = self.state()
        rows = touched.select(base.bucket().alias(_BUCKET)).distinct().collect()
        return self._change(base, [row[0] for row in rows], make)

    def change_where(self, match: Column, make: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the buckets that hold a row for which ``match`` is true. The search reads the
        columns of ``match`` and the key."""
        base = self.state()
        return self.change(self._read(base).where(match), make)

    def drop_before(self, version: int) -> int:
        """Delete versions older than ``version``, and the folders no other version has; how many
        folders. The current version stays."""
        current = self.version()
        numbers = [int(n) for n in storage.names(self.spark, f"{self.root}/_versions") if n.isdigit()]
        old = [n for n in numbers if n < min(version, current)]
        used = {f for n in numbers if n not in old for f in self.state(n).folders.values()}
        gone = {f for n in old for f in self.state(n).folders.values()} - used
        for number in old:
            storage.delete(self.spark, self._marker(number))
        return sum(storage.delete(self.spark, f"{self.root}/data/{folder}") for folder in gone)

    def _change(self, base: Version, touched: list[int], make: Callable[[DataFrame], DataFrame]) -> int:
        if not touched:
            return base.number
        return self._commit(base, touched, make(self._read(base, touched)))

    def _read(self, state: Version, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = state.folders if buckets is None else set(buckets)
        paths = [f"{self.root}/data/{f}" for b, f in sorted(state.folders.items()) if b in wanted]
        if not paths:
            return self.spark.createDataFrame([], state.schema)
        return self.spark.read.schema(state.schema).parquet(*paths)

    def _commit(self, base: Version, touched: Iterable[int], rows: DataFrame) -> int:
        name, touched = f"c-{uuid.uuid4().hex}", list(touched)
        folder = f"{self.root}/data/{name}"
        (
            rows.select(*base.schema.names).withColumn(_BUCKET, base.bucket())
            .hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(folder)
        )
        made = {}
        for found in storage.names(self.spark, folder):
            if found.startswith(f"{_BUCKET}="):
                made[int(found.removeprefix(f"{_BUCKET}="))] = f"{name}/{found}"
        try:
            if not set(made) <= set(touched):
                raise ValueError("a change made rows of a key whose bucket it did not name")
            while True:
                number = self.version()
                now = self.state(number) if number else Version(0, base.key, base.buckets, base.schema, {})
                if number < base.number or any(
                    now.folders.get(b) != base.folders.get(b) for b in touched
                ) or (number and not base.number):
                    raise Conflict(f"{self.root} already exists in another form than was read")
                folders = {b: f for b, f in now.folders.items() if b not in set(touched)} | made
                new = Version(number + 1, base.key, base.buckets, base.schema, folders)
                try:
                    storage.create_new(self.spark, self._marker(new.number), new.text())
                    return new.number
                except storage.Taken:
                    continue
        except Exception:
            storage.delete(self.spark, folder)
            raise

    def _marker(self, number: int) -> str:
        return f"{self.root}/_versions/{number:010d}"
