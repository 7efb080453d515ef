"""Tables that are replaced as a whole: write a new version, then point to it.

Every commit writes a folder of its own, whose name its marker holds, and a version counts only once
its marker exists. So the rows being read are never overwritten, a job that dies while writing
changes nothing, and of two writers that start from one version only the first to mark it counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from harborlane.sinks import storage


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def version(self) -> int:
        """Number of the current version; 0 before the first commit."""
        return max(self._marked(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        number = self.version() if version is None else version
        if number == 0:
            raise ValueError(f"no version under {self.root}")
        return self.spark.read.parquet(self._folder(number))

    def commit(
        self, df: DataFrame, partition_by: tuple[str, ...] = (), after: int | None = None
    ) -> int:
        """Write ``df`` as the version after ``after``, by default the current one. Fails, and leaves
        nothing behind, if another writer took that number first."""
        number = (self.version() if after is None else after) + 1
        name = f"v{number:010d}-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}")
        try:
            storage.create_new(self.spark, self._marker(number), name)
        except Exception:
            storage.delete(self.spark, f"{self.root}/{name}")
            raise
        return number

    def drop_before(self, version: int) -> int:
        """Delete the files of versions older than ``version``; the current one stays."""
        old = [n for n in self._marked() if n < min(version, self.version())]
        return sum(storage.delete(self.spark, self._folder(n)) for n in old)

    def _marked(self) -> list[int]:
        names = storage.names(self.spark, f"{self.root}/_versions")
        return [int(n) for n in names if n.isdigit()]

    def _marker(self, number: int) -> str:
        return f"{self.root}/_versions/{number:010d}"

    def _folder(self, number: int) -> str:
        # Markers were empty once, and the folder had the number only.
        name = storage.content(self.spark, self._marker(number)) or f"v{number:010d}"
        return f"{self.root}/{name}"
