"""Complete listings: objects that Spark's own file sources leave out.

Those skip names that begin with ``_`` or ``.`` and objects without content, and they decode seven
character sets. Here folders are listed and objects read in tasks, with the file systems of Arrow
(local, ``s3a``, ``gs``, ``abfss``, ``hdfs``), whose credentials are those of the executors'
environment. ``sources.files`` is the faster way where no such names occur.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from harborlane import session

LISTING = "path string, length bigint, modificationTime timestamp, folder boolean"

_LOCAL = "file:"
# Schemes that Arrow knows by another name.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_LISTED = pa.schema([
    ("path", pa.string()),
    ("length", pa.int64()),
    ("modificationTime", pa.timestamp("us", tz="UTC")),
    ("folder", pa.bool_()),
])


def _plain(path: str) -> str:
    """A path as listings have it; one without a scheme is local."""
    if ":" not in path.split("/")[0]:
        return _LOCAL + path
    return _LOCAL + "/" + path[len(_LOCAL):].lstrip("/") if path.startswith(_LOCAL) else path


def _root(path: str) -> str:
    """The part of a path that names its file system: scheme and bucket."""
    return _LOCAL if path.startswith(_LOCAL) else "/".join(path.split("/", 3)[:3])


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root, and what the root is called in it."""
    if root == _LOCAL:
        return pafs.LocalFileSystem(), ""
    scheme, rest = root.split(":", 1)
    fs, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")
    return fs, base.rstrip("/")


def _is_checksum(root: str, name: str) -> bool:
    """Checksum files of Hadoop's local file system are not objects."""
    return root == _LOCAL and name.startswith(".") and name.endswith(".crc")


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder in batch.column("path").to_pylist():
            root = _root(folder)
            fs, base = _open(root)
            found = [
                info
                for info in fs.get_file_info(pafs.FileSelector(base + folder[len(root):]))
                if not _is_checksum(root, info.base_name)
            ]
            columns = [
                [root + info.path[len(base):] for info in found],
                [info.size or 0 for info in found],
                [info.mtime for info in found],
                [info.type == pafs.FileType.Directory for info in found],
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, field.type) for values, field in zip(columns, _LISTED)],
                schema=_LISTED,
            )


def list_all(spark: SparkSession, path: str) -> DataFrame:
    """path, length and modificationTime of every object below a folder, whatever its name and size.

    Level by level: the folders of a level are listed in tasks, one folder by one task, and every
    level is written to the shared folder, so a lost executor repeats only its own level.
    """
    folders = spark.createDataFrame([(_plain(path).rstrip("/"),)], "path string")
    written = session.fresh_dir(spark, "listing")
    depth = 0
    while True:
        level = f"{written}/level={depth}"
        folders.mapInArrow(_children, LISTING).write.parquet(level)
        below = spark.read.schema(LISTING).parquet(level).where("folder").select("path")
        if below.isEmpty():
            break
        # Folders are few next to objects but may lie in few files of the level.
        folders = below.repartition(spark.sparkContext.defaultParallelism)
        depth += 1
    return (
        spark.read.schema(LISTING)
        .parquet(*[f"{written}/level={n}" for n in range(depth + 1)])
        .where(~F.col("folder"))
        .drop("folder")
    )


def _contents(
    batches: Iterator[pa.RecordBatch], value: Callable[[bytes], bytes | str | None], kind: pa.DataType
) -> Iterator[pa.RecordBatch]:
    """One object a batch, so a task holds one of them."""
    schema = pa.schema([("path", pa.string()), ("content", kind)])
    opened = cache(_open)
    for batch in batches:
        for path in batch.column("path").to_pylist():
            root = _root(path)
            fs, base = opened(root)
            with fs.open_input_stream(base + path[len(root):]) as stream:
                row = {"path": path, "content": value(stream.read())}
            yield pa.RecordBatch.from_pylist([row], schema=schema)


def read_all_bytes(listing: DataFrame) -> DataFrame:
    """path and content of the objects of a listing."""
    return listing.select("path").mapInArrow(
        lambda batches: _contents(batches, bytes, pa.binary()), "path string, content binary"
    )


def read_all_text(listing: DataFrame, encoding: str = "utf-8") -> DataFrame:
    """path and text of the objects of a listing, in any character set Python knows.

    The text is null where a byte is not valid in it; an object without content is empty text.
    """
    codecs.lookup(encoding)  # an unknown name fails here and not in a task

    def text(content: bytes) -> str | None:
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            return None

    return listing.select("path").mapInArrow(
        lambda batches: _contents(batches, text, pa.string()), "path string, content string"
    )


def write_all(rows: DataFrame) -> DataFrame:
    """Write each row's ``content`` (binary) to its ``path``; the paths written come back.

    An object is replaced as a whole, so a repeated task writes the same again. The action on the
    result does the writing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = cache(_open)
        for batch in batches:
            for row in batch.to_pylist():
                path = _plain(row["path"])
                root = _root(path)
                fs, base = opened(root)
                target = base + path[len(root):]
                fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with fs.open_output_stream(target) as stream:
                    stream.write(row["content"])
            yield batch.select(["path"])

    return rows.select("path", "content").mapInArrow(write, "path string")
