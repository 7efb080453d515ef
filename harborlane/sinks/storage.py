"""Small file-system steps on the shared folder, through Hadoop so any scheme works."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Schemes on which a plain create fails if the file is there, whoever asks first.
EXCLUSIVE = {"file", "hdfs", "viewfs", "abfs", "abfss", "ofs"}
#: Schemes with a create that the store itself refuses if the file is there, when asked for.
CONDITIONAL = {"s3a"}
_CONDITION = "fs.option.create.conditional.overwrite"


class Taken(Exception):
    """The file is there already."""


def _file_system(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder; empty if there is none."""
    target, fs = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(target))


def create_new(spark: SparkSession, path: str, text: str = "") -> None:
    """Create a file with an ASCII text; ``Taken`` if it is there, which is how two writers notice each
    other.

    A store that only looks before it writes would let both through, so schemes not known to refuse
    the second one are refused here.
    """
    target, fs = _file_system(spark, path)
    scheme = fs.getUri().getScheme()
    if scheme not in EXCLUSIVE | CONDITIONAL:
        raise ValueError(f"{scheme} is not known to create a file only if it is not there")
    try:
        if scheme in CONDITIONAL:
            # ``must`` fails where the file system does not know the option.
            stream = fs.createFile(target).recursive().overwrite(True).must(_CONDITION, True).build()
        else:
            stream = fs.create(target, False)
        stream.writeBytes(text)
        stream.close()
    except Py4JJavaError as error:
        if fs.exists(target):
            raise Taken(f"{path} already exists") from error
        raise


def content(spark: SparkSession, path: str) -> str:
    target, fs = _file_system(spark, path)
    stream = fs.open(target)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def delete(spark: SparkSession, path: str) -> bool:
    target, fs = _file_system(spark, path)
    return fs.exists(target) and fs.delete(target, True)


def replace(spark: SparkSession, path: str, by: str) -> None:
    """Put the folder ``by`` in the place of ``path``."""
    target, fs = _file_system(spark, path)
    source, _ = _file_system(spark, by)
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{by} could not be renamed to {path}")
