"""Table reads: parquet tables and equality lookups."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAX_PAGE = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table; filters and columns are pushed to the database by Spark."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def document_store(spark: SparkSession, fmt: str = "mongodb", **options: str) -> DataFrame:
    """A document collection through whatever connector the cluster has installed."""
    return spark.read.format(fmt).options(**options).load()


def matching(**wanted: Any) -> Column | None:
    """Conjunction of equality tests; an argument that is None adds nothing."""
    tests = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return reduce(lambda a, b: a & b, tests) if tests else None


def page(
    df: DataFrame, order: str, limit: int = 100, offset: int = 0, most: int = MAX_PAGE
) -> DataFrame:
    """Rows of one page in the order of a unique column."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    return df.orderBy(order).offset(offset).limit(limit)


def find(df: DataFrame, limit: int = 0, **wanted: Any) -> DataFrame:
    """Rows equal to every given value; limit 0 means all of them."""
    test = matching(**wanted)
    found = df if test is None else df.where(test)
    return found.limit(limit) if limit else found
