"""Positions in one global order, without sorting everything in one task.

Rows are cut into ranges of an integer key; each range is numbered on its own and shifted by the
rows before it. Only the range counts are summed, in two levels, so the last step sees one row
per million ranges of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_position(
    df: DataFrame, key: str, ties: list[Column], width: int = 10_000, name: str = "position"
) -> DataFrame:
    """Add the 0-based position of each row in the order of ``key`` and then ``ties``.

    ``key`` is an integer column, not negative, with a bounded number of rows per value; ``width``
    is how many key values share a range. The rows are computed twice, once for the counts with
    the key column only; write them first if they are costly to make.
    """
    ranged = df.withColumn("_range", F.expr(f"`{key}` div {width}"))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows")).withColumn(
        "_block", F.expr("_range div 1000")
    )
    inside = W.partitionBy("_block").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    blocks = counts.groupBy("_block").agg(F.sum("_rows").alias("_block_rows"))
    # One row per block of a thousand ranges.
    before = W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_inside", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
        .join(
            blocks.select(
                "_block", F.coalesce(F.sum("_block_rows").over(before), F.lit(0)).alias("_before")
            ),
            "_block",
        )
        .select("_range", (F.col("_before") + F.col("_inside")).alias("_offset"))
    )
    within = F.row_number().over(W.partitionBy("_range").orderBy(F.col(key), *ties)) - 1
    return (
        ranged.withColumn("_within", within)
        .join(offsets, "_range")
        .withColumn(name, (F.col("_offset") + F.col("_within")).cast("bigint"))
        .drop("_range", "_within", "_offset")
    )
