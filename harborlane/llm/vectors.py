"""What the two vector searches share: which vectors take part, shards, and the merge of results.

A search index is built shard by shard, and a shard has a bounded number of rows. Queries come in
blocks about as large as a shard; every block meets every shard once, and the best of each meeting are
merged per query. So a shard is sent once for some ``QUERIES_PER_BLOCK`` queries. Vectors only meet vectors of the same length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

QUERIES_PER_BLOCK = 16_384

#: Key of a shard, and of a meeting of a shard with a block of queries.
SHARD = ["dim", "shard"]
MEETING = [*SHARD, "block"]


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector as doubles) of the rows with an id and a vector of finite numbers."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(
            F.col(vec_id).cast("bigint").alias("vec_id"),
            F.col(vector).cast("array<double>").alias("vector"),
        )
        .where(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
        .where(finite)
    )


def _dealt(vectors: DataFrame, name: str, count: int) -> DataFrame:
    """Deal rows to ``count`` numbers; copies of a row do not stay together."""
    spread = F.xxhash64("vec_id", "vector", F.spark_partition_id())
    return vectors.withColumn("dim", F.size("vector").cast("bigint")).withColumn(
        name, F.pmod(spread, F.lit(count))
    )


def parts_of(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def build(vectors: DataFrame, shards: int, index: Callable, schema: str) -> DataFrame:
    """One row per shard, made by ``index(ids, matrix)`` from all its rows: a dict of columns."""

    def run(table: pa.Table) -> pa.Table:
        made = index(table["vec_id"].to_numpy(), matrix(table["vector"], table["dim"][0].as_py()))
        key = {c: [table[c][0].as_py()] for c in SHARD}
        return pa.table(key | {c: [v] for c, v in made.items()})

    dealt = _dealt(vectors, "shard", shards)
    return dealt.groupBy(*SHARD).applyInArrow(run, f"dim bigint, shard bigint, {schema}")


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def split_scores(scores: np.ndarray) -> tuple[np.ndarray, list[int], list[bytes]]:
    """Integers as 64-bit ones (none beyond), -1, 0 or 1 for below, within or above them, and for
    those beyond bytes in their order."""
    if scores.dtype != object:
        return scores, [0] * len(scores), [b""] * len(scores)
    sides = [0 if -(1 << 63) <= s < 1 << 63 else 1 if s > 0 else -1 for s in scores]
    bytes_ = []
    for score, side in zip(scores, sides):
        raw = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big") if side else b""
        key = len(raw).to_bytes(4, "big") + raw if side else b""
        bytes_.append(key if side >= 0 else bytes(255 - b for b in key))
    return [None if side else s for s, side in zip(scores, sides)], sides, bytes_


def meet(
    index: DataFrame, queries: DataFrame, shards: int, search: Callable, top: int, kind: str
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` best of each query over all shards.

    ``search(index row, ids, matrix)`` gives for a block of queries the positions of queries, the
    ids found and their scores, at least the ``top`` best of the shard for each query. Equal query
    rows each have their own result. Integer scores may be Python integers; one beyond 64 bits has its
    rank and is null.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "query", "vec_id", "score"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.float64() if kind == "double" else pa.int64()]
        if kind == "bigint":
            names, types = [*names, "side", "beyond"], [*types, pa.int64(), pa.binary()]
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in types], names)
        row = {c: left[c][0].as_py() for c in left.column_names}
        ids = right["vec_id"].to_numpy()
        at, found, score = search(row, ids, matrix(right["vector"], row["dim"]))
        scores = [score] if kind == "double" else split_scores(score)
        columns = [ids[at], right["query"].to_numpy()[at], found, *scores]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names)

    beyond = ", side bigint, beyond binary" if kind == "bigint" else ""
    # At least a meeting for each core, however few shards there are.
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(parts_of(queries.count(), QUERIES_PER_BLOCK), parts_of(cores, shards))
    asked = _dealt(queries, "block", blocks).withColumn("query", F.monotonically_increasing_id())
    met = (
        index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        .groupBy(*MEETING)
        .cogroup(
            asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
            .groupBy(*MEETING)
        )
        .applyInArrow(run, f"query_id bigint, query bigint, vec_id bigint, score {kind}{beyond}")
    )
    best = [F.desc("score")]
    if beyond:
        best = [F.desc("side"), F.desc("score"), F.desc("beyond")]
    order = W.partitionBy("query_id", "query").orderBy(*best, "vec_id")
    return (
        met.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .select("query_id", "rank", "vec_id", "score")
    )


def divisible(by: int) -> Column:
    return F.col("vec_id") % by == 0
