"""Toxicity scores by FTRL-proximal logistic regression over hashed word features.

Features are the presence in a text of a word, a pair of neighbours, and a skip-gram (two words with
one between), hashed to ``2**bits`` coordinates. Words are runs of ASCII letters, digits, apostrophes
and bytes beyond ASCII, A-Z in lower case. Each coordinate has its own learning rate, and L1 keeps
all but telling ones at zero, so the weights are a short table.

Training runs in shards of labelled rows: each task goes through its shard row by row, starting from
the state all shards agreed on in the round before, and the states are averaged by coordinate in
Spark. ``max_rows`` bounds the labelled rows used (the ones with the smallest hash); below it, all
are. A null or empty text has no features and gets the score of the intercept. Labels other than 0
and 1, null ones, and null ids teach nothing; several labels of one id count as the largest. With
nothing to learn from, every score is 0.5. Extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harborlane.llm.common import pieces, stored, text_bytes

BITS = 20
MAX_ROWS, ROWS_PER_SHARD = 25_000, 12_500
ROUNDS, PASSES = 2, 5
ALPHA, BETA, L1, L2 = 3.0, 1.0, 4.0, 0.0
INTERCEPT = -1

_BASE = 0x9E3779B97F4A7C15 | 1
_WINDOW = 1 << 18


def _mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that nearby values land far apart."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class WordHashes:
    """Hashes the words of a block of bytes all at once, by differences of running sums."""

    def __init__(self):
        self.base = np.uint64(_BASE)
        self.inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.kinds = np.zeros(256, bool)
        for byte in b"0123456789'abcdefghijklmnopqrstuvwxyz":
            self.kinds[byte] = True
        self.kinds[128:] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            with np.errstate(over="ignore"):
                one = np.ones(1, np.uint64)
                up = np.full(size - 1, self.base)
                down = np.full(size - 1, self.inverse)
                self.powers = np.concatenate((one, np.cumprod(up, dtype=np.uint64)))
                self.inverses = np.concatenate((one, np.cumprod(down, dtype=np.uint64)))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and the row it is in."""
        data = self.lower[data]
        inside = self.kinds[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:-1]
        end = inside.copy()
        end[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        hashes = np.empty(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            first = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, first + _WINDOW, "right")))
            size = int(ends[to - 1] - first)
            self._grow(size + 1)
            sums = np.zeros(size + 1, np.uint64)
            block = data[first : first + size].astype(np.uint64) + np.uint64(1)
            np.cumsum(block * self.powers[:size], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            hashes[at:to] = (sums[e] - sums[s]) * self.inverses[s]
            at = to
        rows = np.searchsorted(offsets, starts, "right") - 1
        return _mixed(hashes), rows


def features(
    hasher: WordHashes, data: np.ndarray, offsets: np.ndarray, bits: int
) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, row) of every word, pair and skip-gram, repeats included."""
    words, rows = hasher.words(data, offsets)
    found, owners = [words], [rows]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0xD6E8FEB86659FD93)):
        if len(words) > gap:
            same = rows[:-gap] == rows[gap:]
            pair = words[:-gap] * np.uint64(salt) + words[gap:]
            found.append(_mixed(pair[same]))
            owners.append(rows[:-gap][same])
    shift = np.uint64(64 - bits)
    return np.concatenate(found) >> shift, np.concatenate(owners)


class Ftrl:
    """FTRL-proximal state over binary features; the intercept is neither shrunk nor sparse."""

    def __init__(self, bits: int):
        self.z = np.zeros((1 << bits) + 1)
        self.n = np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        pull = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, pull / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


def labelled(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str) -> DataFrame:
    """(id, text, label) of the rows of ``docs`` that have a label of 0 or 1."""
    marks = (
        labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    bodies = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return bodies.join(marks, "id")


def _round(sample: DataFrame, state: DataFrame, shards: int, bits: int) -> DataFrame:
    """(at, z, n): one task per shard goes on from ``state``, then the shards' states are averaged
    by coordinate."""

    def run(taught: pa.Table, start: pa.Table) -> pa.Table:
        model, hasher, rows = Ftrl(bits), WordHashes(), []
        at = start["at"].to_numpy()
        model.z[at], model.n[at] = start["z"].to_numpy(), start["n"].to_numpy()
        for batch in taught.to_batches():
            for piece in pieces(batch, "text"):
                found, owner = features(hasher, *text_bytes(piece["text"]), bits)
                order = np.argsort(owner, kind="stable")
                found, edges = found[order], np.searchsorted(owner[order], np.arange(len(piece) + 1))
                marks, keys = piece["label"].to_pylist(), piece["key"].to_pylist()
                for i, (mark, key) in enumerate(zip(marks, keys)):
                    own = np.unique(found[edges[i] : edges[i + 1]]).astype(np.int32)
                    rows.append((key, mark, np.append(own, np.int32(1 << bits))))
        rows.sort(key=lambda row: row[:2])
        for _ in range(PASSES):
            for _, mark, own in rows:
                model.learn(own, mark)
        seen = np.flatnonzero(model.n)
        return pa.table({"at": seen, "z": model.z[seen], "n": model.n[seen]})

    everywhere = state.withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))
    )
    return (
        sample.groupBy("shard")
        .cogroup(everywhere.groupBy("shard"))
        .applyInArrow(run, "at bigint, z double, n double")
        .groupBy("at")
        # A shard that has not met a coordinate holds zero for it.
        .agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n"))
    )


def train(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    bits: int = BITS,
    max_rows: int = MAX_ROWS,
) -> dict[int, float]:
    """Weights by coordinate, zero ones left out; ``INTERCEPT`` holds the intercept.

    The state is at most ``2**bits`` coordinates and stays in Spark; only the weights that L1 leaves
    come to the driver.
    """
    rows = labelled(docs, labels, label, doc_id, text)
    known = labels.where(F.col(label).isin(0, 1)).count()
    chance = min(1.0, max_rows / max(known, 1))
    shards = max(1, -(-min(known, max_rows) // ROWS_PER_SHARD))
    sample = stored(
        rows.withColumn("key", F.xxhash64("id", F.lit(label)))
        .where(F.pmod("key", F.lit(1 << 20)) < round(chance * (1 << 20)))
        .withColumn("shard", F.pmod(F.shiftright("key", 20), F.lit(shards)).cast("bigint"))
        .select("key", "shard", "text", "label"),
        "toxicity-sample",
    )
    state = docs.sparkSession.createDataFrame([], "at bigint, z double, n double")
    for _ in range(ROUNDS):
        state = stored(_round(sample, state, shards, bits), "toxicity-state")
    l1 = F.when(F.col("at") == 1 << bits, 0.0).otherwise(L1)
    weight = (F.signum("z") * l1 - F.col("z")) / ((BETA + F.sqrt("n")) / ALPHA + L2)
    rows = state.where(F.abs("z") > l1).select("at", weight.alias("weight")).collect()
    return {INTERCEPT if r["at"] == 1 << bits else r["at"]: r["weight"] for r in rows}


def score(
    docs: DataFrame, weights: dict[int, float], text: str = "text", bits: int = BITS
) -> DataFrame:
    """(row, score): the whole input row as a struct, and its probability of label 1."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = WordHashes(), np.zeros(1 << bits)
        for at, weight in held.value.items():
            if at != INTERCEPT:
                table[at] = weight
        intercept = held.value.get(INTERCEPT, 0.0)
        for batch in batches:
            for piece in pieces(batch, "text"):
                found, owner = features(hasher, *text_bytes(piece["text"]), bits)
                telling = table[found] != 0.0
                pairs = np.unique((owner[telling].astype(np.uint64) << np.uint64(bits)) | found[telling])
                sums = np.full(len(piece), intercept)
                np.add.at(
                    sums,
                    (pairs >> np.uint64(bits)).astype(np.int64),
                    table[pairs & np.uint64((1 << bits) - 1)],
                )
                made = 1.0 / (1.0 + np.exp(-np.clip(sums, -35, 35)))
                yield pa.RecordBatch.from_arrays([piece["row"], pa.array(made)], ["row", "score"])

    schema = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(run, f"row {schema}, score double")
