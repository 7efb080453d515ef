"""Exact top-k by integer inner product with a bit-sliced index.

Components become integers, ``floor(scale * x)``. A shard's index holds, for each component, bitmaps
over its rows: the leading bits of the component above its least value (``PLANES`` of them), and the
integers themselves.

A query's weights are written with digits -1, 0 and 1. Every digit adds the slices of its component
at the digit's place (their complement for -1) to the sum of all rows at once, with full adders on
bitmaps, which leaves the scores, up to the bits the index lacks, as slices themselves. From the most
significant slice downward the k-th largest is found, then the rows not below it by more than the
missing bits can make up for. Only these boundary rows are scored exactly, so results are exact.

Vectors that are null, empty, or hold nulls or non-finite numbers take no part, nor do rows with a
null id; vectors only meet vectors of their length. Integers have no bound: sums that could leave
64 bits are made of Python integers, and a score that does leave them has its right rank and is null
itself. A query is not its own candidate: rows with its id are left out. Equal scores go to the smaller id; repeated rows
are candidates, and queries, of their own. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame

from harborlane.llm.common import stored
from harborlane.llm.vectors import build, meet, parts_of, usable

SCALE, PLANES = 1024, 7
ROWS_PER_SHARD = 16_384
#: Up to here all integers are doubles.
EXACT = 1 << 53


def quantised(matrix: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers, or all as Python integers if one is beyond 2**53."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * scale)
    if np.abs(scaled).max(initial=0) <= EXACT:
        return scaled.astype(np.int64)
    whole = np.empty(matrix.size, object)
    whole[:] = [
        int(s) if math.isfinite(s) else math.floor(x) * scale
        for x, s in zip(matrix.ravel().tolist(), scaled.ravel().tolist())
    ]
    return whole.reshape(matrix.shape)


def stored_numbers(values: np.ndarray) -> dict:
    if values.dtype == object:
        return {"form": "text", "numbers": " ".join(map(str, values.ravel())).encode()}
    form = "<i4" if np.abs(values).max(initial=0) < 1 << 31 else "<i8"
    return {"form": form, "numbers": values.astype(form).tobytes()}


def read_numbers(row: dict) -> np.ndarray:
    if row["form"] == "text":
        found = np.array([int(n) for n in row["numbers"].split()], object)
    else:
        found = np.frombuffer(row["numbers"], row["form"])
    return found.reshape(-1, row["dim"])


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    padded = np.pad(packed, [(0, 0)] * (flags.ndim - 1) + [(0, short)])
    return np.ascontiguousarray(padded).view("<u8")


def slice_index(ids: np.ndarray, matrix: np.ndarray, scale: int) -> dict:
    values = quantised(matrix, scale)
    above = values - values.min(axis=0)
    lost = max(0, int(above.max()).bit_length() - PLANES)
    kept = (above >> lost).astype(np.int64)
    slices = np.stack([bitmaps((kept.T >> bit & 1).astype(bool)) for bit in range(PLANES)], axis=1)
    return {
        "ids": ids.astype("<i8").tobytes(),
        "lost": lost,
        "slices": slices.tobytes(),
        **stored_numbers(values),
    }


def signed_digits(weight: int) -> list[tuple[int, int]]:
    """(place, 1 or -1) with no two neighbouring places, which sum up to the weight."""
    found, place, sign = [], 0, 1 if weight >= 0 else -1
    weight = abs(weight)
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            found.append((place, digit * sign))
            weight -= digit
        weight >>= 1
        place += 1
    return found


def add_slices(both: np.ndarray, columns: dict[int, list[int]]) -> list[np.ndarray]:
    """Sum bitmaps of given places, lowest first: one slice of the sums for every place."""
    result, carried, place = [], [], 0
    last = max(columns, default=-1)
    width = both.shape[1]
    while place <= last or carried:
        stack = np.concatenate([both[columns.get(place, [])], *carried])
        carried = []
        while len(stack) > 2:
            third = len(stack) // 3
            a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
            half = a ^ b
            carried.append((a & b) | (c & half))
            stack = np.concatenate([half ^ c, stack[3 * third :]])
        if len(stack) == 2:
            carried.append(stack[:1] & stack[1:])
            stack = stack[:1] ^ stack[1:]
        result.append(stack[0] if len(stack) else np.zeros(width, np.uint64))
        place += 1
    return result


def boundary(slices: list[np.ndarray], eligible: np.ndarray, top: int, slack: int) -> np.ndarray:
    """The rows whose sum is at most ``slack`` below the ``top``-th largest, as a bitmap."""
    if int(np.bitwise_count(eligible).sum()) <= top:
        return eligible
    sure, equal, value = np.zeros_like(eligible), eligible, 0
    for one in reversed(slices):
        more = sure | (equal & one)
        if int(np.bitwise_count(more).sum()) >= top:
            equal, value = equal & one, value * 2 + 1
        else:
            sure, equal, value = more, equal & ~one, value * 2
    value -= slack
    if value <= 0:
        return eligible
    above, equal = np.zeros_like(eligible), eligible
    if value >> len(slices):
        return above
    for place in range(len(slices) - 1, -1, -1):
        if value >> place & 1:
            equal = equal & slices[place]
        else:
            above, equal = above | (equal & slices[place]), equal & ~slices[place]
    return above | equal


def search_shard(row: dict, query_ids: np.ndarray, matrix: np.ndarray, scale: int, top: int):
    """Positions of the queries, ids and scores of the shard's best for each."""
    dim = row["dim"]
    ids = np.frombuffer(row["ids"], "<i8")
    numbers = read_numbers(row)
    largest = int(np.abs(numbers.astype(object if numbers.dtype == object else np.int64)).max())
    slices = np.frombuffer(row["slices"], "<u8").reshape(dim * PLANES, -1)
    valid = bitmaps(np.ones(len(ids), bool))
    both = np.concatenate([slices, ~slices & valid])
    lost = row["lost"]
    at, found, scores = [], [], []
    for position, weights in enumerate(quantised(matrix, scale)):
        columns: dict[int, list[int]] = {}
        for part, weight in enumerate(weights.tolist()):
            for place, digit in signed_digits(weight):
                first = part * PLANES + (dim * PLANES if digit < 0 else 0)
                for bit in range(PLANES):
                    columns.setdefault(place + bit, []).append(first + bit)
        eligible = valid & ~bitmaps(ids == query_ids[position])
        total = sum(map(abs, weights.tolist()))
        slack = ((1 << lost) - 1) * total >> lost
        near = boundary(add_slices(both, columns), eligible, top, slack)
        rows = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
        if largest * total < 1 << 63:
            exact = numbers[rows].astype(np.int64) @ weights.astype(np.int64)
            best = np.lexsort((ids[rows], -exact))[:top]
        else:
            one = weights.tolist()
            exact = np.empty(len(rows), object)
            exact[:] = [sum(a * b for a, b in zip(n, one)) for n in numbers[rows].tolist()]
            order = sorted(range(len(rows)), key=lambda r: (-exact[r], ids[rows[r]]))
            best = np.array(order[:top], int)
        at.append(np.full(len(best), position))
        found.append(ids[rows[best]])
        scores.append(exact[best])
    return np.concatenate(at), np.concatenate(found), np.concatenate(scores)


def slice_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> tuple[DataFrame, int]:
    """The index of all vectors, written to the shared folder, and its number of shards."""
    rows = usable(vectors, vec_id, vector)
    shards = parts_of(rows.count(), ROWS_PER_SHARD)
    index = build(
        rows, shards, lambda ids, matrix: slice_index(ids, matrix, scale),
        "ids binary, lost bigint, slices binary, form string, numbers binary",
    )
    return stored(index, "topk-index"), shards


def search(
    vectors: DataFrame,
    is_query: Column,
    top: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = SCALE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows with ``is_query``, a condition on ``vec_id``."""
    index, shards = slice_vectors(vectors, vec_id, vector, scale)
    queries = usable(vectors, vec_id, vector).where(is_query)
    return meet(
        index, queries, shards,
        lambda row, ids, matrix: search_shard(row, ids, matrix, scale, top), top, "bigint",
    )
