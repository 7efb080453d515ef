"""Near-duplicates by SimHash, found with multi-index hashing.

``fingerprints`` gives each document 64 bits: of the XXH64 hashes of its word shingles (repeats
count), bit by bit, whether more than half are set. Fingerprints that differ in at most
``max_bits`` link, and linked documents form components.

``links`` splits a fingerprint into segments. Two fingerprints within ``max_bits`` differ in one of
the segments by no more than ``max_bits // segments`` bits, so each looks up its own segment with
all values in that small Hamming ball in the table of segments, and the whole distance is checked.
Only different fingerprints take part, so a group of copies of any size is one row. A segment value
that very many fingerprints share (a large group of near copies) is not met row by row: those
fingerprints look up, by whole value, every fingerprint that is within the distance and has that
segment, so their work is bounded by the ball's size and not by the group's.

Null and empty texts, and texts without words, have fingerprint zero and link like any other.
Components name the smallest id that can be reached; null ids count only where no other is there,
then the component is null. Repeated rows keep their number. Extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from harborlane.llm.common import stored

SHINGLE_WORDS, MAX_BITS = 3, 2
SEED = 42
SEGMENTS = 2
CROWD = 512
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64 bits as a signed number."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle_words, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame, text: str, keep: list[str], shingle_words: int = SHINGLE_WORDS
) -> DataFrame:
    """The columns ``keep`` and ``fingerprint`` as a signed bigint."""
    names = [f"_{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), shingle_words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(prints, pa.int64())], [*names, "fingerprint"]
            )

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "fingerprint bigint"])
    made = docs.select(
        F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names)]
    ).mapInArrow(run, schema)
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "fingerprint")


def _segments(segments: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _masks(low: int, width: int, most: int, least: int = 0) -> list[int]:
    """All masks with ``least`` to ``most`` bits within a segment, as signed numbers."""
    found = [
        sum(1 << bit for bit in chosen)
        for n in range(least, most + 1)
        for chosen in combinations(range(low, low + width), n)
    ]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def _segment(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """(a, b) with a < b: the different fingerprints within ``max_bits``. ``prints`` has one row
    per fingerprint."""
    radius = max_bits // segments
    parts = _segments(segments)
    distance = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    table = prints.select(
        "fingerprint",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("place"),
                        _segment(F.col("fingerprint"), low, width).alias("value"),
                    )
                    for i, (low, width) in enumerate(parts)
                ]
            )
        ).alias("_s"),
    ).select("_s.place", "_s.value", "fingerprint")
    crowds = (
        table.groupBy("place", "value").count().where(F.col("count") > CROWD)
        .select("place", "value")
    )
    crowds = stored(crowds, "simhash-crowds")
    sparse = table.join(crowds, ["place", "value"], "left_anti")
    probes = prints.select(
        F.col("fingerprint").alias("a"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("place"),
                        _segment(
                            F.col("fingerprint").bitwiseXOR(F.lit(mask).cast("bigint")), low, width
                        ).alias("value"),
                    )
                    for i, (low, width) in enumerate(parts)
                    for mask in _masks(low, width, radius)
                ]
            )
        ).alias("_s"),
    ).select("_s.place", "_s.value", "a")
    # Sizes are guessed before the rows are multiplied, so a guess must not choose a broadcast.
    near = (
        probes.hint("merge")
        .join(sparse.withColumnRenamed("fingerprint", "b"), ["place", "value"])
        .where((F.col("a") != F.col("b")) & (distance("a", "b") <= max_bits))
        .select("a", "b")
    )
    return (
        near.unionAll(_crowded(prints, probes.join(crowds, ["place", "value"]), parts, max_bits))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _crowded(prints: DataFrame, probes: DataFrame, parts: list, max_bits: int) -> DataFrame:
    """Links of ``probes`` to the fingerprints that have a crowded segment value.

    With the segment fixed, the rest may differ in the bits that remain; each such fingerprint is
    looked up as a whole. Whole values are all different, so no key of this join is crowded.
    """
    whole = (1 << 64) - 1
    found = None
    for place, (low, width) in enumerate(parts):
        inside = ((1 << width) - 1) << low
        others = [bit for bit in range(64) if not inside >> bit & 1]
        masks = [
            (n, m - (1 << 64) if m >> 63 else m)
            for n in range(max_bits + 1)
            for chosen in combinations(others, n)
            for m in [sum(1 << bit for bit in chosen)]
        ]
        spent = F.bit_count(
            _segment(F.col("a"), low, width).bitwiseXOR(F.col("value"))
        )
        outside = whole & ~inside
        outside = outside - (1 << 64) if outside >> 63 else outside
        base = F.col("a").bitwiseAND(F.lit(outside).cast("bigint")).bitwiseOR(
            F.shiftleft("value", low)
        )
        ball = F.array(*[F.lit(m).cast("bigint") for _, m in masks])
        # The masks stand in the order of their bits, so a shorter budget is a prefix.
        sizes = [sum(n <= budget for n, _ in masks) for budget in range(max_bits + 1)]
        size = F.element_at(F.array(*[F.lit(s) for s in sizes]), max_bits - spent + 1)
        asked = (
            probes.where((F.col("place") == place) & (spent <= max_bits))
            .select("a", base.alias("base"), size.alias("size"))
            .select("a", F.explode(F.transform(
                F.slice(ball, F.lit(1), F.col("size")), lambda m: F.col("base").bitwiseXOR(m)
            )).alias("b"))
            .where(F.col("a") != F.col("b"))
        )
        found = asked if found is None else found.unionAll(asked)
    return (
        found.hint("merge")
        .join(prints.select(F.col("fingerprint").alias("b")), "b")
        .select("a", "b")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node with an edge.

    Each round takes the smallest label among the neighbours, then the label of that label, so
    labels spread over paths of doubling length. Every round is written to the shared folder.
    """
    both = stored(
        edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b"), F.col("a"))
        ),
        "component-edges",
    )
    labels = stored(
        both.groupBy("node").agg(F.min("other").alias("_min")).select(
            "node", F.least("node", "_min").alias("component")
        ),
        "component-labels",
    )
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), "component"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near, "node").select(
            "node", "component", F.least("component", "near").alias("next")
        )
        jumped = hooked.join(
            labels.select(F.col("node").alias("next"), F.col("component").alias("further")), "next"
        ).select("node", "component", F.least("next", "further").alias("next"))
        after = stored(jumped, "component-labels")
        changed = after.where(F.col("next") != F.col("component")).limit(1).count()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: list[str] | None = None,
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Every row's ``keep`` columns (the id if none are named), fingerprint, component_id, and
    ``component``, a fingerprint of the component, which is never null."""
    keep = [doc_id] if keep is None else keep
    prints = stored(fingerprints(docs, text, keep, shingle_words), "simhash-prints")
    groups = stored(
        prints.groupBy("fingerprint").agg(F.min(doc_id).alias("smallest")), "simhash-groups"
    )
    joined = components(links(groups.select("fingerprint"), max_bits))
    members = groups.join(joined, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "smallest", F.coalesce("component", "fingerprint").alias("component")
    )
    ids = members.groupBy("component").agg(F.min("smallest").alias("component_id"))
    of_print = members.join(ids, "component").select("fingerprint", "component_id", "component")
    return prints.join(of_print, "fingerprint").select(
        *[F.col(c) for c in keep], "fingerprint", "component_id", "component"
    )
