"""Language identification by rank order of character n-grams.

A profile is a language's ``profile_size`` most frequent n-grams of one to three characters, by rank.
A text's own most frequent n-grams are compared with each profile: an n-gram costs the difference of
its two ranks, or ``profile_size`` if the profile lacks it (the out-of-place distance). The language
with the smallest sum is predicted; equal sums go to the name that sorts first.

Texts are lower-cased; runs of characters that are neither letters nor marks become one blank, and
n-grams hold a blank only at their ends. Ties in frequency go to the smaller code points.

A text without a letter, and a null one, is ``und`` with score 0; so is every text if nothing was
learned. The score is one less the distance as a share of the largest possible one. Rows with a null
label or text teach nothing. Whole texts count, whatever their length. Repeated rows count as often
as they are there. Extra columns may have any name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harborlane.llm.common import pieces

PROFILE_SIZE, LONGEST = 300, 3
UNKNOWN = "und"
#: Profiles are compared in blocks of so many languages, which bounds a task's tables.
BLOCK = 64
#: Texts are taken together, and cut, to about so many characters, which bounds a task's memory.
SLICE = 1 << 19
_BITS = 21


def character_kinds() -> np.ndarray:
    """By code point: 2 for a letter, 1 for a mark, 0 for anything else."""
    kinds = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in "LM":
            kinds[point] = 2 if kind == "L" else 1
    return kinds


def grams(texts: list[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The packed n-grams of some texts, the number of the text each is from, and per text whether
    it has a letter. Texts without a letter have no n-grams."""
    lowered = ["\n" + t.lower() + " " for t in texts]
    joined = "".join(lowered).encode("utf-32-le", "surrogatepass")
    points = np.frombuffer(joined, dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    kind = kinds[points]
    has_letter = np.zeros(len(texts), bool)
    has_letter[owner[kind == 2]] = True
    word = kind > 0
    kept = word.copy()
    kept[1:] |= word[:-1]
    # The line feed that opens each text stands for the blank before its first word.
    kept[np.flatnonzero(np.diff(owner, prepend=-1))] = True
    kept &= has_letter[owner]
    points, owner, word = np.where(word, points, 32)[kept], owner[kept], word[kept]
    codes, owners = [points[word]], [owner[word]]
    blank = ~word
    for n in range(2, LONGEST + 1):
        if len(points) < n:
            break
        code = points[: len(points) - n + 1].copy()
        for at in range(1, n):
            code = (code << np.uint64(_BITS)) | points[at : len(points) - n + 1 + at]
        good = owner[: len(code)] == owner[n - 1 :]
        for at in range(1, n - 1):
            good &= ~blank[at : at + len(code)]
        if n == 2:
            good &= ~(blank[:-1] & blank[1:])
        codes.append(code[good])
        owners.append(owner[: len(code)][good])
    return np.concatenate(codes), np.concatenate(owners), has_letter


def slices(text: str) -> Iterator[str]:
    """Cut a long text where it has neither letter nor mark, which leaves its n-grams as they are.

    A word longer than a slice is cut as well.
    """
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end > at + SLICE // 2 and unicodedata.category(text[end])[0] in "LM":
            end -= 1
        yield text[at:end]
        at = end
    yield text[at:]


def counted(texts: Iterator[str], kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of texts, sorted, and how often they occur, a slice at a time."""
    found, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for text in texts:
        for part in slices(text):
            more, n = np.unique(grams([part], kinds)[0], return_counts=True)
            found, counts = np.concatenate([found, more]), np.concatenate([counts, n])
            found, place = np.unique(found, return_inverse=True)
            counts = np.bincount(place, counts, len(found)).astype(np.int64)
    return found, counts


def top_grams(found: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes, most frequent first, ties to the smaller code."""
    if len(found) > size:
        # What is rarer than the last one that fits cannot be among them.
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        found, counts = found[counts >= least], counts[counts >= least]
    return found[np.argsort(-counts, kind="stable")[:size]]


def each_counted(texts: list[str], kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The n-grams and counts of each text; a text without a letter has none."""
    if len(texts) == 1:
        has_letter = any(kinds[ord(c)] == 2 for c in texts[0])
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        yield counted(texts, kinds) if has_letter else none
        return
    codes, owner, _ = grams(texts, kinds)
    order = np.argsort(owner, kind="stable")
    codes, edges = codes[order], np.searchsorted(owner[order], np.arange(len(texts) + 1))
    for begin, end in zip(edges, edges[1:]):
        yield np.unique(codes[begin:end], return_counts=True)


def gram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all labelled rows, summed within pieces of a batch already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = character_kinds()
        for batch in batches:
            for piece in pieces(batch, "text", SLICE):
                by_lang: dict[str, list[str]] = {}
                for label, body in zip(piece["lang"].to_pylist(), piece["text"].to_pylist()):
                    by_lang.setdefault(label, []).append(body)
                for label, bodies in by_lang.items():
                    if len(bodies) == 1:
                        found, n = counted(bodies, kinds)
                    else:
                        found, n = np.unique(grams(bodies, kinds)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([label] * len(found), pa.string()),
                            pa.array(found.astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        ["lang", "gram", "n"],
                    )

    return (
        docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .mapInArrow(run, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", profile_size: int = PROFILE_SIZE
) -> DataFrame:
    """(lang, gram, rank): at most ``profile_size`` rows for each language, ranks from 0."""
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (
        gram_counts(docs, text, lang)
        .withColumn("rank", F.row_number().over(order) - 1)
        .where(F.col("rank") < profile_size)
        .select("lang", "gram", "rank")
    )


class Profiles:
    """Learned profiles as arrays: per block of languages the known grams, sorted, and their ranks
    in each language. Its size is ``profile_size`` rows a language, whatever was learned from."""

    def __init__(self, size: int, names: list[str], blocks: list[tuple]):
        self.size, self.names, self.blocks = size, names, blocks

    @classmethod
    def of(cls, rows: list, size: int = PROFILE_SIZE) -> Profiles:
        names, blocks = sorted({row["lang"] for row in rows}), []
        place = {name: i for i, name in enumerate(names)}
        for first in range(0, len(names), BLOCK):
            some = names[first : first + BLOCK]
            own = [r for r in rows if first <= place[r["lang"]] < first + len(some)]
            known = np.unique(np.array([r["gram"] for r in own], np.uint64))
            ranks = np.full((len(known) + 1, len(some)), -1, np.int32)
            at = np.searchsorted(known, np.array([r["gram"] for r in own], np.uint64))
            ranks[at, [place[r["lang"]] - first for r in own]] = [r["rank"] for r in own]
            blocks.append((known, ranks))
        return cls(size, names, blocks)

    def state(self) -> tuple:
        return self.size, self.names, self.blocks

    def distances(self, top: np.ndarray) -> np.ndarray:
        """The out-of-place distance of a text's ranked grams to each language, in name order."""
        parts = []
        for known, ranks in self.blocks:
            at = np.minimum(np.searchsorted(known, top), len(known) - 1)
            at[known[at] != top] = len(known)
            ranked = ranks[at]
            cost = np.abs(ranked - np.arange(len(top))[:, None])
            parts.append(np.where(ranked < 0, self.size, cost).sum(axis=0))
        return np.concatenate(parts)


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", profile_size: int = PROFILE_SIZE
) -> Profiles:
    return Profiles.of(profiles(docs, text, lang, profile_size).collect(), profile_size)


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> DataFrame:
    """(row, lang_pred, score): the whole input row as a struct, and what is predicted for it."""
    held = docs.sparkSession.sparkContext.broadcast(model.state())
    row = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, known = character_kinds(), Profiles(*held.value)
        for batch in batches:
            for piece in pieces(batch, "text", SLICE):
                bodies = [t or "" for t in piece["text"].to_pylist()]
                names, scores = [], []
                for found, counts in each_counted(bodies, kinds):
                    if not len(found) or not known.names:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    top = top_grams(found, counts, known.size)
                    far = known.distances(top)
                    best = int(far.argmin())
                    names.append(known.names[best])
                    scores.append(1.0 - float(far[best]) / (len(top) * known.size))
                yield pa.RecordBatch.from_arrays(
                    [piece["row"], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    ["row", "lang_pred", "score"],
                )

    schema = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(run, f"row {schema}, lang_pred string, score double")


def learnable(out: Column, text: str, lang: str) -> Column:
    """Rows a model may learn from: not held out, with text and label."""
    return ~out & F.col(text).isNotNull() & F.col(lang).isNotNull()
