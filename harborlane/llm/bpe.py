"""Byte-pair encoding and decoding, with texts cut at certain token borders first.

No token holds a pair of neighbouring bytes that stands in no entry of the vocabulary, so between
such bytes every encoding has a border, whatever surrounds them. White space stands in no entry: a
text is cut there first. Within a word the other absent pairs cut it further. The fragments are
encoded on their own, each once as long as it is remembered, and their ids are concatenated.

The vocabulary file is that of the ``tokenizers`` library, whose normaliser and pre-tokeniser are
used as they are; merging is done here. Texts of any length are encoded whole, in time that grows as
n log n with the longest uncut fragment. A null text is empty, and an empty text has no ids. Repeated
rows are encoded each. Every column named to be kept is kept, and no other is looked at.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harborlane.llm.common import pieces

REMEMBERED = 1 << 17
LONGEST_REMEMBERED = 64
#: Up to so many bytes, all pairs are looked through for each merge; beyond, they wait in a heap.
SHORT = 64
NONE = 1 << 60


class Memory:
    """What was computed lately, in two generations of bounded size."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.old.get(key)
        if value is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


#: Visible ASCII and the precomposed Latin letters whose lower case is one letter.
PLAIN = re.compile("[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u0148\u014a-\u017e]+")
PLAIN_LETTERS, PLAIN_DIGITS = "a-z\xdf-\xf6\xf8-\u0148\u014a-\u017e", "0-9"


def plain_pattern(file: dict) -> re.Pattern | None:
    """The word pattern for lower-cased ``PLAIN`` texts, which normalising leaves as they are; none
    if the vocabulary works otherwise."""
    steps = [step["type"] for step in (file["normalizer"] or {}).get("normalizers", [])]
    splits = (file["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or len(splits) != 2:
        return None
    split, byte_level = splits
    if (split["type"], split.get("behavior"), split.get("invert")) != ("Split", "Removed", True):
        return None
    if byte_level["type"] != "ByteLevel" or byte_level["add_prefix_space"] or byte_level["use_regex"]:
        return None
    pattern = split["pattern"]["Regex"]
    for unicode, plain in ((r"\p{L}", PLAIN_LETTERS), (r"\p{N}", PLAIN_DIGITS)):
        pattern = pattern.replace(unicode, plain)
    return re.compile(pattern) if r"\p" not in pattern else None


def written_bytes() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: visible Latin-1 bytes are
    written as themselves, the others as the characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [byte for byte in range(256) if byte not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A byte-level BPE vocabulary in the JSON format of the ``tokenizers`` library."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        file = json.loads(vocabulary)
        ids, suffix = file["model"]["vocab"], file["model"]["end_of_word_suffix"] or ""
        self.bytes_of = written_bytes()
        written = {byte: char for char, byte in self.bytes_of.items()}
        self.size = len(ids)
        self.first = [ids[written[byte]] for byte in range(256)]
        self.last = [ids[written[byte] + suffix] for byte in range(256)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        #: The rank of a pair of ids, and by rank the id they merge to.
        self.ranks = {ids[a] * self.size + ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [ids[a + b] for a, b in merges]
        #: Pairs of bytes that some entry holds.
        self.inner = {
            pair
            for token in ids
            for pair in pairwise([self.bytes_of[c] for c in token.removesuffix(suffix)])
        }
        # Only the steps before merging are the library's, so it need not hold the entries.
        none = {"type": "BPE", "vocab": {}, "merges": []}
        tool = Tokenizer.from_str(json.dumps(file | {"model": none, "added_tokens": []}))
        self.normalise = tool.normalizer.normalize_str if tool.normalizer else str
        self.plain = plain_pattern(file)
        self.split = tool.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.fragments, self.words = Memory(REMEMBERED), Memory(REMEMBERED // 2)

    def encode(self, text: bytes) -> bytes:
        """The ids of a text as 32-bit numbers."""
        memory, found = self.fragments, []
        for fragment in text.split():
            ids = memory.new.get(fragment)
            if ids is None:
                ids = memory.get(fragment)
                if ids is None:
                    ids = self._fragment(fragment.decode())
                    if len(fragment) <= LONGEST_REMEMBERED:
                        memory.put(fragment, ids)
            found.append(ids)
        return b"".join(found)

    def _fragment(self, text: str) -> bytes:
        """The ids of a text without white space."""
        if "<" not in text and self.plain and PLAIN.fullmatch(text):
            return b"".join([self._word(w.encode()) for w in self.plain.findall(text.lower())])
        found = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                found.append(array("i", [self.special[part]]).tobytes())
            elif part:
                for word, _ in self.split(self.normalise(part)):
                    found.append(self._word(bytes([self.bytes_of[c] for c in word])))
        return b"".join(found)

    def _word(self, word: bytes) -> bytes:
        ids = self.words.new.get(word) or self.words.get(word)
        if ids is None:
            if self.inner.issuperset(zip(word, word[1:])):
                found = self._merge(word, True)
            else:
                pairs = enumerate(zip(word, word[1:]), 1)
                cuts = [0, *(i for i, pair in pairs if pair not in self.inner), len(word)]
                found = []
                for begin, end in pairwise(cuts):
                    found += self._merge(word[begin:end], end == len(word))
            ids = array("i", found).tobytes()
            if len(word) <= LONGEST_REMEMBERED:
                self.words.put(word, ids)
        return ids

    def _merge(self, fragment: bytes, ends_word: bool) -> list[int]:
        """Merge neighbours, lowest rank first and from the left, until none has a rank."""
        parts = [self.first[byte] for byte in fragment]
        if ends_word:
            parts[-1] = self.last[fragment[-1]]
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank, size, merged = self.ranks.get, self.size, self.merged
        ranks = [rank(a * size + b, NONE) for a, b in pairwise(parts)]
        while ranks:
            best = min(ranks)
            if best == NONE:
                break
            i = ranks.index(best)
            one = parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(one * size + parts[i + 1], NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] * size + one, NONE)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with the pairs in a heap, and links to the parts before and after."""
        count, gone = len(parts), -1
        after, before = list(range(1, count + 1)), list(range(-1, count - 1))
        queue = []

        def offer(i: int, j: int) -> None:
            rank = self.ranks.get(parts[i] * self.size + parts[j])
            if rank is not None:
                heapq.heappush(queue, (rank, i, parts[i], parts[j]))

        for i in range(count - 1):
            offer(i, i + 1)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= count or parts[j] != right:
                continue
            parts[i], parts[j], after[i] = self.merged[rank], gone, after[j]
            if after[i] < count:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [part for part in parts if part != gone]


def read_vocabulary(path: str) -> str:
    """The vocabulary file's text, read where the driver runs; it is a few megabytes."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def written_tokens(vocabulary: str) -> dict[int, str]:
    """The written form of each id, special tokens included."""
    file = json.loads(vocabulary)
    names = {i: name for name, i in file["model"]["vocab"].items()}
    return names | {token["id"]: token["content"] for token in file["added_tokens"]}


class Decoder:
    """Writes ids out as text, for a vocabulary file that names no decoder: the written forms of the
    ids joined by blanks. An id the vocabulary lacks is left out; null ids give an empty text."""

    def __init__(self, vocabulary: str):
        names = written_tokens(vocabulary)
        numbers = range(max(names) + 1)
        self.known = np.isin(numbers, list(names))
        self.tokens = pa.array([names.get(i, "") for i in numbers])

    def decode(self, column: pa.ListArray) -> pa.Array:
        ids = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        sizes = pa.compute.list_value_length(column).fill_null(0).to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        good = (ids >= 0) & (ids < len(self.tokens))
        good[good] = self.known[ids[good]]
        ends = np.concatenate(([0], np.cumsum(good)))[ends].astype(np.int32)
        written = pa.ListArray.from_arrays(pa.array(ends), self.tokens.take(pa.array(ids[good])))
        return pa.compute.binary_join(written, " ")


def check(vocabulary: str) -> None:
    if json.loads(vocabulary)["decoder"] is not None:
        raise ValueError("only vocabularies without a decoder are supported")


def encode(
    docs: DataFrame, vocabulary: str, keep: list[str], text: str = "text", decoded: bool = False
) -> DataFrame:
    """The columns ``keep`` and ``ids``, the ids of each row's whole text; on demand also
    ``decoded``, what the ids decode to, made in the same pass."""
    if decoded:
        check(vocabulary)
    names = [f"_{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    made_columns = ["ids", "decoded"][: 1 + decoded]
    # A worker keeps its copy of a broadcast value, so its encoder lasts from task to task.
    worker = docs.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker.value
        if "encoder" not in own:
            own["encoder"], own["decoder"] = Encoder(own["vocabulary"]), Decoder(own["vocabulary"])
        encoder, decoder = own["encoder"], own["decoder"]
        for batch in batches:
            for piece in pieces(batch, "_text", 1 << 19):
                made = [encoder.encode((t or "").encode()) for t in piece["_text"].to_pylist()]
                ends = np.cumsum([0, *(len(ids) // 4 for ids in made)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.frombuffer(b"".join(made), dtype=np.int32))
                )
                found = [ids, decoder.decode(ids)] if decoded else [ids]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[1:], *found], [*names, *made_columns]
                )

    types = dict(zip(["ids", "decoded"], ["array<int>", "string"]))
    schema = [f"{n} {k}" for n, k in zip(names, kinds)] + [f"{c} {types[c]}" for c in made_columns]
    made = docs.select(
        F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in zip(keep, names)]
    ).mapInArrow(run, ", ".join(schema))
    return made.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], *made_columns)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``decoded``, what ``ids`` decode to, to the other columns."""
    check(vocabulary)
    worker = encoded.sparkSession.sparkContext.broadcast({"vocabulary": vocabulary})
    row = encoded.select(F.struct("*").alias("row"), F.col("ids").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker.value
        if "decoder" not in own:
            own["decoder"] = Decoder(own["vocabulary"])
        for batch in batches:
            for first in range(0, len(batch), 256):
                piece = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays(
                    [piece["row"], own["decoder"].decode(piece["ids"])], ["row", "decoded"]
                )

    schema = row.schema["row"].dataType.simpleString()
    return row.mapInArrow(run, f"row {schema}, decoded string").select("row.*", "decoded")
