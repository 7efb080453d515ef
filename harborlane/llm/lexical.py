"""Ranked lexical search that mixes term-at-a-time with document-at-a-time scoring.

Terms are the runs of letters, digits and characters beyond ASCII, A-Z in lower case. A document that
holds a term ``tf`` times scores ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` for it, where
``w = floor(1000 * ln((2N + 2) / (2 df + 1)))`` falls with the documents ``df`` that hold the term and
``m = 10 + (90 * n * N) div L`` grows with the document's length ``n``; ``N`` documents have ``L`` terms
in all. Apart from the logarithm all numbers are 64-bit integers, so sums do not depend on their order.

Items are searched in blocks of about ``BLOCK_CHARS`` characters, so what a task is sent does not grow
with either table. For a block, one pass over the documents counts the terms its items ask for. Tasks
then build inverted lists of about ``SHARD_POSTINGS`` postings at a time and search every item in them:

* the shortest lists, as long as they have together no more postings than a share of the shard's
  documents, are summed into one sorted list of accumulators (term at a time);
* that list and each long list are iterators with a highest score. Iterators whose highest scores
  together cannot reach the tenth best document so far propose no documents. The others are read in
  document order, window by window, and skip windows none of them has a document in; the lists left
  aside are looked up for documents that can still get there, highest first (document at a time).

The ten best of an item go on from shard to shard of a task, and the tasks' lists are merged.

A null text has no terms, and a document without terms does not count. Documents that score 0 are not
listed. Equal scores go to the smaller document id, null ids last; repeated rows are documents, and
items, of their own. Items without a known term, and empty tables, give no rows. Other columns are not
looked at.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harborlane.llm.common import LOWER, UPPER, pieces, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_CHARS = 1 << 22
SHARD_POSTINGS = 1 << 21
#: Short lists hold together up to this share of a shard's documents, or this many postings.
SHORT_SHARE, SHORT_LEAST = 1 / 8, 256
WINDOW = 4096


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def numbered(items: DataFrame, text: str) -> tuple[DataFrame, int]:
    """The items as (number, block, item, terms), each term once, and the number of blocks."""
    found = stored(
        items.select(
            F.struct("*").alias("item"),
            F.array_distinct(
                F.regexp_extract_all(
                    lowered(F.coalesce(F.col(text), F.lit(""))), F.lit(TERM), F.lit(0)
                )
            ).alias("terms"),
        )
        .where(F.size("terms") > 0)
        .withColumn("number", F.monotonically_increasing_id()),
        "lexical-items",
    )
    chars = found.agg(F.sum(F.char_length(F.array_join("terms", " ")))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    return found.withColumn("block", F.pmod(F.xxhash64("number"), F.lit(max(1, blocks)))), blocks


def term_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, counts): of each document with a term its number of terms, and which of
    ``vocabulary`` it holds how often."""
    kind = docs.schema[doc_id].dataType.simpleString()
    number = {term: i for i, term in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                sizes, terms, counts = [], [], []
                for value in piece["_text"].to_pylist():
                    found = (match.group() for match in re.finditer(TERM, value or ""))
                    ids = np.fromiter(map(number.get, found, repeat(-1)), np.int32)
                    sizes.append(len(ids))
                    unique, often = np.unique(ids[ids >= 0], return_counts=True)
                    terms.append(unique)
                    counts.append(often)
                ends = np.cumsum([0, *map(len, terms)], dtype=np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(t)))
                    for x, t in ((terms, np.int32), (counts, np.int64))
                ]
                made = pa.RecordBatch.from_arrays(
                    [piece["doc_id"], pa.array(sizes, pa.int64()), *lists],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield made.filter(pa.compute.greater(made["n"], 0))

    return docs.select(
        F.col(doc_id).alias("doc_id"), lowered(F.col(text)).alias("_text")
    ).mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, counts array<bigint>")


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Shard:
    """Inverted lists of some documents, numbered in the order of their ids."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        table = pa.Table.from_batches(batches)
        order = pa.compute.sort_indices(table, [("doc_id", "ascending")], null_placement="at_end")
        table = table.take(order).combine_chunks()
        self.ids = table["doc_id"].combine_chunks()
        self.size = len(self.ids)
        lists = table["terms"].combine_chunks()
        held = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(self.size), held)
        term = lists.flatten().to_numpy(zero_copy_only=False)
        often = table["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        by_term = np.argsort(term, kind="stable")
        self.docs, term, often = doc[by_term], term[by_term], often[by_term]
        norm = 10 + (90 * table["n"].to_numpy() * documents) // length
        self.scores = weights[term] * ((10**9 * often) // (1000 * often + 8 * norm[self.docs]))
        self.starts = np.searchsorted(term, np.arange(len(weights) + 1))

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[term], self.starts[term + 1])
        return self.docs[part], self.scores[part]

    def search(self, terms: list[int], best: list[tuple], top: int) -> list[tuple]:
        """``best``, the best so far as sorted (-score, id is null, id), with the shard's documents."""
        lists = [self.list_of(term) for term in terms]
        lists = sorted((x for x in lists if len(x[0]) and x[1].max() > 0), key=lambda x: len(x[0]))
        iterators = Iterators(lists, max(SHORT_LEAST, int(self.size * SHORT_SHARE)))
        least = -best[-1][0] if len(best) == top else 1
        at = 0
        while True:
            aside = iterators.aside(least)
            at = iterators.next_document(aside, at)
            if at is None:
                return best
            docs, scores = iterators.window(aside, at, at + WINDOW, least)
            at += WINDOW
            if len(docs):
                some = np.lexsort((docs, -scores))[:top]
                ids = self.ids.take(pa.array(docs[some])).to_pylist()
                best += [(-s, i is None, i) for s, i in zip(scores[some].tolist(), ids)]
                best = sorted(best, key=lambda x: x[:2] if x[1] else x)[:top]
                least = -best[-1][0] if len(best) == top else 1


class Iterators:
    """Sorted document lists with scores, in the order of their highest scores; the shortest are
    summed into one."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], short: int):
        """``lists`` come shortest first."""
        lengths = np.cumsum([len(docs) for docs, _ in lists])
        summed = int(np.searchsorted(lengths, short, side="right"))
        self.lists = lists[summed:]
        if summed:
            self.lists.append(accumulated(lists[:summed]))
        self.lists.sort(key=lambda x: int(x[1].max()))
        self.highest = [int(scores.max()) for _, scores in self.lists]
        self.reach = np.cumsum([0, *self.highest])
        self.passed = [0] * len(self.lists)

    def aside(self, least: int) -> int:
        """How many iterators, lowest first, cannot bring a document to ``least`` by themselves."""
        return int(np.searchsorted(self.reach[1:], least, side="left"))

    def next_document(self, aside: int, at: int) -> int | None:
        """The first document from ``at`` on that an iterator which is not aside has."""
        found = []
        for k in range(aside, len(self.lists)):
            docs = self.lists[k][0]
            self.passed[k] += int(np.searchsorted(docs[self.passed[k] :], at))
            if self.passed[k] < len(docs):
                found.append(int(docs[self.passed[k]]))
        return min(found, default=None)

    def window(self, aside: int, first: int, end: int, least: int):
        """Documents of ``first`` to before ``end`` that score ``least`` or more, and their scores."""
        sums = np.zeros(end - first, np.int64)
        for k in range(aside, len(self.lists)):
            docs, scores = self.lists[k]
            start = self.passed[k]
            stop = start + int(np.searchsorted(docs[start:], end))
            sums[docs[start:stop] - first] += scores[start:stop]
        docs = np.flatnonzero((sums > 0) & (sums + self.reach[aside] >= least))
        sums = sums[docs]
        docs += first
        for k in range(aside - 1, -1, -1):
            if not len(docs):
                break
            others, scores = self.lists[k]
            place = np.searchsorted(others, docs)
            there = place < len(others)
            there[there] = others[place[there]] == docs[there]
            sums[there] += scores[place[there]]
            kept = sums + self.reach[k] >= least
            docs, sums = docs[kept], sums[kept]
        return docs, sums


def accumulated(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The documents of all lists, sorted, and the sums of their scores."""
    docs = np.concatenate([docs for docs, _ in lists])
    scores = np.concatenate([scores for _, scores in lists])
    order = np.argsort(docs, kind="stable")
    docs, scores = docs[order], scores[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    return docs[first], np.add.reduceat(scores, first)


def _search_block(docs: DataFrame, doc_id: str, text: str, asked: DataFrame, top: int) -> DataFrame:
    """(number, doc_id, score): at least the best of each item of a block, up to ``top`` a task."""
    items = [(row.number, row.terms) for row in asked.select("number", "terms").collect()]
    vocabulary = sorted({term for _, terms in items for term in terms})
    place = {term: i for i, term in enumerate(vocabulary)}
    items = [(number, [place[term] for term in terms]) for number, terms in items]
    counts = stored(term_counts(docs, doc_id, text, vocabulary), "lexical-counts")
    documents, length = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    holding = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    weights = np.zeros(len(vocabulary), np.int64)
    for term, held in holding:
        weights[term] = weight(documents, held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, postings, kind = [[] for _ in items], [], 0, None

        def search():
            shard = Shard(waiting, weights, documents, length)
            for k, (_, terms) in enumerate(items):
                best[k] = shard.search(terms, best[k], top)

        for batch in batches:
            if not len(batch):
                continue
            kind = batch.schema.field("doc_id").type
            waiting.append(batch)
            postings += len(batch["terms"].flatten()) + len(batch)
            if postings >= SHARD_POSTINGS:
                search()
                waiting, postings = [], 0
        if waiting:
            search()
        rows = [(n, i, -s) for (n, _), found in zip(items, best) for s, _, i in found]
        if rows:
            number, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64())],
                ["number", "doc_id", "score"],
            )

    kind = counts.schema["doc_id"].dataType.simpleString()
    return counts.select("doc_id", "n", "terms", "counts").mapInArrow(
        run, f"number bigint, doc_id {kind}, score bigint"
    )


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    doc_id: str = "doc_id",
    text: str = "text",
    item_text: str = "text",
) -> DataFrame:
    """(item, rank, doc_id, score): for each row of ``items``, as a struct, its best documents."""
    asked, blocks = numbered(items, item_text)
    found = None
    for block in range(max(1, blocks)):
        part = _search_block(docs, doc_id, text, asked.where(F.col("block") == block), top)
        found = part if found is None else found.unionAll(part)
    order = W.partitionBy("number").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("number", "item"), "number").select(
        "item", "rank", "doc_id", "score"
    )
