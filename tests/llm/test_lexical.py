"""Hybrid search against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harborlane.llm import lexical, queries

WORDS = [f"w{i}" for i in range(60)]


def brute(docs, items, top):
    """(item_id, rank, doc_id, score) by scoring all documents; docs and items are (id, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda text: re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").translate(lower))
    held = [(i, Counter(found), len(found)) for i, t in docs if (found := terms(t))]
    total = sum(n for _, _, n in held)
    df = Counter(term for _, counts, _ in held for term in counts)
    found = []
    for item, text in items:
        scored = []
        for i, counts, n in held:
            m = 10 + 90 * n * len(held) // total
            score = sum(
                math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1)))
                * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in set(terms(text)) if t in counts
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (s, _, _, i) in enumerate(sorted(scored)[:top], 1):
            found.append((item, rank, i, -s))
    return found


def searched(spark, docs, items, top=10):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    found = lexical.search(docs.repartition(3), items, top)
    return [(r.item.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()]


@pytest.mark.parametrize("postings, window, least, share, block", [
    (1 << 21, 4096, 256, 1 / 8, 1 << 22), (300, 7, 0, 0, 1 << 22), (2000, 16, 40, 1 / 2, 150),
    (500, 64, 10**6, 1, 60),
])
def test_search_equals_scoring_all(spark, monkeypatch, postings, window, least, share, block):
    for name, value in (("SHARD_POSTINGS", postings), ("WINDOW", window), ("SHORT_LEAST", least),
                        ("SHORT_SHARE", share), ("BLOCK_CHARS", block)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(7)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    text = lambda n: " ".join(rng.choices(WORDS, weights, k=n))
    docs = [(i, text(rng.randrange(1, 40))) for i in range(600)]
    docs += [(600 + i, docs[3][1]) for i in range(30)]  # copies, so ties at the border
    docs += [(9, docs[9][1]), (None, docs[9][1]), (None, docs[9][1]), (700, None), (701, " .,; ")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(12)]
    items += [(20, docs[3][1]), (20, docs[3][1]), (21, "unknown"), (22, None), (None, "w1 W1 w50")]
    key = lambda r: tuple(map(str, r))
    assert sorted(searched(spark, docs, items), key=key) == sorted(brute(docs, items, 10), key=key)


def test_documents_are_skipped():
    """With a threshold that only the rare list reaches, the long list proposes nothing."""
    import numpy as np

    long = (np.arange(10_000), np.full(10_000, 5))
    rare = (np.array([17, 9_000]), np.array([50, 60]))
    iterators = lexical.Iterators([rare, long], 0)
    assert iterators.aside(1) == 0 and iterators.aside(6) == 1
    assert iterators.next_document(1, 0) == 17 and iterators.next_document(1, 18) == 9_000
    assert iterators.next_document(1, 9_001) is None
    iterators.passed = [0, 0]
    docs, sums = iterators.window(1, 17, 17 + 4096, 55)
    assert docs.tolist() == [17] and sums.tolist() == [55]
    assert not len(iterators.window(1, 17, 17 + 4096, 56)[0])


def test_query_on_odd_rows(spark, odd, none, tmp_path):
    items = spark.createDataFrame(
        [(1, "the dog and das Haus", 3), (2, None, 1), (3, "", 1), (None, "wort WORT é", 1)],
        "item_id bigint, text string, number int",
    )
    for docs, asked, name in (
        (odd, items, "odd"), (none, items, "no-docs"), (odd, items.limit(0), "no-items"),
    ):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        asked.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = [tuple(r) for r in queries.op13_lexical(spark, f"{tmp_path}/{name}").collect()]
        plain = lambda df, c: [(r[c], r.text) for r in df.select(c, F.col("text")).collect()]
        expected = brute(plain(docs, "doc_id"), plain(asked, "item_id"), 10)
        assert sorted(map(str, got)) == sorted(map(str, expected))
