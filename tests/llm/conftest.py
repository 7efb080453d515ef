from __future__ import annotations

import pytest

DOCUMENTS = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, `row` string, "
    "`key` int, size int, ids int, place string"
)
LONG = "wort und noch ein wort " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, odd texts, repeats, and clashing extra columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog\nshared line\n", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog\nshared line\n", "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog\nshared line\n", "en", "a"),
        (3, None, "en", "a"),
        (4, "", "de", None),
        (5, "\n\n", None, "b"),
        (None, "der Hund und die Katze sind im Haus", "de", "b"),
        (None, None, None, None),
        (6, LONG, "de", "c"),
        (7, "  123 !? \x1c ", "en", "c"),
        (8, "Été \U0001f600 naïve\r\n\tShared LINE \r\n", "fr", "b"),
        (9, "one", "en", "b"),
    ]
    return spark.createDataFrame(
        [(*r, None, "r", 1, 2, 3, "p") for r in rows], DOCUMENTS
    )


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
