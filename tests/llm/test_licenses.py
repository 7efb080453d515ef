"""Template markup against a plain backtracking matcher, and the registered query on odd rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from harborlane.llm import licenses, queries
from harborlane.llm.licenses import Form


def plain_ends(parts, words, at):
    """All word numbers after which ``parts`` may end when they begin at ``at``; no automaton."""
    if not parts:
        return {at}
    part, rest = parts[0], parts[1:]
    if isinstance(part, str) or part[0] == "some":
        options = [part] if isinstance(part, str) else part[1]
        here = at < len(words) and words[at] in options
        return plain_ends(rest, words, at + 1) if here else set()
    if part[0] == "any":
        return {
            end
            for n in range(part[1], part[2] + 1) if at + n <= len(words)
            for end in plain_ends(rest, words, at + n)
        }
    middle = plain_ends(part[1], words, at) | {at}
    return {end for m in middle for end in plain_ends(rest, words, m)}


def plain_places(forms, words):
    return [
        (k, at, max(ends))
        for at in range(len(words)) for k, form in enumerate(forms)
        if (ends := plain_ends(form.parts, words, at))
    ]


MARKED = [
    ("x", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>> d<<endOptional>> e"),
    ("y", 'a <<var;name="n";words="0-3">> e'),
    ("y", 'b <<var;name="n";words="2-4">> <<beginOptional>>c<<endOptional>>'),
    ("z", '<<beginOptional>>d<<endOptional>> <<var;name="n";match="a|c">> e e'),
    ("x", "a b"),
]


def test_automaton_equals_backtracking():
    forms = licenses.forms([("p", "a a"), ("q", "b c")], MARKED)
    automaton, rng = licenses.Automaton(forms), random.Random(4)
    for _ in range(400):
        words = [rng.choice("abcdeo") for _ in range(rng.randrange(14))]
        got = automaton.places(automaton.numbers(" ".join(words)))
        assert got == plain_places(forms, words)


def test_remembered_steps_are_bounded(monkeypatch):
    monkeypatch.setattr(licenses, "REMEMBERED", 3)
    test_automaton_equals_backtracking()


@pytest.mark.parametrize("wording", [
    "a <<beginOptional>> b", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>",
])
def test_bad_markup(wording):
    with pytest.raises(ValueError):
        Form.parse("x", wording)


def test_any_words_cannot_begin():
    with pytest.raises(ValueError):
        licenses.Automaton([Form.parse("x", '<<var;name="n";words="0-2">> a')])


MIT = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction,
including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {holder} BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def rows_of(spark, texts, forms=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = licenses.scan(docs, ["doc_id"], forms).orderBy("doc_id").collect()
    return [(sorted({p.label for p in r.places}), r.score) for r in found]


def test_templates(spark):
    texts = [
        MIT.format(holder="THE AUTHORS OR COPYRIGHT HOLDERS"),
        MIT.format(holder="Example Works Ltd"),
        MIT.format(holder="X").replace("substantial", "important"),
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under CC BY-NC 4.0.",
        "Released under the MIT License.",
        "Licensed under the Apache License,\nVersion 2.0.",
        "The GNU lesser general public licence, version 3",
    ]
    assert [labels for labels, _ in rows_of(spark, texts)] == [
        ["mit-text"], ["mit-text"], [], ["gpl-3"], ["cc-by-nc", "cc-by-nc-4"], ["mit"], ["apache-2"], [],
    ]


def test_query_on_odd_rows(spark, odd, none, monkeypatch, tmp_path):
    long = "filler text " * 60_000 + "under the MIT license " + "x " * 1000 + "cc by-nc"
    extra = odd.limit(1).withColumn("text", F.lit(long)).withColumn("doc_id", F.lit(77).cast("bigint"))
    both = odd.unionAll(extra)
    for rows, name in ((both, "odd"), (none, "none")):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = queries.op12_licenses(spark, f"{tmp_path}/{name}").collect()
        texts = [r.text or "" for r in rows.collect()]
        forms = licenses.forms()
        upper = str.maketrans(licenses.UPPER, licenses.LOWER)
        expected = []
        for text in texts:
            words = licenses.words_of(text.translate(upper))
            places = [
                (k, at) for k, form in enumerate(forms) if form.phrase
                for at in range(len(words)) if words[at : at + len(form.parts)] == form.parts
            ]
            starts = [at for _, at in places]
            expected.append((
                len(words), len(places), min(starts, default=None), max(starts, default=None),
                ",".join(sorted({forms[k].label for k, _ in places})),
            ))
        key = lambda r: tuple(map(str, r))
        assert sorted([(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got],
                      key=key) == sorted(expected, key=key)
    assert len(texts) == 0 and got == []
