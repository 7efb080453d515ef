"""License wording found with templates whose markup is compiled to token automata.

A form is a label and a wording. A phrase is a wording without markup; a template may hold

* ``<<beginOptional>> ... <<endOptional>>``: words that may be left out, also nested;
* ``<<var;name="...";words="lo-hi">>``: a replaceable place of ``lo`` to ``hi`` words, whatever they are;
* ``<<var;name="...";match="a|b|c">>``: one of some words.

Everything else is mandatory and has to stand there word for word, so punctuation, line breaks and
the letter case of A-Z make no difference. The forms are compiled to one nondeterministic automaton
over words, of which the sets of states met in texts are remembered, up to ``REMEMBERED`` steps. From
every word that can begin a form the automaton runs on until it is stuck; a form is accepted from
there to the last word it accepts. So all places are found, also overlapping ones, in time
proportional to the text and the longest form.

Words are the runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII. The whole
text is read. A null text is empty, and an empty text has no words, no places and score 0. Repeated
rows are scanned each. Every column named to be kept is kept, and no other is looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from harborlane.llm.common import LOWER, UPPER, pieces

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
REMEMBERED = 1 << 18
OTHER, ANY = 0, -1

# The phrases and their labels.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Public license texts and notices, with markup.
_DISCLAIMER_BSD = """
    this software is provided by <<var;name="holder";words="1-12">> as is and any express or implied
    warranties including but not limited to the implied warranties of merchantability and fitness for
    a particular purpose are disclaimed in no event shall <<var;name="holder";words="1-12">> be liable
    for any direct indirect incidental special exemplary or consequential damages including but not
    limited to procurement of substitute goods or services loss of use data or profits or business
    interruption however caused and on any theory of liability whether in contract strict liability or
    tort including negligence or otherwise arising in any way out of the use of this software even if
    advised of the possibility of such damage
"""
_CONDITIONS_BSD = """
    redistribution and use in source and binary forms with or without modification are permitted
    provided that the following conditions are met
    <<beginOptional>><<var;name="bullet";match="1|a|i">><<endOptional>> redistributions of source code
    must retain the above copyright notice this list of conditions and the following disclaimer
    <<beginOptional>><<var;name="bullet";match="2|b|ii">><<endOptional>> redistributions in binary form
    must reproduce the above copyright notice this list of conditions and the following disclaimer in
    the documentation and or other materials provided with the distribution
"""
_GIVEN = """<<var;name="given";match="licensed|released|distributed|published|available|provided">>
    under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>><<var;name="article";match="the|a">>
    <<endOptional>>"""
_GNU = """gnu {kind} public license <<beginOptional>>as published by the free software foundation
    <<endOptional>> <<beginOptional>>either<<endOptional>>"""
_CC = """creative commons attribution {kind} <<beginOptional>><<var;name="v";match="version|v">>
    <<endOptional>> 4 0 <<beginOptional>>international<<endOptional>>"""
TEMPLATES = [
    ("mit-text", """
        permission is hereby granted free of charge to any person obtaining a copy of this software
        and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense
        and or sell copies of the software and to permit persons to whom the software is furnished to
        do so subject to the following conditions the above copyright notice and this permission
        notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all
        copies or substantial portions of the software the software is provided as is without warranty
        of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall
        <<var;name="holder";words="1-12">> be liable for any claim damages or other liability whether
        in an action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software"""),
    ("mit", _GIVEN + " mit license"),
    ("bsd-2", _CONDITIONS_BSD + _DISCLAIMER_BSD),
    ("bsd-3", _CONDITIONS_BSD + """
        <<beginOptional>><<var;name="bullet";match="3|c|iii">><<endOptional>> neither the name of
        <<var;name="holder";words="1-20">> may be used to endorse or promote products derived from this
        software without specific prior written permission""" + _DISCLAIMER_BSD),
    ("isc", """
        permission to use copy modify and or distribute this software for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice
        appear in all copies the software is provided as is and <<var;name="holder";words="1-12">>
        disclaims all warranties with regard to this software"""),
    ("apache-2", _GIVEN + """ apache license <<beginOptional>><<var;name="v";match="version|v">>
        <<endOptional>> 2 <<beginOptional>>0<<endOptional>>"""),
    ("apache-2-header", """
        licensed under the apache license version 2 0 the license you may not use
        <<var;name="what";words="1-6">> except in compliance with the license you may obtain a copy of
        the license at <<beginOptional>><<var;name="scheme";match="http|https">><<endOptional>> www
        apache org licenses license 2 0 <<beginOptional>><<var;name="type";match="txt|html">>
        <<endOptional>> unless required by applicable law or agreed to in writing software distributed
        under the license is distributed on an as is basis without warranties or conditions of any
        kind either express or implied see the license for the specific language governing permissions
        and limitations under the license"""),
    ("cc-by-nc-4", _GIVEN + """ cc by nc <<beginOptional>><<var;name="v";match="version|v">>
        <<endOptional>> 4 <<beginOptional>>0<<endOptional>>"""),
    ("cc-by-4", _CC.format(kind="")),
    ("cc-by-sa-4", _CC.format(kind="share <<beginOptional>>alike<<endOptional>>")),
    ("cc-by-sa-4", _CC.format(kind="sharealike")),
    ("cc-by-nc-4", _CC.format(kind="non commercial")),
    ("cc-by-nc-4", _CC.format(kind="noncommercial")),
    ("cc0", """cc0 <<beginOptional>>1 0 universal<<endOptional>>
        <<beginOptional>>public domain dedication<<endOptional>>"""),
    ("gpl-2", _GNU.format(kind="general") + " version 2"),
    ("gpl-3", _GNU.format(kind="general") + " version 3"),
    ("lgpl-2", _GNU.format(kind="lesser general") + " version 2 <<beginOptional>>1<<endOptional>>"),
    ("lgpl-3", _GNU.format(kind="lesser general") + " version 3"),
    ("agpl-3", _GNU.format(kind="affero general") + " version 3"),
    ("gpl-or-later", """
        <<var;name="what";match="program|software|library|file|package|it">> is free software you can
        redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version <<var;name="v";match="2|3">> of the license or
        <<beginOptional>>at your option<<endOptional>> any later version"""),
    ("mpl-2", """
        subject to the terms of the mozilla public license <<beginOptional>>
        <<var;name="v";match="version|v">><<endOptional>> 2 0"""),
    ("unlicense", """
        free and unencumbered software released into the public domain anyone is free to copy modify
        publish use compile sell or distribute this software"""),
]

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_SETTING = re.compile(r'(\w+)="([^"]*)"')


def words_of(text: str | None) -> list[str]:
    """The words of a text whose A-Z are in lower case already."""
    return re.findall(WORD, text or "")


@dataclass
class Form:
    """A parsed wording: nested lists of words, ``("some", words)``, ``("any", lo, hi)`` and
    ``("optional", parts)``."""

    label: str
    parts: list
    phrase: bool = False
    mandatory: int = field(init=False)

    def __post_init__(self):
        self.mandatory = sum(isinstance(part, str) for part in self.parts)
        if not self.mandatory:
            raise ValueError(f"{self.label}: a wording without mandatory words accepts any text")

    @classmethod
    def parse(cls, label: str, wording: str, phrase: bool = False) -> Form:
        stack, position = [[]], 0
        for mark in _MARKUP.finditer(wording):
            stack[-1] += words_of(wording[position : mark.start()].lower())
            position = mark.end()
            if mark[1] == "beginOptional":
                stack.append([])
            elif mark[1] == "endOptional":
                if len(stack) == 1:
                    raise ValueError(f"{label}: endOptional without its begin")
                inner = stack.pop()
                stack[-1].append(("optional", inner))
            else:
                settings = dict(_SETTING.findall(mark[1]))
                if "match" in settings:
                    stack[-1].append(("some", settings["match"].lower().split("|")))
                else:
                    low, high = map(int, settings["words"].split("-"))
                    stack[-1].append(("any", low, high))
        stack[-1] += words_of(wording[position:].lower())
        if len(stack) > 1:
            raise ValueError(f"{label}: beginOptional without its end")
        return cls(label, stack[0], phrase)


def forms(phrases=None, templates=None) -> list[Form]:
    return [Form.parse(*x, phrase=True) for x in (PHRASES if phrases is None else phrases)] + [
        Form.parse(*x) for x in (TEMPLATES if templates is None else templates)
    ]


class Automaton:
    """All forms as one automaton over numbered words; 0 stands for every word no form names."""

    def __init__(self, wordings: list[Form]):
        self.number: dict[str, int] = {}
        self.steps: list[dict[int, list[int]]] = []  # by state: word -> next states
        self.silent: list[list[int]] = []  # by state: next states without a word
        self.accepts: dict[int, int] = {}
        begins = []
        for k, form in enumerate(wordings):
            begin = self._state()
            begins.append(begin)
            self.accepts[self._add(form.parts, begin)] = k
        self.start = self._closed(begins)
        # A state may be stuck on every word but those of its own steps.
        opening = {word for state in self.start for word in self.steps[state]}
        if ANY in opening:
            raise ValueError("a wording must begin with a word, not with any words")
        self.opening = np.zeros(len(self.number) + 1, bool)
        self.opening[sorted(opening)] = True
        self.seen: dict[tuple[frozenset, int], frozenset] = {}
        self.accepted: dict[frozenset, list[int]] = {}

    def _state(self) -> int:
        self.steps.append({})
        self.silent.append([])
        return len(self.steps) - 1

    def _step(self, state: int, words: list[int]) -> int:
        after = self._state()
        for word in words:
            self.steps[state].setdefault(word, []).append(after)
        return after

    def _add(self, parts: list, state: int) -> int:
        for part in parts:
            if isinstance(part, str):
                state = self._step(state, [self._word(part)])
            elif part[0] == "some":
                state = self._step(state, [self._word(word) for word in part[1]])
            elif part[0] == "any":
                skips = []
                for i in range(part[2]):
                    if i >= part[1]:
                        skips.append(state)
                    state = self._step(state, [ANY])
                for skip in skips:
                    self.silent[skip].append(state)
            else:
                after = self._add(part[1], state)
                self.silent[state].append(after)
                state = after
        return state

    def _word(self, word: str) -> int:
        return self.number.setdefault(word, len(self.number) + 1)

    def _closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for state in self.silent[todo.pop()]:
                if state not in found:
                    found.add(state)
                    todo.append(state)
        return frozenset(found)

    def after(self, states: frozenset, word: int) -> frozenset:
        key = (states, word)
        found = self.seen.get(key)
        if found is None:
            steps = [self.steps[state] for state in states]
            found = self._closed(
                {s for step in steps for w in {word, ANY} if w in step for s in step[w]}
            )
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[key] = found
        return found

    def ends(self, states: frozenset) -> list[int]:
        found = self.accepted.get(states)
        if found is None:
            found = sorted({self.accepts[s] for s in states if s in self.accepts})
            if len(self.accepted) >= REMEMBERED:
                self.accepted.clear()
            self.accepted[states] = found
        return found

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's words; the words themselves are not kept."""
        found = (match.group() for match in re.finditer(WORD, text))
        return np.fromiter(map(self.number.get, found, repeat(OTHER)), np.int32)

    def places(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(form, first word, word after the last) of each accepted place, in order of the text."""
        found = []
        for first in np.flatnonzero(self.opening[numbers]).tolist():
            states, longest, at = self.start, {}, first
            while states and at < len(numbers):
                states = self.after(states, int(numbers[at]))
                at += 1
                for form in self.ends(states):
                    longest[form] = at
            found += [(form, first, end) for form, end in sorted(longest.items())]
        return found


def scan(
    docs: DataFrame, keep: list[str], wordings: list[Form] | None = None, text: str = "text"
) -> DataFrame:
    """The columns ``keep``, ``n_words``, ``places``, and ``score``.

    A place has the ``label`` of its form, whether that is a ``phrase``, its first word ``start`` and
    ``end``, the word after its last, counted from 0. The score is the share of the text's words
    that the mandatory words of the different forms found would take, at most 1.
    """
    wordings = forms() if wordings is None else wordings
    names = [f"_{i}" for i in range(len(keep))]
    kinds = [docs.schema[c].dataType.simpleString() for c in keep]
    place = pa.list_(
        pa.struct(
            [("label", pa.string()), ("phrase", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(wordings)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                words, places, scores = [], [], []
                for value in piece["_text"].to_pylist():
                    numbers = automaton.numbers(value or "")
                    found = automaton.places(numbers)
                    taken = sum(wordings[k].mandatory for k in {k for k, _, _ in found})
                    words.append(len(numbers))
                    scores.append(min(1.0, taken / len(numbers)) if found else 0.0)
                    places.append(
                        [
                            {"label": wordings[k].label, "phrase": wordings[k].phrase,
                             "start": first, "end": end}
                            for k, first, end in found
                        ]
                    )
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[1:], pa.array(words, pa.int64()), pa.array(places, place),
                     pa.array(scores, pa.float64())],
                    [*names, "n_words", "places", "score"],
                )

    schema = ", ".join(
        [f"{n} {k}" for n, k in zip(names, kinds)]
        + ["n_words bigint",
           "places array<struct<label string, phrase boolean, start bigint, `end` bigint>>",
           "score double"]
    )
    found = docs.select(
        F.translate(F.col(text), UPPER, LOWER).alias("_text"),
        *[F.col(c).alias(n) for c, n in zip(keep, names)],
    ).mapInArrow(run, schema)
    return found.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], "n_words", "places", "score"
    )


def pattern(form: Form) -> str:
    """A regular expression for a form in words that each have a blank before them, as SQL needs it."""

    def written(parts: list) -> str:
        return "".join(
            f" {part}" if isinstance(part, str)
            else f" (?:{'|'.join(part[1])})" if part[0] == "some"
            else f"(?: [^ ]+){{{part[1]},{part[2]}}}" if part[0] == "any"
            else f"(?:{written(part[1])})?"
            for part in parts
        )

    return written(form.parts) + " "
