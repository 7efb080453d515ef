"""Vectors, pages, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenizers import Tokenizer

from harborlane.llm import html_blocks, neighbours, queries, topk, vectors, warc
from harborlane.llm.common import table
from tests.llm.test_text_operators import (
    VOCABULARY, brute_components, brute_fingerprint, brute_lines, brute_targets,
)


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 340)]  # a crowd of copies
    rows += [
        (400, None), (500, []), (600, [1.0, None] * 4), (700, [math.nan] * 8), (800, [math.inf] * 8),
        (None, rows[1][1]), (900, [0.0] * 8), (1000, [1.0, 2.0]), (100, rows[5][1]),
    ]
    return spark.createDataFrame(
        [(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, block string, dim int"
    )


def usable_rows(points, zero):
    rows = [(r.vec_id, r.embedding) for r in points.collect() if r.vec_id is not None]
    good = [(i, v) for i, v in rows if v and None not in v and all(map(math.isfinite, v))]
    return [(i, v) for i, v in good if zero or any(v)]


def brute_search(rows, by, top, score):
    found = []
    for q, a in rows:
        if q % by == 0:
            best = sorted((-score(a, b), i) for i, b in rows if i != q and len(a) == len(b))[:top]
            found += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(found)


def test_topk(points, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 100)
    monkeypatch.setattr(vectors, "QUERIES_PER_BLOCK", 3)
    whole = lambda v: [math.floor(1024 * x) for x in v]
    score = lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b)))
    got = topk.search(points, vectors.divisible(100), top=10).collect()
    assert sorted(map(tuple, got)) == brute_search(usable_rows(points, True), 100, 10, score)


@pytest.mark.parametrize("size", [1e5, 1e6, 1e9, 1e15, 1e200, 1.7e308])
def test_topk_of_large_components(spark, size, monkeypatch):
    monkeypatch.setattr(topk, "ROWS_PER_SHARD", 25)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    for i in range(0, 60, 3):
        rows[i][1][i % 4] = float(size * rng.uniform(-1, 1))
    rows[0][1][:] = [size, 1.0, -2.0, 0.5]
    points = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = lambda v: [math.floor(x) * 1024 if abs(x) > 1e300 else math.floor(1024 * x) for x in v]
    score = lambda a, b: sum(x * y for x, y in zip(whole(a), whole(b)))
    got = topk.search(points, vectors.divisible(20), top=40).collect()
    expected = [
        (q, rank, i, s if -(1 << 63) <= s < 1 << 63 else None)
        for q, rank, i, s in brute_search(rows, 20, 40, score)
    ]
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == expected


def test_neighbours(points, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_SHARD", 150)
    score = lambda a, b: math.fsum(x * y for x, y in zip(a, b))
    got = sorted(map(tuple, neighbours.search(points, vectors.divisible(20), top=20).collect()))
    expected = brute_search(usable_rows(points, False), 20, 20, score)
    assert len(got) == len(expected)
    assert len(set(got) & set(expected)) >= 0.9 * len(expected)


def test_neighbours_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, folder, "embeddings").collect()]
    matrix, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    got = {}
    for r in queries.op9_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = []
    for q in got:
        value = matrix @ matrix[ids == q][0]
        value[ids == q] = -np.inf
        hits.append(len(got[q] & set(ids[np.argsort(-value)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9


def lengthened(kind, count):
    rng = np.random.default_rng(1)
    if kind == "unit":
        matrix = rng.normal(size=(count, 256))
        return matrix / np.linalg.norm(matrix, axis=1)[:, None]
    if kind == "gaussian":
        return rng.normal(size=(count, 256))
    matrix = rng.normal(size=(count, 64))
    return matrix * np.exp(rng.normal(size=count))[:, None] * (1e-140 if kind == "tiny" else 1)


@pytest.mark.parametrize("kind", ["unit", "gaussian", "log-normal", "tiny"])
def test_recall_whatever_the_lengths(kind):
    matrix = lengthened(kind, 8000)
    row = {**neighbours.graph_index(np.arange(len(matrix)), matrix), "dim": matrix.shape[1]}
    asked = np.arange(0, len(matrix), 40)
    at, hits, _ = neighbours.search_shard(row, asked, matrix[asked], 20)
    own, _ = neighbours.scaled(matrix)
    recall = []
    for position, q in enumerate(asked):
        value = own @ own[q]
        value[q] = -np.inf
        best = set(np.argsort(-value)[:20].tolist())
        recall.append(len(best & set(hits[at == position].tolist())) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.7


def test_beam_is_widened(monkeypatch):
    monkeypatch.setattr(neighbours, "BEAM", 4)
    monkeypatch.setattr(neighbours, "ENOUGH", 1.0)
    made = neighbours.graph_index(np.arange(3000), lengthened("gaussian", 3000))
    assert 64 <= made["beam"] <= neighbours.WIDEST


@pytest.mark.parametrize("size", [1e160, 1e200, 1.7e308, 1e-300])
def test_neighbours_with_very_large_components(spark, size):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    for i in (7, 40, 60):
        rows[i][1][i % 4] = size if i < 60 else -size
    rows[90][1][:] = [size, -size, 1.0, 2.0]
    points = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")

    def score(a, b):
        try:
            return math.fsum(x * y for x, y in zip(a, b))
        except (OverflowError, ValueError):
            exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b))
            return float(exact) if abs(exact) < 1 << 1024 else (math.inf if exact > 0 else -math.inf)

    got = sorted(map(tuple, neighbours.search(points, vectors.divisible(20), top=20).collect()))
    expected = brute_search(rows, 20, 20, score)
    assert len(got) == len(expected) == 6 * 20
    assert len(set(got) & set(expected)) >= 0.95 * len(expected)
    huge = rng.uniform(-1, 1, size=(30, 4)) * 1.7e308
    all_huge = spark.createDataFrame(list(enumerate(huge.tolist())), "vec_id bigint, embedding array<double>")
    assert neighbours.search(all_huge, vectors.divisible(20), top=20).count() == 40


def test_neighbours_among_thousands_of_near_copies():
    rng = np.random.default_rng(5)
    copies = rng.normal(size=32) + 1e-7 * rng.normal(size=(3000, 32))
    matrix = np.concatenate([copies, rng.normal(size=(1000, 32))])
    row = {**neighbours.graph_index(np.arange(4000), matrix), "dim": 32}
    asked = np.arange(0, 3000, 60)
    at, hits, _ = neighbours.search_shard(row, asked, matrix[asked], 20, neighbours.BEAM)
    recall = []
    for position, q in enumerate(asked):
        scores = [(-math.fsum((v * matrix[q]).tolist()), i) for i, v in enumerate(matrix) if i != q]
        best = {i for _, i in sorted(scores)[:20]}
        recall.append(len(best & set(hits[at == position].tolist())) / 20)
    assert np.mean(recall) >= 0.8


def test_all_of_the_beam_is_scored(monkeypatch):
    rng = np.random.default_rng(6)
    matrix = rng.normal(size=16) + 1e-9 * rng.normal(size=(120, 16))
    row = {**neighbours.graph_index(np.arange(120), matrix), "dim": 16}
    beam, reached = neighbours.beam_search, []

    def backwards(*args):
        nodes, values = beam(*args)
        reached.append(nodes[0])
        return nodes[:, ::-1], values[:, ::-1]

    monkeypatch.setattr(neighbours, "beam_search", backwards)
    _, hits, _ = neighbours.search_shard(row, np.array([7]), matrix[[7]], 20, 128)
    ids = np.frombuffer(row["ids"], "<i8")[reached[-1][reached[-1] >= 0]].tolist()
    assert sorted(ids) == list(range(120))
    scores = [(-math.fsum((matrix[i] * matrix[7]).tolist()), i) for i in ids if i != 7]
    assert hits.tolist() == [i for _, i in sorted(scores)[:20]]


def test_no_vectors(points):
    none = points.limit(0)
    assert topk.search(none, vectors.divisible(100)).count() == 0
    assert neighbours.search(none, vectors.divisible(20)).count() == 0


# Archives

PAGES = "page_id bigint, url string, html string, payload string"


def test_archives(spark, work):
    long = "<p>ü</p>" * 200
    rows = [
        (1, "http://a/", long), (5, "http://b/\r\nX: y", long), (3, None, long), (None, "u", long),
        (2, "http://c/", "short"), (4, "http://d/", "short"), (6, "e", None), (7, "f", ""),
        (8, "g", "WARC/1.1\r\n\r\n" * 300),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], PAGES)
    warc.write_archives(pages, work, archive_bytes=600)
    found = warc.read_archives(spark, work).collect()
    assert [r for r in found if r.gap] == [] and len(found) == len(rows)
    by_id = {warc_id(r.record_id): r for r in found}
    assert {i: (r.record_type, warc_id(r.refers_to)) for i, r in by_id.items()} == {
        1: ("revisit", 5), 3: ("revisit", 5), None: ("revisit", 5), 5: ("response", None),
        2: ("response", None), 4: ("response", None), 6: ("response", None),
        7: ("response", None), 8: ("response", None),
    }
    assert by_id[1].payload_bytes == by_id[5].payload_bytes == len(long.encode())
    assert by_id[1].payload_digest == by_id[5].payload_digest
    assert bytes(by_id[5].payload) == long.encode() and by_id[5].target_uri.startswith("http://b/%0D")
    assert by_id[6].payload_bytes == 0


@pytest.mark.parametrize("attributes, hidden", [
    ("hidden", True), ("class=x hidden=''", True), ('style="color: red; display:none"', True),
    ("style='visibility : hidden'", True), ('aria-hidden="true"', True), ('title="the hidden truth"', False),
    ('style="display: block"', False), ('aria-hidden="false"', False), ("data-hidden=1", False), ("", False),
])
def test_what_an_element_hides_is_no_text(attributes, hidden):
    page = f"<main><p>Shown first.</p><div {attributes}><main><p>Between.</p></main></div><p>Shown last.</p></main>"
    text = html_blocks.main_text(page, html_blocks.Field())
    assert text.split("\n") == ["Shown first.", *([] if hidden else ["Between."]), "Shown last."]


@pytest.mark.parametrize("mark", ["class=discussion-thread", "class='feedback'", "id=thread", "class=commentList"])
def test_comments_by_other_names(mark):
    page = f"<article><p>The text.</p></article><section {mark}><article><p>A reader.</p></article></section>"
    assert html_blocks.main_text(page, html_blocks.Field()) == "The text."


@pytest.mark.parametrize("common", [1, 4, 1000])
def test_groups_of_copies_and_archives_by_bytes(spark, work, common, monkeypatch):
    monkeypatch.setattr(warc, "COMMON", common)
    body = lambda k: f"<p>{k}</p>" * 300
    rows = [(i, f"u{i}", body(0 if i < 60 else i % 7)) for i in range(100)] + [(100 + i, "v", "x") for i in range(9)]
    pages = spark.createDataFrame([(*r, "") for r in rows], PAGES)
    warc.write_archives(pages, work, archive_bytes=4000)
    found = warc.read_archives(spark, work, payload=False)
    assert "payload" not in found.columns
    last = {}
    for i, _, html in rows:
        last[html] = max(i, last.get(html, 0))
    expected = {i: last[html] if len(html) >= 1000 and last[html] != i else None for i, _, html in rows}
    assert {warc_id(r.record_id): warc_id(r.refers_to) for r in found.collect()} == expected
    sizes = [r.length for r in spark.read.format("binaryFile").load(work).select("length").collect()]
    assert len(sizes) > 3 and max(sizes) < 6000


def warc_id(record_id):
    digits = (record_id or "").removeprefix(warc.RECORD_ID)
    return int(digits) if digits else None


def test_no_pages(spark, work):
    warc.write_archives(spark.createDataFrame([], PAGES), work)
    assert warc.read_archives(spark, work).count() == 0


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("harm", ["flip", "cut", "junk", "length"])
def test_salvage(packed, harm):
    plain = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 40, None) for i in range(5)]
    if harm == "length":
        plain[2] = plain[2].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    parts = [gzip.compress(p, mtime=0) for p in plain] if packed else list(plain)
    whole = list(parts)
    if harm == "flip":
        middle = len(parts[2]) // 2
        parts[2] = parts[2][:middle] + bytes([parts[2][middle] ^ 255]) + parts[2][middle + 1 :]
    elif harm == "cut":
        parts[2] = parts[2][: len(parts[2]) // 2]
    elif harm == "junk":
        parts[2] = b"\x1f\x8b\x08WARC/1.1\r\n" + b"junk" * 20
    found = list(warc.salvage(b"".join(parts)))
    assert [r["record_id"][-1] for r in found if not r["gap"]] == ["0", "1", "3", "4"]
    gaps = [r for r in found if r["gap"]]
    begin = sum(map(len, whole[:2]))
    assert [(g["offset"], g["size"]) for g in gaps] == [(begin, len(parts[2]))]
    assert list(warc.salvage(b"")) == []
    assert [r["gap"] for r in warc.salvage(b"nothing")] == ["no version line"]


def ids_of(found):
    return [r["record_id"][-1] for r in found if not r["gap"]]


@pytest.mark.parametrize("harm", ["digest", "length", "version"])
def test_salvage_within_a_member(harm):
    plain = [warc.record(i, f"http://x/{i}", b"payload %d " % i * 40, None) for i in range(5)]
    change = {
        "digest": (b"payload 2", b"payload X"),
        "length": (b"\r\nContent-Length: ", b"\r\nContent-Length: 9"),
        "version": (b"WARC/1.1", b"WARK/1.1"),
    }[harm]
    plain[2] = plain[2].replace(*change, 1)
    members = [gzip.compress(b"".join(plain), mtime=0), gzip.compress(plain[0], mtime=0)]
    found = list(warc.salvage(b"".join(members)))
    assert ids_of(found) == ["0", "1", "3", "4", "0"]
    assert [r["gap"] is None for r in found] == [True, True, False, True, True, True]
    gap = found[2]
    assert (gap["offset"], gap["size"]) == (0, len(members[0]))
    assert (gap["inner"], gap["inner_size"]) == (len(plain[0] + plain[1]), len(plain[2]))


@pytest.mark.parametrize("level", [0, 6])
@pytest.mark.parametrize("harm", ["cut", "crc", "flip"])
def test_salvage_before_the_damage(harm, level):
    rng = np.random.default_rng(3)
    plain = [warc.record(i, f"http://x/{i}", rng.bytes(30_000), None) for i in range(5)]
    whole = gzip.compress(b"".join(plain), level, mtime=0)
    member = bytearray(whole)
    if harm == "cut":
        del member[len(member) // 2 :]
    elif harm == "crc":
        member[-8] ^= 255
    else:
        member[len(member) // 2] ^= 255
    last = gzip.compress(warc.record(9, "http://x/9", b"last", None), mtime=0)
    for rest in (last, b""):
        found = list(warc.salvage(bytes(member) + rest))
        expected = {"cut": ["0", "1"], "crc": list("01234"), "flip": list("0134")}[harm]
        assert ids_of(found) == expected + ["9"] * bool(rest)
        gaps = [r for r in found if r["gap"]]
        assert gaps and all(g["offset"] == 0 for g in gaps)
        assert gaps[-1]["size"] == len(member)
        assert gaps[0]["inner"] == sum(map(len, plain[: 5 if harm == "crc" else 2]))


def test_salvage_trusts_no_damaged_member_without_digests():
    plain = warc.record(1, "http://x/", b"payload", None).split(b"\r\n")
    plain = b"\r\n".join(line for line in plain if b"Digest" not in line)
    member = bytearray(gzip.compress(plain, mtime=0))
    assert ids_of(warc.salvage(bytes(member))) == ["1"]
    member[-8] ^= 255
    assert [r["gap"] for r in warc.salvage(bytes(member))] == ["damaged member"]


# Pages


def test_main_text_of_unseen_pages(spark, folder):
    field = html_blocks.train(table(spark, folder, "pages"))
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
    <header><h1>Site</h1></header><div class="cookie-notice"><p>We use cookies, please agree.</p></div>
    <nav><ul><li><a href="x>y">Menu</a><li>More</ul></nav><!-- <p>hidden</p> -->
    <main><article><h2>Title &amp; more</h2><p>First <b>bold</b>,
      second&#33;<br>third<p>Unclosed paragraph, with a comma.<script>var a = "</p>";</script>
    <ul><li>one<li>two</ul><form><label>Mail</label><input></form>
    <section id="comments"><p>Nice article, I read all of it.</p></section></article></main>
    <aside><p>Read this other story, it is a long one.</p></aside><footer>&copy; us</footer>"""
    assert html_blocks.main_text(page, field).split("\n") == [
        "Title & more", "First bold, second! third", "Unclosed paragraph, with a comma.", "one", "two",
    ]
    pages = spark.createDataFrame(
        [(1, None, "k"), (2, "", "k"), (2, "", "k"), (3, "<nav>only a menu", None)],
        "page_id int, html string, `row` string",
    )
    assert [r.text for r in html_blocks.extract(pages, field).collect()] == [""] * 4
    assert html_blocks.extract(pages.limit(0), field).count() == 0
    prior = html_blocks.train(pages.limit(0))
    assert html_blocks.main_text("<article><p>a</p></article><nav>b</nav>", prior) == "a"


TEXT = "<p>First sentence of the text here.</p><p>Second sentence of the text.</p>"
OTHER = "<p>What a nice text, I read it.</p><p>I did as well, twice.</p>"
MENU = "<nav><ul><li><a href=/>Home</a><li><a href=/a>About</a></ul></nav>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{TEXT}</article><section id=comments><article>{OTHER}</article></section>",
        f"<article>{TEXT}<section id=comments><article>{OTHER}</article></section></article>",
        f"<main>{TEXT}</main><aside><article><h3>More</h3>{OTHER}</article></aside>",
        f"<article>{TEXT}<aside><article>{OTHER}</article></aside></article>",
        f"<article>{TEXT}</article><ol class='comment-list'><li><article>{OTHER}</article></ol>",
        f"<div class=sidebar><article class=teaser>{OTHER}</article></div><main>{TEXT}</main>",
        f"<article class='post tag-warning'>{TEXT}</article><div class=cookie-notice>{OTHER}</div>",
        f"<article class='hentry category-social'>{TEXT}</article><footer>us</footer>",
        f"<main class='content has-sidebar'>{TEXT}</main><div class=sidebar>{OTHER}</div>",
        f"<div class='layout has-sidebar'><article><div>{TEXT}</div></article></div>",
        f"<form id=page><main>{TEXT}</main></form><footer>us</footer>",
        # Nothing is listed here: parent, text, links and neighbours decide.
        f"<div><ul><li><a href=/>Home</a><li><a href=/a>Us</a></ul></div><div>{TEXT}</div><div>© x</div>",
    ],
)
@pytest.mark.parametrize("menu", ["", MENU])
def test_main_text_by_all_ancestors(spark, folder, page, menu):
    if "pages" not in _field:
        _field["pages"] = html_blocks.train(table(spark, folder, "pages"))
    text = html_blocks.main_text(f"<body class='single has-sidebar'>{menu}{page}", _field["pages"])
    assert text.split("\n") == ["First sentence of the text here.", "Second sentence of the text."]


_field = {}


def test_links_within_an_article(spark, folder):
    field = html_blocks.train(table(spark, folder, "pages"))
    links = "<ul>" + "<li><a href=q>Source</a>" * 5 + "</ul>"
    page = f"<body>{MENU}<article><p>One sentence.</p>{links}</article><footer>us</footer>"
    assert html_blocks.main_text(page, field).split("\n") == ["One sentence."] + ["Source"] * 5


def test_labels_are_no_feature():
    pages = [
        html_blocks.leaf_blocks(f"<body>{MENU}<article>{TEXT}</article><section id=comments><article>{OTHER}"),
        html_blocks.leaf_blocks(f"<body>{MENU}<div class=promo>{OTHER}</div><main>{TEXT}<form>{OTHER}"),
    ]
    rows = []
    for blocks in pages:
        rows += zip(html_blocks.page_features(blocks), html_blocks.marked_labels(blocks))
    for feature in {f for features, _ in rows for f in features}:
        assert {(feature in features) == bool(label) for features, label in rows} != {True}
        assert {(feature in features) != bool(label) for features, label in rows} != {True}
    bare = [f for blocks in pages for own in html_blocks.page_features(blocks, False) for f in own]
    assert all(f.startswith("bare ") for f in bare)


def test_misnested_inline_elements_and_contexts():
    blocks = html_blocks.leaf_blocks("<article><b class=ad><i>x</b>y</i><p>z")
    assert [(b.text, b.around.kind) for b in blocks] == [("xy", "main"), ("z", "main")]


@pytest.mark.parametrize(
    "raw",
    [
        "<svg class='icon' viewBox='0 0 1 1'/>",
        "<svg/>",
        "<svg><title>no</title><svg><text>no</text></svg><text>no</text></svg>",
        "<svg><svg/><text>no</text></svg>",
        "<svg><foreignObject><p>no</p><svg><text>no</text></svg></foreignObject><text>no</text></svg>",
        "<SVG><!-- </svg> --><a title='</svg>'>no</a></SVG >",
        "<template>no<template>no</template>no</template>",
        "<template><script>'</template>'</script><svg>no</template>",
        "<svg><path d='M0 0'>",
    ],
)
def test_foreign_and_nested_raw_elements(raw):
    page = f"<article><p>one {raw}<p>two</p>{raw}<p>three</p></article><footer>us</footer>"
    assert html_blocks.main_text(page, html_blocks.Field()).split("\n") == ["one", "two", "three"]


def test_deeply_nested_raw_elements():
    page = "<article><p>one</p>" + "<svg>" * 20_000 + "no" + "</svg>" * 20_000 + "<p>two</p>"
    assert [b.text for b in html_blocks.leaf_blocks(page)] == ["one", "two"]


def test_viterbi_and_marginals_against_all_sequences():
    rng = np.random.default_rng(1)
    field = html_blocks.Field({f"f{i}": rng.normal(size=2).tolist() for i in range(4)}, rng.normal(size=(2, 2)))
    features = [["f0"], ["f1", "f2"], ["f3"], ["f0", "f3"]]
    unary = field.scores(features)
    total = {}
    for code in range(16):
        labels = [code >> i & 1 for i in range(4)]
        value = sum(unary[i, l] for i, l in enumerate(labels))
        total[tuple(labels)] = value + sum(field.moves[a, b] for a, b in zip(labels, labels[1:]))
    assert tuple(field.decode(features)) == max(total, key=total.get)
    weight = {k: math.exp(v) for k, v in total.items()}
    single, double = html_blocks.marginals(unary, field.moves)
    for i in range(4):
        share = sum(w for k, w in weight.items() if k[i]) / sum(weight.values())
        assert single[i, 1] == pytest.approx(share)
    assert double.sum() == pytest.approx(3)


# Pipeline


def test_stages_on_odd_rows(spark, odd, none, folder):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            made = stage(spark, docs, folder)
            if name != "tokens":
                assert made.columns == docs.columns
                assert [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
            made.collect()
    kept = corpus_pipeline.keep_one_of_each(spark, odd, folder).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 3, 6, 7, 8, 9]
    assert sum(r.doc_id is None for r in kept) == 1


def test_stages_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    identified = corpus_pipeline.identify_language(spark, docs, folder)
    assert identified.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    cleaned = corpus_pipeline.drop_shared_lines(spark, docs, folder).collect()
    expected = brute_lines([r.text for r in docs.collect()], 10)
    assert sorted(r.text for r in cleaned) == sorted(k[2] for k, n in expected.items() for _ in range(n))
    assert all(r.n_chars == len(r.text) for r in cleaned if r.n_chars is not None)
    prints = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    roots = brute_components(prints.values(), 2)
    smallest = {}
    for i, p in prints.items():
        smallest[roots[p]] = min(i, smallest.get(roots[p], i))
    kept = corpus_pipeline.keep_one_of_each(spark, docs, folder)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)


def brute_copies(rows):
    """How often the mix takes each (doc_id, text, source)."""
    streams = defaultdict(list)
    for doc_id, text, source in rows:
        content = hashlib.md5((text or "").encode()).hexdigest()
        order = hashlib.md5(f"17:{doc_id}:{content}".encode()).hexdigest()
        words = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        streams[source].append((order, words, doc_id))
    goals = brute_targets({source: sum(words for _, words, _ in own) for source, own in streams.items()})
    copies = {}
    for source, own in streams.items():
        left = math.floor(round(goals[source], 6) + 0.5)
        taken = Counter()
        for _ in range(3):
            for _, words, doc_id in sorted(own):
                some = min(words, left)
                taken[doc_id] += some
                left -= some
        first = next((doc_id for _, words, doc_id in sorted(own) if words), None)
        for _, words, doc_id in own:
            copies[doc_id] = math.floor(taken[doc_id] / words + 0.5) if words else 0
            if doc_id == first and taken[doc_id]:
                copies[doc_id] = max(1, copies[doc_id])
    return copies


def test_mixing_stage_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    expected = brute_copies([(r.doc_id, r.text, r.source) for r in docs.collect()])
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    got = Counter(map(tuple, mixed.collect()))
    own = {r.doc_id: tuple(r) for r in docs.collect()}
    assert got == Counter({own[i]: n for i, n in expected.items() if n})
    assert len(set(expected.values())) > 2


def test_no_small_source_loses_all_its_documents(spark):
    rows = [(i, "w " * 40, "en", f"s{i:03}", 80) for i in range(300)] + [(999, None, None, "s999", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.mix_sources(spark, docs, None)
    assert {r.source for r in kept.collect()} == {r[3] for r in rows if r[1]}


def without_shared_lines(texts):
    """The texts without the lines that ten of them share."""
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(upper)
    split = [text.split("\n") for text in texts]
    seen = Counter(k for lines in split for k in set(map(key, lines)) if k)
    return ["\n".join(line for line in lines if seen[key(line)] < 10) for lines in split]


def test_run_against_brute_force(spark, folder):
    docs = table(spark, folder, "documents")
    # Which documents have a language, the rows that are kept, and the texts without shared lines.
    rows = [r for r in docs.collect() if re.search(r"[^\W\d_]", r.text or "")]
    identified = corpus_pipeline.identify_language(spark, docs, folder).collect()
    assert Counter(map(tuple, identified)) == Counter(map(tuple, rows))
    texts = without_shared_lines([r.text for r in rows])
    alone = [(r.doc_id, r.lang, r.source, text) for r, text in zip(rows, texts)]
    prints = {i: brute_fingerprint(text) for i, _, _, text in alone}
    roots = brute_components(prints.values(), 2)
    smallest = {}
    for i, p in prints.items():
        smallest[roots[p]] = min(i, smallest.get(roots[p], i))
    kept = [row for row in alone if row[0] in set(smallest.values())]
    copies = brute_copies([(i, text, source) for i, _, source, text in kept])
    library = Tokenizer.from_str(VOCABULARY)
    expected = Counter()
    for i, lang, source, text in kept:
        ids = library.encode(text, add_special_tokens=False).ids
        if copies[i]:
            digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            decoded = library.decode(ids, skip_special_tokens=False)
            text_digest = hashlib.sha256(decoded.encode()).hexdigest()
            expected[i, lang, source, tuple(ids), len(ids), digest, text_digest] += copies[i]
    got = Counter(
        (r.doc_id, r.lang, r.source, tuple(r.ids), r.n_tokens, r.ids_sha256, r.decoded_sha256)
        for r in corpus_pipeline.run(spark, folder).collect()
    )
    assert got == expected
