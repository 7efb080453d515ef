"""Operators on documents, against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from harborlane import session
from harborlane.llm import bpe, language, line_dedup, mixing, queries, simhash, toxicity
from harborlane.llm.common import held_out, table
from harborlane.sinks import storage
from tests.compare import connect, differences
from tests.llm.conftest import LONG

VOCABULARY = bpe.read_vocabulary(public_tokenizers.path(queries.VOCABULARY))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, folder, name):
    assert not differences(
        spark, connect(folder), folder, queries.QUERIES[name], queries.ORACLES[name]
    )


# Lines


def brute_lines(texts, min_docs):
    split = [(t or "").split("\n") for t in texts]
    upper = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    keys = [[line.strip(" \t\n\x0b\x0c\r").translate(upper) for line in lines] for lines in split]
    seen = Counter(k for own in keys for k in set(own) if k)
    kept = [
        [line for line, k in zip(lines, own) if not k or seen[k] < min_docs]
        for lines, own in zip(split, keys)
    ]
    return Counter(
        (len(lines), len(lines) - len(some), "\n".join(some)) for lines, some in zip(split, kept)
    )


@pytest.mark.parametrize("min_docs", [2, 3, 4, 99])
def test_lines(odd, min_docs):
    texts = [r.text for r in odd.collect()]
    got = line_dedup.drop_lines(odd, min_docs=min_docs)
    assert Counter((r.lines, r.dropped, r.kept) for r in got.collect()) == brute_lines(texts, min_docs)
    assert got.select("row.*").columns == odd.columns


def test_many_batches_count_as_one(odd):
    expected = sorted(line_dedup.drop_lines(odd, min_docs=3, batches=1).select("kept").collect())
    found = line_dedup.drop_lines(odd, min_docs=3, batches=7, fanout=2).select("kept").collect()
    assert sorted(found) == expected


def test_runs_leave_settled_keys_out(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=3)
    batch = spark.createDataFrame([(b"a", 5), (b"b", 1)], "key binary, documents bigint")
    for _ in range(3):
        runs.add(batch, 4)
    assert [len(level) for level in runs.levels] == [0, 1]
    assert {bytes(r.key): r.documents for r in runs.totals().collect()} == {b"a": 5, b"b": 3}


def test_counts_of_several_runs_are_added(spark):
    """A key that no run alone shows to be frequent, in runs of two levels."""
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for documents in (3, 1, 2):
        runs.add(spark.createDataFrame([(b"a", documents)], "key binary, documents bigint"), 99)
    assert [len(level) for level in runs.levels] == [1, 1]
    assert [tuple(r) for r in runs.totals().collect()] == [(b"a", 6)]
    runs.drop()


def test_runs_are_read_in_their_order(spark):
    """No exchange and no sort above a run; a run is a bucket a file."""
    runs = line_dedup.LineRuns(spark, buckets=3, fanout=9)
    one = spark.createDataFrame([(bytes([65 + i]), 5) for i in range(20)], "key binary, documents bigint")
    runs.add(one, 4)
    with line_dedup.ordered_buckets(spark):
        first, batch = runs.runs()[0], runs.runs()[0]
        joined = batch.join(first.where("documents >= 4").hint("merge"), "key", "left_anti")
        plan = spark._jvm.PythonSQLUtils.explainString(joined._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert joined.count() == 0


def test_no_runs_are_left(spark, odd):
    folder = f"{session.work_dir(spark)}/harborlane/llm-line-runs"

    def there():
        tables = {t.name for t in spark.catalog.listTables() if t.name.startswith("harborlane_run_")}
        return tables, set(storage.names(spark, folder))

    before = there()
    found = line_dedup.drop_lines(odd, min_docs=3, batches=7, fanout=2)
    assert there() == before and found.count() == odd.count()


@pytest.mark.parametrize("common", [1, 3, 10**6])
def test_common_keys_apart(odd, common, monkeypatch):
    expected = sorted(line_dedup.drop_lines(odd, min_docs=2).select("kept").collect())
    monkeypatch.setattr(line_dedup, "COMMON", common)
    assert sorted(line_dedup.drop_lines(odd, min_docs=2).select("kept").collect()) == expected


def test_no_lines(none):
    assert line_dedup.drop_lines(none).count() == 0


# Near-duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    width = min(3, len(words))
    hashes = [
        xxhash.xxh64_intdigest(" ".join(words[i : i + width]).encode(), 42)
        for i in range(len(words) - width + 1)
    ]
    value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def brute_components(values, most):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= most:
                root[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_fingerprints(odd):
    for row in simhash.fingerprints(odd, "text", ["text"]).collect():
        if row.text != LONG:
            assert row.fingerprint == brute_fingerprint(row.text)


@pytest.mark.parametrize("crowd", [0, 3, 512])
def test_links_and_components(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    values = set(centres)
    for c in centres:
        for _ in range(8):
            c ^= 1 << rng.randrange(64)
            c ^= 1 << rng.randrange(64)
            values.add(c)
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint bigint")
    found = simhash.links(frame, 2).collect()
    near = {
        (min(a, b), max(a, b))
        for a in values for b in values
        if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    }
    assert {(r.a, r.b) for r in found} == near
    roots = brute_components(values, 2)
    smallest = {}
    for v, r in roots.items():
        smallest[r] = min(v, smallest.get(r, v))
    got = {r.node: r.component for r in simhash.components(simhash.links(frame, 2)).collect()}
    assert got == {v: smallest[roots[v]] for pair in near for v in pair}


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd, keep=["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    ids = {r.text: r.component_id for r in rows}
    assert ids[""] == ids[None] == ids["\n\n"] == 3  # no words: fingerprint zero
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert ids["der Hund und die Katze sind im Haus"] is None
    assert simhash.near_duplicates(none).count() == 0


# Languages


def test_language_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    out = held_out(F.col("doc_id"))
    model = language.learn(docs.where(language.learnable(out, "text", "lang")))
    rows = language.predict(docs.where(out), model).select("row.lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def brute_profile(text):
    counts = Counter()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            counts.update(
                g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g.strip()
            )
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    ranked = sorted(counts, key=lambda g: (-counts[g], code(g)))
    return [code(g) for g in ranked[: language.PROFILE_SIZE]]


def test_language_against_brute_force(spark):
    taught = {"de": "der Hund und die Katze sind im Haus, üben", "en": "the dog and the cat are in"}
    docs = spark.createDataFrame([(t, l) for l, t in taught.items()], "text string, lang string")
    model = language.learn(docs)
    profiles = {l: {g: i for i, g in enumerate(brute_profile(t))} for l, t in taught.items()}
    for text in ("die Katze", "cat in the house", "x1y", "ÜBEN!"):
        top = brute_profile(text)
        far = {
            l: sum(abs(p[g] - i) if g in p else language.PROFILE_SIZE for i, g in enumerate(top))
            for l, p in profiles.items()
        }
        row = language.predict(spark.createDataFrame([(text,)], "text string"), model).first()
        assert row.lang_pred == min(sorted(far), key=far.get)
        assert row.score == pytest.approx(1 - min(far.values()) / len(top) / language.PROFILE_SIZE)


def test_slices_keep_the_ngrams(monkeypatch):
    kinds = language.character_kinds()
    text = "Hello wörld, das ist ein Test! " * 20
    whole = language.counted([text], kinds)
    monkeypatch.setattr(language, "SLICE", 50)
    cut = language.counted([text], kinds)
    assert all((a == b).all() for a, b in zip(whole, cut))


def test_language_of_odd_rows(odd, none):
    model = language.learn(odd)
    rows = language.predict(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.row.text or ""))
    nothing = language.learn(none)
    assert {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.predict(none, model).count() == 0


# Toxicity


def test_toxicity_held_out(spark):
    scored = queries.op1_toxicity(spark, "/root/testdata/sf0.1")
    rows = scored.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").where("held_out")
    toxic = [r.predicted for r in rows.collect() if r.toxic == 1]
    clean = [r.predicted for r in rows.collect() if r.toxic == 0]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.01


def test_word_hashes_do_not_depend_on_place():
    hasher = toxicity.WordHashes()
    data = np.frombuffer("Hello wörld hello WÖRLD's".encode(), np.uint8)
    hashes, rows = hasher.words(data, np.array([0, 12, len(data)]))
    assert rows.tolist() == [0, 0, 1, 1] and hashes[0] == hashes[2] and len(set(hashes.tolist())) == 3


def plain_features(text):
    """The different features of a text as strings."""
    words = re.findall(rb"[0-9'a-z\x80-\xff]+", text.encode().translate(bytes.maketrans(
        b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")))
    return set(words) | {("pair", *p) for p in zip(words, words[1:])} | {("skip", *p) for p in zip(words, words[2:])}


def plain_ftrl(shards, rounds, passes):
    """Weights by feature: a dictionary for each number, one row and one feature after the other."""
    state = {}
    for _ in range(rounds):
        made = []
        for rows in shards:
            z, n = ({f: v[i] for f, v in state.items()} for i in (0, 1))
            for _ in range(passes):
                for found, label in rows:
                    weight = {f: plain_weight(f, z.get(f, 0.0), n.get(f, 0.0)) for f in found}
                    p = 1 / (1 + math.exp(-max(-35, min(35, sum(weight.values())))))
                    for f, w in weight.items():
                        old, g = n.get(f, 0.0), p - label
                        sigma = (math.sqrt(old + g * g) - math.sqrt(old)) / toxicity.ALPHA
                        z[f], n[f] = z.get(f, 0.0) + g - sigma * w, old + g * g
            made.append((z, n))
        every = {f for z, _ in made for f in z}
        state = {f: tuple(sum(m[i].get(f, 0.0) for m in made) / len(shards) for i in (0, 1)) for f in every}
    return {f: w for f, (z, n) in state.items() if (w := plain_weight(f, z, n))}


def plain_weight(feature, z, n):
    l1 = 0.0 if feature == "intercept" else toxicity.L1
    if abs(z) <= l1:
        return 0.0
    return (math.copysign(l1, z) - z) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)


@pytest.mark.parametrize("rows_per_shard", [1000, 30])
def test_toxicity_against_plain_ftrl(spark, rows_per_shard, monkeypatch):
    monkeypatch.setattr(toxicity, "ROWS_PER_SHARD", rows_per_shard)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Bad", "\u00fcbel", "it's"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 25))) for _ in range(120)]
    marks = [int("Bad" in t or rng.random() < 0.05) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    got = toxicity.train(docs, labels)
    shards = -(-120 // rows_per_shard)
    keys = {r.id: r.key for r in spark.range(120).select("id", F.xxhash64("id", F.lit("toxic")).alias("key")).collect()}
    parts = [[] for _ in range(shards)]
    for i in sorted(keys, key=lambda i: (keys[i], marks[i])):
        if keys[i] % (1 << 20) < 1 << 20:
            parts[(keys[i] >> 20) % shards].append((plain_features(texts[i]) | {"intercept"}, marks[i]))
    expected = plain_ftrl(parts, toxicity.ROUNDS, toxicity.PASSES)
    assert len(expected) > 3 and any(abs(w) > 1 for w in expected.values())
    assert got[toxicity.INTERCEPT] == pytest.approx(expected["intercept"])
    assert sorted(got.values()) == pytest.approx(sorted(expected.values()))
    scores = {r.row.doc_id: r.score for r in toxicity.score(docs, got).collect()}
    for i, text in enumerate(texts):
        total = sum(expected.get(f, 0.0) for f in plain_features(text) | {"intercept"})
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame(
        [(1, 0), (2, 1), (2, 0), (6, 0), (7, None), (None, 1), (9, 5)], "doc_id bigint, toxic int"
    )
    weights = toxicity.train(odd, labels)
    rows = toxicity.score(odd, weights).collect()
    assert len(rows) == odd.count() and all(0 < r.score < 1 for r in rows)
    empty = {r.score for r in rows if not r.row.text}
    assert len(empty) == 1
    assert {r.score for r in toxicity.score(odd, toxicity.train(none, labels)).collect()} == {0.5}
    assert toxicity.score(none, weights).count() == 0


# Byte pairs


def test_encoder_matches_the_library():
    library, own = Tokenizer.from_str(VOCABULARY), bpe.Encoder(VOCABULARY)
    rng = random.Random(5)
    texts = [
        "", " \n", "Hello's world!!", "a" * 3000, "日本語のテキスト、Ｔｅｓｔ", "\x1c a\x85b\xa0c",
        "x<|endoftext|>y <|startoftext|>", "é ΑΣ ŉx İa Éßſt ×÷ ªº µ", "don't we'LL 4½ #%$", LONG,
    ]
    spans = [(32, 127), (160, 1500), (0x3000, 0x9FFF), (0, 40), (0x1F300, 0x1FF00)]
    for _ in range(1500):
        texts.append("".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(rng.randrange(30))))
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text.encode()), np.int32).tolist() == expected, text[:80]


def test_long_and_short_merging_agree():
    own = bpe.Encoder(VOCABULARY)
    for text in (b"international", b"thethethethethe", b"aaaaaaaaab"):
        parts = [own.first[b] for b in text]
        assert own._merge_long(list(parts)) == own._merge(text, False)


def test_bpe_of_odd_rows(odd, none):
    library = Tokenizer.from_str(VOCABULARY)
    made = bpe.encode(odd, VOCABULARY, ["text", "key"], decoded=True)
    again = bpe.decode(made.drop("decoded"), VOCABULARY).select("text", "decoded")
    texts = {r.text: r.decoded for r in again.collect()}
    for row in made.collect():
        expected = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == expected
        assert row.decoded == library.decode(expected, skip_special_tokens=False) == texts[row.text]
    assert bpe.encode(none, VOCABULARY, ["doc_id"]).count() == 0


def test_unknown_ids_are_left_out(spark):
    ids = spark.createDataFrame([([320, -1, 10**7, 320],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.decode(ids, VOCABULARY).collect()] == ["a</w> a</w>", "", ""]


# Mixing


def test_bits_are_reversed(spark):
    frame = spark.range(8).select(mixing.reversed_bits(F.col("id"), F.lit(3)).alias("r"))
    assert [r.r for r in frame.collect()] == [0, 4, 2, 6, 1, 5, 3, 7]


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        target = {s: 3.0 * sizes[s] for s in full}
        target |= {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        more = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix(spark, folder):
    docs = table(spark, folder, "documents").withColumn(
        "source", F.when(F.col("doc_id") % 50 == 0, None).when(F.col("doc_id") < 3, "src00")
        .otherwise(F.col("source")),
    )
    rows = mixing.mix(docs, slot_words=16).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    goals = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goals[r.source])
    for source, goal in goals.items():
        assert abs(taken[source] - goal) <= 0.5 + 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs, slot_words=16).collect()))


def test_slots_are_ranked_in_the_order_of_the_mix(spark, odd):
    sized = odd.select("source", mixing.word_count(F.col("text")).alias("size"))
    goals = mixing.with_slots(mixing.targets(mixing.source_sizes(sized, "source", "size")), 64)
    slots = sorted((r.slot, r.inner, r.place, r.rank) for r in mixing.schedule(goals).collect())
    own = {r.place: r for r in goals.collect() if r.due}
    common = [s for s, inner, place, _ in slots if own[place].bits == own[place].common]
    assert common and len(common) == len(set(common)) and all(0 <= x[1] < 1 for x in slots)
    seen = Counter()
    for _, _, place, rank in slots:
        assert rank == seen[place]
        seen[place] += 1
    assert seen == {place: r.slots for place, r in own.items()} and min(seen.values()) >= 4


def test_shares_of_slots_are_exact(spark):
    """Point by point, with fractions: also where shares are far below a rounding error of 1."""
    dues = [2**57, 1, 5, 2**40, 3, 0, 7 * 10**15]
    total, low, rows = sum(dues), 0, []
    for place, due in enumerate(dues, 1):
        rows.append((place, due, low, low + due, total))
        low += due
    goals = spark.createDataFrame(rows, "place bigint, due bigint, low bigint, high bigint, total bigint")
    found = {r.place: r for r in mixing.with_slots(goals, 128).collect()}
    for place, due, low, high, _ in rows:
        r = found[place]
        assert r["first"] == -(-low * 2**r.bits // total) and r.end == -(-high * 2**r.bits // total)
        assert r.common == 30 and (r.slots >= min(4, due) if due else r.slots == 0)


def test_reversed_bits_of_many_bits(spark):
    values = [(v, b) for b in (1, 5, 31, 32, 33, 47, 62) for v in (0, 1, 2**b - 1, 2**b // 3, 2 ** (b - 1))]
    frame = spark.createDataFrame(values, "v bigint, b int")
    for r in frame.select("v", "b", mixing.reversed_bits(F.col("v"), F.col("b")).alias("r")).collect():
        assert r.r == int(f"{r.v:0{r.b}b}"[::-1], 2)


def test_small_sources_keep_their_words(spark):
    """Sources far below a slot, with production values: a large one and many tiny ones."""
    rows = [(i, f"s{i % 1000:04}", "w " * 10) for i in range(4000)]
    rows += [(4000 + i, "large", "w " * 500) for i in range(400)]
    rows += [(9000, "one", "w"), (9001, "none", " ")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for some in (docs, docs.where("source like 's%'")):
        found = mixing.mix(some).collect()
        sizes, taken, goals = Counter(), Counter(), {}
        for r in found:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            goals[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
        assert goals == pytest.approx(brute_targets(sizes))
        assert all(abs(taken[s] - goal) <= 0.5 + 1e-6 for s, goal in goals.items())
        assert all(taken[s] > 0 for s, size in sizes.items() if size)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.size == 0)
    assert mixing.mix(none).count() == 0
    empty = odd.withColumn("text", F.lit(None).cast("string"))
    assert {(r.size, r.taken) for r in mixing.mix(empty).collect()} == {(0, 0)}


def test_digests_are_those_of_the_operator(spark, folder):
    library = Tokenizer.from_str(VOCABULARY)
    texts = {r.doc_id: r.text for r in table(spark, folder, "documents").collect()}
    for row in queries.op5_bpe(spark, folder).collect():
        ids = library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
