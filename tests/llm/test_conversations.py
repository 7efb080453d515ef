"""Repair against trying all edits, by a plain dynamic program on whole rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from harborlane.llm import conversations as c, queries

LETTERS = "suaxSUAX-"


def every_path(turns, limit):
    """(cost, audit) of all edits within a cost that write a legal conversation."""
    found = []

    def go(i, written, cost, audit):
        if cost > limit:
            return
        body = written[1:] if written.startswith("s") else written
        legal = body == "ua" * (len(body) // 2) + "u" * (len(body) % 2)
        if not legal:
            return
        if i == len(turns) and (not written or (body and len(body) % 2 == 0)):
            found.append((cost, audit))
        for role in "ua":
            go(i, written + role, cost + 3, audit + "I")
        if i < len(turns):
            go(i + 1, written, cost + 4, audit + "D")
            turn = turns[i]
            if turn != "-":
                more = 3 * turn.isupper()
                if turn.lower() != "x":
                    go(i + 1, written + turn.lower(), cost + more, audit + "K")
                for role in "ua":
                    go(i + 1, written + role, cost + 3 + more, audit + "R")

    go(0, "", 0, "")
    return found


def test_cheapest_equals_trying_all():
    rng = random.Random(1)
    cases = ["".join(x) for n in range(3) for x in itertools.product(LETTERS, repeat=n)]
    cases += ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(3, 6))) for _ in range(60)]
    for turns in cases:
        cost, audit = c.cheapest(turns)
        assert (cost, audit) == min(every_path(turns, cost)), turns
        assert c.least_costs(turns, True)[0] <= cost


def plain(turns):
    """(cost, audit) by dynamic programming with least texts."""
    def inserted(best):
        for _ in range(2):
            for q, value in list(best.items()):
                offer = (value[0] + 3, value[1] + "I")
                best[c.NEXT[q]] = min(best.get(c.NEXT[q], offer), offer)
        return best

    best = {0: (0, "")}
    for turn in turns:
        now = {}

        def offer(q, value, cost, edit):
            made = (value[0] + cost, value[1] + edit)
            now[q] = min(now.get(q, made), made)

        for q, value in inserted(best).items():
            offer(q, value, 4, "D")
            if turn != "-":
                more = 3 * turn.isupper()
                offer(c.NEXT[q], value, 3 + more, "R")
                if (q, turn.lower()) in c.KEPT:
                    offer(c.KEPT[q, turn.lower()], value, more, "K")
        best = now
    best = inserted(best)
    return min(best[q] for q in (0, 3) if q in best)


def test_chunks_chain_to_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        turns = "".join(rng.choice("uauauaSUA-sx") for _ in range(rng.randrange(0, 30)))
        expected = plain(turns)
        assert c.cheapest(turns) == expected
        cuts = sorted(rng.randrange(len(turns) + 1) for _ in range(rng.randrange(0, 5)))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        assert c.chained([c.crossings(part) for part in parts]) == expected


def test_long_damaged_conversation_takes_no_more_than_moments():
    rng = random.Random(3)
    turns = "".join(rng.choice("-SUAxx") if rng.random() < 0.4 else "ua"[i % 2] for i in range(c.CHUNK))
    assert c.cheapest(turns) == plain(turns)
    assert c.cheapest("u" * c.CHUNK) == plain("u" * c.CHUNK)
    assert c.cheapest("x" * c.CHUNK) == plain("x" * c.CHUNK)


SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """The contract's rows, straight from (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(),
                                hashlib.md5(r[2].encode()).digest()))
        seen, letters, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for turn, role, text in own:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
            bare = text.strip(SPACE)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letters += "-" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        cost, audit = plain(letters)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        numbers = {r[0] for r in own if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        lines, state, left = [], 0, iter(own)
        for edit in audit:
            turn = None if edit == "I" else next(left)
            if edit == "D":
                continue
            if edit == "K":
                state = c.KEPT[state, turn[1][:1]]
                lines.append(f"{turn[1]}:{turn[2]}")
            else:
                state = c.NEXT[state]
                lines.append(f"{c.ROLE[state]}:{'' if edit == 'I' else turn[2]}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest, lines)
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, edit string, copies int, found int"


def odd_conversations(spark):
    rng = random.Random(5)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 9)):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.9 else rng.choice(
                ["system", "tool", "", None, "user", "sys"])
            text = rng.choice(["Yes.", "Who?", "one", "", None, " \t\n", f"Text {turn}!", "é\x1c.", "x" * 70 + "."])
            rows.append((conv, turn, role, text))
    rows += [(100, i, ["user", "assistant"][i % 2], f"word {i}.") for i in range(300)]
    rows += [(101, None, "user", "crowd.")] * 700 + [(101, 4, "user", "crowd.")] * 9
    rows += [(102, None, None, None), (103, None, "user", "a"), (103, None, "assistant", "b")]
    rows += [(104, 7, "user", "long " * 50_000), (104, 8, "assistant", "Fine.")]
    rows += [(105, 1, "assistant", "Same."), (105, 1, "assistant", "Same."), (105, 1, "user", "Same.")]
    df = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], SCHEMA)
    return df, rows


@pytest.mark.parametrize("chunk", [512, 5])
def test_query_on_odd_rows(spark, monkeypatch, tmp_path, chunk):
    monkeypatch.setattr(c, "CHUNK", chunk)
    df, rows = odd_conversations(spark)
    df.repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    expected = brute(rows)
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_repair(spark, str(tmp_path)).collect()}
    assert got == {conv: value[:-1] for conv, value in expected.items()}


def test_repaired_turns(spark):
    df, rows = odd_conversations(spark)
    turns = c.damaged(df)
    made = {}
    for r in c.repaired(turns, c.audits(turns)).orderBy("conv_id", "place").collect():
        own = made.setdefault(r.conv_id, [])
        assert r.place == len(own) and r.edit in "IKR"
        own.append(f"{r.role}:{r.text}")
    assert made == {conv: value[-1] for conv, value in brute(rows).items() if value[-1]}


def test_no_rows(spark, tmp_path):
    df, _ = odd_conversations(spark)
    df.limit(0).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_repair(spark, str(tmp_path)).collect() == []


def test_undamaged_conversations_stay(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(4)]
    turns = c.plain_turns(
        spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"),
        "conv_id", "turn", "role", "text",
    )
    found = c.audits(turns).first()
    assert (found.audit, found.cost, found.gaps, found.illegal) == ("KKKK", 0, 0, 0)
    assert c.repaired(turns, c.audits(turns)).where(F.col("edit") != "K").count() == 0
