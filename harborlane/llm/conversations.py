"""Repair of the structure of conversations by iterative-deepening A* over edits.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an
assistant turn; a turn's kind is the first character of its role. Edits and their costs:

* ``D`` delete a turn, 4; blank turns and repeats have to go;
* ``I`` insert an empty user or assistant turn, 3;
* ``K`` keep a turn, 0, or 3 if it is truncated;
* ``R`` give a turn the role user or assistant, 3, or 6 if it is truncated.

The audit is the letters of the cheapest edits in order; of equally cheap ones the least in ASCII.
``cheapest`` finds it by depth-first search in that order under a rising bound on the cost. A state is
the number of turns passed and the kind of the last turn written. The bound on what is left counts
turns that have to go, truncated ones, and disjoint pairs of neighbours that cannot stay neighbours.
A state that fails goes into a table with the least budget it would take; it is not entered again with
less, and the root's entry is the next bound. So the first path that ends well is the answer.

No task needs a whole conversation's texts. Turns are reduced to a letter each, sorted across the
cluster, and cut into chunks of up to ``CHUNK`` turns, also within a conversation, however long. A
chunk that is a whole conversation is searched once; the others once for each pair of states they can
begin and end in, and the chunks' results are chained per conversation. Equally cheap chains differ
before either ends within a chunk, so the least chain is made of least parts. What meets in one task
is a byte per turn and state pair, as much as the audit, which by its nature is one value. Writing the
repaired turns streams a conversation's turns past its audit.

Faults: a turn's first one of blank (only ASCII white space), duplicate (role and text as in an
earlier turn of the conversation) and truncated (the last character that is no white space is none of
``.!?``) counts. Null roles and texts are one blank; a null turn number is a number before all others.
Turns with the same number are ordered by role, by the first ``HEAD`` characters of the text, and by
the text's MD5; equal rows stand next to each other, so a crowd of them is one row with a count.
Rows with a null conversation id are one conversation. Empty tables give empty tables, texts have any
length, and columns other than the four named are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from harborlane.llm.common import ASCII_SPACE, stored

CHUNK = 512
HEAD = 64

# States: nothing written, or the kind of the last turn written.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (NOTHING, ASSISTANT)
#: What an inserted or renamed turn must be after each state; and what a kept turn of a kind leads to.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {
    (NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER,
    (USER, "a"): ASSISTANT,
}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
DELETE, INSERT, RENAME, TRUNCATED = 4, 3, 3, 3
#: Letter of a turn that has to go. Others are s, u, a or x for other kinds, truncated ones in capitals.
GONE = "-"


def least_costs(turns: str, ended: bool) -> list[int]:
    """For each number of turns passed, a cost the rest cannot do without.

    Two neighbours that cannot stay so take an insertion, a new role, or a deletion, which saves a
    truncated turn's cost. No turn counts in two pairs. If the conversation ends here, a last turn
    that may not be the last is a pair with the end.
    """
    sums, after = [0] * (len(turns) + 1), [0] * (len(turns) + 2)
    following, place = ("end" if ended else None), len(turns)
    for i in range(len(turns) - 1, -1, -1):
        turn = turns[i]
        if turn == GONE:
            sums[i], after[i] = sums[i + 1] + DELETE, after[i + 1]
            continue
        kind, cut = turn.lower(), turn.isupper()
        sums[i] = sums[i + 1] + (TRUNCATED if cut else 0)
        after[i] = after[i + 1]
        if following == "end":
            apart, spared = kind != "a", cut
        else:
            apart = following is not None and kind + following.lower() not in LEGAL
            spared = cut or (following is not None and following.isupper())
        if apart:
            extra = DELETE - TRUNCATED if spared else INSERT
            after[i] = max(after[i], extra + after[place + 1])
        following, place = turn, i
    return [a + b for a, b in zip(sums, after)]


def cheapest(turns: str, start: int = NOTHING, ends: tuple[int, ...] = ENDS, ended: bool = True):
    """(cost, audit) of the cheapest edits that lead from a state to one of ``ends``; None if there
    are none."""
    if not any(_reachable(turns, start, end) for end in ends):
        return None
    count = len(turns)
    rest = least_costs(turns, ended)
    needed: dict[tuple[int, int], int] = {}

    def options(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edit, cost, turns passed, state) in ASCII order of the edits."""
        found = [("I", INSERT, i, NEXT[state])]
        if i < count:
            found.insert(0, ("D", DELETE, i + 1, state))
            turn = turns[i]
            if turn != GONE:
                more = TRUNCATED if turn.isupper() else 0
                kept = KEPT.get((state, turn.lower()))
                if kept is not None:
                    found.append(("K", more, i + 1, kept))
                found.append(("R", RENAME + more, i + 1, NEXT[state]))
        return found

    bound = rest[0]
    while True:
        path: list[str] = []
        stack = [(0, start, bound, iter(options(0, start)))]
        while stack:
            i, state, budget, left = stack[-1]
            if i == count and state in ends:
                return bound - budget, "".join(path)
            for edit, cost, j, after in left:
                remains = budget - cost
                if remains >= needed.get((j, after), rest[j]):
                    stack.append((j, after, remains, iter(options(j, after))))
                    path.append(edit)
                    break
            else:
                needed[i, state] = min(
                    cost + needed.get((j, after), rest[j]) for _, cost, j, after in options(i, state)
                )
                stack.pop()
                if path:
                    path.pop()
        bound = needed[0, start]


def _reachable(turns: str, start: int, end: int) -> bool:
    if end == NOTHING:
        return start == NOTHING
    if end == SYSTEM:
        return start == SYSTEM or start == NOTHING and any(t in "sS" for t in turns)
    return True


def crossings(turns: str) -> list[dict]:
    """The cheapest edits of a chunk for each state it may begin and end in."""
    found = []
    for start in range(4):
        for end in range(4):
            way = cheapest(turns, start, (end,), ended=False)
            if way is not None:
                found.append({"start": start, "end": end, "cost": way[0], "audit": way[1]})
    return found


def _before(a, b) -> bool:
    """Whether chain ``a`` of (text, next) links spells less than chain ``b``."""
    x, y, i, j = a[0], b[0], 0, 0
    while True:
        while a is not None and i == len(x):
            a, i = a[1], 0
            x = a[0] if a else ""
        while b is not None and j == len(y):
            b, j = b[1], 0
            y = b[0] if b else ""
        if a is b and i == j or b is None:
            return False
        if a is None:
            return True
        step = min(len(x) - i, len(y) - j)
        if x[i : i + step] != y[j : j + step]:
            return x[i : i + step] < y[j : j + step]
        i, j = i + step, j + step


def chained(parts: list[list[dict]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest way through all chunks of a conversation."""
    best = {state: (0, None) for state in ENDS}
    for ways in reversed(parts):
        now: dict[int, tuple] = {}
        for way in ways:
            if way["end"] not in best:
                continue
            cost, following = best[way["end"]]
            offer = (cost + way["cost"], (way["audit"], following))
            held = now.get(way["start"])
            if held is None or offer[0] < held[0] or (
                offer[0] == held[0] and _before(offer[1], held[1])
            ):
                now[way["start"]] = offer
        best = now
    cost, link = best[NOTHING]
    pieces = []
    while link is not None:
        pieces.append(link[0])
        link = link[1]
    return cost, "".join(pieces)


def plain_turns(
    conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: Column | None = None
) -> DataFrame:
    """(conv_id, turn, role, text, copies, head, mark): rows as they are ordered and compared."""
    text = F.coalesce(F.col(text), F.lit(" "))
    return conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        text.alias("text"),
        (F.lit(1) if copies is None else copies).cast("bigint").alias("copies"),
        F.substring(text, 1, HEAD).alias("head"),
        F.unhex(F.md5(text)).alias("mark"),
    )


ORDER = ["conv_id", "turn", "role", "head", "mark"]


def marked(turns: DataFrame) -> DataFrame:
    """Different turns with their number of copies, and what is wrong with them; no texts.

    A turn with 0 copies only tells that there is the conversation.
    """
    body = F.rtrim(F.col("text"), F.lit(ASCII_SPACE))
    blank = F.length(body) == 0
    counted = (
        turns.withColumn("blank", blank)
        .withColumn("cut", ~blank & ~F.substring(body, -1, 1).isin(".", "!", "?"))
        .groupBy(*ORDER, "blank", "cut")
        .agg(F.sum("copies").alias("copies"))
    )
    there = stored(counted, "conversation-turns")
    number = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = (
        there.where((F.col("copies") > 0) & ~F.col("blank"))
        .groupBy(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("mark").alias("_mark"))
        .agg(F.min(number).alias("_first"))
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & (F.col("role") == F.col("_role")) & (F.col("mark") == F.col("_mark"))
    )
    return there.join(first, same, "left").select(
        *ORDER, "blank", "cut", "copies",
        F.col("_first.turn").eqNullSafe(F.col("turn")).alias("first"),
    )


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
FACTS = [
    "rows", "blank", "duplicate", "truncated", "illegal", "numbers", "lowest", "highest",
]
_FACTS_SCHEMA = ", ".join(f"{name} bigint" for name in FACTS) + ", opening string, closing string"
_WAYS = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
)


class _Chunk:
    """The turns of a chunk as letters, and the counts that go with them."""

    def __init__(self):
        self.letters: list[str] = []
        self.facts = dict.fromkeys(FACTS, 0) | {"lowest": None, "highest": None}
        self.opening = self.closing = None

    def add(self, turn: int | None, role: str, letter: str, fault: str | None, copies: int) -> None:
        facts, kind = self.facts, role[:1]
        self.letters += [letter] * copies
        facts["rows"] += copies
        if fault:
            facts[fault] += copies
        if self.closing is None:
            self.opening = kind
        elif self.closing + kind not in LEGAL:
            facts["illegal"] += 1
        facts["illegal"] += copies - 1
        self.closing = kind
        if turn is not None and turn != facts["highest"]:
            facts["numbers"] += 1
            facts["lowest"] = turn if facts["lowest"] is None else facts["lowest"]
            facts["highest"] = turn


def joined_facts(parts: list[dict]) -> dict:
    """The facts of consecutive chunks as those of one."""
    total = dict.fromkeys(FACTS, 0) | {"lowest": None, "highest": None}
    closing = None
    for part in parts:
        if not part["rows"]:
            continue
        for name in ("rows", "blank", "duplicate", "truncated", "illegal", "numbers"):
            total[name] += part[name]
        if closing is not None and closing + part["opening"] not in LEGAL:
            total["illegal"] += 1
        closing = part["closing"]
        if part["lowest"] is not None:
            if part["lowest"] == total["highest"]:
                total["numbers"] -= 1
            total["lowest"] = part["lowest"] if total["lowest"] is None else total["lowest"]
            total["highest"] = part["highest"]
    return total


def _letters(row: dict) -> Iterator[tuple[str, str | None, int]]:
    """(letter, fault, copies) of a different turn: its first copy, and the repeats."""
    copies = row["copies"]
    if row["blank"]:
        yield GONE, "blank", copies
        return
    if row["first"] and copies:
        kind = row["role"][:1]
        kind = kind if kind in ("s", "u", "a") else "x"
        yield (kind.upper(), "truncated", 1) if row["cut"] else (kind, None, 1)
        copies -= 1
    yield GONE, "duplicate", copies


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """The rows of sorted batches as dicts, and whether each begins a conversation."""
    last, begun = None, False
    for batch in batches:
        for at in range(0, len(batch), 1024):
            for row in batch.slice(at, 1024).to_pylist():
                yield not begun or row["conv_id"] != last, row
                last, begun = row["conv_id"], True


def chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, part, chunk, facts..., ways): the chunks of all conversations with their cheapest
    edits; a single way if a chunk is known to be a whole conversation."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = (
        turns.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        .withColumn("part", F.spark_partition_id())
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {"made": [], "number": 0, "inside": False, "chunk": _Chunk(), "row": None}
        kinds = {}

        def close(ended: bool) -> None:
            """Finish the chunk; ``ended`` if the conversation surely ends with it."""
            chunk, letters = state["chunk"], "".join(state["chunk"].letters)
            if ended and state["inside"] and state["number"] == 0:
                cost, audit = cheapest(letters)
                ways = [{"start": NOTHING, "end": ASSISTANT, "cost": cost, "audit": audit}]
            else:
                ways = crossings(letters)
            state["made"].append(
                {"conv_id": state["row"]["conv_id"], "part": state["row"]["part"],
                 "chunk": state["number"], **chunk.facts, "opening": chunk.opening,
                 "closing": chunk.closing, "ways": ways}
            )
            state["chunk"], state["number"] = _Chunk(), state["number"] + 1

        def given() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds["conv_id"] = batch.schema.field("conv_id").type
                yield batch

        for begins, row in _by_conversation(given()):
            if begins and state["row"] is not None:
                close(ended=True)
                state["inside"], state["number"] = True, 0
            state["row"] = row
            for letter, fault, copies in _letters(row):
                while copies:
                    room = CHUNK - len(state["chunk"].letters)
                    if not room:
                        close(ended=False)
                        continue
                    some = min(room, copies)
                    state["chunk"].add(row["turn"], row["role"], letter, fault, some)
                    copies -= some
            if len(state["made"]) >= 1024:
                yield _batch(state["made"], kinds["conv_id"])
                state["made"] = []
        if state["row"] is not None:
            close(ended=False)
            yield _batch(state["made"], kinds["conv_id"])

    return ordered.mapInArrow(
        run,
        f"conv_id {kind}, part int, chunk int, {_FACTS_SCHEMA}, "
        "ways array<struct<start int, `end` int, cost bigint, audit string>>",
    )


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    fields = [("conv_id", kind), ("part", pa.int32()), ("chunk", pa.int32())]
    fields += [(name, pa.int64()) for name in FACTS]
    fields += [("opening", pa.string()), ("closing", pa.string()), ("ways", _WAYS)]
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def audits(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation.

    ``turns`` as ``plain_turns`` makes them.
    """
    parts = chunks(marked(turns))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, parts, kinds = [], [], {}

        def close() -> None:
            facts = joined_facts(parts)
            cost, audit = (
                (parts[0]["ways"][0]["cost"], parts[0]["ways"][0]["audit"])
                if len(parts) == 1 and len(parts[0]["ways"]) == 1
                else chained([part["ways"] for part in parts])
            )
            gaps = 0 if facts["lowest"] is None else (
                facts["highest"] - facts["lowest"] + 1 - facts["numbers"]
            )
            made.append(
                {"conv_id": parts[0]["conv_id"], "gaps": gaps, "cost": cost, "audit": audit}
                | {name: facts[name] for name in ("blank", "duplicate", "truncated", "illegal")}
            )
            parts.clear()

        def given() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds["conv_id"] = batch.schema.field("conv_id").type
                yield batch

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(made, pa.schema(
                [("conv_id", kinds["conv_id"])] + [(name, pa.int64()) for name in COUNTS]
                + [("audit", pa.string())]
            ))
            made.clear()
            return batch

        for begins, row in _by_conversation(given()):
            if begins and parts:
                close()
                if len(made) >= 4096:
                    yield flushed()
            parts.append(row)
        if parts:
            close()
        if made:
            yield flushed()

    return (
        parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
        .mapInArrow(run, f"conv_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string")
    )


def played(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of each turn the edits leave, in order."""
    state = NOTHING
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit == "K":
            state = KEPT[state, role[:1]]
        else:
            state = NEXT[state]
            role = ROLE[state]
        yield edit, role, text


def _replayed(turns: DataFrame, found: DataFrame, write: Callable, made: dict[str, str]) -> DataFrame:
    """``write(facts, repaired turns)`` gives the output rows, without the id, of each conversation,
    while its turns pass by in order. ``made`` has their columns with types."""
    row = F.struct(*[F.col(c) for c in [*COUNTS, "audit"]])
    headers = found.select("conv_id", F.lit(0).alias("tag"), row.alias("found"))
    bodies = turns.where(F.col("copies") > 0).withColumn("tag", F.lit(1))
    kind = turns.schema["conv_id"].dataType.simpleString()
    types = {"bigint": pa.int64(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, waiting, out = {}, [], []

        def given() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds["conv_id"] = batch.schema.field("conv_id").type
                yield batch

        rows = (row for _, row in _by_conversation(given()))

        def own_turns() -> Iterator[tuple[str, str]]:
            """The turns up to the next conversation's header, which waits."""
            for row in rows:
                if row["tag"] == 0:
                    waiting.append(row)
                    return
                yield from repeat((row["role"], row["text"]), row["copies"])

        def flushed() -> pa.RecordBatch:
            columns = [list(column) for column in zip(*out)]
            out.clear()
            kept = [kinds["conv_id"], *[types[t] for t in made.values()]]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kept)], ["conv_id", *made]
            )

        header = next(rows, None)
        while header is not None:
            own = own_turns()
            for values in write(header["found"], played(header["found"]["audit"], own)):
                out.append((header["conv_id"], *values))
                if len(out) == 512:
                    yield flushed()
            for _ in own:  # the last edits may be insertions, so the next header is still to come
                pass
            header = waiting.pop() if waiting else None
        if out:
            yield flushed()

    stream = (
        headers.unionByName(bodies, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "tag", "turn", "role", "head", "mark")
        .select("conv_id", "tag", "role", "text", "copies", "found")
    )
    return stream.mapInArrow(run, ", ".join([f"conv_id {kind}", *[f"{c} {t}" for c, t in made.items()]]))


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations, from place 0 on.

    ``found`` is what ``audits`` gives for ``turns``.
    """

    def write(facts: dict, lines: Iterator[tuple]) -> Iterator[tuple]:
        return ((place, *line) for place, line in enumerate(lines))

    made = {"place": "bigint", "edit": "string", "role": "string", "text": "string"}
    return _replayed(turns, found, write, made)


def digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``, of the repaired turns as ``role:text`` lines."""

    def write(facts: dict, lines: Iterator[tuple]) -> Iterator[tuple]:
        digest, between = hashlib.sha256(), b""
        for _, role, text in lines:
            digest.update(between + f"{role}:{text}".encode())
            between = b"\n"
        yield (*[facts[c] for c in COUNTS], facts["audit"], digest.hexdigest())

    made = dict.fromkeys(COUNTS, "bigint") | {"audit": "string", "repaired_sha256": "string"}
    return _replayed(turns, found, write, made)


def damaged(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Conversations with planted faults, as ``plain_turns`` makes them.

    The CRC-32 of ``conv_id:turn`` (a null is one blank) modulo 20 says what happens to a row: 0 it
    goes, 1 its text becomes empty, 2 it loses all ``.!?``, 3 it stands twice, 4 its role is user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn)).cast("binary")) % 20
    words = F.coalesce(F.col(text), F.lit(" "))
    changed = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(kind == 4, "user").otherwise(F.col(role)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(words, ".!?", "")).otherwise(words).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("_copies"),
    )
    return plain_turns(changed, "conv_id", "turn", "role", "text", F.col("_copies"))
