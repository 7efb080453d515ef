"""Mixing of sources to target weights by a low-discrepancy schedule.

The mix is a sequence of ``2**k`` slots. Slot ``i`` belongs to the source in whose share of the
cumulative weights the van der Corput point of ``i`` (its bits reversed) falls, so every stretch of the
mix holds the sources nearly in their target proportions, and the number of slots of a source is within
one of its exact share. Slots have at most ``slot_words`` words until there are ``2**30`` of them; beyond
that they grow. A source whose share is below ``LEAST_SLOTS`` of them uses points of more bits, as many
as give it that many, and its slots lie between the others: however small, it has slots as far apart as
its share allows. Shares are whole words and points are counted in integers, so no rounding loses one.

Slots are ranked per source. A source's documents, shuffled by a hash, form an endless stream of words;
the words due to it, its target rounded, are cut from the stream into as many equal blocks as it has
slots, and the slot of rank ``r`` takes block ``r``. So a source gives its target to the word, whatever
the size of slots.

``targets`` shares all words out by weight (1, 2, 3, 1, ... in code-point order of the names, a null
name last), no source above ``max_passes`` times its words; what is cut off is shared again among
the rest until nobody is above.

``schedule`` gives the slots, ``pieces`` what part of which document a block holds, ``mix`` the words
taken per document. Only DataFrame operations are used. No window runs over a whole source: ranks
and stream offsets are numbered in ranges and shifted by the sums of the ranges before. A null text
has no words; a document without words, and a table without any, takes nothing; a target below half a
word is none. Repeated rows are documents of their own. Equal rows may stand in either order, so reruns
give the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from harborlane.llm.common import stored

SLOT_WORDS = 128
MAX_SLOT_BITS = 30
#: A source has at least so many slots, of more bits if need be.
LEAST_SLOTS = 4
MAX_PASSES = 3
CYCLE = 3
SEED = 17
ROWS_PER_RANGE = 5_000
SLOTS_PER_RANGE_BITS = 14


def word_count(text: Column) -> Column:
    """Number of runs of characters that are no ASCII white space; 0 for null."""
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.coalesce(words, F.lit(0)).cast("bigint")


def source_sizes(docs: DataFrame, source: str, size: str) -> DataFrame:
    """(source, source_size, place, weight): one row per source, numbered in code-point order."""
    order = W.orderBy(F.col("source").isNull(), "source")  # one row per source
    return (
        docs.groupBy(F.col(source).alias("source"))
        .agg(F.sum(size).alias("source_size"))
        .withColumn("place", F.row_number().over(order).cast("bigint"))
        .withColumn("weight", ((F.col("place") - 1) % CYCLE + 1).cast("double"))
    )


def targets(sources: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """Add ``target``: words due to each source; ``due``, the same in whole words; and ``low``, ``high``:
    its part of all words due, which are ``total``.

    A source is full if its limit per weight is at most the level all others reach. In the order
    of limit per weight the full ones come first, so the level follows from running sums; ``place``
    settles ties. The table has one row per source.
    """
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), "place")
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    until = by_limit.rowsBetween(W.unboundedPreceding, -1)
    by_place = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    zero = F.lit(0.0)
    level = (F.col("total") - F.col("limits_before")) / (
        F.col("weights") - F.col("weights_before")
    )
    ranked = (
        sources.withColumn("limit", F.col("source_size").cast("double") * max_passes)
        .withColumn("total", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("limits_before", F.coalesce(F.sum("limit").over(until), zero))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(until), zero))
        .withColumn("level", level)
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    )
    # The level of the first source that is not full; if all are, every limit holds.
    shared = F.min_by(
        F.when(~F.col("full"), F.col("level")),
        F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), "place")),
    ).over(whole)
    target = F.when(
        F.col("full") | F.col("shared").isNull(), F.col("limit")
    ).otherwise(F.col("shared") * F.col("weight"))
    # The last digits depend on the order of sums; halves of a word shall not.
    due = F.floor(F.round("target", 6) + 0.5)
    return (
        ranked.withColumn("shared", shared)
        .withColumn("target", target)
        .withColumn("due", due)
        .withColumn("all_due", F.sum("due").over(whole))
        .withColumn("high", F.sum("due").over(by_place))
        .select(
            "source", "source_size", "place", "weight", "target", "due",
            (F.col("high") - F.col("due")).alias("low"), "high", F.col("all_due").alias("total"),
        )
    )


def slot_bits(total: Column, slot_words: int) -> Column:
    """k for 2**k slots of between half of ``slot_words`` and ``slot_words``; at most 30 bits."""
    wanted = F.ceil(F.log2(F.greatest(total, F.lit(1)) / F.lit(float(slot_words))))
    return F.least(F.greatest(wanted, F.lit(0)), F.lit(MAX_SLOT_BITS)).cast("int")


def with_slots(goals: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """Add to each source ``common``, the bits of the mix's slots, ``bits``, those of its own, and the
    numerators ``first`` to before ``end`` of its points; there are ``slots`` of them.

    A share of ``due`` of ``total`` words has at least floor(due * 2**bits / total) points.
    """
    total, due = (F.greatest(F.col(c), F.lit(1)) for c in ("total", "due"))
    finer = F.ceil(F.log2(LEAST_SLOTS * total / due)).cast("int")

    def edge(words: str) -> Column:
        """ceil(words * 2**bits / total): words < 2**58 and bits <= 62 stay below 38 digits."""
        ones = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bits"))
        points = F.col(words).cast("decimal(19,0)") * ones.cast("decimal(19,0)")
        whole = total.cast("decimal(38,0)")
        return F.call_function("div", points + whole - 1, whole)

    return (
        goals.withColumn("common", slot_bits(F.col("total"), slot_words))
        .withColumn("bits", F.least(F.greatest(F.col("common"), finer), F.lit(62)))
        .withColumn("first", edge("low"))
        .withColumn("end", edge("high"))
        .withColumn("slots", F.col("end") - F.col("first"))
    )


def reversed_bits(value: Column, bits: Column) -> Column:
    """The lowest ``bits`` bits of a value below 2**62, in reverse order."""

    def half(value: Column) -> Column:
        for shift, mask in (
            (1, 0x55555555), (2, 0x33333333), (4, 0x0F0F0F0F), (8, 0x00FF00FF), (16, 0x0000FFFF),
        ):
            mask = F.lit(mask).cast("bigint")
            value = F.shiftleft(value.bitwiseAND(mask), shift).bitwiseOR(
                F.shiftright(value, shift).bitwiseAND(mask)
            )
        return value

    low = half(value.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))
    high = half(F.shiftright(value, 32))
    # All 64 bits reversed would be low, high; the sign bit is unused, so they are shifted apart.
    return F.when(
        bits <= 32, F.call_function("shiftright", low, F.lit(32) - bits)
    ).otherwise(
        F.call_function("shiftleft", low, bits - 32).bitwiseOR(
            F.call_function("shiftright", high, F.lit(64) - bits)
        )
    )


def _before(df: DataFrame, keys: list[str], part: str, amount: Column) -> DataFrame:
    """(keys, part, amount of the parts before): parts of a key are summed in order."""
    sums = df.groupBy(*keys, part).agg(amount.alias("_amount"))
    window = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(
        *keys, part, F.coalesce(F.sum("_amount").over(window), F.lit(0)).alias("_before")
    )


def schedule(goals: DataFrame) -> DataFrame:
    """(slot, inner, place, rank): every slot of the mix, its source and its rank among that source's.

    ``goals`` come from ``with_slots``.

    ``slot`` counts the common slots; those of small sources have the number of the common slot they
    lie behind, and ``inner`` says how far, in parts of a slot.

    A source's points are the multiples of 2**-bits in its share, so its slots are the reversed bits of
    their numerators. They are listed a range of the numerators at a time, so a source with a third
    of all slots is many rows, not one long one.
    """
    step = 1 << SLOTS_PER_RANGE_BITS
    ranges = (
        goals.where(F.col("slots") > 0)
        .select("place", "bits", "common", "first", "end")
        .withColumn("range", F.explode(F.expr(f"sequence(first div {step}, (end - 1) div {step})")))
    )
    time = reversed_bits(F.col("point"), F.col("bits"))
    extra = F.col("bits") - F.col("common")
    slots = (
        ranges.repartition("place", "range")
        .withColumn(
            "point",
            F.explode(
                F.expr(
                    f"sequence(greatest(first, range * {step}), least(end, (range + 1) * {step}) - 1)"
                )
            ),
        )
        .withColumn("time", time)
        .withColumn("slot", F.call_function("shiftright", F.col("time"), extra))
        .withColumn("stretch", F.expr(f"slot div {step}"))
        .withColumn("inner", F.col("time") / F.pow(F.lit(2.0), extra) - F.col("slot"))
        .select("place", "slot", "inner", "stretch", "time")
    )
    offsets = _before(slots, ["place"], "stretch", F.count(F.lit(1)))
    inside = F.row_number().over(W.partitionBy("place", "stretch").orderBy("time")) - 1
    return (
        slots.withColumn("_inside", inside)
        # The few sources the slots come from look small enough to broadcast; the slots are not.
        .hint("merge")
        .join(offsets, ["place", "stretch"])
        .select("slot", "inner", "place", (F.col("_before") + F.col("_inside")).alias("rank"))
    )


def streams(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """Add to each document its source's ``place``, size, target and ``slots``, its ``part`` and ``turn``
    in the source's shuffled order, and ``start``, the words of the source before it.

    ``sized`` has ``source``, ``size`` and ``order``, a hash in hexadecimal digits. A part is a range
    of the hashes, so the parts of a source follow each other in its order.
    """
    # So many documents a part, whatever the table's size.
    parts = max(1, -(-sized.count() // ROWS_PER_RANGE))
    leading = F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint")
    placed = (
        sized.join(
            goals.select(
                F.col("source").alias("_source"), "place", "source_size", "target", "due", "slots"
            ),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .drop("_source")
        .withColumn("part", F.shiftright(leading * parts, 32))
    )
    offsets = _before(placed, ["place"], "part", F.sum("size"))
    ordered = W.partitionBy("place", "part").orderBy("order", "size")
    return (
        placed.withColumn("turn", F.row_number().over(ordered))
        .withColumn("_to", F.sum("size").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
        .join(offsets, ["place", "part"])
        .withColumn("start", F.col("_before") + F.col("_to") - F.col("size"))
        .drop("_before", "_to")
    )


def pieces(placed: DataFrame, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per document, pass through its source, and block the document has words in then.

    ``rank`` is the block, ``words`` the number of words in it; block ``r`` of ``n`` ends before the
    word ``floor((r + 1) * due / n)`` of the source's stream.
    """
    # A block wider than the exact place on either side, so that rounding never hides one.
    per_word = F.col("slots") / F.greatest(F.col("due"), F.lit(1)).cast("double")
    first = F.greatest(F.floor(F.col("from") * per_word) - 1, F.lit(0))
    last = F.least(F.ceil(F.col("to") * per_word), F.col("slots") - 1)

    def piece(rank: Column) -> Column:
        def edge(rank: Column) -> Column:
            words = rank.cast("decimal(19,0)") * F.col("due").cast("decimal(19,0)")
            return F.call_function("div", words, F.col("slots").cast("decimal(38,0)"))

        words = F.least(F.col("to"), edge(rank + 1)) - F.greatest(F.col("from"), edge(rank))
        return F.struct(rank.alias("rank"), words.alias("words"))

    return (
        placed.where(F.col("size") > 0)
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))))
        .withColumn("from", F.col("start") + F.col("pass") * F.col("source_size"))
        .withColumn("to", F.col("from") + F.col("size"))
        .where(F.col("from") < F.col("due"))
        .withColumn("first", first.cast("bigint"))
        .withColumn("last", last.cast("bigint"))
        .where(F.col("first") <= F.col("last"))
        .withColumn("rank", F.explode(F.sequence("first", "last")))
        .withColumn("_piece", piece(F.col("rank")))
        .withColumn("words", F.col("_piece.words"))
        .where(F.col("words") > 0)
        .drop("slots", "pass", "from", "to", "first", "last", "_piece")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    slot_words: int = SLOT_WORDS,
    max_passes: int = MAX_PASSES,
    seed: int = SEED,
) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target of its source, words taken, ``start``,
    the words of its source before it, and ``order``, the hash it is shuffled by (``order_hash`` of
    its id and text)."""
    sized = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            order_hash(F.col(doc_id), F.col(text), seed).alias("order"),
        ),
        "mix-sizes",
    )
    sources = targets(source_sizes(sized, "source", "size"), max_passes)
    goals = stored(with_slots(sources, slot_words), "mix-targets")
    placed = stored(streams(sized, goals), "mix-streams")
    row = ["place", "part", "turn"]
    taken = (
        pieces(placed, max_passes)
        .select(*row, "rank", "words")
        .hint("merge")
        .join(schedule(goals).select("place", "rank"), ["place", "rank"])
        .groupBy(*row)
        .agg(F.sum("words").alias("words"))
    )
    return placed.join(taken, row, "left").select(
        "doc_id", "size", "source", "source_size", "target",
        F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"), "start", "order",
    )


def copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes their words, to the nearest whole number; at least
    once a source's first document, if any of it is taken."""
    first = (F.col("start") == 0) & (F.col("taken") > 0)
    times = F.round(F.try_divide(F.sum("taken"), F.sum("size"))).cast("int")
    often = (
        mix(docs, doc_id, text, source)
        .groupBy(F.col("order").alias("_order"))
        .agg(F.greatest(times, F.max(first).cast("int")).alias("_copies"))
        .where(F.col("_copies") > 0)
    )
    rows = docs.select(F.struct("*").alias("row"), order_hash(F.col(doc_id), F.col(text)).alias("key"))
    return (
        rows.join(often, F.col("key") == F.col("_order"))
        .select("row", F.explode(F.sequence(F.lit(1), "_copies")))
        .select("row.*")
    )


def order_hash(doc_id: Column, text: Column, seed: int = SEED) -> Column:
    content = F.md5(F.coalesce(text, F.lit("")))
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), name, content))
