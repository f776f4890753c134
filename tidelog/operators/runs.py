"""Contiguous runs of ids: ack frontiers, pending acks, holes.

Ids are first folded into words: one row per key and 32 consecutive ids with a bit
mask of those present. ``bit_or`` combines before the shuffle, so repeated ids vanish
there, dense ids shrink 32-fold, and a hot key spreads over its words. What follows
works on words or runs cut into blocks of ids; no task ever holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.numbering import floor_div

WORD = 32
FULL = (1 << WORD) - 1
BLOCK = 1 << 20


def word_masks(df: DataFrame, keys: list[str], ident: Column | str = "id") -> DataFrame:
    """``keys, word, mask``: which of the ids ``32 * word + 0..31`` occur."""
    ident = F.col(ident) if isinstance(ident, str) else ident
    tagged = df.select(*keys, ident.cast("long").alias("_id"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_id").bitwiseAND(WORD - 1).cast("int"))
    return tagged.groupBy(*keys, F.shiftright("_id", 5).alias("word")).agg(
        F.bit_or(bit).alias("mask")
    )


def trailing_ones(mask: Column) -> Column:
    """Length of the run of set bits that starts at bit 0."""
    return F.bit_count(mask.bitwiseXOR(mask + 1)).cast("long") - 1


def trailing_zeros(mask: Column) -> Column:
    """Position of the lowest set bit."""
    return F.bit_count(mask.bitwiseXOR(mask - 1)).cast("long") - 1


def ack_frontier(
    acks: DataFrame, keys: list[str], start: int | str | Column = 0, ident: str = "id"
) -> DataFrame:
    """``keys, frontier``: the largest ``p`` with all of ``start+1 .. p`` acked.

    The frontier ends just before the smallest id that is missing. A word shows its
    own first missing id; a word whose last bit is set also announces the next one,
    so an absent word is seen as an empty mask. Two hash aggregates, no window.
    """
    start = F.col(start) if isinstance(start, str) else start
    start = start if isinstance(start, Column) else F.lit(start)
    based = acks.withColumn("_start", start.cast("long"))
    offset = F.col(ident).cast("long") - F.col("_start") - 1
    group = [*keys, "_start"]
    # a stale ack counts as offset -1: it keeps its key in the result and no more
    words = word_masks(based, group, F.greatest(offset, F.lit(-1)))
    last_set = F.shiftright("mask", WORD - 1).bitwiseAND(1) == 1
    own = F.struct(F.col("word"), F.col("mask"))
    following = F.struct((F.col("word") + 1).alias("word"), F.lit(0).cast("long").alias("mask"))
    slots = (
        words.select(*group, F.explode(F.when(last_set, F.array(own, following)).otherwise(F.array(own))).alias("w"))
        .groupBy(*group, "w.word")
        .agg(F.bit_or("w.mask").alias("mask"))
    )
    live = F.col("word") >= 0
    hole = F.when(live & (F.col("mask") != FULL), F.col("word") * WORD + trailing_ones(F.col("mask")))
    return (
        slots.groupBy(*group)
        .agg(F.min(hole).alias("_hole"), F.min(F.when(live, F.col("word"))).alias("_first"))
        .select(
            *keys,
            (F.col("_start") + F.when(F.col("_first") == 0, F.col("_hole")).otherwise(F.lit(0))).alias("frontier"),
        )
    )


def _word_runs(mask: Column) -> Column:
    """Runs of set bits in a mask as an array of ``lo, hi`` bit positions."""
    low = trailing_zeros(mask)
    length = F.bit_count(mask).cast("long")
    single = F.array(F.struct(low.alias("lo"), (low + length - 1).alias("hi")))
    # adding the lowest bit carries through a single run and clears all of it
    is_single = mask.bitwiseAND(mask + mask.bitwiseAND(-mask)) == 0
    bits = F.sequence(low, F.length(F.bin(mask)).cast("long") - 1)

    def edges(side: Column) -> Column:
        edge = mask.bitwiseAND(F.lit(FULL).cast("long").bitwiseXOR(side))
        return F.filter(bits, lambda i: F.getbit(edge, i) == 1)

    starts = edges(F.shiftleft(mask, 1).bitwiseAND(FULL))
    ends = edges(F.shiftright(mask, 1))
    many = F.transform(F.arrays_zip(starts.alias("lo"), ends.alias("hi")), lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi")))
    return F.when(is_single, single).otherwise(many)


def _stitch(runs: DataFrame, within: list[str]) -> DataFrame:
    """Merge runs that touch, inside each group of ``within``."""
    order = Window.partitionBy(*within).orderBy("lo")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.lag("hi").over(order) == F.col("lo") - 1, 0).otherwise(1)
    return (
        runs.withColumn("_opens", opens)
        .withColumn("_run", F.sum("_opens").over(so_far))
        .groupBy(*within, "_run")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_run")
    )


def _block_runs(df: DataFrame, keys: list[str], ident: str, block: int) -> DataFrame:
    """``keys, _block, lo, hi``: runs inside blocks of ``block`` ids (a multiple of 32)."""
    if block % WORD:
        raise ValueError(f"block must be a multiple of {WORD}")
    base = F.col("word") * WORD
    runs = word_masks(df, keys, ident).select(
        *keys,
        floor_div(base, block).alias("_block"),
        base.alias("_base"),
        F.explode(_word_runs(F.col("mask"))).alias("r"),
    )
    runs = runs.select(
        *keys, "_block", (F.col("_base") + F.col("r.lo")).alias("lo"), (F.col("_base") + F.col("r.hi")).alias("hi")
    )
    return _stitch(runs, [*keys, "_block"])


def islands(df: DataFrame, keys: list[str], ident: str = "id", block: int = BLOCK) -> DataFrame:
    """``keys, first_id, last_id, ids``: the contiguous runs of each key.

    Runs are closed inside blocks; only those that touch a block border (at most two
    per block) are merged once more per key.
    """
    runs = _block_runs(df, keys, ident, block)
    border = (F.pmod(F.col("lo"), F.lit(block)) == 0) | (F.pmod(F.col("hi") + 1, F.lit(block)) == 0)
    merged = _stitch(runs.where(border), keys) if keys else _stitch(runs.where(border), [F.lit(0)])
    return runs.where(~border).select(*keys, "lo", "hi").unionByName(merged.select(*keys, "lo", "hi")).select(
        *keys,
        F.col("lo").alias("first_id"),
        F.col("hi").alias("last_id"),
        (F.col("hi") - F.col("lo") + 1).alias("ids"),
    )


def pending_acks(acks: DataFrame, keys: list[str], start: int = 0, ident: str = "id") -> DataFrame:
    """``keys, frontier, pending, min_pending, max_pending``: distinct acks that wait
    beyond the first hole. Ids at or below ``start`` are stale and dropped.

    All of it is read off the words of a key by two hash aggregates. The bits before the
    first hole are set, so those that wait are all bits less these. The first of them is the
    first set bit after the hole of its word, or the lowest bit of the next word that
    exists; that word does not follow a full one, and words before the hole are full, follow
    full ones, and have no bit after a hole, so a minimum over all words finds it.
    """
    words = word_masks(acks.where(F.col(ident) > start), keys, F.col(ident).cast("long") - (start + 1))
    mask, word = F.col("mask"), F.col("word")
    own = F.struct(word, mask, F.lit(False).alias("led"))
    led = F.struct((word + 1).alias("word"), F.lit(0).cast("long").alias("mask"), F.lit(True).alias("led"))
    slots = (
        words.select(*keys, F.explode(F.when(mask == FULL, F.array(own, led)).otherwise(F.array(own))).alias("w"))
        .groupBy(*keys, "w.word")
        .agg(F.bit_or("w.mask").alias("mask"), F.max("w.led").alias("led"))
    )
    base = word * WORD + (start + 1)
    ones = trailing_ones(mask)
    later = F.call_function("shiftright", mask, (ones + 1).cast("int"))
    after_hole = F.when(later != 0, base + ones + 1 + trailing_zeros(later))
    lowest = F.when((mask != 0) & (word > 0) & ~F.col("led"), base + trailing_zeros(mask))
    highest = F.when(mask != 0, base + F.length(F.bin(mask)) - 1)
    found = slots.groupBy(*keys).agg(
        F.when(F.min("word") == 0, F.min(F.when(mask != FULL, base + ones)) - 1).otherwise(F.lit(start)).cast("long").alias("frontier"),
        F.sum(F.bit_count(mask)).alias("_all"),
        F.min(F.least(after_hole, lowest)).alias("_first"),
        F.max(highest).alias("_last"),
    )
    pending = F.col("_all") - (F.col("frontier") - start)
    return found.select(
        *keys,
        "frontier",
        pending.alias("pending"),
        F.when(pending > 0, F.col("_first")).alias("min_pending"),
        F.when(pending > 0, F.col("_last")).alias("max_pending"),
    )


#: Children of a node in the tree of blocks, and the ids beyond which it has one root.
FAN = 1 << 16
IDS = 1 << 62


def log_gaps(
    df: DataFrame, keys: list[str], start: int = 0, ident: str = "id", block: int = BLOCK
) -> DataFrame:
    """``keys, from_id, to_id, missing``: the holes above ``start``, the one before the
    first id included.

    Holes inside a block come from its own runs. Those across blocks are found in a tree over
    the blocks of a key: every node knows its smallest and largest id, and a hole lies before
    each child that has an occupied sibling before it. So a window holds the children of one
    node, never a key, however far apart its ids are.
    """
    runs = _block_runs(df.where(F.col(ident) > start), keys, ident, block)
    upcoming = F.lead("lo").over(Window.partitionBy(*keys, "_block").orderBy("lo"))
    inner = runs.select(*keys, F.col("hi").alias("_from"), upcoming.alias("_to")).where(F.col("_to").isNotNull())
    levels = [0]
    while block * FAN ** levels[-1] < IDS:
        levels.append(levels[-1] + 1)

    def ancestor(level: int) -> Column:
        return floor_div(F.col("_block"), FAN**level) if FAN**level < IDS else F.lit(0).cast("long")

    nodes = F.array(
        *[F.struct(F.lit(k).alias("level"), ancestor(k + 1).alias("parent"), ancestor(k).alias("child")) for k in levels]
    )
    blocks = runs.groupBy(*keys, "_block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    tree = (
        blocks.select(*keys, F.explode(nodes).alias("n"), "lo", "hi")
        .groupBy(*keys, "n.level", "n.parent", "n.child")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    before = F.lag("hi").over(Window.partitionBy(*keys, "level", "parent").orderBy("child"))
    root = F.when(F.col("level") == levels[-1], F.lit(start).cast("long"))
    across = tree.select(*keys, F.coalesce(before, root).alias("_from"), F.col("lo").alias("_to"))
    return (
        inner.unionByName(across)
        .where(F.col("_to") - F.col("_from") > 1)
        .select(
            *keys,
            (F.col("_from") + 1).alias("from_id"),
            (F.col("_to") - 1).alias("to_id"),
            (F.col("_to") - F.col("_from") - 1).alias("missing"),
        )
    )


def ack_frontier_bucketed(
    acks: DataFrame, bucket: int = BLOCK, start: int = 0, ident: str = "id"
) -> DataFrame:
    """One-row frontier of a single very long queue.

    Distinct ids are counted per bucket; the run of full buckets is itself a frontier
    over bucket numbers, and only the bucket after it is read again, with literal id
    bounds that reach the scan.
    """
    if bucket % WORD:
        raise ValueError(f"bucket must be a multiple of {WORD}")
    number = floor_div(F.col("word") * WORD, bucket)
    full = (
        word_masks(acks.where(F.col(ident) > start), [], F.col(ident) - (start + 1))
        .groupBy(number.alias("b"))
        .agg(F.sum(F.bit_count("mask")).alias("n"))
        .where(F.col("n") == bucket)
        .select((F.col("b") + 1).alias("id"))
    )
    leading = ack_frontier(full, []).first()
    base = start + bucket * (leading["frontier"] if leading else 0)
    inside = acks.where((F.col(ident) > base) & (F.col(ident) <= base + bucket))
    return ack_frontier(inside, [], base, ident).agg(
        F.coalesce(F.max("frontier"), F.lit(base).cast("long")).alias("frontier")
    )
