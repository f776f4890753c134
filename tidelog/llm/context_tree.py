"""Context-tree weighting over bytes.

A text is its UTF-8 bytes and one end symbol (0xFF, which UTF-8 never holds). Every byte is
eight binary decisions, from its highest bit, and every decision has a context tree of its own
over the last ``depth`` bytes; the begin of a text counts as end symbols. A node of a tree
keeps how often either bit followed its context in the training texts, with the
Krichevsky-Trofimov estimate of that; its weighted probability is the mean of this estimate
and of the product of its children's weighted probabilities. A bit is then predicted along
the path of its context: each node's estimate counts with the posterior weight that the tree
stops there, and a path that training has never seen ends at its last known node. The
predictions of a context sum to one over the bytes, so the model is a proper code.

The trees are tables. Contexts that end in the same three bytes are a subtree, computed by
one task; above them the trees take one aggregate per depth upwards (a node has at most 256
children) and one join per depth downwards. Texts are dealt into blocks
of bounded size; each block sends its distinct n-grams and words, gets their values back, and
sums them up for its documents. So neither the model nor the vocabulary is ever held whole in
one place, and what is gathered grows with the corpus.

Null texts are empty: an end symbol and nothing else. Repeated rows are scored each. Texts of
any length are scored whole. An empty table gives an empty result; without training texts
every bit has probability one half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import ascii_words, batches_by, mixed, offsets_of, ranges, row_sums, texts_of
from tidelog.llm.blocks import block_count, to_blocks, unpacked
from tidelog.llm.imatch import term_hashes
from tidelog.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from tidelog.session import ship, work_path

DEPTH = 5
LEAST_BLOCKS = 12
#: Keys that wait to be folded, for each one that is.
WAITING = 4
END = 0xFF
#: Bytes whose n-grams are looked at together.
STEP = 1 << 20
LN2 = float(np.log(2))


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, so that later uses only read them."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def grams(texts: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of every byte and end of all texts, context first, and how many each text has."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(texts)
    padded = sizes + depth + 1
    data = np.full(int(padded.sum()), END, np.uint8)
    starts = offsets_of(padded)[:-1]
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data[ranges(starts + depth, sizes)] = flat[offsets[0] : offsets[-1]]
    key = np.zeros(len(data) - depth, np.int64)
    for k in range(depth + 1):
        key = (key << 8) | data[k : len(data) - depth + k]
    return key[ranges(starts, sizes + 1)], sizes + 1


def steps(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Parts of the texts of about STEP bytes, with the row each begins at."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // STEP
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield a, texts.slice(a, b - a)


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and the sum of the weights of each."""
    codes, distinct = pd.factorize(keys)
    return distinct, np.bincount(codes, weights, len(distinct)).astype(np.int64)


class Folded:
    """Distinct keys and their sums, folded together whenever what came since has grown to
    ``WAITING`` times what is folded: memory follows the distinct keys, not the text."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.later: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, sums: np.ndarray) -> None:
        self.later.append((keys, sums))
        self.waiting += len(keys)
        if self.waiting > WAITING * len(self.keys):
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if self.later:
            parts = [(self.keys, self.sums), *self.later]
            self.later, self.waiting = [], 0
            self.keys, self.sums = counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return self.keys, self.sums


def block_counts(dealt: DataFrame, depth: int, bits: int) -> DataFrame:
    """``block, word, range, keys, counts``: the distinct words (by hash) and n-grams of every
    block, and how often each stands in its training texts, by range of the mixed key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by(batches, "block"):
            block = table.column("block")[0].as_py()
            found = (Folded(), Folded())
            for rows in unpacked(table.column("load")):
                train = rows.column("train").to_numpy(zero_copy_only=False)
                texts = texts_of(rows.column("text"))
                for first, part in steps(texts):
                    mark = train[first : first + len(part)].astype(float)
                    keys, sizes = grams(part, depth)
                    found[0].add(*counted(keys, np.repeat(mark, sizes)))
                    words, sizes = ascii_words(part)
                    encoded = words.dictionary_encode()
                    codes = encoded.indices.to_numpy(zero_copy_only=False)
                    hashes = term_hashes(encoded.dictionary).view(np.int64)
                    n = np.bincount(codes, np.repeat(mark, sizes), len(hashes)).astype(np.int64)
                    found[1].add(hashes, n)
            for word, own in enumerate(found):
                keys, n = own.fold()
                part = range_of(keys, bits)
                order = np.lexsort((keys.view(np.uint64), part))
                keys, n = keys[order], n[order]
                cuts = np.searchsorted(part[order], np.arange(2**bits + 1))
                for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                    if b > a:
                        yield packed_row(block, word, i, pack_sorted(keys[a:b].view(np.uint64)), pack(n[a:b]))

    return dealt.sortWithinPartitions("block").mapInArrow(run, PACKED)


PACKED = "block int, word int, range int, keys binary, load binary"


def packed_row(block: int, word: int, part: int, keys: bytes, load: bytes) -> pa.RecordBatch:
    columns = [pa.array([x], pa.int32()) for x in (block, word, part)]
    columns += [pa.array([x], pa.binary()) for x in (keys, load)]
    return pa.RecordBatch.from_arrays(columns, ["block", "word", "range", "keys", "load"])


def range_of(keys: np.ndarray, bits: int) -> np.ndarray:
    """The range that a key is dealt to."""
    return (mixed(keys.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def summed(found: DataFrame) -> DataFrame:
    """``range, key, n``: the counts of all blocks together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Folded] = {}
        for batch in batches:
            for part, keys, load in zip(*(batch.column(c).to_pylist() for c in ("range", "keys", "load")), strict=True):
                held.setdefault(part, Folded()).add(unpack_sorted(keys).view(np.int64), unpack(load, np.int64))
        for part in list(held):
            keys, n = held.pop(part).fold()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), part), pa.int32()), pa.array(keys), pa.array(n)], ["range", "key", "n"]
            )

    return found.repartition("range").mapInArrow(run, "range int, key long, n long")


def answered(found: DataFrame, values: DataFrame) -> DataFrame:
    """The packed rows with the values ``range, key, value`` of their keys as their load."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, value = right.column("key").to_numpy(), right.column("value").to_numpy()
        order = np.argsort(key)
        key, value = key[order], value[order]
        out = []
        for block, word, part, keys in zip(*(left.column(c).to_pylist() for c in ("block", "word", "range", "keys")), strict=True):
            own = value[np.searchsorted(key, unpack_sorted(keys).view(np.int64))]
            out.append(packed_row(block, word, part, keys, pack(own.astype(np.float64))))
        return pa.Table.from_batches(out, schema=EMPTY)

    return found.groupBy("range").cogroup(values.groupBy("range")).applyInArrow(run, PACKED)


EMPTY = pa.schema([(c, pa.int32()) for c in ("block", "word", "range")] + [(c, pa.binary()) for c in ("keys", "load")])


def log_gamma(x: Column) -> Column:
    """The natural logarithm of the gamma function, by Stirling's series eight steps up."""
    y = x + 8
    inverse = 1 / y
    series = inverse / 12 - F.pow(inverse, 3) / 360 + F.pow(inverse, 5) / 1260
    product = reduce(lambda a, b: a * b, [x + k for k in range(8)])
    return (y - 0.5) * F.log(y) - y + float(0.5 * np.log(2 * np.pi)) + series - F.log(product)


def estimate(n0: Column, n1: Column) -> Column:
    """The logarithm of the Krichevsky-Trofimov probability of the counts."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - float(np.log(np.pi))


def log_gamma_of(x: np.ndarray) -> np.ndarray:
    """:func:`log_gamma` for an array."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    product = np.prod([x + k for k in range(8)], axis=0)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


@dataclass
class Level:
    """The nodes of one depth: context and node in one key, bit counts, the logarithm of the
    weighted probability, the weight of stopping here, and each node's parent."""

    key: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    weighted: np.ndarray
    stop: np.ndarray
    parent: np.ndarray | None = None

    def one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1.0)


def tree_levels(keys: np.ndarray, n: np.ndarray, depth: int, least: int) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """The levels from ``depth`` up to ``least`` of all contexts of the keys, and for each
    decision of each key its deepest node and its bit."""
    context, byte = keys >> 8, keys & 255
    j = np.arange(8)
    node = (1 << j) | (byte[:, None] >> (8 - j))
    bit = (byte[:, None] >> (7 - j)) & 1
    at, own = pd.factorize(((context[:, None] << 8) | node).ravel())
    bits = bit.ravel()
    weight = np.repeat(n, 8).astype(float)
    n1 = np.bincount(at, weight * bits, len(own))
    n0 = np.bincount(at, weight * (1 - bits), len(own))

    def estimated(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
        return log_gamma_of(n0 + 0.5) + log_gamma_of(n1 + 0.5) - log_gamma_of(n0 + n1 + 1.0) - np.log(np.pi)

    levels = [Level(own, n0, n1, estimated(n0, n1), np.ones(len(own)))]
    for d in range(depth - 1, least - 1, -1):
        below = levels[-1]
        up = (((below.key >> 8) & ((1 << (8 * d)) - 1)) << 8) | (below.key & 255)
        below.parent, key = pd.factorize(up)
        n0, n1, under = (np.bincount(below.parent, x, len(key)) for x in (below.n0, below.n1, below.weighted))
        here = estimated(n0, n1)
        levels.append(Level(key, n0, n1, np.logaddexp(here, under) - LN2, 1 / (1 + np.exp(np.clip(under - here, -700, 700)))))
    return levels, at.reshape(-1, 8), bit


def local_levels(counts: DataFrame, depth: int, split: int) -> DataFrame:
    """``context, node, n0, n1, weighted, stop`` of the nodes of depth ``split``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        top = tree_levels(keys, n, depth, split)[0][-1]
        columns = [top.key >> 8, (top.key & 255).astype(np.int32), top.n0.astype(np.int64), top.n1.astype(np.int64)]
        columns += [top.weighted, top.stop]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["context", "node", "n0", "n1", "weighted", "stop"])

    schema = "context long, node int, n0 long, n1 long, weighted double, stop double"
    return counts.repartition("suffix").select("key", "n").mapInArrow(run, schema)


def gram_scores(counts: DataFrame, depth: int, split: int = 3) -> DataFrame:
    """``range, key, value``: the decimal logarithm of the probability of the last byte of each
    key behind the others, from the training counts ``range, key, n`` of all keys. Contexts
    that end in the same ``split`` bytes are a tree of their own below depth ``split``, which
    one task can hold; the depths above are joins and aggregates."""
    split = min(split, depth)
    suffix = F.shiftright("key", 8).bitwiseAND(F.lit((1 << (8 * split)) - 1))
    group = F.pmod(F.xxhash64(suffix), F.lit(1 << 10)).cast("int")
    counts = counts.withColumn("suffix", group)
    level = stored(local_levels(counts, depth, split), "tree")
    levels = [level]
    estimated = estimate(F.col("n0"), F.col("n1"))
    for d in range(split - 1, -1, -1):
        parent = F.col("context").bitwiseAND(F.lit((1 << (8 * d)) - 1))
        level = level.groupBy(parent.alias("context"), "node").agg(
            F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below")
        )
        level = level.withColumn("own", estimated)
        most = F.greatest("own", "below")
        level = level.select(
            "context",
            "node",
            "n0",
            "n1",
            (most + F.log(F.exp(F.col("own") - most) + F.exp(F.col("below") - most)) - LN2).alias("weighted"),
            (1 / (1 + F.exp(F.col("below") - F.col("own")))).alias("stop"),
        )
        level = stored(level, "tree")
        levels.append(level)
    levels.reverse()
    # Downwards: what the nodes so far say of bit 1, the weight left, the last estimate.
    kt = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    above = levels[0].select(
        "context", "node", (F.col("stop") * kt).alias("said"), (1 - F.col("stop")).alias("left"), kt.alias("last")
    )
    for d in range(1, split + 1):
        up = above.select(F.col("context").alias("up"), "node", "said", "left", "last")
        own = levels[d].withColumn("up", F.col("context").bitwiseAND(F.lit((1 << (8 * (d - 1))) - 1)))
        known = F.col("n0") + F.col("n1") > 0
        above = own.join(up, ["up", "node"]).select(
            "context",
            "node",
            F.when(known, F.col("said") + F.col("left") * F.col("stop") * kt)
            .otherwise(F.col("said") + F.col("left") * F.col("last"))
            .alias("said"),
            F.when(known, F.col("left") * (1 - F.col("stop"))).otherwise(F.lit(0.0)).alias("left"),
            F.when(known, kt).otherwise(F.col("last")).alias("last"),
        )
    above = above.withColumn("suffix", F.pmod(F.xxhash64("context"), F.lit(1 << 10)).cast("int"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, n = left.column("key").to_numpy(), left.column("n").to_numpy()
        levels, at, bit = tree_levels(keys, n, depth, split)
        order_key = (right.column("context").to_numpy() << 8) | right.column("node").to_numpy()
        order = np.argsort(order_key)
        place = order[np.searchsorted(order_key[order], levels[-1].key)]
        said, rest, last = (right.column(c).to_numpy()[place] for c in ("said", "left", "last"))
        for level in levels[-2::-1]:
            said, rest, last = said[level.parent], rest[level.parent], last[level.parent]
            known, one = level.n0 + level.n1 > 0, level.one()
            said = np.where(known, said + rest * level.stop * one, said + rest * last)
            rest = np.where(known, rest * (1 - level.stop), 0.0)
            last = np.where(known, one, last)
        chance = np.where(bit == 1, said[at], 1 - said[at])
        value = np.log10(chance).sum(1)
        return pa.Table.from_arrays([left.column("range"), pa.array(keys), pa.array(value)], ["range", "key", "value"])

    return counts.groupBy("suffix").cogroup(above.groupBy("suffix")).applyInArrow(run, "range int, key long, value double")


def score_texts(
    docs: DataFrame, training: Column, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes`` of
    every row: the context tree's log10 probability of the text, learned from the rows where
    ``training`` holds, beside that of single words with one added to each count."""
    ship(docs.sparkSession)
    blocks = block_count(docs, text_col, least=LEAST_BLOCKS)
    rows = docs.select(
        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("block"),
        F.col(id_col).alias("id"),
        F.coalesce(training, F.lit(True)).alias("train"),
        F.col(text_col).cast("string").alias("text"),
    )
    dealt = to_blocks(rows, blocks)
    bits = max(32, 2 * blocks).bit_length()
    found = stored(block_counts(dealt, depth, bits), "block-counts")
    # Every text ends with one end token, which is counted as a token of the vocabulary.
    ends = docs.agg(F.count(F.when(F.coalesce(training, F.lit(True)), 1)).alias("n")).first()["n"]
    words = stored(summed(found.where("word = 1")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    train_tokens, distinct = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    scores = gram_scores(stored(summed(found.where("word = 0")), "grams"), depth)
    values = answered(found.where("word = 0"), scores).unionByName(
        answered(found.where("word = 1"), words.select("range", "key", F.col("n").cast("double").alias("value")))
    )
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
    floor = float(np.log10(train_tokens + distinct + 1))

    def looked_up(keys: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
        codes, own = pd.factorize(keys)
        return value[np.searchsorted(known, own)][codes] if len(own) else np.zeros(0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        for k in (0, 1):
            own = right.filter(pc.equal(right.column("word"), k))
            keys = [unpack_sorted(x).view(np.int64) for x in own.column("keys").to_pylist()]
            load = [unpack(x, np.float64) for x in own.column("load").to_pylist()]
            key, value = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*load, np.zeros(0)])
            order = np.argsort(key)
            tables.append((key[order], value[order]))
        out = []
        for packed in unpacked(left.column("load")):
            ids, train = packed.column("id"), packed.column("train").to_numpy(zero_copy_only=False)
            texts = texts_of(packed.column("text"))
            for first, part in steps(texts):
                keys, sizes = grams(part, depth)
                score = row_sums(looked_up(keys, *tables[0]), sizes)
                flat, n = ascii_words(part)
                encoded = flat.dictionary_encode()
                hashes = term_hashes(encoded.dictionary).view(np.int64)
                own = looked_up(hashes, *tables[1])[encoded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0)
                base = row_sums(np.log10(own + 1), n) + np.log10(ends + 1) - (n + 1) * floor
                known = np.round(row_sums((own > 0).astype(float), n)).astype(np.int64) + (ends > 0)
                rows = len(part)
                out.append(
                    pa.Table.from_arrays(
                        [
                            ids.slice(first, rows),
                            pa.array(~train[first : first + rows].astype(bool)),
                            pa.array(n + 1),
                            pa.array(known),
                            pa.array(np.full(rows, train_tokens), pa.int64()),
                            pa.array(base),
                            pa.array(score),
                            pa.array(sizes - 1),
                        ],
                        names,
                    )
                )
        return pa.concat_tables(out)

    schema = (
        f"`{id_col}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double, n_bytes long"
    )
    return dealt.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)
