"""Byte-level BPE by ranks with a segment tree over byte positions.

A text is cut by a pattern and every match is encoded by itself. The leaf of a byte position
holds the rank of the pair of live parts that begins there, and each node the smallest rank
below it with its leftmost position. The root names the next merge; a merge changes three
leaves (the part that grew, the one that it took, and its live left neighbour), so a match of
n bytes takes O(n log n) steps whatever it holds, one letter repeated a million times included.
A match that is itself a token is that token, as in the public library.

The distinct matches of some megabytes of text are encoded together: the trees of short ones
are rows of one array and take their next merges in the same steps; a long one has a tree of
its own. A bounded memory keeps the ids of matches for the texts that follow. Null
texts are empty, an empty text has no tokens, strings of special tokens are ordinary text.
Rows keep their partition: an empty table gives no rows, repeated rows and null ids are
encoded each, further columns are not read, and nothing is collected or shuffled.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import texts_of
from tidelog.session import ship

#: Matches that are held at a time, and the characters of a text cut in one go.
STEP = 1 << 19
#: Distinct matches that a task remembers beyond those it holds.
REMEMBERED = 400_000
#: Longer matches have a tree of their own; shorter ones advance together, so many at a time.
FOREST_BYTES = 64
FOREST = 1 << 14
#: No pair begins here: more than any rank and position.
NONE = 1 << 62
POSITION = (1 << 32) - 1


class RankBpe:
    """Ranks of byte strings, read from a file of base64 tokens and ranks."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for line in file:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.longest = max(map(len, self.ranks), default=0)
        self.token_bytes = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None
            and (right := self.ranks.get(token[cut:])) is not None
        ]
        table = np.array(sorted(pairs) or [(-1, 0)], np.int64)
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()
        # White space as Unicode has it: the library's \s leaves out U+001C to U+001F.
        spaces = pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.pattern = regex.compile(spaces)

    def matches(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        if len(text) <= STEP:
            yield self.pattern.findall(text)
            return
        found = (match.group() for match in self.pattern.finditer(text))
        while part := list(islice(found, STEP)):
            yield part

    def encode_match(self, word: bytes) -> list[int]:
        """The ids of one match."""
        ranks, longest = self.ranks.get, self.longest
        known = ranks(word)
        if known is not None:
            return [known]
        n = len(word)
        leaf = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * leaf)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        for i in range(n - 1):
            rank = ranks(word[i : i + 2])
            if rank is not None:
                tree[leaf + i] = rank << 32 | i
        for node in range(leaf - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

        def put(position: int, value: int) -> None:
            """Set a leaf and the minima above it, up to the first that stays."""
            node = leaf + position
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                least = value if value < other else other
                node >>= 1
                if tree[node] == least:
                    return
                tree[node] = value = least

        def pair(start: int, stop: int) -> int:
            rank = ranks(word[start:stop]) if stop - start <= longest else None
            return NONE if rank is None else rank << 32 | start

        while tree[1] != NONE:
            start = tree[1] & POSITION
            taken = end[start]
            stop = end[taken]
            end[start] = stop
            put(taken, NONE)
            if stop < n:
                before[stop] = start
                put(start, pair(start, end[stop]))
            else:
                put(start, NONE)
            if before[start] >= 0:
                put(before[start], pair(before[start], stop))
        ids, start = [], 0
        while start < n:
            ids.append(self.ranks[word[start : end[start]]])
            start = end[start]
        return ids

    def pair_values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaves of the pairs of tokens that begin at ``at``."""
        keys = left << 32 | right
        place = np.searchsorted(self.pair_keys, keys)
        place[place == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[place] == keys, self.pair_ranks[place] << 32 | at, NONE)

    def encode_forest(self, words: list[bytes], leaf: int) -> list[bytes]:
        """The ids of many short matches, packed: one tree of ``leaf`` leaves each, all of
        which take their next merge in the same step."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        inside = np.arange(leaf) < n[:, None]
        part = np.full(inside.shape, -1, np.int64)
        part[inside] = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((len(words), 2 * leaf), NONE, np.int64)
        rows, at = np.nonzero(inside[:, 1:])
        tree[rows, leaf + at] = self.pair_values(part[rows, at], part[rows, at + 1], at)
        for node in range(leaf - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        end = np.tile(np.arange(1, leaf + 1), (len(words), 1))
        before = end - 2

        def put(rows: np.ndarray, position: np.ndarray, value: np.ndarray) -> None:
            node = leaf + position
            tree[rows, node] = value
            while len(rows) and node[0] > 1:
                value = np.minimum(value, tree[rows, node ^ 1])
                node = node >> 1
                tree[rows, node] = value

        live = np.arange(len(words))
        while True:
            live = live[tree[live, 1] != NONE]
            if not len(live):
                break
            start = tree[live, 1] & POSITION
            taken = end[live, start]
            stop = end[live, taken]
            part[live, start] = tree[live, 1] >> 32
            part[live, taken] = -1
            end[live, start] = stop
            put(live, taken, np.full(len(live), NONE))
            value = np.full(len(live), NONE)
            inner = stop < n[live]
            rows, first, second = live[inner], start[inner], stop[inner]
            before[rows, second] = first
            value[inner] = self.pair_values(part[rows, first], part[rows, second], first)
            put(live, start, value)
            left = before[live, start]
            inner = left >= 0
            rows, first, second = live[inner], left[inner], start[inner]
            put(rows, first, self.pair_values(part[rows, first], part[rows, second], first))
        kept = part >= 0
        ids = part[kept].astype("<u4").tobytes()
        ends = (np.cumsum(kept.sum(1)) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def encode_matches(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Distinct matches with their ids as little-endian unsigned 32-bit numbers."""
        sizes: dict[int, list[str]] = {}
        for word in words:
            coded = word.encode()
            rank = self.ranks.get(coded)
            if rank is not None:
                yield word, rank.to_bytes(4, "little")
            elif len(coded) > FOREST_BYTES:
                yield word, np.array(self.encode_match(coded), "<u4").tobytes()
            else:
                sizes.setdefault(1 << (len(coded) - 1).bit_length(), []).append(word)
        for leaf, own in sizes.items():
            for first in range(0, len(own), FOREST):
                some = own[first : first + FOREST]
                yield from zip(some, self.encode_forest([w.encode() for w in some], leaf), strict=True)

    def encoder(self) -> Callable[[Iterable[str]], Iterator[tuple[int, bytes]]]:
        """A function that gives, for texts in order, their numbers and ids, a text in one or
        more parts; what it remembers goes with it."""
        memory: dict[str, bytes] = {}

        def flush(held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
            fresh = set().union(*(words for _, words in held)).difference(memory)
            if len(memory) + len(fresh) > REMEMBERED:
                memory.clear()
                fresh = set().union(*(words for _, words in held))
            memory.update(self.encode_matches(list(fresh)))
            for row, words in held:
                yield row, b"".join(map(memory.__getitem__, words))

        def encode(column: Iterable[str]) -> Iterator[tuple[int, bytes]]:
            held, size = [], 0
            for row, text in enumerate(column):
                for words in self.matches(text):
                    held.append((row, words))
                    size += len(words)
                    if size >= STEP:
                        yield from flush(held)
                        held, size = [], 0
            yield from flush(held)

        return encode

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str, pattern: str) -> RankBpe:
    return RankBpe(path, pattern)


def texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (text.as_py() for text in texts_of(batch.column(1)))


def picked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The id and the text under names of our own, and the type of the id."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")), kind


def segment_encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<long>`` of every text."""
    rows, kind = picked(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load(path, pattern).encoder()
        for batch in batches:
            parts: list[list[bytes]] = [[] for _ in range(batch.num_rows)]
            for row, part in encode(texts(batch)):
                parts[row].append(part)
            ids = [np.frombuffer(b"".join(own), "<u4").astype(np.int64) for own in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], [id_col, "ids"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, ids array<long>")


def segment_decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes binary`` of every row of ids; null ids give no bytes. An id outside the
    vocabulary fails the job."""
    ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            back = [bpe.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.binary())], [id_col, "bytes"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def segment_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text and returns ``id_col, n_tokens, ids_sha256,
    decoded_sha256`` without holding the ids of a long text at once."""
    rows, kind = picked(docs, id_col, text_col)
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        encode = bpe.encoder()
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            coded = [hashlib.sha256() for _ in range(batch.num_rows)]
            decoded = [hashlib.sha256() for _ in range(batch.num_rows)]
            for row, part in encode(texts(batch)):
                counts[row] += len(part) // 4
                coded[row].update(part)
                decoded[row].update(bpe.decode(np.frombuffer(part, "<u4")))
            digests = [pa.array([h.hexdigest() for h in own], pa.string()) for own in (coded, decoded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), *digests], names)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
