"""Best-fit packing of token pieces into sequences of a fixed capacity.

A document is its ids followed by one end id; only documents longer than the capacity are
cut, into full pieces and a shorter last one. Pieces above a third of the capacity can share
a sequence with at most one of their kind, so they are matched first: the largest free one
with the largest other that still fits. Smaller pieces then go, largest first, into the
smallest gap that holds them, and open a new sequence where none does.

Pieces are dealt by hash into groups of about GROUP_PIECES, each packed in one task, so that
no task grows with the input; a group leaves at most a few open sequences. Null and empty
texts are one piece with the end id. Equal rows are packed separately. Long texts are
encoded whole. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import distinct, offsets_of, ranges
from tidelog.llm.bpe import PairIndexBpe, blocks
from tidelog.session import cut, ship

#: Pieces that one task packs together, on average.
GROUP_PIECES = 2_500
#: Fixed value: the pattern whose matches are the words of the vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: Letters before this one have no combining marks among them and the same lower case
#: everywhere, so chunks of them need no normalisation.
SIMPLE_BELOW = "\u0250"


class ChunkEncoder:
    """Ids of whole texts from the ids of their distinct chunks between spaces.

    Only for vocabularies that drop white space and case: no token of theirs crosses a
    space. Words of Latin chunks are merged through the pair occurrence index; chunks with
    other letters or with special tokens go to the public library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bpe = PairIndexBpe(path)
        self.words = regex.compile(WORDS)

    def words_of(self, chunk: str) -> list[str] | None:
        """The words of a chunk, None where only the library can tell."""
        if chunk.isascii():
            if chunk.isalpha():
                return [chunk.lower()]
            if chunk[:-1].isalpha() and chunk[-1] in ".,":
                return [chunk[:-1].lower(), chunk[-1]]
            if any(s in chunk for s in self.bpe.special):
                return None
        elif max(chunk) >= SIMPLE_BELOW or "\u0130" in chunk:
            return None
        chunk = chunk.lower()
        return [chunk] if chunk.isalpha() else self.words.findall(chunk)

    def chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all chunks, one after the other, and the ids of each."""
        word_at: dict[str, int] = {}
        flat: list[int] = []
        counts = np.zeros(len(chunks), np.int64)
        others: list[int] = []
        for i, chunk in enumerate(chunks):
            words = self.words_of(chunk)
            if words is None:
                others.append(i)
                words = [f" {chunk}"]  # no word begins with a space
            counts[i] = len(words)
            for word in words:
                flat.append(word_at.setdefault(word, len(word_at)))
        ids, sizes = self.bpe.merge([b"" if w[0] == " " else w.encode() for w in word_at])
        if others:
            places = [word_at[f" {chunks[i]}"] for i in others]
            texts = [chunks[i] for i in others]
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            own = [np.array(e.ids, np.int32) for e in found]
            starts = offsets_of(sizes)[places]
            order = np.argsort(starts, kind="stable")
            lengths = np.array([len(x) for x in own], np.int64)
            ids = np.insert(ids, np.repeat(starts[order], lengths[order]), np.concatenate([own[k] for k in order]))
            sizes[places] = lengths
        code = np.array(flat, np.int64)
        taken = sizes[code]
        out = ids[ranges(offsets_of(sizes)[:-1][code], taken)]
        return out, np.diff(offsets_of(taken)[offsets_of(counts)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the ids of each."""
        lists = pc.split_pattern(texts, " ")
        words, code = distinct(lists.flatten())
        ids, sizes = self.chunks(words)
        lengths = sizes[code]
        flat = ids[ranges(offsets_of(sizes)[:-1][code], lengths)]
        rows = offsets_of(lengths)[lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()]
        return flat, np.diff(rows)


@lru_cache(maxsize=2)
def load(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, piece, start, length, ids_crc32`` of every piece of every text."""
    ship(docs.sparkSession)
    names = [id_col, "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(path)
        for batch in batches:
            for first, texts in blocks(batch, "_text"):
                ids, sizes = encoder.encode(texts)
                ids = np.insert(ids, np.cumsum(sizes), end_id).astype("<u4")
                sizes = sizes + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = ranges(np.zeros(len(sizes), np.int64), pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                at = offsets_of(sizes)[row] + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(row + first)),
                        pa.array(piece, pa.int32()),
                        pa.array(start),
                        pa.array(length),
                        pa.array(crc, pa.int64()),
                    ],
                    names,
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """The places of the lengths that share a sequence, for each sequence."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    large = [i for i in order if 3 * lengths[i] > capacity]
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # sorted: what is left, the sequence
    free = [(lengths[i], i) for i in reversed(large)]
    while free:
        size, i = free.pop()
        members = [i]
        if (at := bisect_right(free, (capacity - size, len(lengths)))) > 0:
            other, j = free.pop(at - 1)
            size, members = size + other, [i, j]
        insort(gaps, (capacity - size, len(bins)))
        bins.append(members)
    for i in order[len(large) :]:
        at = bisect_left(gaps, (lengths[i], -1))
        left, k = gaps.pop(at) if at < len(gaps) else (capacity, len(bins))
        if k == len(bins):
            bins.append([])
        bins[k].append(i)
        insort(gaps, (left - lengths[i], k))
    return bins


def best_fit_packing(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces (with a ``length`` of 1 to ``capacity``) with their ``sequence_id`` and
    their ``offset`` in it; sequences have no gaps between their pieces."""
    if taken := {"_group", "sequence_id", "offset"} & set(pieces.columns):
        raise ValueError(f"columns in the way: {sorted(taken)}")
    pieces = cut(pieces)
    groups = max(1, -(-pieces.count() // group_pieces))
    key = F.pmod(F.xxhash64(*[c for c, t in pieces.dtypes if not t.startswith("map")]), F.lit(groups))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sequence = np.zeros(len(frame), np.int64)
        offset = np.zeros(len(frame), np.int64)
        lengths = frame["length"].tolist()
        base = int(frame["_group"].iloc[0]) << 32
        for k, members in enumerate(pack(lengths, capacity)):
            at = 0
            for i in members:
                sequence[i], offset[i] = base + k, at
                at += lengths[i]
        return frame.drop(columns="_group").assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes)
    return (
        pieces.withColumn("_group", key)
        .groupBy("_group")
        .applyInPandas(run, f"{schema}, sequence_id long, offset long")
    )
