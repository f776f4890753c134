"""Byte-level BPE encoding and decoding through a pair occurrence index.

The texts of a batch are cut into chunks at single spaces, the distinct chunks into
pre-tokens, and the distinct pre-tokens are laid out in one array of tokens with links to
their neighbours. The index maps every pair that has a merge to all places where it stands.
Ranks are taken in ascending order: all places of a rank are merged at once, and the pairs
that a merge makes are put into the lists of their own ranks. A merged token is made by one
rank only and its own pairs rank after it, so ascending order over the whole partition gives
every pre-token what its own greedy encoding gives.

Null texts are empty; an empty text has no tokens; equal texts have equal ids. Strings of
special tokens inside a text become their ids, as the public library does by default.
Nothing is collected and no row leaves its partition.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import distinct, offsets_of, ranges, texts_of
from tidelog.session import ship

#: Fixed value: the pattern that cuts a text into pre-tokens before byte-level merges.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    r"| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Texts of one Arrow batch are encoded in blocks of about this many characters.
BLOCK_CHARS = 12 << 20


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others for the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


def sorted_distinct(places: np.ndarray) -> np.ndarray:
    """The distinct places in order, by sorting: the arrays of most ranks are short."""
    places = np.sort(places)
    fresh = np.empty(len(places), bool)
    fresh[:1] = True
    np.not_equal(places[1:], places[:-1], out=fresh[1:])
    return places[fresh]


class PairIndexBpe:
    """A byte-level vocabulary with its merges, read from a ``tokenizers`` file; it may mark
    the ends of words by a suffix of their last token."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in letters.items()}
        end = spec["model"].get("end_of_word_suffix") or ""
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.end_ids = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        merges = [
            tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
            for m in spec["model"]["merges"]
        ]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        keys = (self.left << 32) | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max(max(vocab.values()), *self.special.values(), 0) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token in self.special:
                continue
            ends = bool(end) and token.endswith(end)
            own = token.removesuffix(end) if ends else token
            self.bytes_of[i] = bytes(byte_of[c] for c in own) + (b" " if ends else b"")
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.names = [str(i) for i in range(size)]
        self.pretokens = regex.compile(PATTERN)
        self.special_cut = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special
            else None
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where no merge joins it."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one word after the other, and the tokens of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        token = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
        n = len(token)
        following = np.arange(1, n + 1)
        previous = np.arange(-1, n - 1)
        edges = offsets_of(sizes)
        filled = sizes > 0
        following[edges[1:][filled] - 1] = -1
        previous[edges[:-1][filled]] = -1
        lasts = edges[1:][filled] - 1
        token[lasts] = self.end_ids[np.frombuffer(b"".join(words), np.uint8)[lasts]]

        lists: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def insert(places: np.ndarray) -> None:
            """Put places into the lists of the ranks of the pairs that begin there."""
            found = self.ranks(token[places], token[following[places]])
            places, found = places[found >= 0], found[found >= 0]
            by_rank = np.argsort(found, kind="stable")
            places, found = places[by_rank], found[by_rank]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end > start:
                    rank = int(found[start])
                    if rank not in lists:
                        heapq.heappush(active, rank)
                    lists[rank].append(places[start:end])

        insert(np.flatnonzero(following >= 0))
        while active:
            rank = heapq.heappop(active)
            a, b = self.left[rank], self.right[rank]
            places = sorted_distinct(np.concatenate(lists.pop(rank)))
            places = places[(token[places] == a) & (following[places] >= 0)]
            second = following[places]
            fits = token[second] == b
            places, second = places[fits], second[fits]
            if a == b and len(places) > 1:
                # In a run of equal tokens every other place is taken, from the left.
                joined = np.concatenate([[False], second[:-1] == places[1:]])
                index = np.arange(len(places))
                begin = np.maximum.accumulate(np.where(joined, 0, index))
                taken = (index - begin) % 2 == 0
                places, second = places[taken], second[taken]
            if not len(places):
                continue
            after = following[second]
            token[places] = self.made[rank]
            token[second] = -1
            following[places] = after
            inner = after >= 0
            previous[after[inner]] = places[inner]
            before = previous[places]
            insert(sorted_distinct(np.concatenate([before[before >= 0], places[inner]])))
        kept = token >= 0
        counts = np.concatenate([[0], np.cumsum(kept)])[edges]
        return token[kept].astype(np.int32), np.diff(counts)

    def cut(self, text: str) -> list[str]:
        """A text as pieces that encode independently: special tokens, and the text before
        each space that stands between two characters other than white space."""
        pieces: list[str] = []
        for part in self.special_cut.split(text) if self.special_cut else [text]:
            if part in self.special:
                pieces.append(part)
            elif part:
                pieces.extend(regex.split(r"(?V1)(?<=\S)(?=\x20\S)", part))
        return pieces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and the ids of each."""
        plain = pc.invert(pc.match_substring_regex(texts, r"(?s)\s\s|^\s|\s$|[\x1c-\x1f\x85\p{Z}]{2}"))
        for name in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, name)))
        plain = plain.to_numpy(zero_copy_only=False)
        # Pieces of plain texts are told from first pieces by the space that they begin with.
        values: list[str] = []
        codes: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        if plain.any():
            lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
            lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            words, code = distinct(lists.flatten())
            first = np.zeros(len(code), bool)
            first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
            heads, head = np.unique(code[first], return_inverse=True)
            code = code.astype(np.int64)
            code[first] = len(words) + head
            values += [" " + w for w in words]
            values += [words[h] for h in heads]
            counts[plain] = lengths
            codes.append(code)
        odd = np.flatnonzero(~plain)
        if len(odd):
            place: dict[str, int] = {}
            flat: list[int] = []
            for row in odd.tolist():
                pieces = self.cut(texts[row].as_py())
                counts[row] = len(pieces)
                flat += [place.setdefault(p, len(place)) for p in pieces]
            codes.append(np.array(flat, np.int64) + len(values))
            values += place
        chunk_ids, chunk_counts = self.encode_pieces(values)
        code = np.concatenate([*codes, np.zeros(0, np.int64)]).astype(np.int64)
        lengths = chunk_counts[code]
        ids = chunk_ids[ranges(offsets_of(chunk_counts)[:-1][code], lengths)]
        # Plain rows first, odd rows after them: back to the order of the texts.
        order = np.concatenate([np.flatnonzero(plain), odd])
        ends = offsets_of(lengths)
        per_row = np.diff(ends[offsets_of(counts[order])])
        starts = offsets_of(per_row)[:-1]
        back = np.argsort(order, kind="stable")
        sizes = per_row[back]
        return ids[ranges(starts[back], sizes)], sizes

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of independent pieces, one after the other, and the ids of each."""
        word_at: dict[str, int] = {}
        flat: list[int] = []
        sizes = np.zeros(len(pieces), np.int64)
        find = self.pretokens.findall
        for i, piece in enumerate(pieces):
            words = [piece] if piece in self.special else find(piece)
            sizes[i] = len(words)
            for word in words:
                flat.append(word_at.setdefault(word, len(word_at)))
        special = [word_at[s] for s in self.special if s in word_at]
        words = [w.encode() for w in word_at]
        for at in special:
            words[at] = b""
        ids, lengths = self.merge(words)
        if special:
            starts = offsets_of(lengths)[:-1]
            order = sorted(special)
            names = list(word_at)
            ids = np.insert(ids, starts[order], [self.special[names[at]] for at in order])
            lengths[order] = 1
        code = np.array(flat, np.int64)
        taken = lengths[code]
        out = ids[ranges(offsets_of(lengths)[:-1][code], taken)]
        ends = offsets_of(taken)
        return out, np.diff(ends[offsets_of(sizes)])

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def blocks(batch: pa.RecordBatch, column: str, size: int = BLOCK_CHARS) -> Iterator[tuple[int, pa.Array]]:
    """Parts of a batch of about ``size`` bytes, with the row each begins at."""
    texts = texts_of(batch.column(batch.schema.get_field_index(column)))
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // size
    cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), len(sizes)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield start, texts.slice(start, end - start)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` of every text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start, texts in blocks(batch, "_text"):
                ids, sizes = bpe.encode(texts)
                rows = pa.ListArray.from_arrays(pa.array(offsets_of(sizes), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), rows], [id_col, "ids"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, text`` of every row of ids; null ids give an empty text."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text and returns ``id_col, n_tokens, ids_sha256,
    decoded_sha256`` without moving the ids out of the task."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for start, texts in blocks(batch, "_text"):
                ids, sizes = bpe.encode(texts)
                ends = np.cumsum(sizes)
                coded, decoded = [], []
                for begin, end in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
                    own = ids[begin:end].tolist()
                    names = ",".join(map(bpe.names.__getitem__, own))
                    coded.append(hashlib.sha256(names.encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array(sizes),
                        pa.array(coded, pa.string()),
                        pa.array(decoded, pa.string()),
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
