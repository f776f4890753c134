"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

A pre-token is a word between ASCII white space behind a mark for the space. Its tokens are
the segmentation with the best sum of piece scores, of equal ones the one with fewer tokens.
Piece scores follow Zipf's law of the piece's rank in a public vocabulary; a character that no
piece covers costs ``UNKNOWN`` and counts as its UTF-8 bytes. The distinct pre-tokens of a
block are walked in sorted order, that is, as a trie: the forward scores of a shared prefix
are computed once, and each word's count is stored where it ends. Documents add up the counts.

Null and empty texts have no tokens, long texts are counted whole, repeated rows are counted
each, an empty table gives an empty result. No row leaves its partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import ascii_words, distinct, row_sums
from tidelog.llm.bpe import blocks
from tidelog.session import ship

MARK = "▁"
UNKNOWN = -20.0


@lru_cache(maxsize=1)
def pieces(path: str) -> tuple[dict[str, float], int]:
    """The score of every ordinary piece, and the length of the longest."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    ]
    return {p: -math.log(rank + 2) for rank, p in enumerate(names)}, max(map(len, names), default=1)


def trie_counts(words: list[str], scores: dict[str, float], longest: int) -> np.ndarray:
    """The number of tokens of each word."""
    out = np.zeros(len(words), np.int64)
    forward: list[tuple[float, int]] = [(0.0, 0)]  # best score, less tokens, of each prefix
    before = ""
    get = scores.get
    for i in sorted(range(len(words)), key=words.__getitem__):
        word = MARK + words[i]
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        del forward[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            score, less = forward[end - 1]
            best = (score + UNKNOWN, less - len(word[end - 1].encode()))
            for start in range(max(0, end - longest), end):
                own = get(word[start:end])
                if own is not None:
                    score, less = forward[start]
                    best = max(best, (score + own, less - 1))
            forward.append(best)
        out[i] = -forward[-1][1]
        before = word
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_pretokens, n_tokens`` of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = pieces(path)
        for batch in batches:
            for first, texts in blocks(batch, "_text"):
                flat, counts = ascii_words(texts, lower=False)
                words, code = distinct(flat)
                number = trie_counts(words, scores, longest)[code] if len(code) else np.zeros(0, np.int64)
                columns = [batch.column(0).slice(first, len(texts)), pa.array(counts), pa.array(row_sums(number, counts))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_pretokens", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, f"`{id_col}` {kind}, n_pretokens long, n_tokens long")
