"""Ragged arrays, text splitting and vectors shared by the operators; all of it works on one
Arrow batch or one bounded block at a time, inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = " "


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The texts as one large string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ..`` of every row, one row after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Where each row begins, and where the last one ends."""
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def distinct(values: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct values and, for each value, its place among them."""
    encoded = values.dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)


def ascii_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """The words between ASCII white space of all texts, A-Z lowered, and the number of
    words of each text."""
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    filled = pc.not_equal(pc.binary_length(flat), 0)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    before = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    return flat.filter(filled), np.diff(before[offsets])


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The sum of each row of a ragged array; empty rows give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def batches_by(
    batches: Iterator[pa.RecordBatch], key: str, most_rows: int | None = None
) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of a sorted partition, as tables; a run longer than
    ``most_rows`` comes in several tables."""
    held: list[pa.RecordBatch] = []
    rows, current = 0, None
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if end == start:
                continue
            if held and (keys[start] != current or (most_rows and rows >= most_rows)):
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            current = keys[start]
            held.append(batch.slice(start, end - start))
            rows += end - start
    if held:
        yield pa.Table.from_batches(held)
