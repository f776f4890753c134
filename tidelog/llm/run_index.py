"""A run-length index of the Burrows-Wheeler transform of segments, sampled at run ends.

The suffix array of the segments (each closed by an end of its own) gives the transform; only
its runs are kept, and for the row at either end of each run the text position and the match
length with the row beyond that end. Inside a run, stepping one position on in the text keeps
the neighbour and shortens the match by one, so the samples alone, streamed in text order,
give the matching statistics of every position against all other positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidelog.llm.arrays import offsets_of, ranges


@dataclass
class RunIndex:
    """Samples in text order: where run heads and run tails stand, and how far they match."""

    size: int
    runs: int
    heads: tuple[np.ndarray, np.ndarray]
    tails: tuple[np.ndarray, np.ndarray]

    def matches(self) -> np.ndarray:
        """For each position, the longest match of the text from there with the text from any
        other position; matches end where segments end."""
        out = np.zeros(self.size, np.int64)
        place = np.arange(self.size)
        for at, length in (self.heads, self.tails):
            last = np.searchsorted(at, place, side="right") - 1
            known = last >= 0
            np.maximum(out[known], length[last[known]] - (place[known] - at[last[known]]), out=(own := out[known]))
            out[known] = own
        return out


def build(segments: list[bytes]) -> tuple[RunIndex, np.ndarray]:
    """The index of the segments, and where each begins (an end follows each segment)."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = offsets_of(sizes + 1)[:-1]
    size = int((sizes + 1).sum())
    text = np.zeros(size, np.int64)
    text[ranges(starts, sizes)] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
    ends = starts + sizes
    # Bytes up to the end of the segment, then 0: an end is told from others by its place.
    rank = text.copy()
    rank[ends] = 0
    order = np.arange(size)
    levels: list[tuple[int, np.ndarray]] = []
    longest = int(sizes.max()) + 1 if len(sizes) else 1
    left = np.repeat(ends, sizes + 1) - order  # bytes from here to the end

    def doubled(rank: np.ndarray, step: int, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by twice as many bytes, and the places that still share theirs. A rank is the
        row at which its places begin, so places that stand alone keep theirs."""
        beyond = np.zeros(len(open_), np.int64)
        inside = left[open_] >= step
        beyond[inside] = rank[open_[inside] + step] + 1
        own = rank[open_]
        key = own * (size + 2) + beyond
        by = np.argsort(key)
        key, own, sorted_ = key[by], own[by], open_[by]
        n = np.arange(len(by))
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        new_own = np.concatenate([[True], own[1:] != own[:-1]])
        first_key = np.maximum.accumulate(np.where(new_key, n, 0))
        first_own = np.maximum.accumulate(np.where(new_own, n, 0))
        out = rank.copy()
        out[sorted_] = own + first_key - first_own
        alone = new_key & np.append(new_key[1:], True)
        return out, sorted_[~alone]

    # Up to seven bytes by packing: 257^7 is below 2^63.
    step = 1

    def beyond(rank: np.ndarray, step: int) -> np.ndarray:
        """The ranks ``step`` places on, 0 behind the end of the segment."""
        out = np.zeros(size, np.int64)
        inside = left >= step
        out[inside] = rank[order[inside] + step]
        return out

    for more in (1, 2, 3):
        if step < longest:
            levels.append((step, rank))
            # Of the next bytes, as many as are wanted: the rest of a rank are its last digits.
            rank = rank * 257**more + beyond(rank, step) // 257 ** (step - more)
            step += more
    if size:
        by = np.argsort(rank)
        fresh = np.concatenate([[True], rank[by][1:] != rank[by][:-1]])
        rank[by] = np.maximum.accumulate(np.where(fresh, np.arange(size), 0))
        open_ = by[~(fresh & np.append(fresh[1:], True))]
    while step < longest and size and len(open_):
        levels.append((step, rank))
        rank, open_ = doubled(rank, step, open_)
        step *= 2
    # Equal whole rests (of different segments) are ordered by their place.
    rows = np.argsort(rank * size + order)
    before = np.where(rows > 0, text[rows - 1], -1)
    at_start = np.zeros(size, bool)
    at_start[starts] = True
    before[at_start[rows]] = -1
    change = np.concatenate([[True], (before[1:] != before[:-1]) | (before[1:] == -1)]) if size else np.zeros(0, bool)
    head = np.flatnonzero(change)
    tail = np.append(head[1:], size) - 1

    def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The match length of the texts from a and from b, not beyond a segment."""
        length = np.zeros(len(a), np.int64)
        most = np.minimum(left[a], left[b])
        # What is left is shorter than twice a step, so each step is taken once at most.
        for step, own in reversed(levels):
            fits = np.flatnonzero(most - length >= step)
            fits = fits[own[a[fits] + length[fits]] == own[b[fits] + length[fits]]]
            length[fits] += step
        return length

    def samples(at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (other >= 0) & (other < size)
        length = np.zeros(len(at), np.int64)
        length[inside] = common(rows[at[inside]], rows[other[inside]])
        place = rows[at]
        by = np.argsort(place, kind="stable")
        return place[by], length[by]

    index = RunIndex(size, len(head), samples(head, head - 1), samples(tail, tail + 1))
    return index, starts
