"""The run-length index against the longest match of every pair of places, and folded sums."""

import numpy as np
import pytest

from tidelog.llm.context_tree import WAITING, Folded
from tidelog.llm.run_index import build


def longest(segments):
    places = [(i, j) for i, s in enumerate(segments) for j in range(len(s))]
    out = []
    for i, j in places:
        most = 0
        for k, m in places:
            if (k, m) != (i, j):
                a, b = segments[i][j:], segments[k][m:]
                n = 0
                while n < min(len(a), len(b)) and a[n] == b[n]:
                    n += 1
                most = max(most, n)
        out.append(most)
    return out


@pytest.mark.parametrize("seed", range(40))
def test_matches(seed):
    rng = np.random.default_rng(seed)
    letters = np.frombuffer(b"ab\xff\x00" if seed % 2 else b"ab", np.uint8)
    segments = [bytes(rng.choice(letters, rng.integers(0, 24))) for _ in range(rng.integers(1, 6))]
    if seed % 3 == 0:
        segments.append(segments[0] * 3)
    index, starts = build(segments)
    found = index.matches()
    assert [int(found[starts[i] + j]) for i, s in enumerate(segments) for j in range(len(s))] == longest(segments)


@pytest.mark.parametrize("size", [1, 2, 3, 6, 7, 8, 13, 14, 15])
def test_matches_at_packed_lengths(size):
    segments = [b"a" * size, b"x" + b"a" * size, b"a" * (size - 1) + b"b"]
    index, starts = build(segments)
    found = index.matches()
    assert [int(found[starts[i] + j]) for i, s in enumerate(segments) for j in range(len(s))] == longest(segments)


def test_folded_sums():
    rng = np.random.default_rng(1)
    folded, want = Folded(), {}
    for n in [0, 5, 300, 1, 40, 1000, 2, 0, 700]:
        keys, sums = rng.permutation(1500)[:n].astype(np.int64), rng.integers(0, 9, n)
        folded.add(keys, sums)
        assert folded.waiting <= WAITING * len(folded.keys)
        for k, v in zip(keys.tolist(), sums.tolist(), strict=True):
            want[k] = want.get(k, 0) + v
    keys, sums = folded.fold()
    assert dict(zip(keys.tolist(), sums.tolist(), strict=True)) == want and len(keys) == len(want)
