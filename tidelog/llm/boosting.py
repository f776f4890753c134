"""Gradient-boosted trees of depth three: logistic loss, split on bins, Newton leaves. Few rows
are fitted on the spot (``fit_trees``, quantile bins); many are rows of codes that Spark deals
(``grow_trees``, bins given). There each level of a tree is one job: tasks sum gradients of their
own rows by node, feature and code, the sums are added up. Gradients are whole numbers of
1 / ``UNIT``, so the sums and the trees do not depend on how rows are dealt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.session import cut

BINS = 32
UNIT = 1 << 20
#: Rounds after which margins are stored.
STORED_ROUNDS = 10


@dataclass
class Trees:
    """Trees as arrays: a split feature and threshold per inner node, a value per leaf."""

    depth: int = 3
    features: list[np.ndarray] = field(default_factory=list)
    thresholds: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    #: The thresholds as codes, where the trees were grown on codes.
    codes: list[np.ndarray] = field(default_factory=list)

    def leaf_of(self, x: np.ndarray, feature: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        return node - (2**self.depth - 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, t, v in zip(self.features, self.thresholds, self.leaves, strict=True):
            out += v[self.leaf_of(x, f, t)]
        return out

    def margin_of_codes(self, codes: np.ndarray, margin: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        """The margin of rows whose codes are columns, from that of the trees before ``first``."""
        out = np.full(codes.shape[1], self.base) if margin is None else margin.copy()
        for f, t, v in zip(self.features[first:], self.codes[first:], self.leaves[first:], strict=True):
            out += v[nodes_of_codes(codes, f, t, self.depth) - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.probability_of_margin(self.margin(x))

    @staticmethod
    def probability_of_margin(margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3) -> Trees:
    """Trees for rows ``x`` and labels 0 or 1."""
    trees = Trees(depth)
    share = np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3)
    trees.base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return trees
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], 1)
    margin = np.full(len(y), trees.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = (1e-6, 0, np.inf, None)
            if len(rows) >= 10:
                gs, hs = g[rows].sum(), h[rows].sum()
                for j in range(x.shape[1]):
                    if not len(edges[j]):
                        continue
                    left_g = np.cumsum(np.bincount(binned[rows, j], g[rows], len(edges[j]) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(binned[rows, j], h[rows], len(edges[j]) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], j, edges[j][k], k)
            _, feature[at], threshold[at], _ = best
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        trees.features.append(feature)
        trees.thresholds.append(threshold)
        trees.leaves.append(value)
        margin += value[leaf]
    return trees


def nodes_of_codes(codes: np.ndarray, feature: np.ndarray, code: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row reaches in some levels of a tree."""
    node = np.zeros(codes.shape[1], np.int64)
    for level in range(levels):
        right = np.zeros(len(node), bool)
        for at in range(2**level - 1, 2 ** (level + 1) - 1):
            own = node == at
            np.copyto(right, codes[feature[at]] > code[at], where=own)
        node = 2 * node + 1 + right
    return node


def task_sums(chunks: DataFrame, sums: Callable, width: int) -> np.ndarray:
    """The sum of ``sums(codes, y, n, ...)``, whole numbers, over all rows of ``chunks``: packed
    arrays of codes (column by column), labels, numbers of rows and, if there, margins. A task
    sends its own sum only, and tasks are as many as ``chunks`` has partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums(*unpacked(row, width))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    empty = sums(*unpacked((b"", b"", b"", b"")[: len(chunks.columns)], width))
    out = np.zeros(empty.shape, np.int64)
    for row in chunks.mapInArrow(run, "sums binary").collect():
        out += np.frombuffer(row["sums"], np.int64).reshape(empty.shape)
    return out


def unpacked(row: tuple, width: int) -> tuple[np.ndarray, ...]:
    codes, y, n, *margin = row
    columns = np.frombuffer(codes, np.uint8).reshape(width, -1) if codes else np.zeros((width, 0), np.uint8)
    return columns, np.frombuffer(y, np.uint8), np.frombuffer(n, np.int64), *(np.frombuffer(m) for m in margin)


def with_margins(chunks: DataFrame, trees: Trees, first: int, width: int) -> DataFrame:
    """The chunks with the margins of all trees, those before ``first`` being in them already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            margins = []
            for row in rows:
                codes, _, _, *known = unpacked(row, width)
                margins.append(trees.margin_of_codes(codes, known[0] if known else None, first).tobytes())
            columns = [*batch.columns[:3], pa.array(margins, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["codes", "y", "n", "margin"])

    return cut(chunks.mapInArrow(run, "codes binary, y binary, n binary, margin binary"))


def grow_trees(
    chunks: DataFrame, edges: list[np.ndarray], weights: np.ndarray, rounds: int = 60, rate: float = 0.2, depth: int = 3
) -> Trees:
    """Trees for rows of ``codes, y, n`` (see :func:`task_sums`): a code is the number of the
    ``edges`` of its feature below the value, and each of the first features, one of which is 1,
    gives a row its weight."""
    trees = Trees(depth)
    width, bins, inner = len(edges), max(map(len, edges)) + 1, 2**depth - 1

    def weight_of(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return n * (weights @ (codes[: len(weights)] > 0))

    def labels(codes: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.rint(weight_of(codes, n) * UNIT).astype(np.int64)
        return np.array([w.sum(), w[y > 0].sum()])

    every, true = task_sums(chunks, labels, width)
    share = np.clip(true / every if every else 0.0, 1e-3, 1 - 1e-3)
    trees.base = float(np.log(share / (1 - share)))
    if true in (0, every):
        return trees
    stored, first = with_margins(chunks, trees, 0, width), 0
    for done in range(rounds):
        if done - first == STORED_ROUNDS:
            stored, first = with_margins(stored, trees, first, width), done
        feature, code = np.zeros(inner, np.int64), np.full(inner, bins)

        def level_sums(level: int, feature: np.ndarray = feature, code: np.ndarray = code, first: int = first) -> Callable:
            """Gradients, their slopes and rows by node, feature and code."""

            def sums(codes: np.ndarray, y: np.ndarray, n: np.ndarray, margin: np.ndarray) -> np.ndarray:
                margin = trees.margin_of_codes(codes, margin, first)
                p = 1 / (1 + np.exp(-margin))
                w = weight_of(codes, n)
                g, h = np.rint((y - p) * w * UNIT), np.rint(p * (1 - p) * w * UNIT)
                node = nodes_of_codes(codes, feature, code, level) - (2**level - 1)
                out = np.zeros((3, width, 2**level * bins), np.int64)
                for j in range(width):
                    at = node * bins + codes[j]
                    for k, v in enumerate((g, h, n) if j == 0 else (g, h)):
                        out[k, j] = np.bincount(at, v, 2**level * bins).astype(np.int64)
                return out.reshape(3, width, 2**level, bins)

            return sums

        # Gradients and slopes of the leaves, from the splits of the last level.
        sums = np.zeros((2, 2**depth))
        for level in range(depth):
            found = task_sums(stored, level_sums(level), width)
            for i in range(2**level):
                left_g, left_h = (np.cumsum(found[k, :, i], axis=1) / UNIT for k in (0, 1))
                gs, hs = left_g[0, -1], left_h[0, -1]
                sums[:, 2 * i] = gs, hs
                sums[:, 2 * i + 1] = 0
                if found[2, 0, i].sum() < 10:
                    continue
                gain = left_g**2 / (left_h + 1) + (gs - left_g) ** 2 / (hs - left_h + 1) - gs**2 / (hs + 1)
                j, k = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, k] > 1e-6:
                    feature[2**level - 1 + i], code[2**level - 1 + i] = j, k
                    sums[:, 2 * i] = left_g[j, k], left_h[j, k]
                    sums[:, 2 * i + 1] = gs - left_g[j, k], hs - left_h[j, k]
        trees.features.append(feature)
        trees.codes.append(code)
        trees.thresholds.append(np.array([edges[j][k] if k < len(edges[j]) else np.inf for j, k in zip(feature, code, strict=True)]))
        trees.leaves.append(rate * sums[0] / (sums[1] + 1))
    return trees
