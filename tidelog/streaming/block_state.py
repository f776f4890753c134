"""State of one block of ids of one consumer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Ids per state entry; a bitmap of them takes 8 KiB at most.
BLOCK_IDS = 1 << 16


def leading_ones(seen: np.ndarray) -> int:
    """Length of the run of ones at the start of a bit array."""
    holes = np.flatnonzero(seen == 0)
    return int(holes[0]) if len(holes) else len(seen)


class BlockAcks(StatefulProcessor):
    """Remembers which ids of a block were acked; emits how far it is complete. A full
    block is forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "bits binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bits = np.zeros(BLOCK_IDS, np.uint8)
        if self.seen.exists():
            stored = np.unpackbits(np.frombuffer(bytes(self.seen.get()[0]), np.uint8))
            bits[: len(stored)] = stored
        before = int(bits.sum())
        queue, consumer, block = key
        start = 0
        for part in rows:
            bits[part["place"].to_numpy()] = 1
            start = max(start, int(part["start"].max()))
        bits[: max(0, start - block * BLOCK_IDS)] = 1
        acked = int(bits.sum())
        if acked > before:
            if acked == BLOCK_IDS:
                self.seen.clear()
            else:
                used = int(np.flatnonzero(bits)[-1]) + 1
                self.seen.update((np.packbits(bits[:used]).tobytes(),))
            row = {"queue": [queue], "consumer": [consumer], "start": [start], "block": [block]}
            yield pd.DataFrame({**row, "prefix": [leading_ones(bits)], "acked": [acked]})

    def close(self) -> None:
        pass
