"""Rows dealt into blocks of bounded size, packed and compressed on their way, so that large
texts can meet what belongs to them without a sort of the texts."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text of one block, about, in bytes, and the least number of blocks.
BLOCK_BYTES = 32 << 20
LEAST_BLOCKS = 24


def block_count(docs: DataFrame, text_col: str, least: int = LEAST_BLOCKS) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")).alias("b")).first()["b"] or 0
    return max(least, -(-size // BLOCK_BYTES))


def to_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    """``block, load``: the other columns of ``rows``, many rows in each load, dealt by their
    column ``block``."""
    names = [c for c in rows.columns if c != "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(block, kind="stable")
            edges = np.concatenate([[True], block[order][1:] != block[order][:-1], [True]])
            cuts = np.flatnonzero(edges) if len(block) else np.zeros(1, int)
            own, loads = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.select(names).take(pa.array(order[a:b]))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                own.append(int(block[order[a]]))
                loads.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(loads, pa.binary())], ["block", "load"])

    return rows.select("block", *names).mapInArrow(run, "block int, load binary").repartition(blocks, "block")


def unpacked(loads: pa.ChunkedArray) -> Iterator[pa.RecordBatch]:
    """The rows of each load."""
    for chunk in loads.chunks:
        for load in chunk:
            with pa.ipc.open_stream(load.as_buffer()) as stream:
                yield from stream


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are no longer held. It does so when
    the driver's JVM collects them, which a driver with little to do puts off."""
    gc.collect()
    spark._jvm.System.gc()
