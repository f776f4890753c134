"""Continuous throughput per tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.streaming.receive import batch_path, run

#: What one micro-batch adds to a window, per write.
RATES = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("batch", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)


def save_throughput(
    stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", every: str = "1 second", once: bool = False
) -> StreamingQuery:
    """Store what each micro-batch adds to its windows, per write ``batch``. Nothing is kept
    between micro-batches, so no row comes too late; a replay overwrites itself."""

    def save(rows: DataFrame, batch_id: int) -> None:
        added = rows.groupBy(F.window(F.col(ts).cast("timestamp"), every).alias("w"), F.col("batch").cast("long").alias("batch"))
        added = added.agg(
            F.count(F.lit(1)).alias("packets"), F.sum(F.octet_length("data").cast("long")).alias("bytes")
        )
        added = added.select(F.col("w.start").alias("window_start"), "batch", "packets", "bytes")
        added.write.mode("overwrite").parquet(batch_path(path, batch_id))

    return run(stream, save, checkpoint, once=once)


def load_throughput(added: DataFrame) -> DataFrame:
    """``window_start, packets, bytes, mean_batch`` of every window, from what
    :func:`save_throughput` stored. A write that spans micro-batches is one write."""
    writes = added.groupBy("window_start", "batch").agg(F.sum("packets").alias("n"), F.sum("bytes").alias("b"))
    return writes.groupBy("window_start").agg(
        F.sum("n").alias("packets"),
        F.sum("b").alias("bytes"),
        (F.sum("n").cast("double") / F.count(F.lit(1)).cast("double")).alias("mean_batch"),
    )
