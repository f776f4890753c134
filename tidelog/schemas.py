"""Explicit schemas of the tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

#: One packet of a queue. ``shard`` is the partition column, ``id`` is dense from 1.
LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("shard", T.IntegerType()),
    ]
)

#: Pointer rows; the writer of a queue is the row with an empty consumer.
POINTERS = T.StructType(
    [
        T.StructField("queue", T.StringType()),
        T.StructField("consumer", T.StringType()),
        T.StructField("ptr", T.LongType()),
    ]
)

#: Single acknowledgements.
ACKS = T.StructType(
    [
        T.StructField("queue", T.StringType()),
        T.StructField("consumer", T.StringType()),
        T.StructField("id", T.LongType()),
    ]
)

WRITER = ""

#: Fixed values of the read and write paths.
READ_WINDOW = 50_000
WRITE_BATCH = 10_000
