"""Continuous receivers and publishers of a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.schemas import LOG
from tidelog.sources.publications import publish_batch

#: Idle interval of a receiver.
POLL = "500 milliseconds"


def read_log_stream(
    spark: SparkSession,
    path: str,
    queue: str,
    consumer: str,
    pointers: DataFrame,
    max_files: int = 64,
    schema: T.StructType = LOG,
) -> DataFrame:
    """The rows of a log after the consumer's stored pointer, as a stream. Consumers are
    independent: each runs with its own checkpoint, which outranks the pointer once it
    exists."""
    stored = pointers.where((F.col("queue") == queue) & (F.col("consumer") == consumer)).first()
    after = stored["ptr"] if stored else 0
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", "false")
        .parquet(path)
    )
    return stream.where(F.col("id") > after)


def run(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    once: bool = False,
) -> StreamingQuery:
    """Start a stream whose batches go to ``handle``; with ``once`` it ends after all
    data that is there now."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)
    return writer.start()


def batch_path(path: str, batch_id: int) -> str:
    """Output folder of one micro-batch; a replay overwrites it."""
    return f"{path}/batch_id={batch_id}"


def publish_stream(
    stream: DataFrame,
    path: str,
    pointer_path: str,
    queue: str,
    order_by: list[str] | str,
    checkpoint: str,
    shards: int = 4,
    keep: tuple[str, ...] = ("data",),
    once: bool = False,
) -> StreamingQuery:
    """Number and store a stream of packets through :func:`publish_batch`, with the checkpoint
    as publisher: a batch that Spark repeats finds its own record under ``pointer_path``,
    whatever other checkpoints have published since. A log has one publisher at a time."""
    spark = stream.sparkSession

    def publish(batch: DataFrame, batch_id: int) -> None:
        owner = checkpoint_owner(spark, checkpoint)
        publish_batch(batch, path, pointer_path, queue, owner, batch_id, order_by, shards, keep)

    return run(stream, publish, checkpoint, once=once)


def checkpoint_owner(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint; a new checkpoint has a new one,
    also in a folder used before."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
