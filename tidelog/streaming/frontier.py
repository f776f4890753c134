"""Ack frontiers of a stream.

State is kept per block of ids, not per consumer, so the acks of one busy consumer are
spread over tasks and a state entry never exceeds one small bitmap. Block progress is
merged into pointers batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.numbering import floor_div
from tidelog.operators.runs import ack_frontier
from tidelog.session import cut
from tidelog.sources import deltas
from tidelog.streaming import block_state
from tidelog.streaming.block_state import BLOCK_IDS, BlockAcks
from tidelog.streaming.receive import run

PROGRESS = T.StructType(
    [
        T.StructField("queue", T.StringType()),
        T.StructField("consumer", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("block", T.LongType()),
        T.StructField("prefix", T.LongType()),
        T.StructField("acked", T.LongType()),
    ]
)
BLOCK = ["queue", "consumer", "block"]
#: What a session needs for the state of blocks; set it when the session is started.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)


def stream_ack_frontier(acks: DataFrame, pointers: DataFrame | None = None) -> DataFrame:
    """Progress per ``queue, consumer, block``: ``prefix`` ids of the block are acked
    without a hole, ``acked`` in all. Ids up to the consumer's pointer ``start`` count as
    acked; acks at or below it are late and dropped, repeated ones change nothing, early
    ones wait in the state. Blocks do not depend on the pointers, so a restart with newer
    ones finds the acks that wait; an older one takes nothing back. A block that is full has
    no state any more: repeats of its ids begin it anew, and readers keep the larger prefix."""
    if acks.sparkSession.conf.get(STATE_STORE[0], "") != STATE_STORE[1]:
        raise ValueError(f"start the session with {'='.join(STATE_STORE)}")
    # the state driver does not see shipped packages: the processor travels by value
    cloudpickle.register_pickle_by_value(block_state)
    based = acks.select("queue", "consumer", F.col("id").cast("long").alias("id"))
    if pointers is None:
        based = based.withColumn("start", F.lit(0).cast("long"))
    else:
        starts = pointers.select("queue", "consumer", F.col("ptr").alias("start"))
        based = based.join(starts, ["queue", "consumer"], "left")
        based = based.withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    offset = F.col("id") - 1
    placed = based.where(F.col("id") > F.col("start")).select(
        "queue",
        "consumer",
        "start",
        floor_div(offset, BLOCK_IDS).alias("block"),
        F.pmod(offset, F.lit(BLOCK_IDS)).cast("int").alias("place"),
    )
    return placed.groupBy(*BLOCK).transformWithStateInPandas(BlockAcks(), PROGRESS, "update", "none")


def merge_progress(open_blocks: DataFrame, updates: DataFrame, pointers: DataFrame) -> DataFrame:
    """``queue, consumer, ptr``: frontiers after the updates. Blocks only grow, so the
    larger prefix is the newer one; a run of full blocks moves the pointer on, and it is
    never below the pointer before or the one the stream started from."""
    names = ["queue", "consumer"]
    blocks = open_blocks.unionByName(updates.select(OPEN.names))
    blocks = blocks.groupBy(*BLOCK).agg(F.max("prefix").alias("prefix"), F.max("start").alias("start"))
    starts = blocks.select(*names, F.col("start").alias("ptr")).unionByName(pointers.select(*names, "ptr"))
    base = starts.groupBy(*names).agg(F.max("ptr").alias("_base"))
    known = blocks.join(base, names).withColumn("_passed", floor_div(F.col("_base"), BLOCK_IDS))
    # a block that is not full shows up as a stale ack, so its consumer stays in the result
    number = F.when(F.col("prefix") == BLOCK_IDS, F.col("block") + 1).otherwise(F.lit(0))
    lead = ack_frontier(known.withColumn("_number", number), names, "_passed", "_number")
    reached = blocks.select(*names, F.col("block").alias("frontier"), "prefix")
    ptr = F.greatest(F.col("frontier") * BLOCK_IDS + F.coalesce("prefix", F.lit(0)), "_base")
    lead = lead.join(reached, [*names, "frontier"], "left").join(base, names)
    return lead.select(*names, ptr.alias("ptr"))


OPEN = T.StructType([f for f in PROGRESS.fields if f.name != "acked"])
FRONTIERS = T.StructType([*PROGRESS.fields[:2], T.StructField("ptr", T.LongType())])


def commit_pointers(
    progress: DataFrame,
    path: str,
    checkpoint: str,
    sink: Callable[[DataFrame, int], None] | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Move the stored pointers along with a progress stream. Per batch the sink runs first,
    then the changes of the batch are stored as version ``batch_id``: pointers that moved, and
    blocks that grew, began or were passed. Consumers without an ack in the batch are neither
    computed nor written. A replay repeats all of it, so delivery is at least once and the
    sink must be keyed by batch."""
    spark = progress.sparkSession
    names = ["queue", "consumer"]

    def commit(batch: DataFrame, batch_id: int) -> None:
        updates = cut(batch)
        if sink is not None:
            sink(updates, batch_id)
        grown = updates.select(OPEN.names)
        touched = updates.select(*names).distinct()
        before = deltas.load(spark, f"{path}/frontiers", names, FRONTIERS, batch_id - 1).join(touched, names, "left_semi")
        was_open = deltas.load(spark, f"{path}/blocks", BLOCK, OPEN, batch_id - 1).join(touched, names, "left_semi")
        merged = merge_progress(was_open, updates, before)
        moved = merged.join(before.select(*names, F.col("ptr").alias("_before")), names, "left")
        moved = cut(moved.withColumn("ptr", F.greatest("ptr", F.coalesce("_before", "ptr"))))
        news = moved.where(F.col("_before").isNull() | (F.col("_before") != F.col("ptr")))
        deltas.save(news.select(FRONTIERS.names), f"{path}/frontiers", names, batch_id)
        blocks = (
            was_open.withColumn("_grown", F.lit(False))
            .unionByName(grown.withColumn("_grown", F.lit(True)))
            .groupBy(*BLOCK)
            .agg(F.max("prefix").alias("prefix"), F.max("start").alias("start"), F.max("_grown").alias("_grown"))
            .join(moved.select(*names, floor_div(F.col("ptr"), BLOCK_IDS).alias("_passed")), names)
            .withColumn(deltas.GONE, F.col("block") < F.col("_passed"))
        )
        changed = blocks.where(F.col("_grown") | F.col(deltas.GONE)).select(*OPEN.names, deltas.GONE)
        deltas.save(changed, f"{path}/blocks", BLOCK, batch_id)

    return run(progress, commit, checkpoint, mode="update", once=once)


def committed_pointers(spark: SparkSession, path: str, query: StreamingQuery | None = None) -> DataFrame:
    """The pointers as a run of :func:`commit_pointers` left them, or as they are now."""
    upto = query.lastProgress["batchId"] if query is not None and query.lastProgress else None
    return deltas.load(spark, f"{path}/frontiers", ["queue", "consumer"], FRONTIERS, upto)
