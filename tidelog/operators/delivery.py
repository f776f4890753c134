"""What each consumer was given, acked and still waits for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.numbering import shard_of
from tidelog.operators.runs import ack_frontier
from tidelog.plans.joins import attach, kept
from tidelog.schemas import WRITER


def where_ids(log: DataFrame, ids: DataFrame, shards: int) -> DataFrame:
    """Point lookups. Only the shards that hold wanted ids are scanned: their numbers
    (at most ``shards`` of them) become a literal partition filter."""
    wanted = ids.select(F.col("id").cast("long").alias("id")).distinct()
    wanted = wanted.withColumn("shard", shard_of("id", shards))
    hit = [r["shard"] for r in wanted.select("shard").distinct().collect()]
    return log.where(F.col("shard").isin(hit)).join(wanted, ["shard", "id"], "left_semi")


def drop_stale_acks(acks: DataFrame, pointers: DataFrame) -> DataFrame:
    """Acks above the consumer's pointer; a consumer without a row is at 0."""
    known, size = kept(pointers.select("queue", "consumer", "ptr"))
    live = attach(acks, known, ["queue", "consumer"], "left", spread=["id"], size=size)
    return live.where(F.col("id") > F.coalesce("ptr", F.lit(0))).drop("ptr")


def pointer_pairs(pointers: DataFrame) -> DataFrame:
    """``queue, consumer, reader, writer``: each reader next to its queue's writer; a
    queue without a writer row was never written."""
    written = F.col("consumer") == WRITER
    known, size = kept(pointers.select("queue", "consumer", "ptr"), of=written)
    writers = known.where(written).select("queue", F.col("ptr").alias("_w"))
    readers = known.where(F.col("consumer") != WRITER)
    return attach(readers, writers, ["queue"], "left", spread=["consumer"], size=size).select(
        "queue",
        "consumer",
        F.col("ptr").alias("reader"),
        F.coalesce("_w", F.lit(0)).cast("long").alias("writer"),
    )


def consumer_lag(pointers: DataFrame) -> DataFrame:
    """``queue, consumer, reader, writer, lag, idle``."""
    return pointer_pairs(pointers).select(
        "*",
        (F.col("writer") - F.col("reader")).alias("lag"),
        (F.col("writer") <= F.col("reader")).alias("idle"),
    )


def next_windows(pointers: DataFrame, limit: int) -> DataFrame:
    """``queue, consumer, after, upto``: the ids ``(after, upto]`` each consumer reads
    next; equal bounds mean there is nothing to read."""
    upto = F.greatest("reader", F.least("writer", F.col("reader") + limit))
    return pointer_pairs(pointers).select(
        "queue", "consumer", F.col("reader").alias("after"), upto.alias("upto")
    )


def undelivered(log: DataFrame, pointers: DataFrame) -> DataFrame:
    """Per consumer, the rows after its pointer up to the writer pointer."""
    pairs, size = kept(pointer_pairs(pointers).where(F.col("writer") > F.col("reader")))
    joined = attach(log, pairs, ["queue"], spread=["id"], size=size)
    return joined.where((F.col("id") > F.col("reader")) & (F.col("id") <= F.col("writer"))).drop(
        "reader", "writer"
    )


def in_flight(
    log: DataFrame, acks: DataFrame, pointers: DataFrame, last_read: DataFrame
) -> DataFrame:
    """Delivered rows without an ack: ids in ``(ptr, last_read]`` per consumer.

    ``last_read`` is ``queue, consumer, last_read``. Acks are made distinct first, so
    repeats of one id never pile up, and that shuffle also serves the anti join.
    """
    window = last_read.join(pointers.select("queue", "consumer", "ptr"), ["queue", "consumer"], "left")
    window, size = kept(window.withColumn("ptr", F.coalesce("ptr", F.lit(0).cast("long"))))
    given = attach(log, window, ["queue"], spread=["id"], size=size).where(
        (F.col("id") > F.col("ptr")) & (F.col("id") <= F.col("last_read"))
    )
    acked = acks.select("queue", "consumer", "id").distinct()
    return given.join(acked, ["queue", "consumer", "id"], "left_anti").drop("ptr", "last_read")


def confirmations(sent: DataFrame, acked: DataFrame) -> DataFrame:
    """Every sent row with ``confirmed``: true once the contiguous prefix of stored
    ids of its queue covers it."""
    frontier, size = kept(ack_frontier(acked, ["queue"]))
    joined = attach(sent, frontier, ["queue"], "left", spread=["id"], size=size)
    covered = F.col("id") <= F.coalesce("frontier", F.lit(0))
    return joined.withColumn("confirmed", covered).drop("frontier")


def pending_requests(
    requests: DataFrame, replies: DataFrame, groups: DataFrame, limit: int | None = None
) -> DataFrame:
    """The unanswered requests of the listed groups, all of them or the first ``limit`` by
    ``group_uuid, uuid``; replies carry both ids."""
    listed, size = kept(groups.select("group_uuid").distinct())
    answered = replies.select("uuid", "group_uuid").distinct()
    waiting = attach(requests, listed, ["group_uuid"], "left_semi", spread=["uuid"], size=size)
    open_ = waiting.join(answered, ["uuid", "group_uuid"], "left_anti")
    return open_ if limit is None else open_.orderBy("group_uuid", "uuid").limit(limit)
