"""Volume, batch and integrity reports on a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.numbering import assign_batches, shard_of
from tidelog.operators.runs import word_masks
from tidelog.schemas import READ_WINDOW


def log_catalog(log: DataFrame) -> DataFrame:
    """``queue, shard, packets, bytes, min_id, max_id, share``: contents and skew."""
    parts = log.groupBy("queue", "shard").agg(
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.octet_length("data").cast("long")).alias("bytes"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )
    # one row per shard: the window sees no data rows
    total = F.sum("packets").over(Window.partitionBy("queue"))
    return parts.withColumn("share", F.col("packets").cast("double") / total.cast("double"))


def throughput(log: DataFrame, ts: str = "ts", every: str = "1 second") -> DataFrame:
    """``window_start, packets, bytes, mean_batch`` per tumbling window; counted per
    batch first, so a distinct count is only a count of groups."""
    return (
        log.groupBy(F.window(ts, every).alias("w"), "batch")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data").cast("long")).alias("b"))
        .groupBy(F.col("w.start").alias("window_start"))
        .agg(
            F.sum("n").alias("packets"),
            F.sum("b").alias("bytes"),
            (F.sum("n").cast("double") / F.count(F.lit(1)).cast("double")).alias("mean_batch"),
        )
    )


def batch_audit(log: DataFrame, slow_micros: int = 1_000_000) -> DataFrame:
    """``batch, shard, entries, bytes, mean_size, took_micros, slow`` per write. The
    log carries ``micros``, how long the write that stored the row took."""
    return (
        log.groupBy("batch", "shard")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.sum(F.octet_length("data").cast("long")).alias("bytes"),
            F.max("micros").alias("took_micros"),
        )
        .withColumn("mean_size", F.col("bytes").cast("double") / F.col("entries").cast("double"))
        .withColumn("slow", F.col("took_micros") > slow_micros)
    )


def cross_shard_batches(log: DataFrame) -> DataFrame:
    """``batch, shards``: batches that touch more than one shard."""
    return (
        log.groupBy("batch", "shard")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("batch")
        .agg(F.count(F.lit(1)).alias("shards"))
        .where(F.col("shards") > 1)
    )


def read_batch_bounds(log: DataFrame, after: int = 0, limit: int = READ_WINDOW) -> DataFrame:
    """``batch, packets, min_id, max_id`` of every read window after ``after``."""
    return (
        assign_batches(log.where(F.col("id") > after), limit, after)
        .groupBy("batch")
        .agg(
            F.count(F.lit(1)).alias("packets"),
            F.min("id").alias("min_id"),
            F.max("id").alias("max_id"),
        )
    )


def payload_duplicates(df: DataFrame, data: str = "data", ident: str = "id") -> DataFrame:
    """``digest, copies, first_id`` of payloads that occur more than once; only the
    64-byte digest of a payload is shuffled."""
    return (
        df.groupBy(F.sha2(data, 512).alias("digest"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min(ident).alias("first_id"))
        .where(F.col("copies") > 1)
    )


def log_integrity(log: DataFrame, shards: int) -> DataFrame:
    """``queue, packets, misplaced, duplicate_ids, missing``: rows outside the shard of
    their id, rows that repeat an id, and ids absent between the lowest and highest."""
    misplaced = F.col("shard") != shard_of("id", shards)
    per_queue = log.groupBy("queue").agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if(misplaced).alias("misplaced"),
        (F.max("id") - F.min("id") + 1).alias("_span"),
    )
    distinct = word_masks(log, ["queue"]).groupBy("queue").agg(F.sum(F.bit_count("mask").cast("long")).alias("_ids"))
    return per_queue.join(distinct, "queue").select(
        "queue",
        "packets",
        "misplaced",
        (F.col("packets") - F.col("_ids")).alias("duplicate_ids"),
        (F.col("_span") - F.col("_ids")).alias("missing"),
    )
