"""The log table: scan, append, upsert, union over hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.numbering import dense_ids, floor_div, shard_of, union_all
from tidelog.schemas import LOG

ROWS_PER_FILE = 4_000_000


def log_scan(
    spark: SparkSession,
    path: str,
    shards: list[int] | None = None,
    schema: T.StructType = LOG,
) -> DataFrame:
    """All rows of a log, or those of some shards; the filter on the partition column
    keeps the other folders unread."""
    log = spark.read.schema(schema).parquet(path)
    return log if shards is None else log.where(F.col("shard").isin(shards))


def number_packets(
    df: DataFrame,
    order_by: list[str] | str,
    last_id: int,
    shards: int,
    keep: list[str] | None = None,
) -> DataFrame:
    """The next ids after ``last_id`` in ``order_by`` order, and the shard of each."""
    numbered = dense_ids(df, order_by, last_id, keep=keep)
    return numbered.withColumn("shard", shard_of("id", shards))


def write_log(numbered: DataFrame, path: str, mode: str = "append") -> None:
    """Write numbered rows by shard. Numbering leaves every task with a range of ids, so
    no further shuffle is needed; files are sorted by id for range reads."""
    (
        numbered.sortWithinPartitions("shard", "id")
        .write.partitionBy("shard")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .mode(mode)
        .parquet(path)
    )


def log_append(
    df: DataFrame,
    path: str,
    order_by: list[str] | str,
    last_id: int = 0,
    shards: int = 4,
    keep: tuple[str, ...] = ("data",),
) -> int:
    """Number, route and store the columns ``keep`` of a batch of packets; returns the
    new writer pointer."""
    numbered = number_packets(df, order_by, last_id, shards, list(keep))
    write_log(numbered, path)
    # ids are dense, and the rows of stored numbering are counted from file footers
    return last_id + numbered.count()


def log_upsert(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """``log`` after storing ``incoming`` (``id, data, seq``): per id the row with the
    highest ``seq`` wins, ties by data. ``id`` is unique in ``log``, so stored rows only
    have to be checked for a replacement; they are not grouped."""
    latest = incoming.groupBy("id").agg(F.max(F.struct("seq", "data"))["data"].alias("data"))
    kept = log.select("id", "data").join(latest.select("id"), "id", "left_anti")
    return kept.unionByName(latest)


def log_upsert_into(spark: SparkSession, path: str, incoming: DataFrame, shards: int) -> None:
    """Store ``incoming`` in the table at ``path``; only touched shards are rewritten."""
    tagged = incoming.withColumn("shard", shard_of("id", shards))
    touched = [r["shard"] for r in tagged.select("shard").distinct().collect()]
    merged = log_upsert(log_scan(spark, path, touched), incoming)
    (
        merged.withColumn("shard", shard_of("id", shards))
        .repartition("shard", floor_div(F.col("id"), ROWS_PER_FILE))
        .sortWithinPartitions("shard", "id")
        .write.partitionBy("shard")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def log_union_hosts(hosts: dict[str, DataFrame]) -> DataFrame:
    """One queue kept on several hosts, with the host of each row."""
    return union_all([df.withColumn("host", F.lit(host)) for host, df in hosts.items()])
