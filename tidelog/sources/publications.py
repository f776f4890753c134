"""Publishing with a record of what each publisher stores.

A publisher first records the range of ids that its batch takes (the intent), then stores the
packets, then records that they are there (the commit). The record of a publisher is found by
its name whatever others have stored since, so a batch that is published again finds its own
range: a committed one is left alone, another one is stored anew under the same ids. New
batches take ids after all recorded ranges. Readers see committed batches only, and
:func:`written_upto` is the last id before the first range that is still open.

Batches of one publisher have growing numbers and are published one after the other; a log
has one publisher at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schemas import LOG
from tidelog.sources import deltas
from tidelog.sources.log_table import number_packets, write_log

#: The newest batch of each publisher and the ids ``after + 1 .. upto`` that it takes.
PUBLICATIONS = T.StructType(
    [
        T.StructField("queue", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("after", T.LongType()),
        T.StructField("upto", T.LongType()),
        T.StructField("committed", T.BooleanType()),
    ]
)
KEYS = ["queue", "owner"]


def publications(spark: SparkSession, record_path: str) -> DataFrame:
    """The newest batch of each publisher."""
    return deltas.load(spark, record_path, KEYS, PUBLICATIONS)


def written_upto(spark: SparkSession, record_path: str, queue: str) -> int:
    """The writer pointer: all ids up to it belong to committed batches."""
    own = publications(spark, record_path).where(F.col("queue") == queue)
    row = own.agg(F.max("upto").alias("last"), F.min(F.when(~F.col("committed"), F.col("after"))).alias("open")).first()
    return row["last"] or 0 if row["open"] is None else row["open"]


def data_path(path: str, owner: str, batch_id: int) -> str:
    """The packets of one batch; storing them again overwrites them."""
    return f"{path}/owner={owner}/batch_id={batch_id}"


def publish_batch(
    packets: DataFrame,
    path: str,
    record_path: str,
    queue: str,
    owner: str,
    batch_id: int,
    order_by: list[str] | str,
    shards: int = 4,
    keep: tuple[str, ...] = ("data",),
    first_after: int = 0,
) -> int:
    """Number and store a batch of packets once; returns the last id of the batch. The first
    batch of a queue starts after ``first_after``."""
    spark = packets.sparkSession
    records = {r["owner"]: r for r in publications(spark, record_path).where(F.col("queue") == queue).collect()}
    own = records.get(owner)
    if own and (own["batch_id"] > batch_id or (own["batch_id"] == batch_id and own["committed"])):
        return own["upto"]

    def record(after: int, upto: int, committed: bool) -> None:
        row = spark.createDataFrame([(queue, owner, batch_id, after, upto, committed)], PUBLICATIONS)
        deltas.save(row, record_path, KEYS, deltas.last_version(spark, record_path) + 1)

    if own and own["batch_id"] == batch_id:
        after, upto = own["after"], own["upto"]
    else:
        if own and not own["committed"]:
            raise ValueError(f"batch {own['batch_id']} of {owner} is not stored yet")
        after = max([r["upto"] for r in records.values()], default=first_after)
        upto = after + packets.count()
        record(after, upto, False)
    numbered = number_packets(packets, order_by, after, shards, list(keep))
    target = data_path(path, owner, batch_id)
    write_log(numbered, target, "overwrite")
    stored = spark.read.schema(T.StructType([LOG["id"]])).parquet(target).count()
    if stored != upto - after:
        raise ValueError(f"batch {batch_id} of {owner} has {stored} packets now, {upto - after} were recorded")
    record(after, upto, True)
    return upto


def published_log(
    spark: SparkSession, path: str, record_path: str, queue: str, schema: T.StructType = LOG
) -> DataFrame:
    """The packets of committed batches. There is one record per publisher, so the join is a
    broadcast of few rows; batches before the recorded one are committed."""
    place = [T.StructField("owner", T.StringType()), T.StructField("batch_id", T.LongType())]
    log = spark.read.schema(T.StructType([*schema.fields, *place])).parquet(path)
    known = publications(spark, record_path).where(F.col("queue") == queue)
    last = F.when(F.col("committed"), F.col("batch_id")).otherwise(F.col("batch_id") - 1).alias("_last")
    visible = log.join(F.broadcast(known.select("owner", last)), "owner")
    return visible.where(F.col("batch_id") <= F.col("_last")).drop("_last")
