"""Streaming queries, run until the data that is there is consumed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schemas import LOG, POINTERS
from tidelog.session import work_path
from tidelog.sources.log_table import write_log
from tidelog.sources.publications import publish_batch, published_log
from tidelog.streaming import frontier, receive, throughput
from tidelog.workload import Registry
from tidelog.workload.tables import EVENTS_LOG, ORDER_ACKS, SHARDS, big, events_log, frontier_sql, order_acks, table, text_bytes

R = Registry()


def stream_of(spark, sf, name):
    """A given table as a file stream; a glob fits a single file as well as a folder."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@R.add("t1_read_log_stream", f"WITH {EVENTS_LOG} SELECT id, hex(data) AS data, shard FROM log")
def t1(spark, sf):
    path, out, checkpoint = (work_path(spark, n) for n in ("log", "received", "checkpoint"))
    write_log(events_log(spark, sf).select("id", "data", "shard"), path)
    pointers = spark.createDataFrame([], POINTERS)
    stream = receive.read_log_stream(spark, path, "events", "reader", pointers, max_files=2)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(receive.batch_path(out, batch_id))

    receive.run(stream, keep, checkpoint, once=True).awaitTermination()
    return spark.read.schema(LOG).parquet(out).select("id", F.hex("data").alias("data"), big("shard").alias("shard"))


def _acks(spark, sf):
    """The acks of ``lineitem`` as a stream of two batches."""
    spark.conf.set(*frontier.STATE_STORE)
    path = work_path(spark, "acks")
    acks = order_acks(table(spark, sf, "lineitem"))
    acks.repartition(2).write.parquet(path)
    return spark.readStream.schema(acks.schema).option("maxFilesPerTrigger", 1).parquet(path)


@R.add(
    "t2_stream_ack_frontier",
    f"""WITH {ORDER_ACKS}, places AS (SELECT DISTINCT queue, consumer, (id - 1) // {frontier.BLOCK_IDS} AS block, (id - 1) % {frontier.BLOCK_IDS} + 1 AS place FROM acks),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY queue, consumer, block ORDER BY place) AS rn FROM places)
SELECT queue, consumer, block, coalesce(max(place) FILTER (WHERE place = rn), 0) AS prefix, count(*) AS acked FROM numbered GROUP BY 1, 2, 3""",
)
def t2(spark, sf):
    out, checkpoint = work_path(spark, "progress"), work_path(spark, "checkpoint")

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(receive.batch_path(out, batch_id))

    progress = frontier.stream_ack_frontier(_acks(spark, sf))
    receive.run(progress, keep, checkpoint, mode="update", once=True).awaitTermination()
    schema = T.StructType([*frontier.PROGRESS.fields, T.StructField("batch_id", T.LongType())])
    stored = spark.read.schema(schema).parquet(out)
    return stored.groupBy("queue", "consumer", "block").agg(F.max("prefix").alias("prefix"), F.max("acked").alias("acked"))


@R.add(
    "t3_commit_pointers",
    f"WITH {ORDER_ACKS}, f AS ({frontier_sql('acks', 'queue, consumer')}) SELECT queue, consumer, frontier AS ptr FROM f",
)
def t3(spark, sf):
    path, sunk, checkpoint = (work_path(spark, n) for n in ("pointers", "sunk", "checkpoint"))

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(receive.batch_path(sunk, batch_id))

    query = frontier.commit_pointers(
        frontier.stream_ack_frontier(_acks(spark, sf)), path, checkpoint, sink, once=True
    )
    query.awaitTermination()
    return frontier.committed_pointers(spark, path, query)


@R.add(
    "t4_publish_stream",
    """SELECT row_number() OVER (ORDER BY ts, event_id) AS id, hex(props) AS data,
  row_number() OVER (ORDER BY ts, event_id) % 4 AS shard FROM events""",
)
def t4(spark, sf):
    """The earlier half by one publisher, the later by another; then the first one repeats
    its batch, as after a failure, and nothing changes."""
    path, record = work_path(spark, "published"), work_path(spark, "records")
    order_by = ["ts", "event_id"]
    events = table(spark, sf, "events")
    ends = events.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    middle = ends["low"] + (ends["high"] - ends["low"]) / 2
    late = F.col("ts") > F.lit(str(middle)).cast(events.schema["ts"].dataType)
    packed = ["ts", "event_id", text_bytes("props").alias("data")]
    first = work_path(spark, "checkpoint")
    for part, checkpoint in ((~late, first), (late, work_path(spark, "checkpoint"))):
        packets = stream_of(spark, sf, "events").where(part).select(*packed)
        receive.publish_stream(packets, path, record, "events", order_by, checkpoint, SHARDS, once=True).awaitTermination()
    owner = receive.checkpoint_owner(spark, first)
    again = events.where(~late).select(*packed)
    publish_batch(again, path, record, "events", owner, 0, order_by, SHARDS)
    stored = published_log(spark, path, record, "events")
    return stored.select("id", F.hex("data").alias("data"), big("shard").alias("shard"))


@R.add(
    "t5_stream_throughput",
    f"""WITH {EVENTS_LOG} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS packets,
  CAST(sum(strlen(data)) AS BIGINT) AS bytes, count(*) / count(DISTINCT batch) AS mean_batch FROM log GROUP BY 1""",
)
def t5(spark, sf):
    out, checkpoint = work_path(spark, "rates"), work_path(spark, "checkpoint")
    stream = stream_of(spark, sf, "events").select("ts", text_bytes("props").alias("data"), F.expr("event_id div 100").alias("batch"))
    throughput.save_throughput(stream, out, checkpoint, "ts", "1 hour", once=True).awaitTermination()
    rates = throughput.load_throughput(spark.read.schema(throughput.RATES).parquet(out))
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
