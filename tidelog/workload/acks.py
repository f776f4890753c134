"""Queries on acks and pointers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import delivery, runs
from tidelog.schemas import READ_WINDOW, WRITER
from tidelog.workload import Registry
from tidelog.workload.tables import (
    EVENTS_LOG,
    ORDER_ACKS,
    ORDER_LOG,
    events_log,
    frontier_sql,
    islands_sql,
    line_acks,
    order_acks,
    order_log,
    table,
)

R = Registry()

LINES = "lines AS (SELECT l_orderkey AS queue, CAST(l_linenumber AS BIGINT) AS id FROM lineitem)"


@R.add("a1_ack_frontier", f"WITH {LINES} {frontier_sql('lines', 'queue')}")
def a1(spark, sf):
    return runs.ack_frontier(line_acks(spark, sf), ["queue"])


@R.add("a1_ack_frontier_hot", f"WITH {ORDER_ACKS} {frontier_sql('acks', 'queue, consumer')}")
def a1_hot(spark, sf):
    return runs.ack_frontier(order_acks(table(spark, sf, "lineitem")), ["queue", "consumer"])


@R.add(
    "a2_ack_frontier_bucketed",
    "WITH ids AS (SELECT DISTINCT event_id + 1 AS id FROM events) "
    "SELECT coalesce(max(id) FILTER (WHERE id = rn), 0) AS frontier FROM (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM ids)",
)
def a2(spark, sf):
    return runs.ack_frontier_bucketed(events_log(spark, sf).select("id"), bucket=1024)


@R.add(
    "a3_pending_acks",
    f"""WITH {LINES}, f AS ({frontier_sql('lines', 'queue')}), d AS (SELECT DISTINCT queue, id FROM lines)
SELECT f.queue, f.frontier, count(id) FILTER (WHERE id > frontier) AS pending,
  min(id) FILTER (WHERE id > frontier) AS min_pending, max(id) FILTER (WHERE id > frontier) AS max_pending
FROM f JOIN d ON d.queue = f.queue GROUP BY f.queue, f.frontier""",
)
def a3(spark, sf):
    return runs.pending_acks(line_acks(spark, sf), ["queue"])


@R.add(
    "a4_log_gaps",
    f"""WITH {ORDER_ACKS} SELECT queue, consumer, before + 1 AS from_id, id - 1 AS to_id, id - before - 1 AS missing FROM (
  SELECT queue, consumer, id, lag(id, 1, 0) OVER (PARTITION BY queue, consumer ORDER BY id) AS before
  FROM (SELECT DISTINCT * FROM acks)) WHERE id - before > 1""",
)
def a4(spark, sf):
    return runs.log_gaps(order_acks(table(spark, sf, "lineitem")), ["queue", "consumer"], block=4096)


@R.add("w2_islands", f"WITH {ORDER_ACKS} {islands_sql('acks', 'queue, consumer')}")
def w2(spark, sf):
    return runs.islands(order_acks(table(spark, sf, "lineitem")), ["queue", "consumer"], block=4096)


def event_pointers(spark, sf):
    """A writer per event type, and one reader per event type and region."""
    last = events_log(spark, sf).groupBy("queue").agg(F.max("id").alias("last"))
    writers = last.select("queue", F.lit(WRITER).alias("consumer"), (F.col("last") - 10).alias("ptr"))
    regions = table(spark, sf, "region").agg(F.collect_list(F.struct("r_name", "r_regionkey")).alias("regions"))
    names = regions.first()["regions"]
    options = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("key")) for n, k in names])
    readers = last.select("queue", "last", F.explode(options).alias("r")).select(
        "queue", F.col("r.name").alias("consumer"), F.expr("last * r.key div 4").alias("ptr")
    )
    return writers.unionByName(readers)


EVENT_POINTERS = """
last AS (SELECT queue, max(id) AS last FROM log GROUP BY queue),
readers AS (SELECT queue, r_name AS consumer, (last * r_regionkey) // 4 AS reader, last - 10 AS writer FROM last, region)"""


@R.add(
    "j1_undelivered",
    f"WITH {EVENTS_LOG}, {EVENT_POINTERS} SELECT log.queue, consumer, id, hex(data) AS data "
    "FROM log JOIN readers ON log.queue = readers.queue AND id > reader AND id <= writer",
)
def j1(spark, sf):
    log = events_log(spark, sf).select("queue", "id", "data")
    return delivery.undelivered(log, event_pointers(spark, sf)).select("queue", "consumer", "id", F.hex("data").alias("data"))


@R.add(
    "a5_consumer_lag",
    f"WITH {EVENTS_LOG}, {EVENT_POINTERS} SELECT queue, consumer, reader, writer, writer - reader AS lag, writer <= reader AS idle FROM readers",
)
def a5(spark, sf):
    return delivery.consumer_lag(event_pointers(spark, sf))


@R.add(
    "o2_next_windows",
    f"WITH {EVENTS_LOG}, {EVENT_POINTERS} SELECT queue, consumer, reader AS after, "
    f"greatest(reader, least(writer, reader + {READ_WINDOW})) AS upto FROM readers",
)
def o2(spark, sf):
    return delivery.next_windows(event_pointers(spark, sf), READ_WINDOW)


@R.add(
    "p2_drop_stale_acks",
    """WITH acks AS (SELECT l_returnflag AS queue, l_linestatus AS consumer, l_orderkey + 1 AS id FROM lineitem),
ptrs AS (SELECT queue, consumer, max(id) // 2 AS ptr FROM acks WHERE queue <> 'N' GROUP BY queue, consumer)
SELECT acks.queue, acks.consumer, id FROM acks LEFT JOIN ptrs ON acks.queue = ptrs.queue AND acks.consumer = ptrs.consumer
WHERE id > coalesce(ptr, 0)""",
)
def p2(spark, sf):
    acks = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("queue"), F.col("l_linestatus").alias("consumer"), (F.col("l_orderkey") + 1).alias("id")
    )
    half = F.expr("max(id) div 2").alias("ptr")
    pointers = acks.where(F.col("queue") != "N").groupBy("queue", "consumer").agg(half)
    return delivery.drop_stale_acks(acks, pointers)


@R.add(
    "j2_in_flight",
    f"""WITH {ORDER_ACKS}, f AS ({frontier_sql('acks', 'queue, consumer')}),
reads AS (SELECT queue, consumer, max(id) AS last_read FROM acks GROUP BY queue, consumer), {ORDER_LOG}
SELECT log.queue, r.consumer, log.id, hex(data) AS data
FROM log JOIN reads r ON r.queue = log.queue JOIN f ON f.queue = r.queue AND f.consumer = r.consumer
WHERE log.id > frontier AND log.id <= last_read
  AND NOT EXISTS (SELECT 1 FROM acks a WHERE a.queue = r.queue AND a.consumer = r.consumer AND a.id = log.id)""",
)
def j2(spark, sf):
    acks = order_acks(table(spark, sf, "lineitem"))
    pointers = runs.ack_frontier(acks, ["queue", "consumer"]).withColumnRenamed("frontier", "ptr")
    last_read = acks.groupBy("queue", "consumer").agg(F.max("id").alias("last_read"))
    log = order_log(spark, sf).select("queue", "id", "data")
    return delivery.in_flight(log, acks, pointers, last_read).select("queue", "consumer", "id", F.hex("data").alias("data"))


@R.add(
    "j3_confirmations",
    f"""WITH {ORDER_ACKS}, {ORDER_LOG}, f AS ({frontier_sql('acks', 'queue')})
SELECT log.queue, id, id <= coalesce(frontier, 0) AS confirmed FROM log LEFT JOIN f ON f.queue = log.queue""",
)
def j3(spark, sf):
    sent = order_log(spark, sf).select("queue", "id")
    return delivery.confirmations(sent, order_acks(table(spark, sf, "lineitem")).select("queue", "id"))


@R.add(
    "j5_pending_requests",
    """WITH c AS (SELECT conv_id, turn, role FROM conversations)
SELECT conv_id AS group_uuid, turn AS uuid FROM c q WHERE role = 'user'
  AND conv_id IN (SELECT doc_id FROM labels WHERE quality = 1)
  AND NOT EXISTS (SELECT 1 FROM c a WHERE a.role = 'assistant' AND a.conv_id = q.conv_id AND a.turn = q.turn + 1)
""",
)
def j5(spark, sf):
    turns = table(spark, sf, "conversations")
    requests = turns.where(F.col("role") == "user").select(F.col("conv_id").alias("group_uuid"), F.col("turn").alias("uuid"))
    replies = turns.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("group_uuid"), (F.col("turn") - 1).alias("uuid")
    )
    groups = table(spark, sf, "labels").where(F.col("quality") == 1).select(F.col("doc_id").alias("group_uuid"))
    return delivery.pending_requests(requests, replies, groups).select("group_uuid", "uuid")
