"""Queries on log tables: scans, writes, numbering, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import audit, numbering
from tidelog.session import work_path
from tidelog.sources import log_table, pointers, publish
from tidelog.sources.block_log import BlockLog, read_blocks, upsert_blocks, where_ids_in
from tidelog.sources.publications import publish_batch, published_log
from tidelog.workload import Registry
from tidelog.workload.tables import EVENTS_LOG, SHARDS, big, events_log, table, text_bytes

R = Registry()

#: Blocks of the registered logs, so small that the given tables have several.
BLOCK_IDS = 1 << 15


@R.add("s1_log_scan", f"WITH {EVENTS_LOG} SELECT id, hex(data) AS data, shard FROM log")
def s1(spark, sf):
    path = work_path(spark, "scan")
    log_table.write_log(events_log(spark, sf).select("id", "data", "shard"), path)
    return log_table.log_scan(spark, path).select("id", F.hex("data").alias("data"), big("shard").alias("shard"))


@R.add(
    "s2_log_read_range",
    f"WITH {EVENTS_LOG} SELECT id, hex(data) AS data FROM log WHERE id > 0",
)
def s2(spark, sf):
    log = BlockLog(work_path(spark, "blocks"), SHARDS, BLOCK_IDS)
    upsert_blocks(events_log(spark, sf).select("id", "data", F.lit(0).alias("seq")), log)
    upto = log.zones(spark).agg(F.max("max_id")).first()[0]
    return read_blocks(spark, log, 0, upto).select("id", F.hex("data").alias("data"))


@R.add(
    "s3_log_append",
    """SELECT 1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id, hex(o_orderpriority) AS data,
       (1000 + row_number() OVER (ORDER BY o_orderdate, o_orderkey)) % 4 AS shard FROM orders""",
)
def s3(spark, sf):
    packets = table(spark, sf, "orders").select("o_orderdate", "o_orderkey", text_bytes("o_orderpriority").alias("data"))
    path, record = work_path(spark, "append"), work_path(spark, "records")
    # the second call is a retry and stores nothing
    for _ in range(2):
        publish_batch(packets, path, record, "orders", "loader", 0, ["o_orderdate", "o_orderkey"], SHARDS, first_after=1000)
    stored = published_log(spark, path, record, "orders")
    return stored.select("id", F.hex("data").alias("data"), big("shard").alias("shard"))


@R.add(
    "s4_log_upsert",
    """WITH incoming AS (
  SELECT l_orderkey + 1 AS id, l_returnflag || l_linestatus || l_partkey AS data, l_shipdate AS seq FROM lineitem),
latest AS (SELECT id, data FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, data DESC) AS rn
  FROM incoming) WHERE rn = 1)
SELECT coalesce(latest.id, o_orderkey + 1) AS id, hex(coalesce(data, o_orderpriority)) AS data
FROM orders FULL JOIN latest ON latest.id = o_orderkey + 1""",
)
def s4(spark, sf):
    incoming = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("id"),
        F.encode(F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")), "UTF-8").alias("data"),
        F.col("l_shipdate").alias("seq"),
    )
    orders = table(spark, sf, "orders").select((F.col("o_orderkey") + 1).alias("id"), text_bytes("o_orderpriority").alias("data"))
    log = BlockLog(work_path(spark, "blocks"), SHARDS, BLOCK_IDS)
    upsert_blocks(orders.withColumn("seq", F.lit(0)), log)
    upsert_blocks(incoming, log)
    return log.rows(spark).select("id", F.hex("data").alias("data"))


@R.add(
    "s5_pointer_state",
    """SELECT 'orders' AS queue, 'c' || c_custkey AS consumer, coalesce(ptr, 0) AS ptr FROM customer LEFT JOIN (
  SELECT o_custkey, CAST(floor(arg_max(o_totalprice, o_orderkey)) AS BIGINT) AS ptr FROM orders GROUP BY o_custkey)
ON o_custkey = c_custkey""",
)
def s5(spark, sf):
    updates = table(spark, sf, "orders").select(
        F.lit("orders").alias("queue"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("consumer"),
        F.floor("o_totalprice").alias("ptr"),
        F.col("o_orderkey").alias("seq"),
    )
    consumers = table(spark, sf, "customer").select(
        F.lit("orders").alias("queue"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("consumer")
    )
    return pointers.pointer_state(updates, consumers)


@R.add(
    "s6_log_catalog",
    f"""WITH {EVENTS_LOG}, parts AS (SELECT queue, shard, count(*) AS packets, CAST(sum(strlen(data)) AS BIGINT) AS bytes,
  min(id) AS min_id, max(id) AS max_id FROM log GROUP BY queue, shard)
SELECT *, CAST(packets AS DOUBLE) / CAST(sum(packets) OVER (PARTITION BY queue) AS DOUBLE) AS share FROM parts""",
)
def s6(spark, sf):
    return audit.log_catalog(events_log(spark, sf)).withColumn("shard", big("shard"))


@R.add(
    "s7_log_union_hosts",
    """SELECT o_orderkey + 1 AS id, hex(o_orderpriority) AS data, 'host-a' AS host FROM orders
UNION ALL SELECT c_custkey + 1, hex(c_name), 'host-b' FROM customer
UNION ALL SELECT p_partkey + 1, hex(p_name), 'host-c' FROM part""",
)
def s7(spark, sf):
    def log(name, key, data):
        return table(spark, sf, name).select((F.col(key) + 1).alias("id"), text_bytes(data).alias("data"))

    hosts = {
        "host-a": log("orders", "o_orderkey", "o_orderpriority"),
        "host-b": log("customer", "c_custkey", "c_name"),
        "host-c": log("part", "p_partkey", "p_name"),
    }
    return log_table.log_union_hosts(hosts).select("id", F.hex("data").alias("data"), "host")


@R.add(
    "s8_publish_outbox",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderkey AS source_id, hex(o_orderpriority) AS data,
  row_number() OVER (ORDER BY o_orderkey) % 4 AS shard
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def s8(spark, sf):
    outbox = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_id"), text_bytes("o_orderpriority").alias("data"))
    sent = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_id"))
    return publish.publish_outbox(outbox, sent, 0, SHARDS).select(
        "id", "source_id", F.hex("data").alias("data"), big("shard").alias("shard")
    )


@R.add(
    "p1_where_ids",
    "SELECT doc_id + 1 AS id, md5(text) AS digest FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
)
def p1(spark, sf):
    docs = table(spark, sf, "documents").select((F.col("doc_id") + 1).alias("id"), text_bytes("text").alias("data"), F.lit(0).alias("seq"))
    log = BlockLog(work_path(spark, "blocks"), SHARDS, BLOCK_IDS)
    upsert_blocks(docs, log)
    ids = table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("id"))
    return where_ids_in(spark, log, ids).select("id", F.md5("data").alias("digest"))


@R.add(
    "w1_dense_ids",
    """SELECT 500 + row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS id, o_orderkey FROM orders""",
)
def w1(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    order_by = ["o_orderpriority", "o_orderdate", "o_orderkey"]
    return numbering.dense_ids(orders, order_by, 500).select("id", "o_orderkey")


@R.add(
    "w3_assign_batches",
    f"""WITH {EVENTS_LOG} SELECT id, (id - 1) // 1000 AS read_batch, (id - 1) // 4 // 100 AS write_batch FROM log""",
)
def w3(spark, sf):
    reads = numbering.assign_batches(events_log(spark, sf).select("id"), 1000).withColumnRenamed("batch", "read_batch")
    return numbering.assign_batches(reads, 100, shards=SHARDS).withColumnRenamed("batch", "write_batch")


@R.add("o1_ordered_log", f"WITH {EVENTS_LOG} SELECT id, hex(data) AS data, row_number() OVER (ORDER BY id) AS position FROM log")
def o1(spark, sf):
    return numbering.ordered_positions(events_log(spark, sf).select("id", F.hex("data").alias("data")), BLOCK_IDS)


@R.add(
    "a6_throughput",
    f"""WITH {EVENTS_LOG} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS packets,
  CAST(sum(strlen(data)) AS BIGINT) AS bytes, CAST(count(*) AS DOUBLE) / CAST(count(DISTINCT batch) AS DOUBLE) AS mean_batch
FROM log GROUP BY 1""",
)
def a6(spark, sf):
    rates = audit.throughput(events_log(spark, sf), "ts", "1 hour")
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@R.add(
    "a7_batch_audit",
    f"""WITH {EVENTS_LOG} SELECT batch, shard, count(*) AS entries, CAST(sum(strlen(data)) AS BIGINT) AS bytes,
  max(micros) AS took_micros, CAST(sum(strlen(data)) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS mean_size,
  max(micros) > 1000000 AS slow FROM log GROUP BY batch, shard""",
)
def a7(spark, sf):
    return audit.batch_audit(events_log(spark, sf)).withColumn("shard", big("shard"))


@R.add(
    "a8_cross_shard_batches",
    f"WITH {EVENTS_LOG} SELECT batch, count(DISTINCT shard) AS shards FROM log GROUP BY batch HAVING count(DISTINCT shard) > 1",
)
def a8(spark, sf):
    return audit.cross_shard_batches(events_log(spark, sf))


@R.add(
    "a9_read_batch_bounds",
    f"WITH {EVENTS_LOG} SELECT (id - 1) // 700 AS batch, count(*) AS packets, min(id) AS min_id, max(id) AS max_id FROM log GROUP BY 1",
)
def a9(spark, sf):
    return audit.read_batch_bounds(events_log(spark, sf), 0, 700)


@R.add(
    "a15_payload_duplicates",
    "SELECT count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1",
)
def a15(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("data"))
    return audit.payload_duplicates(docs).select("copies", "first_id")


@R.add(
    "a16_log_integrity",
    """WITH log AS (SELECT l_returnflag AS queue, l_orderkey + 1 AS id, l_suppkey % 4 AS shard FROM lineitem)
SELECT queue, count(*) AS packets, count(*) FILTER (WHERE shard <> id % 4) AS misplaced,
  count(*) - count(DISTINCT id) AS duplicate_ids, max(id) - min(id) + 1 - count(DISTINCT id) AS missing
FROM log GROUP BY queue""",
)
def a16(spark, sf):
    log = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("queue"),
        (F.col("l_orderkey") + 1).alias("id"),
        F.pmod("l_suppkey", F.lit(SHARDS)).cast("int").alias("shard"),
    )
    return audit.log_integrity(log, SHARDS)
