"""The given tables in the roles of logs, acks and pointers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 4
WRITE_SIZE = 100


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("long")


def text_bytes(column: str) -> Column:
    return F.encode(F.col(column), "UTF-8")


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    """``events`` as a log: dense ids from 1, one queue per event type."""
    return table(spark, sf, "events").select(
        (F.col("event_id") + 1).alias("id"),
        text_bytes("props").alias("data"),
        F.pmod(F.col("event_id") + 1, F.lit(SHARDS)).cast("int").alias("shard"),
        F.col("event_type").alias("queue"),
        F.expr(f"event_id div {WRITE_SIZE}").alias("batch"),
        "ts",
        F.floor(F.col("value") * 100000.0).cast("long").alias("micros"),
    )


EVENTS_LOG = """
log AS (
  SELECT event_id + 1 AS id, props AS data, CAST((event_id + 1) % 4 AS BIGINT) AS shard,
         event_type AS queue, event_id // 100 AS batch, ts,
         CAST(floor(value * 100000.0) AS BIGINT) AS micros
  FROM events
)"""


def line_acks(spark: SparkSession, sf: str) -> DataFrame:
    """``lineitem`` as acks of line numbers: one short queue per order."""
    return table(spark, sf, "lineitem").select(
        big("l_orderkey").alias("queue"), big("l_linenumber").alias("id")
    )


def order_queue(key: str) -> list[Column]:
    """Queue and id of an order: even and odd keys are two queues, dense from 1."""
    return [F.expr(f"concat('orders-', {key} % 2)").alias("queue"), F.expr(f"{key} div 2 + 1").alias("id")]


def order_acks(lines: DataFrame) -> DataFrame:
    """``lineitem`` as acks of orders: few, long and hot queues."""
    return lines.select(*order_queue("l_orderkey"), F.col("l_linestatus").alias("consumer"))


def order_log(spark: SparkSession, sf: str) -> DataFrame:
    """``orders`` as a log of two queues."""
    return table(spark, sf, "orders").select(
        *order_queue("o_orderkey"), text_bytes("o_orderpriority").alias("data")
    )


ORDER_ACKS = """
acks AS (SELECT 'orders-' || (l_orderkey % 2) AS queue, l_linestatus AS consumer, l_orderkey // 2 + 1 AS id FROM lineitem)"""
ORDER_LOG = """
log AS (SELECT 'orders-' || (o_orderkey % 2) AS queue, o_orderkey // 2 + 1 AS id, o_orderpriority AS data FROM orders)"""


def frontier_sql(acks: str, keys: str) -> str:
    """SQL of the frontier per key from start 0."""
    return f"""
  SELECT {keys}, coalesce(max(id) FILTER (WHERE id = rn), 0) AS frontier FROM (
    SELECT {keys}, id, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS rn
    FROM (SELECT DISTINCT {keys}, id FROM {acks} WHERE id > 0)) GROUP BY {keys}"""


def islands_sql(acks: str, keys: str) -> str:
    """SQL of the contiguous runs per key."""
    return f"""
  SELECT {keys}, min(id) AS first_id, max(id) AS last_id, count(*) AS ids FROM (
    SELECT {keys}, id, id - row_number() OVER (PARTITION BY {keys} ORDER BY id) AS run
    FROM (SELECT DISTINCT {keys}, id FROM {acks})) GROUP BY {keys}, run"""
