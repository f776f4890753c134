"""Publishing: outbox rows, sourced envelopes and encoded records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.messages import Message
from tidelog.operators.encode import encode_messages, pack_sourced
from tidelog.sources.log_table import number_packets


def publish_outbox(
    outbox: DataFrame, published: DataFrame, last_id: int = 0, shards: int = 4
) -> DataFrame:
    """Rows of a proxy table that are not in the queue yet (by ``source_id``), numbered
    in ``source_id`` order."""
    sent = published.select("source_id").distinct()
    fresh = outbox.join(sent, "source_id", "left_anti")
    return number_packets(fresh, "source_id", last_id, shards)


def publish_sourced(
    df: DataFrame,
    source: Column | int,
    source_id: Column,
    source_name: Column,
    order_by: list[str] | str,
    last_id: int = 0,
    shards: int = 4,
) -> DataFrame:
    """Payloads in ``data`` wrapped in the sourced envelope and numbered."""
    source = source if isinstance(source, Column) else F.lit(source)
    wrapped = pack_sourced(df, source, source_id, source_name, F.col("data"))
    return number_packets(wrapped, order_by, last_id, shards, ["data"])


def publish_encoded(
    df: DataFrame,
    message: Message,
    order_by: list[str] | str,
    last_id: int = 0,
    shards: int = 4,
) -> DataFrame:
    """Typed records encoded into ``data`` and numbered."""
    return number_packets(encode_messages(df, message), order_by, last_id, shards, ["data"])
