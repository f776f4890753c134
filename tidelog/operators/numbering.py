"""Dense numbering, batching and ordered reads of a log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import work_path

#: ``monotonically_increasing_id`` keeps the partition above these bits.
ROW_BITS = 33


def dense_ids(
    df: DataFrame,
    order_by: list[str] | str,
    start: int = 0,
    id_col: str = "id",
    keep: list[str] | None = None,
) -> DataFrame:
    """Consecutive ids from ``start + 1`` in the order of the unique key ``order_by``.

    The rows are sorted over range partitions and stored once in the shared folder with
    their place in their partition, so that sizes and rows come from the same sort even
    when tasks are repeated. An id is that place plus the rows of the partitions before;
    only the partition sizes (one row per sort task) are broadcast. ``keep`` names the
    columns to carry along; the order key need not be one of them.
    """
    order_by = [order_by] if isinstance(order_by, str) else list(order_by)
    spark = df.sparkSession
    path = work_path(spark, "numbering")
    columns = df.columns if keep is None else keep
    ordered = df.select(*dict.fromkeys([*columns, *order_by])).orderBy(*order_by)
    placed = ordered.select(*columns, F.monotonically_increasing_id().alias("_at"))
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path)
    stored = stored.withColumn("_part", F.shiftright("_at", ROW_BITS))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    )
    place = F.col("_at").bitwiseAND((1 << ROW_BITS) - 1)
    return (
        stored.join(F.broadcast(shifts), "_part")
        .withColumn(id_col, F.lit(start + 1).cast("long") + F.col("_shift") + place)
        .drop("_part", "_shift", "_at")
    )


def floor_div(value: Column, by: int) -> Column:
    """Whole division rounded down, in longs (a double would lose large ids)."""
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def shard_of(ident: Column | str, shards: int) -> Column:
    """The shard an id lives in."""
    column = F.col(ident) if isinstance(ident, str) else ident
    return F.pmod(column, F.lit(shards)).cast("int")


def assign_batches(df: DataFrame, size: int, after: int = 0, shards: int | None = None) -> DataFrame:
    """Add ``batch``: the read window of an id, or with ``shards`` the write batch of
    its shard (ids are dense, so the rank inside a shard follows from the id)."""
    offset = F.col("id") - F.lit(after + 1)
    if shards is not None:
        offset = floor_div(offset, shards)
    return df.withColumn("batch", floor_div(offset, size))


def ordered_log(log: DataFrame) -> DataFrame:
    """The rows of all shards in id order (a range exchange, no single task)."""
    return log.orderBy("id")


#: Ids of one row of a rank directory.
DIRECTORY_IDS = 1 << 20


def ordered_positions(log: DataFrame, block: int = DIRECTORY_IDS) -> DataFrame:
    """:func:`ordered_log` with the ``position`` of every row; ids are unique.

    A directory tells how many rows lie before each block of ids; it has one row for each
    ``block`` ids and is broadcast. The rows are dealt by ranges of blocks once and sorted
    inside the tasks, where the rank in a block is counted: partition after partition they
    are in id order, so nothing is sorted again."""
    spark = log.sparkSession
    ident = F.col("id").cast("long")
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    directory = (
        log.groupBy(floor_div(ident, block).alias("_block"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_block", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy("id"))
    return (
        log.withColumn("_block", floor_div(ident, block))
        .repartitionByRange(parts, "_block")
        .withColumn("_rank", rank)
        .join(F.broadcast(directory), "_block")
        .withColumn("position", F.col("_before") + F.col("_rank"))
        .drop("_block", "_rank", "_before")
    )


def read_range(log: DataFrame, after: int, upto: int, limit: int | None = None) -> DataFrame:
    """Rows with ids in ``(after, upto]``, at most up to ``after + limit`` if a limit is
    asked for, in id order; missing ids are skipped, an empty window gives no rows."""
    last = upto if limit is None else min(upto, after + limit)
    return log.where((F.col("id") > after) & (F.col("id") <= last)).orderBy("id")


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
