"""Logs kept by shard and block of ids, with a table of zones.

A block is a range of ``block_ids`` ids; the folder of a packet is its shard and its block, so
a range of ids, a set of ids or an upsert touches few folders however long the log is, and no
folder grows with it. The zone table has a row for each file: the folder it is in, its smallest
and largest id and its rows. Lookups first drop the ids that no zone can hold, then read the
folders of those that are left.

Zones are bounds, never less than what is stored: before a folder is rewritten its zones are
widened to the whole block, afterwards they are measured. A writer that fails in between
leaves wide zones, which cost reading and lose nothing; the same call made again ends the work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators.numbering import floor_div, shard_of
from tidelog.plans.joins import attach
from tidelog.session import cut
from tidelog.sources.log_table import number_packets

#: Ids of one block; a folder holds that many by the number of shards.
BLOCK_IDS = 1 << 22
#: Folders that become a literal list in a filter; more become their smallest and largest block.
LISTED = 1000

ROWS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("data", T.BinaryType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.LongType()),
    ]
)
ZONES = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("min_id", T.LongType()),
        T.StructField("max_id", T.LongType()),
        T.StructField("packets", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.LongType()),
    ]
)
FOLDER = ["shard", "block"]


@dataclass(frozen=True)
class BlockLog:
    """Where a log is and how it is laid out."""

    path: str
    shards: int = 4
    block_ids: int = BLOCK_IDS

    @property
    def rows_path(self) -> str:
        return f"{self.path}/rows"

    @property
    def zones_path(self) -> str:
        return f"{self.path}/zones"

    def placed(self, df: DataFrame, ident: str = "id") -> DataFrame:
        """``df`` with the folder of each id."""
        ids = F.col(ident).cast("long")
        return df.withColumn("shard", shard_of(ids, self.shards)).withColumn("block", floor_div(ids, self.block_ids))

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ROWS).parquet(self.rows_path)

    def zones(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ZONES).parquet(self.zones_path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _replace(df: DataFrame, path: str) -> None:
    """Write folders whole, and leave all other folders alone."""
    writer = df.write.partitionBy(*FOLDER).option("partitionOverwriteMode", "dynamic")
    writer.mode("overwrite").parquet(path)


def _within(folders: DataFrame) -> Column:
    """A filter on both partition columns that holds for all ``folders`` (few columns, known
    size): a literal list of blocks where there are few, else their range; the join that
    follows is exact. At most LISTED rows reach the driver."""
    bounds = folders.agg(
        F.min("block").alias("low"),
        F.max("block").alias("high"),
        F.collect_set("shard").alias("shards"),
        F.approx_count_distinct("block").alias("blocks"),
    ).first()
    if bounds["low"] is None:
        return F.lit(False)
    shards = F.col("shard").isin(bounds["shards"])
    if bounds["blocks"] <= LISTED:
        listed = [r["block"] for r in folders.select("block").distinct().limit(2 * LISTED).collect()]
        if len(listed) < 2 * LISTED:
            return shards & F.col("block").isin(listed)
    return shards & F.col("block").between(bounds["low"], bounds["high"])


def _measure(spark: SparkSession, log: BlockLog, within: Column, folders: DataFrame) -> None:
    """Zones of the folders, from the ids of their files."""
    stored = log.rows(spark).where(within).select("id", *FOLDER, F.col("_metadata.file_name").alias("file"))
    own = attach(stored, folders, FOLDER, "left_semi", spread=["id"])
    measured = own.groupBy("file", *FOLDER).agg(
        F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("packets")
    )
    _replace(measured.select(ZONES.names).repartition(*FOLDER), log.zones_path)


def _store(rows: DataFrame, log: BlockLog, folders: DataFrame, within: Column) -> None:
    """Replace the folders by ``rows`` and keep their zones no smaller than they are."""
    spark = rows.sparkSession
    wide = folders.select(
        F.lit("").alias("file"),
        (F.col("block") * log.block_ids).alias("min_id"),
        ((F.col("block") + 1) * log.block_ids - 1).alias("max_id"),
        F.lit(0).cast("long").alias("packets"),
        *FOLDER,
    )
    _replace(wide.repartition(*FOLDER), log.zones_path)
    _replace(rows.select(ROWS.names).repartition(*FOLDER).sortWithinPartitions(*FOLDER, "id"), log.rows_path)
    _measure(spark, log, within, folders)


def upsert_blocks(incoming: DataFrame, log: BlockLog) -> None:
    """Store ``incoming`` (``id, data, seq``): per id the row with the highest ``seq`` wins,
    ties by data, and replaces the stored one. Only the folders of incoming ids are read and
    rewritten; storing the same rows again changes nothing."""
    spark = incoming.sparkSession
    latest = incoming.groupBy(F.col("id").cast("long").alias("id")).agg(F.max(F.struct("seq", "data"))["data"].alias("data"))
    latest = cut(log.placed(latest))
    folders = cut(latest.select(*FOLDER).distinct())
    within = _within(folders)
    merged = latest.select(ROWS.names)
    if _exists(spark, log.rows_path):
        touched = attach(log.rows(spark).where(within), folders, FOLDER, "left_semi", spread=["id"])
        kept = attach(touched, latest.select(*FOLDER, "id"), [*FOLDER, "id"], "left_anti", spread=["id"])
        merged = kept.select(ROWS.names).unionByName(merged)
    _store(merged, log, folders, within)


def append_blocks(df: DataFrame, log: BlockLog, order_by: list[str] | str, last_id: int = 0) -> None:
    """Number the packets ``data`` after ``last_id`` and store them. The block that
    ``last_id`` lies in is completed, the others are new."""
    numbered = number_packets(df, order_by, last_id, log.shards, ["data"])
    upsert_blocks(numbered.select("id", "data", F.lit(0).alias("seq")), log)


def read_blocks(spark: SparkSession, log: BlockLog, after: int, upto: int, limit: int | None = None) -> DataFrame:
    """Rows with ids in ``(after, upto]`` in id order, at most up to ``after + limit`` if a
    limit is asked for. The folders are those of zones that meet the range."""
    last = upto if limit is None else min(upto, after + limit)
    inside = (F.col("id") > after) & (F.col("id") <= last)
    blocks = F.col("block").between(after // log.block_ids, last // log.block_ids)
    if not _exists(spark, log.zones_path):
        return spark.createDataFrame([], ROWS)
    met = log.zones(spark).where(blocks & (F.col("max_id") > after) & (F.col("min_id") <= last))
    shards = [r["shard"] for r in met.select("shard").distinct().collect()]
    return log.rows(spark).where(blocks & F.col("shard").isin(shards) & inside).orderBy("id")


def where_ids_in(spark: SparkSession, log: BlockLog, ids: DataFrame) -> DataFrame:
    """Point lookups. Wanted ids that no zone can hold are dropped, the folders of the others
    and their smallest and largest id reach the scan, and a semi join finds them."""
    if not _exists(spark, log.zones_path):
        return spark.createDataFrame([], ROWS)
    wanted = log.placed(ids.select(F.col("id").cast("long").alias("id")).distinct())
    zones = log.zones(spark).groupBy(*FOLDER).agg(F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"))
    held = attach(wanted, cut(zones), FOLDER, spread=["id"])
    held = cut(held.where(F.col("id").between(F.col("min_id"), F.col("max_id"))).select("id", *FOLDER))
    bounds = held.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    if bounds["low"] is None:
        return spark.createDataFrame([], ROWS)
    near = log.rows(spark).where(_within(held) & F.col("id").between(bounds["low"], bounds["high"]))
    return attach(near, held, [*FOLDER, "id"], "left_semi", spread=["id"]).select(ROWS.names)
