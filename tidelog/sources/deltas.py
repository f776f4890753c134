"""Keyed tables stored as changes.

Each version of a table is a folder with the rows that changed in it; every ``every``-th
version is also kept whole. Reading takes the newest whole version and the changes after it,
the last one per key, so what is written per version follows what changed, and what is read
is bounded by the table and ``every`` changes. What is older than the last but one whole
version is deleted, so versions can be read and repeated as far back as that. A version that
is written again replaces itself, so replays repeat themselves. A row with ``gone`` ends its
key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Versions between two that are kept whole.
EVERY = 20
GONE = "gone"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place, place(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The versions of a kind that were written to their end, in order."""
    place, files = _files(spark, path)
    if not files.exists(place(path)):
        return []
    names = [status.getPath().getName() for status in files.listStatus(place(path))]
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=")]
    return sorted(v for v in numbers if files.exists(place(f"{path}/{kind}={v}/_SUCCESS")))


def last_version(spark: SparkSession, path: str) -> int:
    """The newest version, or -1."""
    return max(_versions(spark, path, "delta"), default=-1)


def load(spark: SparkSession, path: str, keys: list[str], schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The rows of a table as of version ``upto``, its newest if there is none given."""

    def until(kind: str) -> list[int]:
        return [v for v in _versions(spark, path, kind) if upto is None or v <= upto]

    whole = max(until("whole"), default=-1)
    parts = [v for v in until("delta") if v > whole]
    stored = T.StructType([*schema.fields, T.StructField(GONE, T.BooleanType())])

    def rows(kind: str, version: int) -> DataFrame:
        return spark.read.schema(stored).parquet(f"{path}/{kind}={version}").withColumn("_version", F.lit(version))

    frames = ([rows("whole", whole)] if whole >= 0 else []) + [rows("delta", v) for v in parts]
    if not frames:
        return spark.createDataFrame([], schema)
    values = [c for c in stored.names if c not in keys]
    last = (
        reduce(DataFrame.unionByName, frames)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "_version").alias("_last"))
        .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in values])
    )
    return last.where(~F.col(GONE)).select(*schema.names)


def save(changes: DataFrame, path: str, keys: list[str], version: int, every: int = EVERY) -> None:
    """Store ``changes``, one row per key, as ``version``; rows may carry ``gone``."""
    spark = changes.sparkSession
    if GONE not in changes.columns:
        changes = changes.withColumn(GONE, F.lit(False))
    changes.write.mode("overwrite").parquet(f"{path}/delta={version}")
    since = max([v for v in _versions(spark, path, "whole") if v < version], default=-1)
    if version - since >= every:
        schema = T.StructType([f for f in changes.schema.fields if f.name != GONE])
        whole = load(spark, path, keys, schema, version).withColumn(GONE, F.lit(False))
        whole.write.mode("overwrite").parquet(f"{path}/whole={version}")
        place, files = _files(spark, path)
        for kind in ("delta", "whole"):
            for old in _versions(spark, path, kind):
                if old < since:
                    files.delete(place(f"{path}/{kind}={old}"), True)
