"""Pointer tables: the last upsert per queue and consumer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.schemas import POINTERS


def pointer_state(updates: DataFrame, consumers: DataFrame) -> DataFrame:
    """``queue, consumer, ptr``: the update with the highest ``seq`` per consumer, even
    when it moves backwards; a consumer that never wrote is at 0."""
    latest = updates.groupBy("queue", "consumer").agg(F.max_by("ptr", "seq").alias("ptr"))
    return (
        consumers.select("queue", "consumer")
        .distinct()
        .join(latest, ["queue", "consumer"], "left")
        .withColumn("ptr", F.coalesce("ptr", F.lit(0)).cast("long"))
    )


def _version_path(path: str, version: int) -> str:
    return f"{path}/version={version}"


def save_pointers(pointers: DataFrame, path: str, version: int) -> None:
    """Store a full snapshot; saving a version again replaces it."""
    pointers.select("queue", "consumer", "ptr").write.mode("overwrite").parquet(
        _version_path(path, version)
    )


def has_version(spark: SparkSession, path: str, version: int) -> bool:
    """Whether that snapshot was written to its end."""
    jvm = spark._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{_version_path(path, version)}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def newest_version(spark: SparkSession, path: str) -> int:
    """The last snapshot that was written to its end, or -1."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return -1
    names = [status.getPath().getName() for status in files.listStatus(root)]
    versions = sorted((int(n.partition("=")[2]) for n in names if n.startswith("version=")), reverse=True)
    return next((v for v in versions if has_version(spark, path, v)), -1)


def load_pointers(spark: SparkSession, path: str, version: int) -> DataFrame:
    """A snapshot, or no rows when there is none."""
    if version < 0 or not has_version(spark, path, version):
        return spark.createDataFrame([], POINTERS)
    return spark.read.schema(POINTERS).parquet(_version_path(path, version))
