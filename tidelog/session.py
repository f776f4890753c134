"""Session helpers: the shared work folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is refused, because a machine-local folder would be lost
    with its machine.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="tidelog-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh table path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep the rows in the shared folder, so later uses
    neither repeat the work nor depend on executors staying alive."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer splits than that (a small or
    unsplittable file ahead of costly work per row); anything larger is left alone. For
    table scans: asking a plan with shuffles for its partitions would run them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session, once."""
    sc = spark.sparkContext
    if not any(Path(name).name.startswith(f"{PACKAGE.name}-ship") for name in sc.listFiles):
        archive = Path(tempfile.mkdtemp(prefix="tidelog-")) / f"{PACKAGE.name}-ship.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(PACKAGE.rglob("*.py")):
                out.write(source, source.relative_to(PACKAGE.parent))
        sc.addPyFile(str(archive))


def bounded_batches(spark: SparkSession, most_bytes: int = 4 << 20) -> None:
    """Arrow batches of about ``most_bytes`` at most from now on in this session. Batches of
    10,000 rows of text take tens of MB, several times over in each task's JVM and worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(most_bytes)).rstrip("bB")) >= most_bytes:
        spark.conf.set(name, str(most_bytes))
