"""Publishing with records, and tables stored as changes."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import work_path
from tidelog.sources import deltas, publications
from tidelog.sources.publications import publish_batch, published_log, written_upto
from tidelog.streaming import receive


def packets(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("k"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))


def stored(spark, path, record):
    return sorted((r["id"], bytes(r["data"]).decode()) for r in published_log(spark, path, record, "q").collect())


def test_a_replayed_batch_keeps_its_ids(spark):
    """One publisher fails between its record and Spark's commit, another publishes, the first
    one starts again and goes on."""
    path, record = work_path(spark, "log"), work_path(spark, "records")
    sources, checkpoints = [work_path(spark, "in") for _ in "ab"], [work_path(spark, "checkpoint") for _ in "ab"]

    def go(k):
        stream = spark.readStream.schema(packets(spark, 0, 1).schema).parquet(sources[k])
        receive.publish_stream(stream, path, record, "q", "k", checkpoints[k], once=True).awaitTermination()

    packets(spark, 0, 20).coalesce(1).write.parquet(sources[0])
    packets(spark, 20, 25).coalesce(1).write.parquet(sources[1])
    go(0)
    folder = f"{checkpoints[0].removeprefix('file:')}/commits"
    for name in os.listdir(folder):
        os.remove(f"{folder}/{name}")
    go(1)
    want = [(i, str(i - 1)) for i in range(1, 26)]
    assert stored(spark, path, record) == want
    go(0)
    assert stored(spark, path, record) == want
    packets(spark, 25, 30).coalesce(1).write.mode("append").parquet(sources[0])
    go(0)
    assert stored(spark, path, record) == [(i, str(i - 1)) for i in range(1, 31)]
    assert written_upto(spark, record, "q") == 30


def test_an_open_range_is_not_read_and_not_taken(spark, monkeypatch):
    path, record = work_path(spark, "log"), work_path(spark, "records")

    def publish(owner, batch_id, low, high):
        return publish_batch(packets(spark, low, high), path, record, "q", owner, batch_id, "k")

    assert publish("a", 0, 0, 10) == 10
    with monkeypatch.context() as patch:
        patch.setattr(publications, "write_log", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            publish("a", 1, 10, 20)
    assert publish("b", 0, 20, 25) == 25
    assert [i for i, _ in stored(spark, path, record)] == [*range(1, 11), *range(21, 26)]
    assert written_upto(spark, record, "q") == 10
    with pytest.raises(ValueError):
        publish("a", 2, 30, 31)
    assert publish("a", 1, 10, 20) == 20
    assert publish("a", 1, 10, 20) == 20 and publish("a", 0, 0, 10) == 20
    assert stored(spark, path, record) == [(i, str(i - 1)) for i in range(1, 26)]
    assert written_upto(spark, record, "q") == 25 and written_upto(spark, record, "other") == 0


def test_an_empty_batch(spark):
    path, record = work_path(spark, "log"), work_path(spark, "records")
    assert publish_batch(packets(spark, 0, 0), path, record, "q", "a", 0, "k", first_after=7) == 7
    assert publish_batch(packets(spark, 0, 2), path, record, "q", "a", 1, "k") == 9
    assert [i for i, _ in stored(spark, path, record)] == [8, 9]


SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])


def test_changes_fold_to_the_last_row_per_key(spark):
    path, want, sizes = work_path(spark, "deltas"), {}, []
    for version in range(12):
        rows = [(f"k{version % 5}", version, False), ("hot", version, False), (f"k{(version + 2) % 5}", None, True)]
        changes = spark.createDataFrame(rows, "k string, v long, gone boolean")
        for _ in range(1 + version % 2):  # some versions are written twice
            deltas.save(changes, path, ["k"], version, every=4)
        for k, v, gone in rows:
            want.pop(k, None) if gone else want.update({k: v})
        assert {r["k"]: r["v"] for r in deltas.load(spark, path, ["k"], SCHEMA).collect()} == want
        if version == 9:
            then = dict(want)
        sizes.append(len(deltas._versions(spark, path, "delta")))
    assert {r["k"]: r["v"] for r in deltas.load(spark, path, ["k"], SCHEMA, 9).collect()} == then
    assert max(sizes) <= 9
    assert deltas.load(spark, work_path(spark, "none"), ["k"], SCHEMA).count() == 0
