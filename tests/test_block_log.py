"""Logs by shard and block of ids."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.session import work_path
from tidelog.sources import block_log
from tidelog.sources.block_log import BlockLog, append_blocks, read_blocks, upsert_blocks, where_ids_in

SCHEMA = "id long, data binary, seq int"


def contents(df):
    return {r["id"]: bytes(r["data"]).decode() for r in df.select("id", "data").collect()}


def files(log, spark):
    return {re.search(r"shard=\d+/block=-?\d+", f)[0]: f for f in log.rows(spark).inputFiles()}


def scan(df):
    """Partition filters and pushed filters of the scan of the rows, from the whole plan."""
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    return re.search(r"PartitionFilters: (.*?), PushedFilters: (.*?), ReadSchema: struct<id", plan).groups()


@pytest.fixture
def log(spark):
    log = BlockLog(work_path(spark, "blocks"), 2, 8)
    upsert_blocks(spark.createDataFrame([(i, str(i).encode(), 0) for i in range(1, 61) if i != 30], SCHEMA), log)
    return log


def test_upsert_rewrites_only_its_folders(spark, log):
    before, kept = files(log, spark), contents(log.rows(spark))
    incoming = spark.createDataFrame([(5, b"x", 2), (5, b"y", 1), (30, b"new", 1), (100, b"far", 1)], SCHEMA)
    for _ in range(2):  # the second time is a retry
        upsert_blocks(incoming, log)
        assert contents(log.rows(spark)) == kept | {5: "x", 30: "new", 100: "far"}
    after = files(log, spark)
    touched = {"shard=1/block=0", "shard=0/block=3", "shard=0/block=12"}
    assert set(after) - set(before) == {"shard=0/block=12"}
    assert {k for k in before if before[k] != after[k]} == touched - {"shard=0/block=12"}


def test_zones_bound_every_folder(spark, log):
    zones = {(r["shard"], r["block"]): (r["min_id"], r["max_id"], r["packets"]) for r in log.zones(spark).collect()}
    rows = contents(log.rows(spark))
    own = {}
    for i in rows:
        own.setdefault((i % 2, i // 8), []).append(i)
    assert zones == {k: (min(v), max(v), len(v)) for k, v in own.items()}


def test_a_writer_that_fails_leaves_wide_zones(spark, log, monkeypatch):
    incoming = spark.createDataFrame([(31, b"late", 1)], SCHEMA)
    with monkeypatch.context() as patch:
        patch.setattr(block_log, "_measure", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upsert_blocks(incoming, log)
    assert contents(where_ids_in(spark, log, incoming)) == {31: "late"}
    upsert_blocks(incoming, log)
    assert contents(log.rows(spark))[31] == "late"


def test_ranges_and_points_prune_on_both_columns(spark, log):
    window = read_blocks(spark, log, 10, 12)
    assert [r["id"] for r in window.collect()] == [11, 12]
    filters, _ = scan(window)
    assert "block#" in filters and "shard#" in filters
    assert [r["id"] for r in read_blocks(spark, log, 10, 60, 3).collect()] == [11, 12, 13]
    assert read_blocks(spark, log, 29, 30).collect() == [] and read_blocks(spark, log, 500, 900).collect() == []
    wanted = spark.createDataFrame([(5,), (9,), (9,), (30,), (500,), (None,)], "id long")
    found = where_ids_in(spark, log, wanted)
    assert sorted(contents(found)) == [5, 9]
    filters, pushed = scan(found)
    assert "block#" in filters and "shard#" in filters
    assert "GreaterThanOrEqual(id,5)" in pushed and "LessThanOrEqual(id,9)" in pushed
    assert where_ids_in(spark, log, wanted.where("id > 100")).count() == 0


def test_many_blocks_become_a_range(spark, log, monkeypatch):
    monkeypatch.setattr(block_log, "LISTED", 2)
    wanted = spark.createDataFrame([(i,) for i in range(3, 60, 7)], "id long")
    found = where_ids_in(spark, log, wanted)
    assert sorted(contents(found)) == [i for i in range(3, 60, 7)]
    assert re.search(r"block#\d+L >= 0\).*block#\d+L <= 7\)", scan(found)[0])


def test_random_upserts(spark):
    rng = random.Random(4)
    log, want = BlockLog(work_path(spark, "blocks"), 3, 16), {}
    for step in range(4):
        rows = [(rng.randrange(1, 200), f"{step}-{rng.randrange(9)}".encode(), rng.randrange(3)) for _ in range(60)]
        upsert_blocks(spark.createDataFrame(rows, SCHEMA).repartition(4), log)
        latest = {}
        for i, data, seq in rows:
            latest[i] = max(latest.get(i, (-1, b"")), (seq, data))
        want |= {i: data.decode() for i, (_, data) in latest.items()}
    assert contents(log.rows(spark)) == want
    ids = spark.range(0, 250)
    assert contents(where_ids_in(spark, log, ids)) == want
    assert contents(read_blocks(spark, log, 20, 120)) == {i: d for i, d in want.items() if 20 < i <= 120}


def test_append_completes_the_last_block(spark):
    log = BlockLog(work_path(spark, "blocks"), 2, 8)
    packets = spark.range(20).select("id", F.encode(F.col("id").cast("string"), "UTF-8").alias("data"))
    append_blocks(packets, log, "id")
    append_blocks(packets, log, "id", 20)
    assert contents(log.rows(spark)) == {i + 1: str(i % 20) for i in range(40)}
    empty = BlockLog(work_path(spark, "blocks"))
    assert read_blocks(spark, empty, 0, 9).count() == 0 and where_ids_in(spark, empty, spark.range(3)).count() == 0
