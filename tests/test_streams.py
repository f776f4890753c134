"""Streams over several batches and restarts."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidelog.operators.audit import throughput as batch_throughput
from tidelog.operators.runs import ack_frontier
from tidelog.schemas import ACKS, LOG, POINTERS
from tidelog.session import work_path
from tidelog.sources import deltas
from tidelog.sources.log_table import log_append, log_scan
from tidelog.sources.publications import published_log, written_upto
from tidelog.streaming import frontier, receive, throughput


def add(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def packets(spark, low, high):
    return spark.range(low, high).select("id", F.encode(F.col("id").cast("string"), "UTF-8").alias("data")).withColumnRenamed("id", "k")


def test_receiver_restarts_and_starts_after_its_pointer(spark):
    path, out, checkpoint = (work_path(spark, n) for n in ("log", "out", "checkpoint"))
    last = log_append(packets(spark, 0, 40), path, "k")
    pointers = spark.createDataFrame([("q", "c", 10)], POINTERS)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(receive.batch_path(out, batch_id))

    def go():
        stream = receive.read_log_stream(spark, path, "q", "c", pointers, max_files=1)
        receive.run(stream, keep, checkpoint, once=True).awaitTermination()
        return sorted(r["id"] for r in spark.read.schema(LOG).parquet(out).collect())

    assert go() == list(range(11, 41))
    log_append(packets(spark, 40, 60), path, "k", last)
    assert go() == list(range(11, 61))


def test_frontier_over_batches(spark, monkeypatch):
    """Early, repeated and late acks over four runs; small blocks, so some fill up."""
    monkeypatch.setattr(frontier.block_state, "BLOCK_IDS", 16)
    monkeypatch.setattr(frontier, "BLOCK_IDS", 16)
    acks, path, checkpoint, sunk = (work_path(spark, n) for n in ("acks", "state", "checkpoint", "sunk"))
    rounds = [
        [("q", "a", i) for i in (1, 2, 4, 2, 40)] + [("q", "b", i) for i in range(1, 33)],
        [("q", "a", i) for i in [3, *range(5, 40), 5]] + [("q", "b", 34)],
        [("q", "a", 1), ("q", "b", 33)] + [("r", "a", i) for i in (2, 3)],
        [("q", "a", i) for i in range(41, 65)] + [("q", "b", 33)],
    ]
    so_far = []

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(receive.batch_path(sunk, batch_id))

    for rows in rounds:
        add(spark, acks, rows, ACKS)
        so_far += rows
        stream = spark.readStream.schema(ACKS).parquet(acks)
        progress = frontier.stream_ack_frontier(stream)
        query = frontier.commit_pointers(progress, path, checkpoint, sink, once=True)
        query.awaitTermination()
        stored = {(r["queue"], r["consumer"]): r["ptr"] for r in frontier.committed_pointers(spark, path, query).collect()}
        batch = ack_frontier(spark.createDataFrame(so_far, ACKS), ["queue", "consumer"]).collect()
        assert stored == {(r["queue"], r["consumer"]): r["frontier"] for r in batch}
    assert stored == {("q", "a"): 64, ("q", "b"): 34, ("r", "a"): 0}


def test_frontier_from_a_pointer(spark):
    acks, path, checkpoint = (work_path(spark, n) for n in ("acks", "state", "checkpoint"))
    add(spark, acks, [("q", "c", 3), ("q", "c", 5), ("q", "c", 6), ("q", "c", 8)], ACKS)
    start = spark.createDataFrame([("q", "c", 4)], POINTERS)
    progress = frontier.stream_ack_frontier(spark.readStream.schema(ACKS).parquet(acks), start)
    query = frontier.commit_pointers(progress, path, checkpoint, once=True)
    query.awaitTermination()
    assert [r["ptr"] for r in frontier.committed_pointers(spark, path, query).collect()] == [6]


def test_frontier_restarts_with_a_newer_pointer(spark):
    """Acks that wait are found again after a restart with moved pointers."""
    acks, path, checkpoint = (work_path(spark, n) for n in ("acks", "state", "checkpoint"))

    def go(rows, pointers):
        add(spark, acks, rows, ACKS)
        stream = spark.readStream.schema(ACKS).parquet(acks)
        query = frontier.commit_pointers(frontier.stream_ack_frontier(stream, pointers), path, checkpoint, once=True)
        query.awaitTermination()
        return [tuple(r) for r in frontier.committed_pointers(spark, path, query).collect()]

    nothing = spark.createDataFrame([], POINTERS)
    assert go([("q", "c", i) for i in (1, 2, 4, 5)], nothing) == [("q", "c", 2)]
    assert go([("q", "c", 3)], spark.createDataFrame([("q", "c", 2)], POINTERS)) == [("q", "c", 5)]
    # past a block without acks, with one id missing in between
    far = 3 * frontier.BLOCK_IDS + 7
    moved = spark.createDataFrame([("q", "c", far)], POINTERS)
    assert go([("q", "c", far + i) for i in (1, 3)], moved) == [("q", "c", far + 1)]


def test_full_blocks_stay_full(spark, monkeypatch):
    monkeypatch.setattr(frontier.block_state, "BLOCK_IDS", 16)
    monkeypatch.setattr(frontier, "BLOCK_IDS", 16)
    acks, path, checkpoint = (work_path(spark, n) for n in ("acks", "state", "checkpoint"))
    for rows, want in [(range(1, 17), 16), ((3, 16, 18), 16), ((17, 1), 18)]:
        add(spark, acks, [("q", "c", i) for i in rows], ACKS)
        stream = spark.readStream.schema(ACKS).parquet(acks)
        query = frontier.commit_pointers(frontier.stream_ack_frontier(stream), path, checkpoint, once=True)
        query.awaitTermination()
        assert [r["ptr"] for r in frontier.committed_pointers(spark, path, query).collect()] == [want]


def test_publishing_continues_over_checkpoints(spark):
    path, record = work_path(spark, "log"), work_path(spark, "records")
    schema = packets(spark, 0, 1).schema
    for low, high in ((50, 70), (20, 25)):
        source = work_path(spark, "in")
        packets(spark, low, high).coalesce(1).write.parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        checkpoint = work_path(spark, "checkpoint")
        receive.publish_stream(stream, path, record, "q", "k", checkpoint, once=True).awaitTermination()
    stored = sorted((r["id"], bytes(r["data"]).decode()) for r in published_log(spark, path, record, "q").collect())
    assert stored == [(i + 1, str(v)) for i, v in enumerate([*range(50, 70), *range(20, 25)])]
    assert written_upto(spark, record, "q") == 25


def test_state_ends_with_full_blocks(spark, monkeypatch):
    """Twenty batches, each fills a block and begins the next: state and changes stay small."""
    monkeypatch.setattr(frontier.block_state, "BLOCK_IDS", 16)
    monkeypatch.setattr(frontier, "BLOCK_IDS", 16)
    acks, path, checkpoint = (work_path(spark, n) for n in ("acks", "state", "checkpoint"))
    add(spark, acks, [("idle", "c", i) for i in (1, 2)] + [("q", "c", 1)], ACKS)
    for k in range(20):
        add(spark, acks, [("q", "c", i) for i in range(16 * k + 2, 16 * k + 18)], ACKS)
    stream = spark.readStream.schema(ACKS).option("maxFilesPerTrigger", 1).parquet(acks)
    query = frontier.commit_pointers(frontier.stream_ack_frontier(stream), path, checkpoint, once=True)
    query.awaitTermination()
    assert query.lastProgress["batchId"] >= 20
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    pointers = {r["queue"]: r["ptr"] for r in frontier.committed_pointers(spark, path).collect()}
    assert pointers == {"q": 321, "idle": 2}
    last = spark.read.parquet(f"{path}/frontiers/delta=20")
    assert [(r["queue"], r["ptr"]) for r in last.collect()] == [("q", 321)]
    still_open = deltas.load(spark, f"{path}/blocks", frontier.BLOCK, frontier.OPEN).collect()
    assert sorted((r["queue"], r["block"]) for r in still_open) == [("idle", 0), ("q", 20)]


def test_a_session_without_the_state_store_is_refused(spark):
    name, value = frontier.STATE_STORE
    spark.conf.unset(name)
    try:
        with pytest.raises(ValueError):
            frontier.stream_ack_frontier(spark.createDataFrame([], ACKS))
        assert spark.conf.get(name, "") == ""
    finally:
        spark.conf.set(name, value)


def test_throughput_equals_batch(spark):
    rows = [(datetime.datetime(2024, 1, 1, 0, 0, s // 3), bytes(s % 4), s // 5) for s in range(60)]
    schema = "ts timestamp, data binary, batch long"
    source, out, checkpoint = (work_path(spark, n) for n in ("in", "out", "checkpoint"))
    # hours later first: rows of any age count
    rows += [(datetime.datetime(2024, 1, 1, 5, 0, s), b"xy", 90 + s // 2) for s in range(9)]
    for part in (rows[60:], rows[22:60], rows[:22]):
        add(spark, source, part, schema)
    stream = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).option("maxFilesPerTrigger", 1).parquet(source)
    throughput.save_throughput(stream, out, checkpoint, "ts", "5 seconds", once=True).awaitTermination()
    newest = throughput.load_throughput(spark.read.schema(throughput.RATES).parquet(out)).collect()
    want = batch_throughput(spark.createDataFrame(rows, schema), "ts", "5 seconds").collect()
    assert sorted(map(tuple, newest)) == sorted(map(tuple, want))
