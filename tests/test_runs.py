"""Frontiers, runs and gaps against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelog.operators import numbering, runs
from tidelog.operators.runs import (
    ack_frontier,
    ack_frontier_bucketed,
    islands,
    log_gaps,
    pending_acks,
)

ACKS = "queue string, consumer string, id long"


def acks_of(spark, ids):
    return spark.createDataFrame([("q", "c", i) for i in ids], ACKS)


@pytest.mark.parametrize(
    "ids, start, frontier, pending",
    [
        ([1, 2, 4, 2, 5], 0, 2, {4, 5}),
        ([1, 3, 2], 0, 3, set()),
        ([5, 6], 4, 6, set()),
        ([6], 4, 4, {6}),
        ([3], 4, 4, set()),
        ([5, 5, 6], 4, 6, set()),
    ],
)
def test_vectors(spark, ids, start, frontier, pending):
    acks = acks_of(spark, ids)
    keys = ["queue", "consumer"]
    assert [r["frontier"] for r in ack_frontier(acks, keys, start).collect()] == [frontier]
    assert ack_frontier_bucketed(acks, 32, start).first()["frontier"] == frontier
    waiting = pending_acks(acks, keys, start).collect()
    if max(ids) > start:
        row = waiting[0]
        assert (row["frontier"], row["pending"]) == (frontier, len(pending))
        assert row["min_pending"] == min(pending, default=None)
        assert row["max_pending"] == max(pending, default=None)


def brute(ids, start):
    have = {i for i in ids if i > start}
    frontier = start
    while frontier + 1 in have:
        frontier += 1
    runs, gaps, last = [], [], start
    for i in sorted(have):
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
        if i - last > 1:
            gaps.append((last + 1, i - 1))
        last = i
    return frontier, [tuple(r) for r in runs], gaps


@pytest.mark.parametrize("seed", range(3))
def test_random_queues(spark, seed):
    """Holes of single ids, of whole words and of whole blocks; repeated ids."""
    rng = random.Random(seed)
    start = rng.choice([0, 7, 100])
    queues = {}
    for n in range(12):
        ids = set(range(1, rng.choice([3, 31, 32, 33, 64, 65, 200, 700])))
        for _ in range(rng.randrange(4)):
            low = rng.randrange(1, 700)
            ids -= set(range(low, low + rng.choice([1, 2, 32, 64, 150])))
        ids |= {rng.randrange(1, 2000) for _ in range(rng.randrange(5))}
        if ids:
            queues[f"q{n}"] = sorted(ids) + rng.sample(sorted(ids), min(3, len(ids)))
    rows = [(q, "c", i) for q, ids in queues.items() for i in ids]
    rng.shuffle(rows)
    acks = spark.createDataFrame(rows, ACKS).repartition(3)
    frontier = {r["queue"]: r["frontier"] for r in ack_frontier(acks, ["queue"], start).collect()}
    live = acks.where(F.col("id") > start)
    runs, gaps = {}, {}
    for r in islands(live, ["queue"], block=64).collect():
        runs.setdefault(r["queue"], []).append((r["first_id"], r["last_id"]))
        assert r["ids"] == r["last_id"] - r["first_id"] + 1
    for r in log_gaps(acks, ["queue"], start, block=64).collect():
        gaps.setdefault(r["queue"], []).append((r["from_id"], r["to_id"]))
    for q, ids in queues.items():
        want_frontier, want_runs, want_gaps = brute(ids, start)
        assert frontier[q] == want_frontier
        assert sorted(runs.get(q, [])) == want_runs
        assert sorted(gaps.get(q, [])) == want_gaps
        one = acks.where(F.col("queue") == q)
        if q in ("q0", "q1"):
            assert ack_frontier_bucketed(one, 32, start).first()["frontier"] == want_frontier


def test_start_per_key(spark):
    rows = [("a", 3, 4), ("a", 3, 5), ("b", 0, 1), ("b", 0, 3), ("c", 9, 2)]
    acks = spark.createDataFrame(rows, "queue string, start long, id long")
    found = {r["queue"]: r["frontier"] for r in ack_frontier(acks, ["queue"], "start").collect()}
    assert found == {"a": 5, "b": 1, "c": 9}


def test_hot_queue_is_spread(spark):
    """One queue holds nearly everything: its words must end up in many tasks."""
    from tidelog.operators.runs import word_masks

    acks = spark.range(1, 100_001).select(F.lit("hot").alias("queue"), "id")
    words = word_masks(acks, ["queue"])
    shares = words.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in shares) == 100_001 // 32 + 1
    assert ack_frontier(acks, ["queue"]).first()["frontier"] == 100_000


@pytest.mark.parametrize("start", [0, 5])
def test_pending_acks_by_words(spark, start):
    """Dense, holed and far ids around the borders of words, against sets."""
    rng = random.Random(start)
    groups = {"full": range(1, 97), "absent": range(65, 70), "far": [1, 2, 10**12], "stale": [1, 2], "border": [*range(1, 33), 34, 64, 65], "next": [*range(6, 38), *range(70, 72)]}
    for k in range(60):
        groups[f"r{k}"] = [i for i in range(1, 140) if rng.random() < rng.choice((0.5, 0.95, 0.999))] or [3]
    df = spark.createDataFrame([(g, i) for g, ids in groups.items() for i in ids], "q string, id long")
    want = {}
    for g, ids in groups.items():
        own = {i for i in ids if i > start}
        if own:
            p = start
            while p + 1 in own:
                p += 1
            waits = {i for i in own if i > p}
            want[g] = (p, len(waits), min(waits, default=None), max(waits, default=None))
    found = runs.pending_acks(df, ["q"], start)
    assert {r["q"]: tuple(r)[1:] for r in found.collect()} == want
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_gaps_in_a_tree_of_blocks(spark, monkeypatch):
    """One hot queue with ids up to 10 ** 12, and trees of many levels."""
    rng = random.Random(2)
    ids = sorted({rng.randrange(1, 10 ** rng.randrange(1, 13)) for _ in range(2000)} | {10**12})
    df = spark.createDataFrame([("hot", i) for i in ids] + [("one", 1)], "q string, id long")
    want = sorted(("hot", a + 1, b - 1, b - a - 1) for a, b in zip([0, *ids], ids) if b - a > 1)
    for fan, block in ((runs.FAN, runs.BLOCK), (4, 32)):
        monkeypatch.setattr(runs, "FAN", fan)
        found = runs.log_gaps(df, ["q"], block=block)
        assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    for window in re.findall(r"hashpartitioning\(([^)]*)\)", plan):
        assert not re.fullmatch(r"q#\d+, \d+", window)
    assert runs.log_gaps(df.limit(0), ["q"]).collect() == []


def test_positions_take_one_range_exchange(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1, 5000), 700)
    log = spark.createDataFrame([(i, str(i)) for i in ids], "id long, data string").repartition(5)
    found = numbering.ordered_positions(log, 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1
    assert [(r["id"], r["position"]) for r in found.collect()] == [(i, k + 1) for k, i in enumerate(sorted(ids))]
    assert numbering.ordered_positions(log.limit(0)).collect() == []
