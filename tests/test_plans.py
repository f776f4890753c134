"""Plans: what must not appear at scale, and what must reach the scans."""

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES = entry.queries()
#: One-row results and the window over partition sizes.
GLOBAL = {"a2_ack_frontier_bucketed", "a10_payload_size", "m5_roundtrip_report"}
NUMBERED = {"w1_dense_ids", "o1_ordered_log", "s8_publish_outbox", "s9_publish_sourced", "s10_publish_encoded"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("t", "s11"))))
def test_no_cross_join_and_no_single_task(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    single = plan.count("Exchange SinglePartition")
    assert single <= (1 if name in GLOBAL | NUMBERED else 0)


@pytest.mark.parametrize(
    "name, columns",
    [
        ("a1_ack_frontier", {"l_orderkey", "l_linenumber"}),
        ("a6_throughput", {"event_id", "ts", "props"}),
        ("a15_payload_duplicates", {"doc_id", "text"}),
        ("p2_drop_stale_acks", {"l_orderkey", "l_returnflag", "l_linestatus"}),
    ],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    plan = plan_of(QUERIES[name](spark, SF))
    read = {c for part in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in re.findall(r"(\w+):", part)}
    assert read == columns


def test_frontier_aggregates_before_it_shuffles(spark):
    plan = plan_of(QUERIES["a1_ack_frontier_hot"](spark, SF))
    assert "partial_bit_or" in plan and "Window" not in plan and "SortMergeJoin" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(QUERIES["q2_fetch_as"](spark, SF))
    assert "GreaterThan(o_totalprice" in plan and "In(o_orderpriority" in plan
