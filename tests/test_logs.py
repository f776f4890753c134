"""Log tables, pointers, deliveries and documents."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import audit, delivery, numbering
from tidelog.plans import joins
from tidelog.session import work_path
from tidelog.sources import log_table, pointers
from tidelog.sources.documents import read_all_documents, read_documents


def packets(spark, keys):
    return spark.createDataFrame([(k, str(k)) for k in keys], "k long, text string").withColumn("data", F.encode("text", "UTF-8"))


def test_dense_ids_with_hot_leading_key(spark):
    """A third of all rows share the leading key; ties are broken by the second."""
    rng = random.Random(1)
    keys = [(None if i % 50 == 0 else i % 3 // 2 * i, i) for i in range(3000)]
    rng.shuffle(keys)
    df = spark.createDataFrame(keys, "a long, b long").repartition(5)
    found = numbering.dense_ids(df, ["a", "b"], 10).collect()
    order = sorted(keys, key=lambda k: (k[0] is not None, k[0] or 0, k[1]))
    assert {(r["a"], r["b"]): r["id"] for r in found} == {k: 11 + i for i, k in enumerate(order)}


def test_dense_ids_of_nothing(spark):
    assert numbering.dense_ids(spark.createDataFrame([], "a long"), "a").collect() == []


def test_append_twice_and_prune(spark):
    path = work_path(spark, "log")
    last = log_table.log_append(packets(spark, range(100, 150)), path, "k")
    last = log_table.log_append(packets(spark, range(30)), path, "k", last)
    assert last == 80
    log = log_table.log_scan(spark, path)
    assert sorted((r["id"], bytes(r["data"]).decode(), r["shard"]) for r in log.collect()) == [
        (i, str(i + 99 if i <= 50 else i - 51), i % 4) for i in range(1, 81)
    ]
    assert audit.log_integrity(log.withColumn("queue", F.lit("q")), 4).collect() == [("q", 80, 0, 0, 0)]
    part = log_table.log_scan(spark, path, [1, 3])
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "shard#" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert {r["shard"] for r in part.collect()} == {1, 3}
    wanted = spark.createDataFrame([(5,), (9,), (9,), (500,)], "id long")
    assert sorted(r["id"] for r in delivery.where_ids(log, wanted, 4).collect()) == [5, 9]


def test_range_reads(spark):
    path = work_path(spark, "log")
    log_table.log_append(packets(spark, range(100)), path, "k")
    log = log_table.log_scan(spark, path)
    window = numbering.read_range(log, 10, 90, 5)
    assert [r["id"] for r in window.collect()] == [11, 12, 13, 14, 15]
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,10), LessThanOrEqual(id,15)]" in window._jdf.queryExecution().toString()
    assert numbering.read_range(log, 200, 300).collect() == []
    assert [r["id"] for r in numbering.read_range(log.where("id <> 12"), 10, 13).collect()] == [11, 13]


def test_upsert_into_touches_only_its_shards(spark):
    path = work_path(spark, "log")
    log_table.log_append(packets(spark, range(1, 41)), path, "k")

    def files(shard):
        return sorted(f for f in log_table.log_scan(spark, path).inputFiles() if f"/shard={shard}/" in f)

    before = {s: files(s) for s in range(4)}
    incoming = spark.createDataFrame([(5, b"x", 2), (5, b"y", 1), (41, b"new", 1)], "id long, data binary, seq int")
    log_table.log_upsert_into(spark, path, incoming, 4)
    rows = {r["id"]: bytes(r["data"]) for r in log_table.log_scan(spark, path).collect()}
    assert len(rows) == 41 and rows[5] == b"x" and rows[41] == b"new" and rows[9] == b"9"
    assert files(1) != before[1] and all(files(s) == before[s] for s in (0, 2, 3))


def test_pointer_snapshots(spark):
    path = work_path(spark, "pointers")
    updates = spark.createDataFrame([("q", "c", 9, 1), ("q", "c", 4, 2)], "queue string, consumer string, ptr long, seq int")
    consumers = spark.createDataFrame([("q", "c"), ("q", "new")], "queue string, consumer string")
    state = pointers.pointer_state(updates, consumers)
    pointers.save_pointers(state, path, 3)
    loaded = {(r["queue"], r["consumer"]): r["ptr"] for r in pointers.load_pointers(spark, path, 3).collect()}
    assert loaded == {("q", "c"): 4, ("q", "new"): 0}  # may move backwards; unknown is 0
    assert pointers.load_pointers(spark, path, 2).count() == 0


def test_lag_example(spark):
    rows = [("q", "", 731_204), ("q", "reader", 412_080), ("q", "idle", 731_204), ("unwritten", "reader", 0)]
    table = spark.createDataFrame(rows, "queue string, consumer string, ptr long")
    lag = {(r["queue"], r["consumer"]): (r["lag"], r["idle"]) for r in delivery.consumer_lag(table).collect()}
    assert lag == {("q", "reader"): (319_124, False), ("q", "idle"): (0, True), ("unwritten", "reader"): (0, True)}
    windows = {(r["queue"], r["consumer"]): (r["after"], r["upto"]) for r in delivery.next_windows(table, 50_000).collect()}
    assert windows[("q", "reader")] == (412_080, 462_080) and windows[("q", "idle")] == (731_204, 731_204)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_equals_broadcast(spark, how):
    big = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("queue"), "id")
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("k2", 4)], "queue string, v int")
    small = small if how in ("inner", "left") else small.select("queue").distinct()
    wide = joins.attach(big, small, ["queue"], how, spread=["id"])
    spread = joins.attach(big, small, ["queue"], how, spread=["id"], limit=0)
    assert sorted(map(tuple, wide.collect()), key=str) == sorted(map(tuple, spread.collect()), key=str)


def test_only_hot_keys_are_split(spark):
    big = spark.range(9000).selectExpr("if(id % 3 = 0, 'hot', 'k' || id % 5000) AS queue", "id")
    small = spark.createDataFrame([("hot", 1)] + [(f"k{n}", n) for n in range(5000)], "queue string, v int")
    hot = joins.hot_keys(big, ["queue"], 64)
    assert len(hot) == 1 and big.where(F.xxhash64("queue").isin(hot)).select("queue").distinct().collect() == [("hot",)]
    left, right = joins.sides(big, small, ["queue"], F.xxhash64("queue").isin(hot), ["id"], 64)
    assert right.count() == 5000 + 64 and left.where("queue = 'hot'").select("_salt").distinct().count() == 64
    assert left.where("queue <> 'hot' AND _salt <> 0").count() == 0
    joined = joins.salted(big, small, ["queue"], spread=["id"], parts=64)
    assert joined.count() == 9000 and joined.agg(F.sum("v")).first() == big.join(small, "queue").agg(F.sum("v")).first()
    cold = spark.range(9000).selectExpr("'k' || id % 5000 AS queue", "id")
    assert joins.hot_keys(cold, ["queue"], 64) == []
    plan = joins.salted(cold, small, ["queue"], spread=["id"], parts=64)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "_salt" not in plan
    nulls = spark.range(900).selectExpr("if(id % 2 = 0, null, 'k' || id) AS queue", "id")
    assert joins.salted(nulls, small, ["queue"], "left", spread=["id"], parts=64).count() == 900
    other = small.selectExpr("int(v) AS id", "v")
    assert joins.salted(big, other, ["id"]).count() == 5001  # key types differ; 1 stands twice


def test_sides_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [("q", "", 90), *[("q", f"c{n}", n) for n in range(50)]]
    table = spark.createDataFrame(rows, "queue string, consumer string, ptr long")
    table = table.mapInArrow(counted, table.schema)
    acks = spark.range(100).selectExpr("'q' AS queue", "'c' || id % 50 AS consumer", "id")
    log = spark.range(1, 101).selectExpr("'q' AS queue", "id", "1 AS shard", "cast('x' AS binary) AS data")
    for operator, want in [
        (lambda: delivery.drop_stale_acks(acks, table), 50),
        (lambda: delivery.consumer_lag(table), 50),
        (lambda: delivery.next_windows(table, 5), 50),
        (lambda: delivery.undelivered(log, table), sum(90 - n for n in range(50))),
    ]:
        before = read.value
        assert len(operator().collect()) == want
        assert read.value - before == len(rows)


def test_reports(spark):
    rows = [("q", 1, 1, b"ab", 0, 5), ("q", 2, 2, b"c", 0, 2_000_000), ("q", 5, 1, b"", 1, 1), ("q", 5, 3, b"", 1, 1)]
    log = spark.createDataFrame(rows, "queue string, id long, shard int, data binary, batch long, micros long")
    audits = {(r["batch"], r["shard"]): (r["entries"], r["bytes"], r["slow"]) for r in audit.batch_audit(log).collect()}
    assert audits[(0, 2)] == (1, 1, True) and audits[(0, 1)] == (1, 2, False)
    assert sorted(map(tuple, audit.cross_shard_batches(log).collect())) == [(0, 2), (1, 2)]
    assert audit.log_integrity(log, 4).collect() == [("q", 4, 1, 1, 2)]
    copies = audit.payload_duplicates(log.select("id", "data")).collect()
    assert [(r["copies"], r["first_id"], len(r["digest"])) for r in copies] == [(2, 5, 128)]


DOC = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.LongType()), T.StructField("tags", T.ArrayType(T.StringType()))])


def test_documents(spark, tmp_path):
    (tmp_path / "conf" / "deep").mkdir(parents=True)
    (tmp_path / "conf" / "a.json").write_text('{"name": "a",\n "size": 1, "more": true, "tags": null}')
    (tmp_path / "conf" / "deep" / "b.json").write_text('{"name": "b", "tags": ["x", "y"]}')
    (tmp_path / "conf" / "bad.json").write_text('{"name": ')
    (tmp_path / "conf" / "c.json5").write_text("// note\n{name: 'c', size: 3}")
    (tmp_path / "conf" / "d.yaml").write_text("name: d\nsize: 4\ntags: [p, q]\nother: 1\n")
    (tmp_path / "conf" / "e.yml").write_text("name: [unclosed")
    found = {r["rel_path"]: r for r in read_documents(spark, str(tmp_path), "conf/**/*.json", DOC).collect()}
    assert set(found) == {"conf/a.json", "conf/deep/b.json", "conf/bad.json"}
    assert (found["conf/a.json"]["size"], found["conf/a.json"]["tags"]) == (1, None)
    assert found["conf/deep/b.json"]["tags"] == ["x", "y"] and found["conf/deep/b.json"]["size"] is None
    assert found["conf/bad.json"]["_corrupt_record"] is not None
    assert [r["rel_path"] for r in read_documents(spark, str(tmp_path), "conf/a*.json", DOC).collect()] == ["conf/a.json"]
    rest = {r["rel_path"]: r for r in read_all_documents(spark, str(tmp_path), ["conf/*.json5", "conf/*.yaml", "conf/*.yml"], DOC).collect()}
    assert (rest["conf/c.json5"]["name"], rest["conf/c.json5"]["size"]) == ("c", 3)
    assert (rest["conf/d.yaml"]["name"], rest["conf/d.yaml"]["tags"]) == ("d", ["p", "q"])
    assert rest["conf/e.yml"]["_corrupt_record"] is not None and rest["conf/e.yml"]["name"] is None
    with pytest.raises(ValueError):
        read_documents(spark, str(tmp_path), "*.toml", DOC)
