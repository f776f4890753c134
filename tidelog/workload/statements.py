"""Named SQL queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.plans import sqlbook
from tidelog.session import work_path
from tidelog.workload import Registry
from tidelog.workload.tables import table

R = Registry()

BOOK = sqlbook.parse_book(
    """
-- name: revenue-by-flag
select l_returnflag as flag, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as quantity
from lineitem where l_linestatus in (?) and l_linenumber >= ? group by l_returnflag;

-- name: orders-of
select o_orderkey, o_orderpriority from orders where o_orderpriority in (:priorities) and o_totalprice > :least;

-- name: create-notes!
create table if not exists {table} (id bigint, note string) using parquet location '{path}';

-- name: fill-notes!
insert into {table} select p_partkey, p_name || ' ' || ? from part;
"""
)


def _views(spark, sf, *names):
    for name in names:
        table(spark, sf, name).createOrReplaceTempView(name)


def _fresh_table(spark):
    """The book with the name and folder of a new table filled in."""
    name = f"notes_{uuid.uuid4().hex}"
    path = work_path(spark, "notes")
    return name, {k: v.replace("{table}", name).replace("{path}", path) for k, v in BOOK.items()}


@R.add(
    "q1_named_query",
    """SELECT l_returnflag AS flag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity
FROM lineitem WHERE l_linestatus IN ('O', 'F') AND l_linenumber >= 2 GROUP BY 1""",
)
def q1(spark, sf):
    _views(spark, sf, "lineitem")
    return sqlbook.named_query(spark, BOOK, "revenue-by-flag", ["O", "F"], 2)


@R.add(
    "q2_fetch_as",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice > 100000.5",
)
def q2(spark, sf):
    _views(spark, sf, "orders")
    rows = sqlbook.named_query(spark, BOOK, "orders-of", priorities=["1-URGENT", "2-HIGH"], least=100000.5)
    shape = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType())])
    return sqlbook.fetch_as(rows, shape)


@R.add("q3_execute", "SELECT p_partkey AS id, p_name || ' seen' AS note FROM part")
def q3(spark, sf):
    _views(spark, sf, "part")
    name, book = _fresh_table(spark)
    sqlbook.execute(spark, book, "create-notes!")
    sqlbook.execute(spark, book, "fill-notes!", "seen")
    return spark.table(name)


@R.add("q4_execute_batch", "SELECT o_orderkey AS id, o_orderpriority AS note FROM orders")
def q4(spark, sf):
    name, book = _fresh_table(spark)
    sqlbook.execute(spark, book, "create-notes!")
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("note"), F.col("o_orderkey").alias("id"))
    sqlbook.execute_batch(rows, name)
    return spark.table(name)
