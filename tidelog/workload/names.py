"""Queries on names, paths and typed text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.typed_text import instant_nanos, instant_of, nanos_between, typed_columns
from tidelog.operators import names
from tidelog.session import spread, work_path
from tidelog.sources.documents import read_documents
from tidelog.workload import Registry
from tidelog.workload.tables import table

R = Registry()


@R.add(
    "j4_longest_prefix_join",
    """WITH places AS (SELECT r_name || '.' || n_name AS place, r_name, n_nationkey FROM nation JOIN region ON r_regionkey = n_regionkey),
refs AS (SELECT c_custkey, place || '.' || c_mktsegment AS scope, 'd' || (c_custkey % 13) AS name FROM customer JOIN places ON n_nationkey = c_nationkey),
defs AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN r_name || '.d' || (s_suppkey % 13) WHEN 1 THEN place || '.d' || (s_suppkey % 13) ELSE 'd' || (s_suppkey % 5) END AS full_name,
  min(s_suppkey) AS def FROM supplier JOIN places ON n_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey, scope, name, def, full_name FROM (
  SELECT refs.*, def, full_name, row_number() OVER (PARTITION BY c_custkey ORDER BY length(full_name) DESC NULLS LAST) AS rn
  FROM refs LEFT JOIN defs ON full_name = name OR (full_name LIKE '%.' || name AND scope || '.' LIKE left(full_name, length(full_name) - length(name)) || '%'))
WHERE rn = 1""",
)
def j4(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    places = nations.select(F.concat_ws(".", "r_name", "n_name").alias("place"), "r_name", "n_nationkey")
    refs = table(spark, sf, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey",
        F.concat_ws(".", "place", "c_mktsegment").alias("scope"),
        F.concat(F.lit("d"), (F.col("c_custkey") % 13).cast("string")).alias("name"),
    )
    defs = table(spark, sf, "supplier").join(places, F.col("n_nationkey") == F.col("s_nationkey")).select(
        F.expr(
            "CASE s_suppkey % 3 WHEN 0 THEN r_name || '.d' || (s_suppkey % 13) "
            "WHEN 1 THEN place || '.d' || (s_suppkey % 13) ELSE 'd' || (s_suppkey % 5) END"
        ).alias("full_name"),
        F.col("s_suppkey").alias("def"),
    )
    return names.longest_prefix_join(refs, defs)


URL_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]+', ''), '[?#].*$', '')"
URL_HOST = r"regexp_extract(url, '^[a-z]+://([^/]+)', 1)"


@R.add(
    "a13_common_path",
    f"""WITH p AS (SELECT {URL_HOST} AS host, {URL_PATH} AS path FROM pages),
e AS (SELECT host, min(path) AS lo, max(path) AS hi FROM p GROUP BY host)
SELECT host, left(lo, CAST(list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda n: left(lo, n) = left(hi, n))) AS BIGINT)) AS prefix,
  array_to_string(string_split(lo, '/')[1:list_max(list_filter(range(0, least(len(string_split(lo, '/')), len(string_split(hi, '/')))),
    lambda n: string_split(lo, '/')[1:n] = string_split(hi, '/')[1:n]))], '/') AS root
FROM e""",
)
def a13(spark, sf):
    pages = table(spark, sf, "pages").select(F.expr(URL_HOST).alias("host"), F.expr(URL_PATH).alias("path"))
    return names.common_path(pages, ["host"], "path")


@R.add(
    "a14_path_rollup",
    f"""WITH p AS (SELECT string_split({URL_PATH}, '/') AS parts FROM pages),
s AS (SELECT parts, unnest(range(1, greatest(len(parts), 2))) AS d FROM p)
SELECT array_to_string(parts[1:d], '/') AS dir, d - 1 AS depth, count(*) AS files, count(DISTINCT parts[-1]
  || chr(1) || array_to_string(parts[1:d], '/')) AS names FROM s GROUP BY 1, 2""",
)
def a14(spark, sf):
    return names.path_rollup(table(spark, sf, "pages").select(F.expr(URL_PATH).alias("path")), "path")


@R.add(
    "m6_typed_columns",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE (o_orderkey % 50) * 3600000000000 + (o_custkey % 60) * 60000000000 + (o_orderkey % 1000) * 1000000 END AS took_ns,
  o_orderstatus = 'P' AS took_error, CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE epoch_us(o_orderdate) - 5400000000 END AS at_micros,
  CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE CAST(5400 AS BIGINT) END AS at_offset, o_custkey % 10 = 0 AS at_error FROM orders""",
)
def m6(spark, sf):
    texts = spread(table(spark, sf, "orders")).select(
        "o_orderkey",
        F.expr(
            "(o_orderkey % 50) || 'h' || (o_custkey % 60) || 'm' || (o_orderkey % 1000) || IF(o_orderstatus = 'P', 'x', 'ms')"
        ).alias("took"),
        F.expr("date_format(o_orderdate, IF(o_custkey % 10 = 0, 'yyyy-MM-dd', \"yyyy-MM-dd'T'HH:mm:ss'+01:30'\"))").alias("at"),
    )
    typed = typed_columns(texts, {"took": "duration", "at": "time"})
    return typed.select(
        "o_orderkey",
        "took_ns",
        "took_error",
        F.unix_micros("at_time").alias("at_micros"),
        F.col("at_offset").cast("long").alias("at_offset"),
        "at_error",
    )


#: Times of orders to the nanosecond, some without a time of day.
AT_NANOS = "o_orderkey * 7919 % 1000000000"


def order_instants(spark, sf):
    texts = spread(table(spark, sf, "orders")).select(
        "o_orderkey",
        "o_custkey",
        F.expr(
            f"""IF(o_custkey % 10 = 0, date_format(o_orderdate, 'yyyy-MM-dd'), date_format(o_orderdate, "yyyy-MM-dd'T'HH:mm:ss")
            || '.' || lpad({AT_NANOS}, 9, '0') || IF(o_orderkey % 2 = 0, 'Z', '-05:00'))"""
        ).alias("at"),
    )
    return typed_columns(texts, {"at": "instant"})


@R.add(
    "m6_instants",
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN CAST(epoch_us(o_orderdate) // 1000000 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 18000 END AS BIGINT) END AS seconds,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST({AT_NANOS} AS BIGINT) END AS nanos,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE -18000 END AS BIGINT) END AS at_offset,
  o_custkey % 10 = 0 AS at_error FROM orders""",
)
def m6_instants(spark, sf):
    return order_instants(spark, sf).select(
        "o_orderkey",
        "at_instant.seconds",
        F.col("at_instant.nanos").cast("long").alias("nanos"),
        F.col("at_offset").cast("long").alias("at_offset"),
        "at_error",
    )


@R.add(
    "m6_instant_spans",
    f"""WITH t AS (SELECT o_custkey, CAST(epoch_us(o_orderdate) // 1000000 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 18000 END AS HUGEINT) * 1000000000 + {AT_NANOS} AS ns
  FROM orders WHERE o_custkey % 10 <> 0)
SELECT o_custkey, CAST((min(ns) - ((min(ns) % 1000000000) + 1000000000) % 1000000000) // 1000000000 AS BIGINT) AS first_second,
  CAST(((min(ns) % 1000000000) + 1000000000) % 1000000000 AS BIGINT) AS first_nano, CAST(max(ns) - min(ns) AS BIGINT) AS span_ns, count(*) AS orders
FROM t GROUP BY 1""",
)
def m6_spans(spark, sf):
    found = order_instants(spark, sf).where("not at_error").withColumn("at_ns", instant_nanos(F.col("at_instant")))
    ends = found.groupBy("o_custkey").agg(F.min("at_ns").alias("lo"), F.max("at_ns").alias("hi"), F.count("at_ns").alias("orders"))
    ends = ends.select("o_custkey", instant_of(F.col("lo")).alias("first"), instant_of(F.col("hi")).alias("last"), "orders")
    return ends.select(
        "o_custkey",
        F.col("first.seconds").alias("first_second"),
        F.col("first.nanos").cast("long").alias("first_nano"),
        nanos_between(F.col("first"), F.col("last")).alias("span_ns"),
        "orders",
    )


TURNS_PER_DOC = 8
DOC = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("part", T.LongType()),
        T.StructField(
            "turns",
            T.ArrayType(T.StructType([T.StructField("turn", T.LongType()), T.StructField("text", T.StringType())])),
        ),
    ]
)


@R.add(
    "s11_read_documents",
    """SELECT conv_id, turn // 8 AS part, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, 1 AS files
FROM conversations GROUP BY 1, 2""",
)
def s11(spark, sf):
    folder = work_path(spark, "documents")
    docs = (
        table(spark, sf, "conversations")
        .groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_DOC).alias("part"))
        .agg(F.collect_list(F.struct("turn", "role", "text")).alias("turns"))
    )
    cores = spark.sparkContext.defaultParallelism
    docs.repartition(cores).write.option("maxRecordsPerFile", 1).json(folder)
    read = read_documents(spark, folder, "**/*.json", DOC)
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"]))
    return read.select("conv_id", "part", F.size("turns").cast("long").alias("turns"), chars.alias("chars"), F.lit(1).alias("files"))
