"""Queries on wire payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.messages import SOURCED, Enum, Field, Message
from tidelog.operators import decode, encode
from tidelog.session import spread
from tidelog.sources import publish
from tidelog.workload import Registry
from tidelog.workload.tables import SHARDS, big, table, text_bytes

R = Registry()

STATUS = Enum("status", (("UNKNOWN", 0), ("FILLED", 1), ("OPEN", 2), ("PARTIAL", 3)))
BUYER = Message("buyer", (Field(1, "key", "uint32"), Field(2, "segment", "string")))
ORDER = Message(
    "order",
    (
        Field(1, "order_key", "uint64"),
        Field(2, "day", "sint32"),
        Field(3, "status", STATUS),
        Field(4, "priority", "string", default="3-MEDIUM"),
        Field(5, "buyer", BUYER),
        Field(6, "digits", "int64", repeated=True),
        Field(7, "checksum", "fixed32"),
        Field(20, "urgent", "bool"),
    ),
)
LINE = Message(
    "line",
    (
        Field(1, "order_key", "int64"),
        Field(2, "line_number", "int32", required=True),
        Field(3, "quantity", "float"),
        Field(4, "price", "double"),
        Field(5, "discount", "double", default=0.05),
        Field(6, "flag", "string"),
        Field(7, "day", "sint64"),
        Field(8, "part", "fixed64"),
        Field(9, "tags", "string", repeated=True),
        Field(10, "sizes", "uint32", map_key="string"),
    ),
)
DAY = "datediff(o_orderdate, DATE'1998-01-01')"


def order_records(spark, sf):
    """``orders`` in the shape of :data:`ORDER`."""
    return spread(table(spark, sf, "orders")).select(
        F.col("o_orderkey").cast("decimal(20,0)").alias("order_key"),
        F.expr(DAY).alias("day"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.expr(
            "IF(o_custkey % 7 = 0, NULL, named_struct('key', o_custkey, 'segment', IF(o_custkey % 5 = 0, '', 'seg-' || o_custkey % 11)))"
        ).alias("buyer"),
        F.expr("IF(o_orderkey % 3 = 0, array(o_orderkey), IF(o_orderkey % 3 = 1, array(o_custkey, o_orderkey * 1000, 0), array()))").cast("array<bigint>").alias("digits"),
        F.expr("(o_orderkey * 2654435761) % 4294967296").alias("checksum"),
        F.expr("o_orderpriority = '1-URGENT'").alias("urgent"),
    )


def varint_sql(v: str) -> str:
    """DuckDB: hex of the varint of a non-negative number below 2**42."""
    cases = []
    for n in range(1, 7):
        bytes_ = [f"(({v}) >> {7 * i}) & 127{' | 128' if i < n - 1 else ''}" for i in range(n)]
        text = f"printf('{'%02X' * n}', {', '.join(f'CAST({b} AS BIGINT)' for b in bytes_)})"
        cases.append(f"WHEN ({v}) < {1 << (7 * n)} THEN {text}")
    return f"CASE {' '.join(cases)} END"


def varint_size_sql(v: str) -> str:
    return "CASE " + " ".join(f"WHEN ({v}) < {1 << (7 * n)} THEN {n}" for n in range(1, 7)) + " END"


def bytes_sql(text: str) -> str:
    return f"{varint_sql(f'strlen({text})')} || hex({text})"


def field_sql(tag: str, condition: str, content: str) -> str:
    return f"CASE WHEN {condition} THEN '{tag}' || {content} ELSE '' END"


ZIGZAG = "(CASE WHEN day < 0 THEN -2 * day - 1 ELSE 2 * day END)"
RECORDS = """
base AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(date_diff('day', TIMESTAMP '1998-01-01', o_orderdate) AS BIGINT) AS day,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS status, o_orderpriority AS priority,
  CASE WHEN o_custkey % 5 = 0 THEN '' ELSE 'seg-' || (o_custkey % 11) END AS segment,
  (o_orderkey * 2654435761) % 4294967296 AS checksum FROM orders)"""
BUYER_SQL = f"({field_sql('08', 'c <> 0', varint_sql('c'))} || {field_sql('12', 'segment <> chr(0) AND strlen(segment) > 0', bytes_sql('segment'))})"
PACKED = f"({varint_sql('c')} || {varint_sql('k * 1000')} || '00')"
ORDER_HEX = " || ".join(
    [
        field_sql("08", "k <> 0", varint_sql("k")),
        field_sql("10", "day <> 0", varint_sql(ZIGZAG)),
        field_sql("18", "status <> 0", varint_sql("status")),
        field_sql("22", "priority <> '3-MEDIUM'", bytes_sql("priority")),
        f"CASE WHEN c % 7 <> 0 THEN '2A' || {varint_sql(f'strlen({BUYER_SQL}) // 2')} || {BUYER_SQL} ELSE '' END",
        f"CASE WHEN k % 3 = 0 THEN '30' || {varint_sql('k')} WHEN k % 3 = 1 THEN '32' || {varint_sql(f'strlen({PACKED}) // 2')} || {PACKED} ELSE '' END",
        field_sql("3D", "checksum <> 0", "printf('%02X%02X%02X%02X', CAST(checksum & 255 AS BIGINT), CAST((checksum >> 8) & 255 AS BIGINT), CAST((checksum >> 16) & 255 AS BIGINT), CAST(checksum >> 24 AS BIGINT))"),
        field_sql("A001", "priority = '1-URGENT'", "'01'"),
    ]
)


@R.add("m2_encode_messages", f"WITH {RECORDS} SELECT k AS order_key, {ORDER_HEX} AS payload FROM base")
def m2(spark, sf):
    coded = encode.encode_messages(order_records(spark, sf), ORDER)
    return coded.select(big("order_key").alias("order_key"), F.hex("data").alias("payload"))


@R.add(
    "s10_publish_encoded",
    f"WITH {RECORDS} SELECT 7 + row_number() OVER (ORDER BY k) AS id, {ORDER_HEX} AS payload, "
    "(7 + row_number() OVER (ORDER BY k)) % 4 AS shard FROM base",
)
def s10(spark, sf):
    stored = publish.publish_encoded(order_records(spark, sf), ORDER, "order_key", 7, SHARDS)
    return stored.select("id", F.hex("data").alias("payload"), big("shard").alias("shard"))


ENVELOPE = " || ".join(
    [
        field_sql("08", "turn <> 0", varint_sql("turn")),
        field_sql("10", "conv_id <> 0", varint_sql("conv_id")),
        field_sql("1A", "strlen(role) > 0", bytes_sql("role")),
        field_sql("52", "strlen(text) > 0", bytes_sql("text")),
    ]
)


def envelopes(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("data", text_bytes("text"))
    return encode.pack_sourced(turns, F.col("turn"), F.col("conv_id"), F.col("role"), F.col("data"))


@R.add("m3_pack_sourced", f"SELECT conv_id, turn, {ENVELOPE} AS payload FROM conversations")
def m3_pack(spark, sf):
    return envelopes(spark, sf).select("conv_id", "turn", F.hex("data").alias("payload"))


@R.add("m3_unpack_sourced", "SELECT turn AS source, conv_id AS source_id, role AS source_name, hex(text) AS packet FROM conversations")
def m3_unpack(spark, sf):
    read = decode.unpack_sourced(envelopes(spark, sf).select("data"))
    return read.select(big("source").alias("source"), big("source_id").alias("source_id"), "source_name", F.hex("packet").alias("packet"))


@R.add(
    "s9_publish_sourced",
    f"SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, {ENVELOPE} AS payload FROM conversations",
)
def s9(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("data", text_bytes("text"))
    stored = publish.publish_sourced(turns, F.col("turn"), F.col("conv_id"), F.col("role"), ["conv_id", "turn"], 0, SHARDS)
    return stored.select("id", F.hex("data").alias("payload"))


def line_records(spark, sf):
    """``lineitem`` in the shape of :data:`LINE`."""
    return spread(table(spark, sf, "lineitem")).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_quantity").cast("float").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_returnflag").alias("flag"),
        F.expr("CAST(datediff(l_shipdate, DATE'1998-01-01') AS BIGINT)").alias("day"),
        F.col("l_partkey").cast("decimal(20,0)").alias("part"),
        F.expr("IF(l_linenumber % 2 = 0, array(l_returnflag, '', l_linestatus), NULL)").alias("tags"),
        F.expr("IF(l_linenumber = 3, NULL, map(l_returnflag, l_suppkey, 'z', 0L))").alias("sizes"),
    )


LINE_COLUMNS = """l_orderkey AS order_key, CAST(l_linenumber AS BIGINT) AS line_number, CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS quantity,
  l_extendedprice AS price, l_discount AS discount, l_returnflag AS flag,
  CAST(date_diff('day', TIMESTAMP '1998-01-01', l_shipdate) AS BIGINT) AS day, l_partkey AS part,
  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || '||' || l_linestatus ELSE '' END AS tags,
  CASE WHEN l_linenumber = 3 THEN -1 ELSE l_suppkey END AS size"""


@R.add("m1_decode_messages", f"SELECT {LINE_COLUMNS} FROM lineitem")
def m1(spark, sf):
    coded = encode.encode_messages(line_records(spark, sf), LINE).select("data")
    read = encode.fill_defaults(decode.decode_messages(coded, "data", LINE), LINE)
    return read.select(
        "order_key",
        big("line_number").alias("line_number"),
        F.col("quantity").cast("double").alias("quantity"),
        "price",
        "discount",
        "flag",
        "day",
        big("part").alias("part"),
        F.coalesce(F.array_join("tags", "|"), F.lit("")).alias("tags"),
        F.coalesce(F.element_at("sizes", F.col("flag")), F.lit(-1)).alias("size"),
    )


@R.add("p3_project_fields", "SELECT l_orderkey AS order_key, l_extendedprice AS price FROM lineitem")
def p3(spark, sf):
    coded = encode.encode_messages(line_records(spark, sf), LINE).select("data")
    read = decode.project_fields(coded, "data", LINE, ["order_key", "price"])
    return read.select(F.coalesce("order_key", F.lit(0)).alias("order_key"), F.coalesce("price", F.lit(0.0)).alias("price"))


@R.add(
    "p4_fill_defaults",
    """SELECT l_orderkey AS order_key, coalesce(nullif(l_discount, 0.1), 0.05) AS discount, coalesce(nullif(l_returnflag, 'R'), '') AS flag,
  CAST(coalesce(nullif(l_linenumber, 2), 0) AS BIGINT) AS line_number FROM lineitem""",
)
def p4(spark, sf):
    holes = line_records(spark, sf).select(
        "order_key",
        F.nullif("discount", F.lit(0.1)).alias("discount"),
        F.nullif("flag", F.lit("R")).alias("flag"),
        F.nullif("line_number", F.lit(2)).alias("line_number"),
    )
    return encode.fill_defaults(holes, LINE).withColumn("line_number", big("line_number"))


@R.add(
    "p5_sparse",
    """SELECT l_partkey AS part, CAST(l_linenumber AS BIGINT) AS line_number, nullif(l_orderkey, 0) AS order_key, nullif(l_discount, 0.05) AS discount,
  nullif(CAST(date_diff('day', TIMESTAMP '1998-01-01', l_shipdate) AS BIGINT), 0) AS day, l_linenumber % 2 = 0 AS tagged FROM lineitem""",
)
def p5(spark, sf):
    records = line_records(spark, sf).withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    thin = encode.sparse(records, LINE)
    return thin.select(
        F.coalesce(big("part"), F.lit(0)).alias("part"), big("line_number").alias("line_number"), "order_key", "discount", "day", F.col("tags").isNotNull().alias("tagged")
    )


BUYER_SIZE = f"((CASE WHEN c <> 0 THEN 1 + {varint_size_sql('c')} ELSE 0 END) + (CASE WHEN strlen(segment) > 0 THEN 1 + {varint_size_sql('strlen(segment)')} + strlen(segment) ELSE 0 END))"
PACKED_SIZE = f"({varint_size_sql('c')} + {varint_size_sql('k * 1000')} + 1)"
SIZES = {
    "order_key": f"CASE WHEN k <> 0 THEN 1 + {varint_size_sql('k')} ELSE 0 END",
    "day": f"CASE WHEN day <> 0 THEN 1 + {varint_size_sql(ZIGZAG)} ELSE 0 END",
    "status": "2",
    "priority": "CASE WHEN priority <> '3-MEDIUM' THEN 2 + strlen(priority) ELSE 0 END",
    "buyer": f"CASE WHEN c % 7 <> 0 THEN 1 + {varint_size_sql(BUYER_SIZE)} + {BUYER_SIZE} ELSE 0 END",
    "digits": f"CASE WHEN k % 3 = 0 THEN 1 + {varint_size_sql('k')} WHEN k % 3 = 1 THEN 1 + {varint_size_sql(PACKED_SIZE)} + {PACKED_SIZE} ELSE 0 END",
    "checksum": "CASE WHEN checksum <> 0 THEN 5 ELSE 0 END",
    "urgent": "CASE WHEN priority = '1-URGENT' THEN 3 ELSE 0 END",
}
SIZE_ROWS = " UNION ALL ".join(f"SELECT '{n}' AS field, sum({s}) AS bytes FROM base" for n, s in SIZES.items())


@R.add(
    "a10_payload_size",
    f"WITH {RECORDS}, sizes AS ({SIZE_ROWS}) SELECT field, CAST(bytes AS BIGINT) AS bytes FROM sizes "
    "UNION ALL SELECT 'total', CAST(sum(bytes) AS BIGINT) FROM sizes",
)
def a10(spark, sf):
    return encode.payload_size(order_records(spark, sf), ORDER)


FIELDS = " UNION ALL ".join(f"SELECT '{f.name}' AS field" for f in LINE.fields)


@R.add(
    "m5_roundtrip_report",
    f"SELECT field, (SELECT count(*) FROM lineitem) AS compared, CAST(0 AS BIGINT) AS mismatches FROM ({FIELDS} UNION ALL SELECT 'payload size')",
)
def m5(spark, sf):
    return decode.roundtrip_report(line_records(spark, sf), LINE)


def order_payloads(spark, sf):
    return encode.encode_messages(order_records(spark, sf), ORDER).select(big("order_key").alias("id"), "data")


def _spot(number: int, wire: int, condition: str, length: str) -> str:
    return f"SELECT k AS id, CAST({number} AS BIGINT) AS field_no, {wire} AS wire_type, CAST({length} AS BIGINT) AS len FROM base WHERE {condition}"


SPOTS = " UNION ALL ".join(
    [
        _spot(1, 0, "k <> 0", varint_size_sql("k")),
        _spot(2, 0, "day <> 0", varint_size_sql(ZIGZAG)),
        _spot(3, 0, "true", "1"),
        _spot(4, 2, "priority <> '3-MEDIUM'", "strlen(priority)"),
        _spot(5, 2, "c % 7 <> 0", BUYER_SIZE),
        _spot(6, 0, "k % 3 = 0", varint_size_sql("k")),
        _spot(6, 2, "k % 3 = 1", PACKED_SIZE),
        _spot(7, 5, "checksum <> 0", "4"),
        _spot(20, 0, "priority = '1-URGENT'", "1"),
    ]
)


#: Orders whose payload lost its last byte, which breaks its last field.
DAMAGED = "{0} % 50 = 7"


def damaged_payloads(spark, sf):
    """:func:`order_payloads`, a share of them cut short."""
    cut = F.expr("substring(data, 1, length(data) - 1)")
    return order_payloads(spark, sf).withColumn("data", F.when(F.expr(DAMAGED.format("id")), cut).otherwise(F.col("data")))


WHOLE_SPOTS = f"spots AS (SELECT * FROM ({SPOTS}) WHERE NOT {DAMAGED.format('id')}), broken AS (SELECT k FROM base WHERE {DAMAGED.format('k')})"


@R.add(
    "m4_wire_scan",
    f"""WITH {RECORDS}, {WHOLE_SPOTS} SELECT id, field_no, CAST(wire_type AS BIGINT) AS wire_type, len, false AS broken FROM spots
UNION ALL SELECT k, NULL, NULL, NULL, true FROM broken""",
)
def m4(spark, sf):
    found = decode.wire_scan(damaged_payloads(spark, sf), "data")
    broken = F.col("_error").isNotNull().alias("broken")
    return found.select("id", "field_no", big("wire_type").alias("wire_type"), big("len").alias("len"), broken)


@R.add(
    "a11_field_census",
    f"""WITH {RECORDS}, {WHOLE_SPOTS} SELECT field_no, CAST(wire_type AS BIGINT) AS wire_type, count(*) AS occurrences,
  count(DISTINCT id) AS messages, CAST(sum(len) AS BIGINT) AS bytes FROM spots GROUP BY ALL
UNION ALL SELECT NULL, NULL, 0, count(*), 0 FROM broken HAVING count(*) > 0""",
)
def a11(spark, sf):
    return decode.field_census(damaged_payloads(spark, sf), "data").withColumn("wire_type", big("wire_type"))


#: An older declaration: no ``urgent``, ``status`` as text, ``digits`` not a list.
OLD_ORDER = Message(
    "order",
    (
        Field(1, "order_key", "uint64"),
        Field(2, "day", "sint32"),
        Field(3, "status", "string"),
        Field(4, "priority", "string"),
        Field(5, "buyer", BUYER),
        Field(6, "digit", "int64"),
        Field(7, "checksum", "fixed32"),
    ),
)


@R.add(
    "a12_schema_drift",
    f"""WITH {RECORDS}, {WHOLE_SPOTS}, known(field_no, field, wire) AS (VALUES (3, 'status', 2), (6, 'digit', 0))
SELECT s.field_no, CAST(s.wire_type AS BIGINT) AS wire_type, field, CASE WHEN field IS NULL THEN 'unknown' ELSE 'wire_type' END AS drift,
  count(*) AS occurrences, count(DISTINCT id) AS messages
FROM spots s LEFT JOIN known k ON k.field_no = s.field_no
WHERE s.field_no = 20 OR (k.wire IS NOT NULL AND k.wire <> s.wire_type) GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, 'broken', 0, count(*) FROM broken HAVING count(*) > 0""",
)
def a12(spark, sf):
    census = decode.field_census(damaged_payloads(spark, sf), "data")
    return decode.schema_drift(census, OLD_ORDER).withColumn("wire_type", big("wire_type"))
