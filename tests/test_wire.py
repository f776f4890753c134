"""Wire payloads: fixed vectors, round trips, broken input."""

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidelog.functions.messages import SCALARS, Enum, Field, Message
from tidelog.functions.wire import fixed_hex, tag_hex, unzigzag, varint_hex, varint_size, zigzag
from tidelog.operators.decode import (
    decode_messages,
    field_census,
    project_fields,
    roundtrip_report,
    schema_drift,
    unpack_sourced,
    wire_scan,
)
from tidelog.operators.encode import encode_messages, fill_defaults, pack_sourced, payload_size, sparse

NESTED = Message("nested", (Field(1, "bb", "int32"),))
ENUM = Enum("enum", (("FOO", 1), ("BAR", 2), ("BAZ", 3), ("NEG", -1), ("ALIAS", 1)))


def one(spark, message, **values):
    row = tuple(values.get(f.name) for f in message.fields)
    return spark.createDataFrame([row], message.schema())


def payload(spark, message, **values):
    return bytes(encode_messages(one(spark, message, **values), message).first()["data"])


def read(spark, data, message, **options):
    df = spark.createDataFrame([(bytearray(d),) for d in data], "data binary").coalesce(1)
    return decode_messages(df, "data", message, **options)


def test_numbers(spark):
    values = [0, 1, 127, 128, 300, 2**14 - 1, 2**14, 2**28, 2**35, 2**49, 2**56 - 1, 2**56, 2**63 - 1]
    values += [-1, -32, -(2**63)] + [2 ** (7 * n) - 1 for n in range(1, 9)]

    def varint(v):
        v &= 2**64 - 1
        out = bytearray()
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        return bytes([*out, v]).hex().upper()

    df = spark.createDataFrame([(v,) for v in values], "v long")
    found = df.select(
        "v",
        F.expr(varint_hex("v")).alias("hex"),
        varint_size(F.col("v")).alias("size"),
        F.expr(fixed_hex("v", 8)).alias("fixed"),
        F.expr(fixed_hex("v", 4)).alias("half"),
        unzigzag(zigzag(F.col("v"))).alias("back"),
    )
    for r in found.collect():
        raw = (r["v"] & (2**64 - 1)).to_bytes(8, "little").hex().upper()
        assert r["hex"] == varint(r["v"]) and r["size"] == len(r["hex"]) // 2
        assert (r["fixed"], r["half"], r["back"]) == (raw, raw[:8], r["v"])


def test_vectors(spark):
    assert payload(spark, Message("m", (Field(1, "a", "int64"),)), a=-32).hex() == "08e0ffffffffffffffff01"
    assert payload(spark, Message("m", (Field(18, "n", NESTED),)), n=(118,)).hex() == "9201020876"
    assert len(payload(spark, Message("m", (Field(1, "b", "bool"),)), b=True)) == 2
    signed = Message("m", (Field(1, "a", "sint64"),))
    assert read(spark, [bytes.fromhex("08d401")], signed).first()["a"] == 106
    assert tag_hex(16, 2) == "8201"
    with pytest.raises(ValueError):
        tag_hex(1 << 31, 0)


KINDS = list(SCALARS)
SINGLE = [Field(i + 1, f"o_{k}", k) for i, k in enumerate(KINDS)]
LISTS = [Field(i + 31, f"r_{k}", k, repeated=True) for i, k in enumerate(KINDS)]


def value(kind, n):
    return {
        "bool": n % 2 == 1,
        "string": f"é{n}",
        "bytes": bytearray([n % 256, 0, 255]),
        "float": -1.5 * n,
        "double": -0.1 * n,
    }.get(kind, Decimal(2**64 - n) if kind in ("uint64", "fixed64") else 2**32 - n if kind in ("uint32", "fixed32") else -n)


def test_all_scalars(spark):
    message = Message("all", tuple(SINGLE))
    rows = [tuple(value(k, n) for k in KINDS) for n in (1, 2, 100)] + [tuple(None for _ in KINDS)]
    df = spark.createDataFrame(rows, message.schema()).coalesce(1)
    back = decode_messages(encode_messages(df, message).select("data"), "data", message).collect()
    thin = sparse(df, message).collect()
    for want, got in zip(thin, back):
        assert got["_error"] is None
        assert [want[f.name] for f in message.fields] == [got[f.name] for f in message.fields]


def test_all_lists(spark):
    message = Message("lists", tuple(LISTS))
    rows = [tuple([value(k, n + j) for j in range(n)] or None for k in KINDS) for n in range(4)]
    df = spark.createDataFrame(rows, message.schema()).coalesce(1)
    back = decode_messages(encode_messages(df, message).select("data"), "data", message).collect()
    for want, got in zip(df.collect(), back):
        assert [want[f.name] for f in message.fields] == [got[f.name] for f in message.fields]


RICH = Message(
    "rich",
    (
        Field(1, "nested", NESTED),
        Field(2, "items", NESTED, repeated=True),
        Field(3, "by_text", "int32", map_key="string"),
        Field(4, "by_number", NESTED, map_key="int32"),
        Field(5, "kind", ENUM),
        Field(6, "kinds", ENUM, repeated=True),
        Field(7, "deep", Message("deep", (Field(1, "inner", NESTED), Field(2, "names", "string", repeated=True)))),
        Field(8, "deeps", Message("deep", (Field(1, "inner", NESTED), Field(2, "sizes", "sint32", repeated=True))), repeated=True),
        Field(61, "limit", "int32", default=401),
        Field(62, "word", "string", default="415"),
        Field(63, "must", "int64", required=True),
    ),
)
RICH_ROWS = [
    ((5,), [None, (1,), None], {"z": 1, "a": 300}, {0: None, 2: (2,), 3: None}, -1, [1, 99, -1], ((7,), ["x", "", "yy"]), [((1,), [1, -2, 300]), None], 7, "w", 1),
    (None, None, None, None, 1, None, None, None, 401, "415", 0),
    ((0,), [(300,)], {"": 0}, {100: (7,)}, 0, [2], (None, None), [(None, [4])], 0, "", -1),
    tuple(None for _ in range(11)),
]


def test_rich_round_trip(spark):
    df = spark.createDataFrame(RICH_ROWS, RICH.schema()).coalesce(1)
    report = roundtrip_report(df.limit(2), RICH).collect()
    assert {r["field"]: r["mismatches"] for r in report} == {**{f.name: 0 for f in RICH.fields}, "payload size": 0}
    coded = encode_messages(df, RICH)
    back = decode_messages(coded.select("data"), "data", RICH).collect()
    assert back[0]["items"][0] is None and back[0]["items"][1]["bb"] == 1
    assert back[0]["by_number"] == {0: None, 2: (2,), 3: None}
    assert back[0]["kinds"] == [1, 99, -1]
    assert back[2]["nested"] is None  # an empty submessage reads as null
    assert back[3]["must"] == 0 and back[3]["limit"] is None
    sizes = {r["field"]: r["bytes"] for r in payload_size(df, RICH).collect()}
    assert sizes["total"] == sum(len(r["data"]) for r in coded.collect())
    filled = fill_defaults(spark.createDataFrame(back, decode_messages(coded.select("data"), "data", RICH).schema), RICH)
    assert [r["limit"] for r in filled.collect()] == [7, 401, 0, 401]


def test_reading_rules(spark):
    single = Message("m", (Field(1, "a", "int32"), Field(2, "n", NESTED), Field(3, "list", "int32", repeated=True)))
    data = {
        "080108ff01": 255,  # the last value wins
        "08ffffffffffffffff7f": -1,  # truncated to 32 bits
        "f8070108 05".replace(" ", ""): 5,  # unknown field
        "a3010b08010ca4010803": 3,  # nested group skipped
    }
    for text, want in data.items():
        row = read(spark, [bytes.fromhex(text)], single).first()
        assert (row["a"], row["_error"]) == (want, None), text
    mixed = read(spark, [bytes.fromhex("18011a0202031804")], single).first()
    assert mixed["list"] == [1, 2, 3, 4]
    twice = read(spark, [bytes.fromhex("12020801120208051200")], single).first()
    assert twice["n"] is None  # sent again, empty: last wins without merging


def test_enum_list_may_be_packed(spark):
    message = Message("m", (Field(1, "kinds", ENUM, repeated=True),))
    assert read(spark, [bytes.fromhex("0a020102"), bytes.fromhex("08010802")], message).select("kinds").collect() == [
        ([1, 2],),
        ([1, 2],),
    ]


def test_map_rules(spark):
    message = Message("m", (Field(1, "m", "int32", map_key="string"),))
    data = bytes.fromhex("0a050a016110010a050a016110020a0210070a030a0162")
    assert read(spark, [data], message).first()["m"] == {"a": 2, "": 7, "b": 0}


BROKEN = ["08", "920102", "0f", "08ffffffffffffffffff02", "ffffffffff7f01", "0b0801", "1a020180", "12020880"]


def test_broken_payloads(spark):
    message = Message("m", (Field(1, "a", "int32"), Field(2, "n", NESTED), Field(3, "l", "int32", repeated=True), Field(18, "x", NESTED)))
    rows = read(spark, [bytes.fromhex(t) for t in ["0801", *BROKEN]], message).collect()
    assert rows[0]["_error"] is None and rows[0]["a"] == 1
    for text, row in zip(BROKEN, rows[1:]):
        # a list block that ends inside a number still gives the field's other bytes
        assert row["_error"] is not None, text
        assert row["a"] is None
    with pytest.raises(Exception, match="broken payload"):
        read(spark, [bytes.fromhex("08")], message, mode="FAILFAST").collect()


def test_null_payload(spark):
    df = spark.createDataFrame([(None,), (bytearray(),)], "data binary").coalesce(1)
    rows = decode_messages(df, "data", NESTED).collect()
    assert [(r["bb"], r["_error"]) for r in rows] == [(None, None), (None, None)]


def test_defaults(spark):
    message = Message("m", (Field(1, "i", "double", default=math.inf), Field(2, "n", "double", default=math.nan), Field(3, "t", "uint64", default=2**64 - 1)))
    df = one(spark, message)
    row = fill_defaults(df, message).first()
    assert row["i"] == math.inf and math.isnan(row["n"]) and row["t"] == 2**64 - 1
    assert payload(spark, message, i=math.inf, n=math.nan, t=Decimal(2**64 - 1)) == b""


def test_envelope(spark):
    df = spark.createDataFrame([(3, 2**40, "src", bytearray(b"body"))], "s int, i long, n string, p binary")
    coded = pack_sourced(df, F.col("s"), F.col("i"), F.col("n"), F.col("p"))
    row = unpack_sourced(coded.select("data")).first()
    assert (row["source"], int(row["source_id"]), row["source_name"], bytes(row["packet"])) == (3, 2**40, "src", b"body")
    empty = unpack_sourced(spark.createDataFrame([(bytearray(),)], "data binary")).first()
    assert (empty["source"], empty["source_id"], empty["source_name"], bytes(empty["packet"])) == (0, 0, "", b"")


def test_scan_and_census(spark):
    data = bytes.fromhex("0801080212020876")
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(data[:2]))], "id long, data binary").coalesce(1)
    found = [(r["id"], r["path"], r["wire_type"], r["nth"], r["pos"], r["len"]) for r in wire_scan(df, "data", depth=2).collect()]
    assert sorted(found) == [(1, "1", 0, 1, 0, 1), (1, "1", 0, 2, 2, 1), (1, "2", 2, 1, 4, 2), (1, "2.1", 0, 1, 0, 1), (2, "1", 0, 1, 0, 1)]
    census = field_census(df, "data")
    assert {(r["field_no"], r["occurrences"], r["messages"], r["bytes"]) for r in census.collect()} == {(1, 3, 2, 3), (2, 1, 1, 2)}
    drift = schema_drift(census, Message("m", (Field(1, "a", "string"),))).collect()
    assert {(r["field_no"], r["drift"]) for r in drift} == {(1, "wire_type"), (2, "unknown")}


def test_broken_payloads_are_counted(spark):
    rows = [(1, bytearray.fromhex("0801")), (2, bytearray.fromhex("080112050876")), (3, None), (4, bytearray())]
    df = spark.createDataFrame(rows, "id long, data binary")
    found = [(r["id"], r["field_no"], r["_error"] is not None) for r in wire_scan(df, "data").collect()]
    assert sorted(found) == [(1, 1, False), (2, None, True)]
    census = field_census(df, "data")
    assert {(r["field_no"], r["occurrences"], r["messages"], r["bytes"]) for r in census.collect()} == {(1, 1, 1, 1), (None, 0, 1, 0)}
    drift = schema_drift(census, Message("m", (Field(1, "a", "int32"),))).collect()
    assert [(r["field_no"], r["drift"], r["messages"]) for r in drift] == [(None, "broken", 1)]


def test_projection_skips_other_fields(spark):
    message = Message("m", (Field(1, "a", "int32"), Field(2, "n", NESTED)))
    # the submessage is broken inside, but it is not asked for
    row = project_fields(spark.createDataFrame([(bytearray.fromhex("080112020880"),)], "data binary"), "data", message, ["a"]).first()
    assert (row["a"], row["_error"]) == (1, None)
    assert decode_messages(spark.createDataFrame([(bytearray(b"\x08\x01"),)], "data binary"), "data", message).schema["a"].metadata == {"number": 1}
