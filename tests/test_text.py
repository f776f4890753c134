"""Typed text, names, paths and named SQL."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.typed_text import instant_nanos, instant_of, nanos_between, typed_columns, typed_errors
from tidelog.operators import names
from tidelog.plans import sqlbook

SECOND = 1_000_000_000
DURATIONS = {
    "1h30m": 5400 * SECOND,
    "500ms": 500_000_000,
    "-1.5s": -1_500_000_000,
    "+.5s": 500_000_000,
    "1.s": SECOND,
    "1µs3ns": 1003,
    "1μs": 1000,
    "0": 0,
    "42": 42,
    "9223372036854775807": 2**63 - 1,
    "2562047h47m16.854775807s": 2**63 - 1,
    "9223372036854775808": None,
    "2562047h47m16.854775808s": None,
    "99999999999999999999h": None,
    "": None,
    "abc": None,
    "1h-2m": None,
    "1 h": None,
    "1x": None,
    ".s": None,
}
TIMES = {
    "2024-01-02T03:04:05Z": (1704164645000000, 0),
    "2024-01-02T03:04:05.123456789+02:30": (1704155645123456, 9000),
    "2024-01-02T03:04:05,5-01:00": (1704168245500000, -3600),
    "2024-01-02": None,
    "2024-02-30T00:00:00Z": None,
    "2024-01-02 03:04:05Z": None,
    "2024-01-02T03:04:05": None,
    "2024-01-02T3:04:05Z": None,
}


def test_padded_durations(spark):
    texts = ["0" * 40 + "1h", "-" + "0" * 40 + "2.5s", "0" * 40 + "7", "0" * 40 + "s", "9" * 40 + "h"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    found = [r["t_ns"] for r in typed_columns(df, {"t": "duration"}).collect()]
    assert found == [3_600_000_000_000, -2_500_000_000, 7, 0, None]


def test_durations(spark):
    df = spark.createDataFrame([(t,) for t in [*DURATIONS, None]], "t string")
    for r in typed_columns(df, {"t": "duration"}).collect():
        want = DURATIONS.get(r["t"])
        assert (r["t_ns"], r["t_error"]) == (want, r["t"] is not None and want is None), r["t"]


def test_times(spark):
    df = spark.createDataFrame([(t,) for t in [*TIMES, None]], "t string")
    typed = typed_columns(df, {"t": "time"}).withColumn("micros", F.unix_micros("t_time"))
    for r in typed.collect():
        want = TIMES.get(r["t"])
        assert (r["micros"], r["t_offset"]) == (want or (None, None)), r["t"]
        assert r["t_error"] == (r["t"] is not None and want is None)
    counts = typed_errors(df, {"t": "time"}).first()
    assert (counts["column"], counts["present"], counts["errors"]) == ("t", 8, 5)


INSTANTS = {
    "2031-05-06T07:08:09.123456789Z": (1935817689, 123_456_789),
    "2031-05-06T07:08:09.1234567891Z": (1935817689, 123_456_789),
    "2031-05-06T07:08:09,000000001+01:00": (1935814089, 1),
    "2031-05-06T07:08:09Z": (1935817689, 0),
    "1969-12-31T23:59:59.9Z": (-1, 900_000_000),
    "1969-12-31T23:59:58Z": (-2, 0),
    "2031-05-06": None,
    "2031-02-30T00:00:00.1Z": None,
    "2031-05-06T07:08:09.Z": None,
}


def test_instants(spark):
    df = spark.createDataFrame([(t,) for t in [*INSTANTS, None]], "t string")
    for r in typed_columns(df, {"t": "instant"}).collect():
        want = INSTANTS.get(r["t"])
        assert (tuple(r["t_instant"]) if r["t_instant"] else None) == want, r["t"]
        assert r["t_error"] == (r["t"] is not None and want is None) and (r["t_offset"] is None) == (want is None)


def test_instants_in_order(spark):
    pairs = [((-1, 999_999_999), (0, 0), 1), ((5, 3), (5, 2), -1), ((-(10**10), 0), (10**10, 0), None), ((7, 7), (7, 7), 0)]
    kind = "struct<seconds: long, nanos: int>"
    df = spark.createDataFrame([(a, b, w) for a, b, w in pairs], f"a {kind}, b {kind}, w long")
    a, b = F.col("a"), F.col("b")
    for r in df.select("*", nanos_between(a, b).alias("gap"), (a < b).alias("less"), instant_of(instant_nanos(a)).alias("back")).collect():
        assert r["gap"] == r["w"] and r["less"] == (r["a"] < r["b"]) and r["back"] == r["a"]


def test_scopes(spark):
    df = spark.createDataFrame([("a.b.c",), ("",)], "s string")
    assert [r[0] for r in df.select(names.scope_chain(F.col("s"))).collect()] == [["a.b.c", "a.b", "a", ""], [""]]


def test_longest_prefix(spark):
    refs = spark.createDataFrame([(1, "a.b", "T"), (2, "a", "T"), (3, "", "T"), (4, "x.y", "U"), (5, "a.b", "in.T")], "k int, scope string, name string")
    defs = spark.createDataFrame([("a.b.T", 10), ("T", 11), ("a.in.T", 12)], "full_name string, def int")
    found = {r["k"]: r["def"] for r in names.longest_prefix_join(refs, defs).collect()}
    assert found == {1: 10, 2: 11, 3: 11, 4: None, 5: 12}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_longest_prefix_of_a_hot_pair(spark, limit):
    refs = spark.range(4000).selectExpr("id AS k", "if(id % 2 = 0, 'a.b', 's' || id % 700) AS scope", "if(id % 2 = 0, 'T', 'n' || id % 90) AS name")
    defs = spark.range(90).selectExpr("'n' || id AS full_name", "int(id) AS def").unionByName(
        spark.createDataFrame([("a.T", 500), ("T", 600), ("s7.n7", 700)], "full_name string, def int"))
    found = {r["k"]: r["def"] for r in names.longest_prefix_join(refs, defs, limit).collect()}
    want = {k: 500 if k % 2 == 0 else 700 if k % 700 == 7 and k % 90 == 7 else k % 90 for k in range(4000)}
    assert found == want


def test_common_path(spark):
    groups = {
        "three": ["/srv/media/2031/jun/x.raw", "/srv/media/2031/july", "/srv/media/20"],
        "same": ["/a/b/c", "/a/b/c"],
        "parts": ["/ab/cd", "/ab/ce"],
    }
    df = spark.createDataFrame([(g, p) for g, ps in groups.items() for p in ps], "g string, p string")
    found = {r["g"]: (r["prefix"], r["root"]) for r in names.common_path(df, ["g"], "p").collect()}
    assert found == {"three": ("/srv/media/20", "/srv/media"), "same": ("/a/b/c", "/a/b"), "parts": ("/ab/c", "/ab")}


def test_path_parts(spark):
    df = spark.createDataFrame([("/var/harbour/logs/tide.txt", "/var/harbour")], "p string, b string")
    p = F.col("p")
    row = df.select(names.subtract_path(p, F.col("b")), names.file_name(p), names.dir_name(p)).first()
    assert tuple(row) == ("/logs/tide.txt", "tide.txt", "/var/harbour/logs")


BOOK = sqlbook.parse_book(
    """
-- name: select-one
select 1;

-- name: pick
-- a comment with ? and :name
select v from numbers where v in (?) and v > ? and '?' = '?';

-- name: named
select v, :label as label from numbers where v in (:list) and v <> :not::bigint;
"""
)


def test_named_query(spark):
    spark.range(2000).selectExpr("id AS v").createOrReplaceTempView("numbers")
    assert sqlbook.named_query(spark, BOOK, "select-one").collect() == [(1,)]
    assert [r["v"] for r in sqlbook.named_query(spark, BOOK, "pick", [3, 5, 9], 4).collect()] == [5, 9]
    assert sqlbook.named_query(spark, BOOK, "pick", list(range(1500)), 1400).count() == 99
    rows = sqlbook.named_query(spark, BOOK, "named", list=[1, 2], label="it's", **{"not": 2}).collect()
    assert rows == [(1, "it's")]


@pytest.mark.parametrize("args, error", [(([], 1), ValueError), (([1],), ValueError), (([1], 2, 3), ValueError)])
def test_wrong_arguments(spark, args, error):
    with pytest.raises(error):
        sqlbook.named_query(spark, BOOK, "pick", *args)


def test_unknown_query(spark):
    with pytest.raises(KeyError):
        sqlbook.named_query(spark, BOOK, "nothing")
    with pytest.raises(ValueError):
        sqlbook.named_query(spark, BOOK, "named", label="x")


def test_books_of_a_folder(tmp_path):
    (tmp_path / "a.sql").write_text("-- name: x\nselect 1;\n-- name: y\nselect 2;")
    (tmp_path / "b.sql").write_text("-- name: x\nselect 3;")
    (tmp_path / "c.txt").write_text("-- name: z\nselect 4;")
    assert sqlbook.load_books(str(tmp_path)) == {"x": "select 3", "y": "select 2"}


def test_fetch_as_is_strict(spark):
    df = spark.range(3).selectExpr("id", "CAST(id AS STRING) AS name")
    shape = T.StructType([T.StructField("name", T.StringType()), T.StructField("id", T.LongType())])
    assert sqlbook.fetch_as(df, shape).columns == ["name", "id"]
    with pytest.raises(ValueError, match="extra"):
        sqlbook.fetch_as(df.withColumn("more", F.lit(1)), shape)
    with pytest.raises(ValueError, match="missing"):
        sqlbook.fetch_as(df.drop("name"), shape)


def test_path_algebra(spark):
    cases = {
        "/a//b/f": ("/a/b/f", "/a/c", "b/f"),
        "/a/./b/../c": ("/a/c", "/a", "c"),
        "/../x": ("/x", "/x", ""),
        "../k/../m": ("../m", "../n", "m"),
        "./": (".", "q", ""),
        "": (".", "", ""),
        "/": ("/", "/a/b", ""),
        "/p/q": ("/p/q", "/p/q/r", ""),
        "/p/q/r/s": ("/p/q/r/s", "/p/q", "r/s"),
        "/p/q/r": ("/p/q/r", "/z", "p/q/r"),
    }
    df = spark.createDataFrame([(p, b) for p, (_, b, _) in cases.items()], "p string, b string")
    found = {r["p"]: (r["n"], r["b"], r["r"]) for r in df.select("p", "b", names.normal_path(F.col("p")).alias("n"), names.rest_after(F.col("p"), F.col("b")).alias("r")).collect()}
    assert found == cases
    paths = spark.createDataFrame([("/a//b/f",), ("/a/b/f",), ("/a/x/../b/g",), ("/top",), ("",)], "path string")
    rolled = {r["dir"]: (r["depth"], r["files"], r["names"]) for r in names.path_rollup(paths, "path").collect()}
    assert rolled == {"": (0, 5, 4), "/a": (1, 3, 2), "/a/b": (2, 3, 2)}
