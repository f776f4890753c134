"""Wire payloads to typed records, and reports on payload columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.messages import BYTES, FIXED32, FIXED64, SOURCED, VARINT, Message
from tidelog.functions.wire_arrow import decode_batch, scan_batch
from tidelog.operators.encode import encode_messages, entries_by_key, fill_defaults, message_size, sparse
from tidelog.session import ship

OCCURRENCES = T.ArrayType(
    T.StructType(
        [
            T.StructField("field_no", T.LongType()),
            T.StructField("wire_type", T.IntegerType()),
            T.StructField("nth", T.IntegerType()),
            T.StructField("pos", T.IntegerType()),
            T.StructField("len", T.IntegerType()),
            T.StructField("raw", T.BinaryType()),
        ]
    )
)


def decode_column(column: Column, message: Message, fields: list[str] | None = None) -> Column:
    """``struct<value, error>`` of a payload column; only this column goes to Python."""
    result = T.StructType(
        [T.StructField("value", message.schema(fields)), T.StructField("error", T.StringType())]
    )

    @F.arrow_udf(result)
    def decode(payload: pa.Array) -> pa.Array:
        values, errors = decode_batch(payload, message, fields)
        return pa.StructArray.from_arrays([values, errors], names=["value", "error"])

    return decode(column)


def decode_messages(
    df: DataFrame,
    col: str,
    message: Message,
    fields: list[str] | None = None,
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """Add the fields of ``message`` as columns. Absent fields are null; the last value
    of a single field wins; lists may be packed or not; unknown fields are skipped. A
    broken payload gives nulls and ``_error``, or fails the job with ``FAILFAST``."""
    if mode not in ("PERMISSIVE", "FAILFAST"):
        raise ValueError(f"unknown mode: {mode}")
    ship(df.sparkSession)
    decoded = df.withColumn("_decoded", decode_column(F.col(col), message, fields))
    if mode == "FAILFAST":
        failure = F.raise_error(F.concat(F.lit("broken payload: "), F.col("_decoded.error")))
        decoded = decoded.withColumn(
            "_decoded", F.when(F.col("_decoded.error").isNotNull(), failure.cast(decoded.schema["_decoded"].dataType)).otherwise(F.col("_decoded"))
        )
    names = [f.name for f in message.chosen(fields)]
    columns = [
        F.col(f"_decoded.value.{f.name}").alias(f.name, metadata={"number": f.number})
        for f in message.chosen(fields)
    ]
    kept = [c for c in df.columns if c not in names and c != "_error"]
    error = [F.col("_decoded.error").alias("_error")] if mode == "PERMISSIVE" else []
    return decoded.select(*kept, *columns, *error)


def project_fields(df: DataFrame, col: str, message: Message, fields: list[str]) -> DataFrame:
    """Decode a few fields: one walk over the tags, other values are stepped over."""
    return decode_messages(df, col, message, fields)


def unpack_sourced(df: DataFrame, col: str = "data") -> DataFrame:
    """The envelope fields of a payload column, absent ones at their zero."""
    return fill_defaults(decode_messages(df, col, SOURCED), SOURCED)


def wire_scan(df: DataFrame, col: str, depth: int = 1) -> DataFrame:
    """One row per field occurrence: ``path, field_no, wire_type, nth, pos, len, raw``
    next to the columns of ``df``. ``nth`` counts a field within its payload. A broken
    payload is one row with ``_error`` and no field. With more ``depth``, length-delimited
    values that read as payloads are scanned as well."""
    ship(df.sparkSession)
    result_type = T.StructType([T.StructField("found", OCCURRENCES), T.StructField("error", T.StringType())])

    @F.arrow_udf(result_type)
    def scan(payload: pa.Array) -> pa.Array:
        found, errors = scan_batch(payload)
        return pa.StructArray.from_arrays([found, errors], names=["found", "error"])

    kept = [c for c in df.columns if c not in (col, "_error")]
    scanned = df.select(*kept, scan(F.col(col)).alias("_scan"))
    found = scanned.select(*kept, F.col("_scan.error").alias("_error"), F.inline_outer("_scan.found"))
    found = found.where(F.col("field_no").isNotNull() | F.col("_error").isNotNull())
    level = found.withColumn("path", F.col("field_no").cast("string"))
    columns = [*kept, "path", "field_no", "wire_type", "nth", "pos", "len", "raw", "_error"]
    result = level.select(*columns)
    for _ in range(depth - 1):
        nested = level.where((F.col("wire_type") == BYTES) & (F.col("len") > 0))
        nested = nested.select(*kept, "_error", F.col("path").alias("_up"), scan(F.col("raw")).alias("_scan"))
        nested = nested.select(*kept, "_error", "_up", F.inline("_scan.found"))
        level = nested.withColumn("path", F.concat_ws(".", "_up", F.col("field_no").cast("string")))
        result = result.unionByName(level.select(*columns))
    return result


def field_census(df: DataFrame, col: str) -> DataFrame:
    """``field_no, wire_type, occurrences, messages, bytes`` of a corpus. A payload's
    first occurrence of a field counts the payload, so nothing has to be made distinct.
    Broken payloads are the ``messages`` of a row without a field."""
    return (
        wire_scan(df.select(col), col)
        .groupBy("field_no", "wire_type")
        .agg(
            F.count("field_no").alias("occurrences"),
            F.count_if((F.col("nth") == 1) | F.col("_error").isNotNull()).alias("messages"),
            F.coalesce(F.sum(F.col("len").cast("long")), F.lit(0)).alias("bytes"),
        )
    )


def schema_drift(census: DataFrame, message: Message) -> DataFrame:
    """Census rows that do not fit the declared fields: ``unknown`` numbers, ``wire_type``
    mismatches (a packed block is fine for a list of numbers) and ``broken`` payloads."""
    wires = {VARINT: "varint", FIXED64: "fixed64", BYTES: "bytes", FIXED32: "fixed32"}
    declared = []
    for f in message.fields:
        wire = BYTES if f.map_key is not None else f.wire
        declared.append((f.number, f.name, wire, wires[wire], f.repeated and wire != BYTES))
    known = census.sparkSession.createDataFrame(
        declared, "field_no long, field string, declared int, declared_name string, packs boolean"
    )
    seen = census.join(F.broadcast(known), "field_no", "left")
    fits = (F.col("wire_type") == F.col("declared")) | (F.col("packs") & (F.col("wire_type") == BYTES))
    drift = F.when(F.col("field_no").isNull(), "broken").when(F.col("declared").isNull(), "unknown").when(~fits, "wire_type")
    return (
        seen.withColumn("drift", drift)
        .where(F.col("drift").isNotNull())
        .select("field_no", "wire_type", "field", "drift", "occurrences", "messages")
    )


def roundtrip_report(df: DataFrame, message: Message) -> DataFrame:
    """``field, compared, mismatches``: rows whose field differs after encoding and
    decoding, and under ``payload size`` those whose size was not predicted."""
    names = [f.name for f in message.fields]
    before = sparse(df.select(*names), message)
    coded = encode_messages(before, message, "_data").withColumn("_size", message_size(message, F.col))
    both = coded.select(
        F.struct(*names).alias("_before"),
        "_size",
        F.octet_length("_data").cast("long").alias("_bytes"),
        "_data",
    )
    read = sparse(decode_messages(both, "_data", message), message)

    def comparable(field, value: Column) -> Column:
        return entries_by_key(value) if field.map_key is not None else value

    wrong = [
        F.count_if(~comparable(f, F.col(f"_before.{f.name}")).eqNullSafe(comparable(f, F.col(f.name)))).alias(f"m{i}")
        for i, f in enumerate(message.fields)
    ]
    totals = read.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_size") != F.col("_bytes")).alias("s"), *wrong
    )
    rows = [
        F.struct(F.lit(label).alias("field"), F.col("n").alias("compared"), F.col(c).alias("mismatches"))
        for label, c in [*[(n, f"m{i}") for i, n in enumerate(names)], ("payload size", "s")]
    ]
    return totals.select(F.inline(F.array(*rows)))
