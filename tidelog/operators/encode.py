"""Typed records to wire payloads, and their exact sizes, as native expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.messages import BYTES, FIXED32, SOURCED, VARINT, Field, Message
from tidelog.functions.wire import each, fixed_hex, let, tag_hex, varint_hex, varint_size, wire_long

EMPTY = b""
#: SQL of the varint size of a long ``v``.
SIZE = "(length(bin(v)) + 6) DIV 7"


def zero_literal(field: Field) -> Column:
    """The value that is not written: the declared default or the zero of the type."""
    value = field.zero()
    wide = isinstance(value, int) and field.scalar in ("uint64", "fixed64")
    return F.lit(str(value) if wide else value).cast(field.spark_type())


def is_written(field: Field, value: Column) -> Column:
    """Whether a field appears in the payload."""
    if field.map_key is not None or field.repeated:
        return F.coalesce(F.size(value) > 0, F.lit(False))
    if field.required:
        return F.lit(True)
    if field.is_message:
        return value.isNotNull()
    return F.coalesce(value != zero_literal(field), F.lit(False))


def fill_defaults(df: DataFrame, message: Message) -> DataFrame:
    """Absent fields read as their declared default or the zero of the type."""
    filled = {
        f.name: F.coalesce(F.col(f.name), zero_literal(f))
        for f in message.fields
        if f.zero() is not None and f.name in df.columns
    }
    return df.withColumns(filled)


def sparse(df: DataFrame, message: Message) -> DataFrame:
    """Fields at their default become null, empty lists and maps too, unless required."""
    return df.withColumns(
        {
            f.name: F.when(is_written(f, F.col(f.name)), F.col(f.name))
            for f in message.fields
            if not f.required
        }
    )


class Stages:
    """Names for intermediate values: temporary columns, added level by level, so that
    generated code computes each value once."""

    def __init__(self) -> None:
        self.levels: list[dict[str, Column]] = []

    def bind(self, level: int, value: Column) -> str:
        while len(self.levels) <= level:
            self.levels.append({})
        name = f"_stage_{level}_{len(self.levels[level])}"
        self.levels[level][name] = value
        return name

    def hold(self, level: int, value: Column) -> Column:
        return F.col(self.bind(level, value))

    def apply(self, df: DataFrame, out: str, value: Column) -> DataFrame:
        for columns in self.levels:
            df = df.withColumns(columns) if columns else df
        return df.withColumn(out, value).drop(*[n for columns in self.levels for n in columns])


def _height(message: Message) -> int:
    """Levels of messages below this one."""
    below = [_height(f.kind) + 1 for f in message.fields if f.is_message and f.is_single]
    return max(below, default=0)


def _number_sql(wire: int, v: str) -> str:
    if wire == VARINT:
        return varint_hex(v)
    return fixed_hex(v, 4 if wire == FIXED32 else 8)


# Values of arrays: hex text. Each step is one flat pass over an array and names its
# input once: lambdas are interpreted, and what is named twice is computed twice.


def _delimit(texts: Column, tag: str) -> Column:
    """Tag, length and content for an array of hex contents; null gives no text."""
    length = varint_hex("(octet_length(v) DIV 2)")
    return each(texts, f"coalesce(concat('{tag}', {length}, v), '')")


def _numbers(field: Field, patterns: Column, tag: str) -> Column:
    """Tag and number for an array of longs; null gives no text."""
    return each(patterns, f"coalesce(concat('{tag}', {_number_sql(field.wire, 'v')}), '')")


def _pattern(field: Field, value: Column) -> Column:
    return wire_long(F.coalesce(value, zero_literal(field)), field.scalar)


def _values_hex(field: Field, values: Column, tag: str) -> Column:
    """The values of a list, each after ``tag``; null reads as zero."""
    if field.is_message:
        return _delimit(_messages_hex(field.kind, values), tag)
    if field.wire == BYTES:
        return _delimit(F.transform(values, lambda v: F.coalesce(F.hex(v), F.lit(""))), tag)
    zero = F.lit(0).cast(field.value_type())
    patterns = F.transform(values, lambda v: wire_long(F.coalesce(v, zero), field.scalar))
    return _numbers(field, patterns, tag)


def entries_by_key(value: Column) -> Column:
    """The entries of a map, sorted by key."""
    by_key = F.call_function(
        "array_sort",
        F.map_entries(value),
        F.expr("(a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END"),
    )
    return F.when(F.size(value) > 1, by_key).otherwise(F.map_entries(value))


def _many_hex(field: Field, value: Column) -> Column:
    """A list or map with its tags, as one text."""
    block, tag = tag_hex(field.number, BYTES), tag_hex(field.number, field.wire)
    if field.map_key is not None:
        entries = _messages_hex(field.entry(), entries_by_key(value), always=True)
        return F.array_join(_delimit(entries, block), "")
    if field.packable:
        content = F.array(F.array_join(_values_hex(field, value, ""), ""))
        alone = F.array_join(_values_hex(field, value, tag), "")
        return F.when(F.size(value) > 1, F.get(_delimit(content, block), F.lit(0))).otherwise(alone)
    return F.array_join(_values_hex(field, value, tag), "")


def _single_hex(field: Field, values: Column) -> Column:
    """A single field of an array of structs, one text each."""
    tag = tag_hex(field.number, field.wire)

    def given(x: Column) -> Column:
        return x.getField(field.name)

    if field.is_message:
        inner = _messages_hex(field.kind, F.transform(values, given))
        texts = F.zip_with(values, inner, lambda x, text: F.when(is_written(field, given(x)), text))
        return _delimit(texts, tag)
    if field.wire == BYTES:
        texts = F.transform(
            values, lambda x: F.when(is_written(field, given(x)), F.coalesce(F.hex(given(x)), F.lit("")))
        )
        return _delimit(texts, tag)
    patterns = F.transform(values, lambda x: F.when(is_written(field, given(x)), _pattern(field, given(x))))
    return _numbers(field, patterns, tag)


def _messages_hex(message: Message, values: Column, always: bool = False) -> Column:
    """The payloads of an array of structs as hex texts; null is empty, unless there is
    ``always`` a struct."""
    pieces = []
    for f in message.fields:
        if f.is_single:
            pieces.append(_single_hex(f, values).alias(f"f{f.number}"))
        else:
            given = F.transform(values, lambda x: x.getField(f.name))
            many = F.transform(
                given, lambda v: F.when(is_written(f, v), _many_hex(f, v)).otherwise(F.lit(""))
            )
            pieces.append(many.alias(f"f{f.number}"))
    if not pieces:
        return F.transform(values, lambda x: F.lit(""))
    joined = F.transform(
        F.arrays_zip(*pieces), lambda z: F.concat(*[z.getField(f"f{f.number}") for f in message.fields])
    )
    if always or not any(f.required for f in message.fields):
        return joined
    return F.zip_with(values, joined, lambda x, text: F.when(x.isNull(), F.lit("")).otherwise(text))


# Outside lambdas: bytes, values bound by temporary columns.


def _varint(value: Column, level: int, stages: Stages) -> Column:
    return F.expr(varint_hex(stages.bind(level, value)))


def _field_bytes(field: Field, value: Column, stages: Stages) -> Column:
    tag = F.lit(tag_hex(field.number, field.wire))
    if field.packable:
        content = stages.hold(0, F.array_join(_values_hex(field, value, ""), ""))
        length = _varint((F.length(content) / 2).cast("long"), 1, stages)
        block = F.concat(F.lit(tag_hex(field.number, BYTES)), length)
        return F.unhex(F.concat(F.when(F.size(value) > 1, block).otherwise(tag), content))
    if not field.is_single:
        return F.unhex(_many_hex(field, value))
    if field.wire == BYTES:
        level = 0
        content = F.encode(value, "UTF-8") if field.scalar == "string" else value
        if field.is_message:
            level = _height(field.kind) + 2
            content = message_bytes(field.kind, value.getField, stages)
            content = F.when(value.isNull(), F.lit(EMPTY)).otherwise(content)
        held = stages.hold(level, F.coalesce(content, F.lit(EMPTY)))
        length = _varint(F.octet_length(held).cast("long"), level + 1, stages)
        return F.concat(F.unhex(F.concat(tag, length)), held)
    pattern = stages.bind(0, _pattern(field, value))
    return F.unhex(F.concat(tag, F.expr(_number_sql(field.wire, pattern))))


def message_bytes(message: Message, get: Callable[[str], Column], stages: Stages) -> Column:
    """The payload of a record whose fields ``get`` returns, in declaration order."""
    pieces = [
        F.when(is_written(f, get(f.name)), _field_bytes(f, get(f.name), stages)).otherwise(
            F.lit(EMPTY)
        )
        for f in message.fields
    ]
    return F.concat(*pieces) if pieces else F.lit(EMPTY)


def encode_messages(df: DataFrame, message: Message, out: str = "data") -> DataFrame:
    """Add the payload of every row; the fields are columns of ``df``."""
    stages = Stages()
    return stages.apply(df, out, message_bytes(message, F.col, stages))


def pack_sourced(
    df: DataFrame,
    source: Column,
    source_id: Column,
    name: Column,
    packet: Column,
    out: str = "data",
) -> DataFrame:
    """Add the sourced envelope around a payload."""
    given = {
        "source": source.cast("int"),
        "source_id": source_id.cast("decimal(20,0)"),
        "source_name": name,
        "packet": packet,
    }
    stages = Stages()
    return stages.apply(df, out, message_bytes(SOURCED, given.__getitem__, stages))


def _value_size(field: Field, value: Column) -> Column:
    """Bytes of one value without its tag."""
    if field.wire == BYTES:
        if field.is_message:
            inner = F.when(value.isNull(), F.lit(0).cast("long")).otherwise(
                message_size(field.kind, value.getField)
            )
        else:
            inner = F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
        return let(inner, f"{SIZE} + v") if field.is_message else varint_size(inner) + inner
    if field.wire == VARINT:
        zero = F.lit(0).cast(field.value_type())
        return varint_size(wire_long(F.coalesce(value, zero), field.scalar)).cast("long")
    return F.lit(4 if field.wire == FIXED32 else 8).cast("long")


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda a, s: a + s)


def field_size(field: Field, value: Column) -> Column:
    """Bytes a field takes in the payload, 0 when it is not written."""
    tag = len(tag_hex(field.number, field.wire)) // 2
    if field.map_key is not None:
        entry = field.entry()

        def entry_size(e: Column) -> Column:
            inner = message_size(entry, e.getField)
            return let(inner, f"{tag} + {SIZE} + v")

        size = _total(F.transform(F.map_entries(value), entry_size))
    elif field.packable:
        content = _total(F.transform(value, lambda v: _value_size(field, v)))
        blocked = let(content, f"{tag} + {SIZE} + v")
        size = F.when(F.size(value) > 1, blocked).otherwise(content + tag)
    elif field.repeated:
        size = _total(F.transform(value, lambda v: F.lit(tag) + _value_size(field, v)))
    else:
        size = F.lit(tag) + _value_size(field, value)
    return F.when(is_written(field, value), size).otherwise(F.lit(0)).cast("long")


def message_size(message: Message, get: Callable[[str], Column]) -> Column:
    """Exact payload size without encoding."""
    total = F.lit(0).cast("long")
    for f in message.fields:
        total = total + field_size(f, get(f.name))
    return total


def payload_size(df: DataFrame, message: Message) -> DataFrame:
    """``field, bytes``: what each field takes over the whole table, and ``total``."""
    names = [f.name for f in message.fields]
    sums = df.agg(*[F.sum(field_size(f, F.col(f.name))).alias(f.name) for f in message.fields])
    rows = [F.struct(F.lit(n).alias("field"), F.coalesce(n, F.lit(0)).alias("bytes")) for n in names]
    total = sum((F.coalesce(n, F.lit(0)) for n in names), F.lit(0).cast("long"))
    return sums.select(F.inline(F.array(*rows, F.struct(F.lit("total").alias("field"), total.alias("bytes")))))
