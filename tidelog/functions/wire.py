"""Wire encoding as Column expressions.

Numbers become hex text by arithmetic on longs, texts are concatenated and turned into
bytes once per field. Everything stays in generated code, except inside lists and maps.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _long(pattern: int) -> str:
    """An unsigned 64-bit pattern as SQL long literal."""
    return f"{pattern - (1 << 64) if pattern >> 63 else pattern}L"


def let(value: Column, body: str) -> Column:
    """The SQL expression ``body`` of ``v``, a value that is computed once; for use
    inside lambdas and nested messages, where no column can hold it."""
    return F.get(each(F.array(value), body), F.lit(0))


def each(values: Column, body: str) -> Column:
    """The SQL expression ``body`` of every element ``v`` of an array."""
    return F.call_function("transform", values, F.expr(f"v -> {body}"))


def varint_size(value: Column) -> Column:
    """Bytes of a long as varint: one per started 7 bits, ten for negatives."""
    return F.floor((F.length(F.bin(value)) + 6) / 7).cast("long")


def _packed(parts: list[tuple[int, int]], mask: int, v: str, extra: int = 0) -> str:
    """SQL of a long made of groups of ``v``: ``(from bit, to bit)`` of each."""
    terms = [] if not extra else [_long(extra)]
    for source, target in parts:
        group = f"({v} & {mask}L)" if not source else f"(shiftrightunsigned({v}, {source}) & {mask}L)"
        terms.append(group if not target else f"shiftleft({group}, {target})")
    return " | ".join(terms)


def fixed_hex(v: str, size: int) -> str:
    """SQL of the low ``size`` bytes of a long, lowest first."""
    swapped = _packed([(8 * i, 8 * (size - 1 - i)) for i in range(size)], 255, v)
    return f"lpad(hex({swapped}), {2 * size}, '0')"


def varint_hex(v: str) -> str:
    """SQL of the base-128 bytes of a long's 64-bit pattern, lowest group first. All
    bytes but the last have their top bit set, so the hex text needs no padding."""

    def groups(n: int, more: int) -> str:
        parts = [(7 * i, 8 * (n - 1 - i)) for i in range(n)]
        top = sum(0x80 << (8 * (n - 1 - i)) for i in range(more))
        return f"hex({_packed(parts, 127, v, top)})"

    cases = [f"WHEN {v} < {1 << (7 * n)}L THEN {groups(n, n - 1)}" for n in range(2, 9)]
    high = f"hex(shiftrightunsigned({v}, 56))"
    return (
        f"CASE WHEN {v} < 0 THEN concat({groups(8, 8)}, {high}, '01') "
        f"WHEN {v} < 128 THEN lpad(hex({v}), 2, '0') {' '.join(cases)} "
        f"ELSE concat({groups(8, 8)}, lpad({high}, 2, '0')) END"
    )


def zigzag(value: Column) -> Column:
    """Signed to unsigned: 0, -1, 1, -2 … as 0, 1, 2, 3 …"""
    return F.shiftleft(value, 1).bitwiseXOR(F.shiftright(value, 63))


def unzigzag(value: Column) -> Column:
    """Inverse of :func:`zigzag`."""
    return F.shiftrightunsigned(value, 1).bitwiseXOR(F.negative(value.bitwiseAND(F.lit(1).cast("long"))))


def unsigned_bits(value: Column) -> Column:
    """An unsigned 64-bit decimal as the long of the same bits."""
    wrapped = value - F.lit(str(1 << 64)).cast("decimal(20,0)")
    big = value > F.lit(str((1 << 63) - 1)).cast("decimal(20,0)")
    return F.when(big, wrapped).otherwise(value).cast("long")


def float_bits(value: Column, kind: str) -> Column:
    """IEEE bits of a float (32) or double (64) as a long."""
    owner, method = {
        "float": ("java.lang.Float", "floatToRawIntBits"),
        "double": ("java.lang.Double", "doubleToRawLongBits"),
    }[kind]
    return F.call_function("reflect", F.lit(owner), F.lit(method), value).cast("long")


def wire_long(value: Column, kind: str) -> Column:
    """A scalar number as the long whose bits go on the wire."""
    if kind in ("float", "double"):
        return float_bits(value, kind)
    if kind in ("uint64", "fixed64"):
        return unsigned_bits(value.cast("decimal(20,0)"))
    plain = value.cast("int").cast("long") if kind == "bool" else value.cast("long")
    return zigzag(plain) if kind in ("sint32", "sint64") else plain


def tag_hex(number: int, wire: int) -> str:
    """The tag of a field as constant hex text."""
    if not 0 < number <= (1 << 31) - 1:
        raise ValueError(f"field number out of range: {number}")
    rest, out = (number << 3) | wire, ""
    while rest > 127:
        out, rest = out + f"{rest & 127 | 128:02X}", rest >> 7
    return out + f"{rest:02X}"
