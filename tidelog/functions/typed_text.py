"""Text to typed values: durations with units and RFC 3339 times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Duration units in nanoseconds (both micro signs are accepted).
UNITS = {
    "ns": 1,
    "us": 1_000,
    "µs": 1_000,
    "μs": 1_000,
    "ms": 1_000_000,
    "s": 1_000_000_000,
    "m": 60_000_000_000,
    "h": 3_600_000_000_000,
}
UNIT = "(ns|us|µs|μs|ms|s|m|h)"
NUMBER = r"([0-9]+\.?[0-9]*|\.[0-9]+)"
DURATION = rf"^[+-]?(0|({NUMBER}{UNIT})+)$"
INTEGER = r"^[+-]?[0-9]+$"
MAX_LONG = (1 << 63) - 1
RFC3339 = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.,][0-9]+)?"
    r"(Z|[+-]([01][0-9]|2[0-4]):[0-5][0-9])$"
)


def duration_nanos(text: Column) -> Column:
    """Nanoseconds of ``1h30m``, ``-1.5s`` or a plain integer; null when malformed or
    out of range. Fractions below a nanosecond are cut off."""
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    numbers = F.regexp_extract_all(text, F.lit(NUMBER + UNIT), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(NUMBER + UNIT), F.lit(2))

    def part(n: Column, u: Column) -> Column:
        whole = F.coalesce(F.nullif(F.substring_index(n, ".", 1), F.lit("")), F.lit("0"))
        whole = F.regexp_replace(whole, "^0+(?=[0-9])", "")
        digits = F.when(F.contains(n, F.lit(".")), F.substring_index(n, ".", -1)).otherwise(F.lit(""))
        scale = F.element_at(unit, u).cast("decimal(14,0)")
        fraction = F.concat(F.lit("0."), F.substring(digits, 1, 18), F.lit("0")).cast("decimal(19,19)")
        amount = F.when(F.length(whole) <= 19, whole).cast("decimal(19,0)")
        # the fraction of each part is cut separately
        return (amount * scale).cast("decimal(33,0)") + F.floor(fraction * scale).cast("decimal(33,0)")

    zero = F.lit(0).cast("decimal(38,0)")
    total = F.aggregate(
        F.zip_with(numbers, units, part), zero, lambda a, p: (a + p).cast("decimal(38,0)")
    )
    sign = F.when(F.startswith(text, F.lit("-")), -1).otherwise(1)
    value = (total * sign).cast("decimal(38,0)")
    inside = (value <= F.lit(MAX_LONG).cast("decimal(38,0)")) & (
        value >= F.lit(-MAX_LONG - 1).cast("decimal(38,0)")
    )
    return F.when(F.rlike(text, F.lit(INTEGER)), text.try_cast("bigint")).when(
        F.rlike(text, F.lit(DURATION)) & inside, value.cast("bigint")
    )


def rfc3339_offset(text: Column) -> Column:
    """Seconds east of UTC named by the text; null when it is not RFC 3339."""
    zone = F.regexp_extract(text, "([+-])([0-9]{2}):([0-9]{2})$", 0)
    hours = F.substring(zone, 2, 2).try_cast("int")
    minutes = F.substring(zone, 5, 2).try_cast("int")
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    offset = F.when(F.length(zone) == 0, 0).otherwise(sign * (hours * 3600 + minutes * 60))
    return F.when(F.rlike(text, F.lit(RFC3339)), offset)


def rfc3339_time(text: Column) -> Column:
    """The instant of a strict RFC 3339 text to the microsecond; null when malformed."""
    local = F.regexp_replace(F.regexp_replace(text, "(Z|[+-][0-9]{2}:[0-9]{2})$", "Z"), ",", ".")
    instant = F.try_to_timestamp(F.when(F.rlike(text, F.lit(RFC3339)), local))
    return F.timestamp_micros(F.unix_micros(instant) - rfc3339_offset(text).cast("long") * 1_000_000)


def rfc3339_instant(text: Column) -> Column:
    """``seconds`` since 1970 and ``nanos`` within the second of a strict RFC 3339 text, to
    the nanosecond; null when malformed. Instants compare as structs, in order of time.
    Digits of a fraction beyond the ninth are cut off."""
    whole = rfc3339_time(F.regexp_replace(text, "[.,][0-9]+", ""))
    digits = F.regexp_extract(text, "[.,]([0-9]+)", 1)
    nanos = F.rpad(F.substring(digits, 1, 9), 9, "0").cast("int")
    valid = F.rlike(text, F.lit(RFC3339)) & whole.isNotNull()
    return F.when(valid, F.struct(F.unix_seconds(whole).alias("seconds"), nanos.alias("nanos")))


def instant_nanos(instant: Column) -> Column:
    """Nanoseconds since 1970, exact for every year, and one number that aggregates combine
    before they shuffle."""
    seconds = instant["seconds"].cast("decimal(19,0)")
    return (seconds * F.lit(1_000_000_000).cast("decimal(10,0)") + instant["nanos"]).cast("decimal(30,0)")


def instant_of(nanos: Column) -> Column:
    """The instant so many nanoseconds after 1970, or before it where negative."""
    second = F.lit(1_000_000_000).cast("decimal(10,0)")
    # The remainder is taken first: quotients of decimals are rounded.
    rest = F.pmod(nanos.cast("decimal(30,0)"), second)
    seconds = ((nanos.cast("decimal(30,0)") - rest) / second).cast("bigint")
    return F.when(nanos.isNotNull(), F.struct(seconds.alias("seconds"), rest.cast("int").alias("nanos")))


def nanos_between(start: Column, end: Column) -> Column:
    """Nanoseconds from one instant to another; null when beyond a long."""
    gap = instant_nanos(end) - instant_nanos(start)
    return F.when(gap.between(-MAX_LONG - 1, MAX_LONG), gap.cast("bigint"))


def typed_columns(df: DataFrame, specs: dict[str, str]) -> DataFrame:
    """Add typed columns for text columns. ``duration`` gives ``<c>_ns``, ``time`` gives
    ``<c>_time`` and ``<c>_offset``, ``instant`` gives ``<c>_instant`` (to the nanosecond) and
    ``<c>_offset``; ``<c>_error`` marks text that is neither absent nor well-formed."""
    added: dict[str, Column] = {}
    for name, kind in specs.items():
        if kind == "duration":
            typed = added[f"{name}_ns"] = duration_nanos(F.col(name))
        elif kind == "time":
            typed = added[f"{name}_time"] = rfc3339_time(F.col(name))
            added[f"{name}_offset"] = F.when(typed.isNotNull(), rfc3339_offset(F.col(name)))
        elif kind == "instant":
            typed = added[f"{name}_instant"] = rfc3339_instant(F.col(name))
            added[f"{name}_offset"] = F.when(typed.isNotNull(), rfc3339_offset(F.col(name)))
        else:
            raise ValueError(f"unknown type: {kind}")
        added[f"{name}_error"] = F.col(name).isNotNull() & typed.isNull()
    return df.withColumns(added)


def typed_errors(df: DataFrame, specs: dict[str, str]) -> DataFrame:
    """``column, present, errors`` per text column."""
    counts = typed_columns(df, specs).agg(
        *[F.count(name).alias(f"{name}_present") for name in specs],
        *[F.count_if(F.col(f"{name}_error")).alias(f"{name}_errors") for name in specs],
    )
    rows = [
        F.struct(
            F.lit(name).alias("column"),
            F.col(f"{name}_present").alias("present"),
            F.col(f"{name}_errors").alias("errors"),
        )
        for name in specs
    ]
    return counts.select(F.inline(F.array(*rows)))
