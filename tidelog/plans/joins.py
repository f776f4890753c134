"""Joins of big, possibly skewed rows with one-row-per-key tables.

One queue may hold a third of all rows, so a plain shuffle on ``queue`` would send
them to one task. The small side is broadcast when its measured size allows it;
beyond that the hot keys of the big side are found by a sketch, and only their rows are
spread over salts and only their rows of the small side repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.session import cut

#: Largest side that is broadcast, in measured bytes.
BROADCAST_BYTES = 64 << 20
SALTS = 64
#: A key is hot when it has at least this part of all rows; so there are at most as many.
HOT_PARTS = 1024
#: Keys a sketch counts at once: counts are right to 3.5 / TRACKED of all rows or better,
#: far below the part that makes a key hot.
TRACKED = 1 << 16


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: text by length, the rest by slot."""
    width = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            width = width + F.lit(16) + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            width = width + F.octet_length(F.to_json(F.struct(field.name)))
        else:
            width = width + F.lit(16)
    return width.cast("long")


def kept(df: DataFrame, of: Column | None = None) -> tuple[DataFrame, int]:
    """The rows cut from their lineage, and their size (or that of the rows where ``of``
    holds), which is observed while they are stored: ``df`` is computed once. (A task that
    is repeated may count twice, which can only make the size too large.)"""
    seen = Observation()
    size = row_bytes(df) if of is None else F.when(of, row_bytes(df))
    rows = cut(df.observe(seen, F.coalesce(F.sum(size), F.lit(0)).alias("n")))
    return rows, seen.get["n"]


def measured_bytes(df: DataFrame) -> int:
    """Size of ``df`` from one aggregate over it."""
    row = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("n")).first()
    return row["n"]


def attach(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    limit: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join ``small`` to ``big``; ``spread`` names the columns that tell the rows of one hot
    key apart. ``small`` is the result of :func:`kept` with its ``size``, or a table or a
    :func:`tidelog.session.cut` result, which is cheap to measure here."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join: {how}")
    if (measured_bytes(small) if size is None else size) <= limit:
        return big.join(F.broadcast(small), on, how)
    return salted(big, small, on, how, spread)


def hot_keys(df: DataFrame, on: list[str], parts: int = HOT_PARTS) -> list[int]:
    """The hashes of all keys with at least one ``parts``-th of the rows, from a sketch that
    every task keeps of its own rows: nothing is shuffled but sketches. At most ``parts``."""
    keys = df.select(F.xxhash64(*on).alias("key"))
    row = keys.agg(F.count("key").alias("n"), F.expr(f"approx_top_k(key, {parts}, {TRACKED})").alias("top")).first()
    return [r["item"] for r in row["top"] or [] if r["count"] * parts >= row["n"]]


def sides(
    big: DataFrame, small: DataFrame, on: list[str], hot: Column, spread: list[str], salts: int
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt``: 0 but for the keys where ``hot`` holds."""
    salt = F.when(hot, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    copies = F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return big.withColumn("_salt", salt), small.withColumn("_salt", F.explode(copies))


def salted(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: list[str] | None = None,
    salts: int = SALTS,
    parts: int = HOT_PARTS,
) -> DataFrame:
    """Equi-join whose hot keys are split over ``salts`` tasks; the others are joined plainly.
    The keys of ``big`` are read once more to find the hot ones. Where that is no use (a
    stream, or key columns whose types differ and so their hashes), all keys are split."""
    columns = spread or [c for c in big.columns if c not in on] or big.columns
    if big.isStreaming or any(big.schema[c].dataType != small.schema[c].dataType for c in on):
        hot = F.lit(True)
    elif found := hot_keys(big, on, parts):
        hot = F.xxhash64(*on).isin(found)
    else:
        return big.join(small, on, how)
    left, right = sides(big, small, on, hot, columns, salts)
    return left.join(right, [*on, "_salt"], how).drop("_salt")
