"""Whitening of embeddings by their leading components.

Entries become whole numbers, so the sums of all vectors are exact. The covariance is summed
in tasks over vectors that were centred before (whole part first, then the rest of the mean),
and its rows are added up by their number; it is as large as a vector is long, whatever the
number of vectors, so it may go to the driver. There its leading eigenvalues and eigenvectors
are found (:mod:`tidelog.llm.eigen`), and go to all tasks, which project the centred vectors.
The covariance of the projections is then summed in the same way and compared with the identity.

A vector takes part if it is not null or empty, holds no null or non-finite entry, and has the
length that most such vectors have (of equally frequent lengths, the largest); all others give
no rows. Entries beyond 2 ** 52 after scaling fail the job. Components whose variance is below
``LEAST_SHARE`` of the largest cannot be told from rounding and are left out, so copies of one
vector, and an empty table, give no rows. Repeated rows and null ids count and are returned
each; columns that are not named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.eigen import leading_eigenpairs
from tidelog.session import ship

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
LEAST_SHARE = 1e-10
#: Output rows of one Arrow batch, about.
ROWS = 1 << 16


def whole_vectors(table: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``_id, _v array<double>`` of the vectors that take part, and their length."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.select(F.col(id_col).alias("_id"), v.alias("_v")).where(v.isNotNull() & (F.size(v) > 0) & finite)
    length = F.size("_v").alias("length")
    most = rows.groupBy(length).count().orderBy(F.desc("count"), F.desc("length")).first()
    if most is None:
        return rows, 0
    return rows.where(F.size("_v") == most["length"]), most["length"]


def matrix_of(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The vectors of a batch as whole numbers less ``SHIFT``."""
    column = batch.column(batch.schema.get_field_index("_v"))
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, length)
    if scaled.size and np.max(np.abs(scaled)) > 2.0**52:
        raise ValueError("an entry is too large to be a whole number")
    return scaled.astype(np.int64)


def added(partial: DataFrame, length: int) -> np.ndarray:
    """Rows ``i, values`` added up per ``i``; there are at most ``length`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = values.values.to_numpy()
                sums[i] = sums[i] + own if i in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()))], ["i", "values"])

    kind = partial.schema
    rows = partial.repartition("i").mapInArrow(run, kind).collect()
    out = np.zeros((length, len(rows[0]["values"]) if rows else 0), np.int64 if "bigint" in kind.simpleString() else float)
    for row in rows:
        out[row["i"]] = row["values"]
    return out


def sums_of(rows: DataFrame, length: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums, shifted entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length + 1, np.int64)
        for batch in batches:
            x = matrix_of(batch, length)
            total[:length] += x.sum(0)
            total[length] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total])], ["i", "values"])

    # One short row per task: they meet in steps of many tasks, then in one row.
    parts = rows.select("_v").mapInArrow(run, "i int, values array<long>")
    flat = parts.select(F.posexplode("values").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("s"))
    by_place = {r["at"]: r["s"] for r in flat.collect()}
    n = by_place.get(length, 0)
    return n, [by_place.get(i, 0) + n * SHIFT for i in range(length)]


class Centre:
    """Centres whole numbers at the exact mean: its whole part, then the rest."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n = n
        unshifted = [s - n * SHIFT for s in sums]
        self.whole = np.array([s // n for s in unshifted], np.int64)
        self.rest = [s % n for s in unshifted]
        self.part = np.array([r / n for r in self.rest])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - sum) ** 2 of every row."""
        y = x - self.whole
        widest = self.n * int(np.max(np.abs(y), initial=0)) + self.n
        if widest * widest * y.shape[1] < 1 << 62:
            d = y * self.n - np.array(self.rest, np.int64)
            return (d * d).sum(1).tolist()
        d = y.astype(object) * self.n - np.array(self.rest, object)
        return [int(v) for v in (d * d).sum(1)]


def covariance(rows: DataFrame, length: int, n: int, centred: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The covariance, divisor ``n``, of what ``centred`` makes of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            y = centred(matrix_of(batch, length))
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(list(total))], ["i", "values"])

    parts = rows.select("_v").mapInArrow(run, "i int, values array<double>")
    total = added(parts, size) / n
    return (total + total.T) / 2


def whiten(
    table: DataFrame,
    components: int = COMPONENTS,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """``id_col, component, n, deviation, whitened, explained, identity_error`` of every vector
    that takes part and every component; ``deviation`` is exact, as a decimal."""
    spark = table.sparkSession
    ship(spark)
    kind = table.schema[id_col].dataType.simpleString()
    schema = (
        f"`{id_col}` {kind}, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double"
    )
    rows, length = whole_vectors(table, id_col, vec_col)
    if not length:
        return spark.createDataFrame([], schema)
    n, sums = sums_of(rows, length)
    centre = Centre(n, sums)
    v = covariance(rows, length, n, centre, length)
    values, vectors = leading_eigenpairs(v, components)
    kept = values > LEAST_SHARE * max(values[0], 0.0)
    values, vectors = values[kept], vectors[:, kept]
    k = len(values)
    if not k or values[0] <= 0:
        return spark.createDataFrame([], schema)
    explained = values / np.trace(v)
    onto = vectors / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return centre(x) @ onto

    identity_error = float(np.max(np.abs(covariance(rows, length, n, projected, k) - np.eye(k))))
    names = [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    decimal = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, ROWS // k)
        for whole in batches:
            for first in range(0, whole.num_rows, step):
                batch = whole.slice(first, step)
                x = matrix_of(batch, length)
                own = pa.array(np.repeat(np.arange(len(x)), k))
                exact = pa.array([Decimal(d) for d in centre.deviations(x)], decimal)
                columns = [
                    batch.column(0).take(own),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(own), n)),
                    exact.take(own),
                    pa.array(projected(x).reshape(-1)),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(own), identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("_id", "_v").mapInArrow(run, schema)
