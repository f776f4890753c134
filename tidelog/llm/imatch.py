"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band: above ``least_share`` of
the documents (and at least 2) and at most ``most_share`` of them. A document has a bounded
mean number of distinct terms, so the lower bound of the band bounds the lexicon by that
number over ``least_share``, whatever the size of the corpus; that is what may be broadcast.

The lexicon is thinned at random: replica ``r`` gives each term a level, and the subset
``(r, l)`` keeps the terms of level ``l`` or more, a quarter of the subset below it. A
fingerprint has one slot per subset: the distinct terms of the text in the subset, in sorted
order, hashed, with their number. Levels are there because short and long texts need
different rates to keep few terms. The likeness of two fingerprints is the share of equal
slots among those where one of them has 1 or 2 terms and neither has more, or among all
slots that one of them fills if there is no such slot.

Null texts are empty. A text without lexicon terms is hashed whole into all its slots, so
equal texts always have equal fingerprints and likeness 1. Repeated rows are documents of
their own: rows are ordered by id, then text, and the next document of the last row is the
first row; a table of one row follows itself. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrays import ascii_words, mixed, offsets_of, texts_of
from tidelog.session import cut, ship

REPLICAS = 32
LEVELS = 5
LEAST_SHARE = 1 / 4000
MOST_SHARE = 1 / 10
#: Text that one task orders and compares, about, in bytes.
PART_BYTES = 6 << 20
#: The least number of ranges, so that small tables are not left to one task.
LEAST_PARTS = 8
#: Documents whose fingerprints are computed together.
TOGETHER = 256
NO_ID = -(2**63)
TELLING = 2
MANY = 15  # the number of terms of a slot is kept up to this


def term_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word, from its bytes alone."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) if len(words) else np.zeros(0, np.uint64)


def row_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sorted term hashes of every text, one text after the other, and how many."""
    words, counts = ascii_words(texts)
    encoded = words.dictionary_encode()
    hashes = term_hashes(encoded.dictionary)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = rank[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    key = np.unique(row * max(1, len(order)) + code)
    row, code = np.divmod(key, max(1, len(order)))
    return hashes[order][code], np.bincount(row, minlength=len(counts))


def document_frequency(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, df``: the number of texts each term hash stands in."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, _ = row_terms(texts_of(batch.column(0)))
            term, df = np.unique(terms, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df)], ["term", "df"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "term long, df long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(
    docs: DataFrame, text_col: str = "text", least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE
) -> np.ndarray:
    """The sorted term hashes of the band; see above for its bound."""
    n = docs.count()
    band = document_frequency(docs, text_col).where(
        (F.col("df") >= max(2, least_share * n)) & (F.col("df") <= max(2, most_share * n))
    )
    terms = [np.array(b.column(0)).astype(np.int64) for b in band.select("term").toArrow().to_batches()]
    return np.sort(np.concatenate([*terms, np.zeros(0, np.int64)]).view(np.uint64))


class Fingerprinter:
    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        seeds = mixed(np.arange(1, REPLICAS + 1))
        levels = np.zeros((len(terms), REPLICAS), np.int8)
        for r in range(REPLICAS):
            own = mixed(terms ^ seeds[r])
            level = np.zeros(len(terms), np.int8)
            for k in range(1, LEVELS):
                level += (own & np.uint64(4**k - 1)) == 0
            levels[:, r] = level
        self.levels = levels
        self.values = mixed(terms + np.uint64(0x9E3779B97F4A7C15))

    def slots(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hash and number of terms of every slot of every text."""
        n = len(texts)
        terms, counts = row_terms(texts)
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        known = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        row, at = np.repeat(np.arange(n), counts)[known], at[known]
        hashes = np.zeros((n, REPLICAS, LEVELS), np.uint64)
        sizes = np.zeros((n, REPLICAS, LEVELS), np.int64)
        for r in range(REPLICAS):
            own_row, own_at = row, at
            for k in range(LEVELS):
                if k:
                    deep = self.levels[own_at, r] >= k
                    own_row, own_at = own_row[deep], own_at[deep]
                if not len(own_row):
                    break
                # Terms come sorted: each hash takes up its place among the terms of its slot.
                starts = np.flatnonzero(np.concatenate([[True], own_row[1:] != own_row[:-1]]))
                number = np.diff(np.append(starts, len(own_row)))
                place = np.arange(len(own_row)) - np.repeat(starts, number)
                value = mixed(self.values[own_at] + place.astype(np.uint64))
                hashes[own_row[starts], r, k] = np.add.reduceat(value, starts)
                sizes[own_row[starts], r, k] = number
        hashes, sizes = hashes.reshape(n, -1), sizes.reshape(n, -1)
        for i in np.flatnonzero(sizes.sum(1) == 0).tolist():
            whole = hashlib.blake2b(texts[i].as_py().encode(), digest_size=8).digest()
            hashes[i] = mixed(np.arange(hashes.shape[1]).astype(np.uint64) ^ np.frombuffer(whole, np.uint64)[0])
            sizes[i] = 1
        return hashes & np.uint64(0xFFFFFF), np.minimum(sizes, MANY)


def fingerprint_texts(hashes: np.ndarray, sizes: np.ndarray) -> list[str]:
    """A slot as seven hexadecimal digits, the first its number of terms."""
    packed = ((sizes.astype(np.uint32) << np.uint32(24)) | hashes.astype(np.uint32)).astype(">u4")
    return [row.tobytes().hex() for row in packed]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The likeness of fingerprints, row by row."""
    most = np.maximum(a[1], b[1])
    telling = (most >= 1) & (most <= TELLING)
    filled = most >= 1
    used = np.where(telling.any(1)[:, None], telling, filled)
    same = used & (a[0] == b[0]) & (a[1] == b[1])
    return same.sum(1) / np.maximum(1, used.sum(1))


def likeness_of_texts(a: str, b: str) -> float:
    """The likeness of two fingerprints as they are returned."""

    def read(text: str) -> tuple[np.ndarray, np.ndarray]:
        packed = np.frombuffer(bytes.fromhex(text), ">u4").astype(np.int64)[None]
        return packed & 0xFFFFFF, packed >> 24

    return float(likeness(read(a), read(b))[0])


def in_order(docs: DataFrame, part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows dealt into ranges of ids, sorted, each range followed by the first row of the
    next one (``_ahead`` 1) and the last range by the first row of all. Columns: ``_part,
    _ahead, _id, _text``. Rows without an id come first, as NO_ID; each text is shuffled once."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text").cast("long")).alias("b"), F.min("_id").alias("least"), F.count("*").alias("n")).first()
    if not size["n"]:
        empty = T.StructType.fromDDL("_part long, _ahead int, _id long, _text string")
        return spark.createDataFrame([], empty)
    parts = max(LEAST_PARTS, -(-size["b"] // part_bytes))
    cuts = rows.agg(
        F.percentile_approx("_id", [i / parts for i in range(1, parts)] or [0.0], 100 * parts).alias("q")
    ).first()["q"]
    bounds = np.array(sorted({size["least"], *cuts}), np.int64)

    @F.pandas_udf("long")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right") - 1)

    last = len(bounds) - 1
    starts = spark.createDataFrame([(int(b),) for b in bounds], "_id long")
    own = rows.withColumn("_part", part_of("_id")).withColumn("_ahead", F.lit(0))
    before = F.when(F.col("_part") == 0, F.lit(last).cast("long")).otherwise(F.col("_part") - 1)
    # One id for each part: a broadcast of 8 bytes per PART_BYTES of text.
    ahead = (
        rows.join(F.broadcast(starts), "_id")
        .withColumn("_part", part_of("_id"))
        .withColumn("_part", before)
        .withColumn("_ahead", F.lit(1))
    )
    columns = ["_part", "_ahead", "_id", "_text"]
    both = own.select(columns).unionByName(ahead.select(columns))
    return both.repartition(max(LEAST_PARTS, len(bounds)), "_part").sortWithinPartitions("_part", "_ahead", "_id", "_text")


def imatch_fingerprints(
    docs: DataFrame,
    least_share: float = LEAST_SHARE,
    most_share: float = MOST_SHARE,
    part_bytes: int = PART_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next`` of every row, where the edited text is the text with its last half replaced
    by the beginning of the next document."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(lexicon(docs, text_col, least_share, most_share))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def compared(printer: Fingerprinter, ids: list[int], texts: list[str]) -> pa.RecordBatch:
        """All but the last text, each against the one behind it."""
        edited = []
        for text, following in zip(texts[:-1], texts[1:], strict=True):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + following[:half])
        own = printer.slots(pa.array(texts, pa.large_string()))
        other = printer.slots(pa.array(edited, pa.large_string()))
        mine, following = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
        near_edited, near_next = likeness(mine, other), likeness(mine, following)
        # Equal texts have equal slots, so their likeness is 1 by construction.
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if i == NO_ID else i for i in ids[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(fingerprint_texts(*mine), pa.string()),
                pa.array(fingerprint_texts(*other), pa.string()),
                pa.array(near_edited),
                pa.array(near_next),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprinter(shared.value)
        ids: list[int] = []
        texts: list[str] = []
        held, part, closed = 0, None, False
        for batch in batches:
            for p, ahead, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    ids, texts, held, part, closed = [], [], 0, p, False
                if closed:
                    continue  # more rows with the id of the first one
                ids.append(i)
                texts.append(text)
                held += len(text)
                closed = ahead == 1
                if closed or len(ids) > TOGETHER or held > PART_BYTES:
                    if len(ids) > 1:
                        yield compared(printer, ids, texts)
                    ids, texts, held = ids[-1:], texts[-1:], len(texts[-1])

    ordered = in_order(docs, part_bytes, id_col, text_col)
    schema = (
        f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    return ordered.mapInArrow(run, schema)
