"""Toxicity of texts whose words may be disguised: a noisy-channel decoder restores the words,
a classifier scores the restored text.

The channel writes a letter as itself, as a look-alike (``LOOKS``), several times, or with a
separator behind it. A disguised word is the lattice of all letters that its characters can
stand for; Viterbi finds the path with the best sum of channel costs and the log probability
of the letters under a trigram model. Single characters in a row are one lattice, in which a
space may also be the end of a word, read too without its first and last ones, which may be
words or marks of their own; the reading with the most evidence counts. The trigram model counts the letters of all texts; its
alphabet is fixed, so its table has a fixed size. Words without any sign of a disguise are
lattices with one path and are taken as they are.

The classifier looks at restored words and their beginnings. It is fitted on a sample of at
most about ``LEARNED`` labelled rows (hash of the id, the same rows at every run) from rows
that are not held out; weights are log ratios of document frequencies, a text's evidence is
the sum of its three strongest words, and a logistic curve fitted to the sample turns it into
a score between 0 and 1. Labels, ids, languages and sources are no inputs of a score.

Null and empty texts have no words and get the score of no evidence. Equal texts get equal
scores. Texts of any length are scored whole. Without labelled rows every score is the same.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.arrays import texts_of
from tidelog.session import cut, ship

#: Labelled rows that the classifier is fitted on, about and at most.
LEARNED = 20_000
#: Features that the classifier keeps.
FEATURES = 5_000
LEAST_DOCS = 3
LEAST_WEIGHT = 2.0
#: The letters that a character may stand for, itself aside.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou",
}
SEPARATORS = " .-_*·~"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100)))
CODES = {c: i + 1 for i, c in enumerate(LETTERS)}  # 0 is the edge of a word
SIZE = len(LETTERS) + 1
#: Costs of the channel, in nats.
LOOK_COST, REPEAT_COST, SEPARATOR_COST, BOUNDARY_COST = 1.0, 1.5, 0.2, 0.5
#: Disguises: look-alikes beside letters, a letter three times, letters with separators.
SINGLE = r"(?:[^\W_]|[" + re.escape("".join(c for c in LOOKS if not c.isalnum())) + "])"
SPACED = re.compile(rf"(?<![^\W_]){SINGLE}(?:[{re.escape(SEPARATORS)}]{{1,3}}{SINGLE}){{2,}}(?![^\W_])")
#: Characters at each end of a row of single ones that may be words or marks of their own.
APART = 2
REPEATED = re.compile(r"(.)\1\1")
EDGE = ".,;:!?\"'()[]{}*#%&$"
CACHED = 100_000


def _code_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c, i in CODES.items():
        table[ord(c)] = i
        if len(c.upper()) == 1:
            table[ord(c.upper())] = i
    return table


def letter_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``code, n``: how often each three letters follow each other in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _code_table()
        counts = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            for text in texts_of(batch.column(0)).to_pylist():
                points = np.frombuffer(f"  {text}  ".encode("utf-32-le"), np.uint32)
                c = table[points].astype(np.int32)
                code = (c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:]
                # What follows two edges without a letter is white space only.
                counts += np.bincount(code[(c[1:-1] + c[2:]) > 0], minlength=SIZE**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


class Restorer:
    """Viterbi over the lattice of a disguised word, under the letter model."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SIZE, SIZE, SIZE) + 0.0
        two = three.sum(0)
        one = two.sum(0) + 0.5
        p1 = one / one.sum()
        n2 = two.sum(1, keepdims=True)
        p2 = (two + 20 * p1) / (n2 + 20)
        n3 = three.sum(2, keepdims=True)
        self.log = np.log((three + 20 * p2) / (n3 + 20)).astype(np.float32)

    def restore(self, word: str, bounds: bool = False) -> str:
        """The likeliest letters of a word; characters that stand for no letter end it, and
        with ``bounds`` spaces may."""
        out: list[str] = []
        for piece in re.split(r"([^\w" + re.escape("".join(LOOKS) + SEPARATORS) + "]+)", word):
            if piece:
                out.append(self.best_path(piece, bounds))
        return " ".join(x for x in out if x)

    def best_path(self, word: str, bounds: bool = False) -> str:
        # State: the last two letters; value: the score, and the way back.
        log = self.log
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c in word:
            arcs = [(CODES[c], 0.0)] if c in CODES else []
            arcs += [(CODES[x], LOOK_COST) for x in LOOKS.get(c, "")]
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def offer(state: tuple[int, int], score: float, way: tuple | None, to=following) -> None:
                if state not in to or score > to[state][0]:
                    to[state] = (score, way)

            for (a, b), (score, way) in states.items():
                if c in SEPARATORS or not arcs:
                    offer((a, b), score - (SEPARATOR_COST if c in SEPARATORS else 3.0), way)
                if bounds and c == " " and b:
                    offer((b, 0), score - BOUNDARY_COST + float(log[a, b, 0]), (0, way))
                for letter, cost in arcs:
                    offer((b, letter), score - cost + float(log[a, b, letter]), (letter, way))
                    if letter == b:
                        offer((a, b), score - cost - REPEAT_COST, way)
            states = dict(heapq.nlargest(32, following.items(), key=lambda s: (s[1][0], s[0])))
        (_, _), (_, way) = max(states.items(), key=lambda s: (s[1][0] + float(log[s[0][0], s[0][1], 0]), s[0]))
        letters = []
        while way:
            letters.append(LETTERS[way[0] - 1] if way[0] else " ")
            way = way[1]
        return "".join(reversed(letters))


def disguised(word: str) -> bool:
    """Whether a word without white space shows any sign of a disguise; marks around a word
    of letters are none, unless it is one mark that looks like a letter."""
    core = word if word.isalpha() else word.strip(EDGE)
    if core.isalpha():
        return REPEATED.search(core) is not None or (len(word) == len(core) + 1 and word.strip("@$!*") == core)
    if not any(c.isalpha() for c in core):
        return False
    return any(c in LOOKS or c in SEPARATORS for c in core)


def features_of(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in (4, 5, 6) if len(word) >= n)]


class Words:
    """The restored words of texts, with a cache of bounded size."""

    def __init__(self, counts: np.ndarray, cached: int = CACHED) -> None:
        self.restorer = Restorer(counts)
        self.cached = cached
        self.cache: dict[str, tuple[str, ...]] = {}
        self.rows: dict[str, tuple[tuple[str, ...], ...]] = {}

    def readings(self, word: str) -> tuple[str, ...]:
        """A word as it stands without its edges, and restored where it looks disguised."""
        found = self.cache.get(word)
        if found is None:
            core = word.strip(EDGE)
            read = {core} if core.isalpha() else {x for x in re.split(r"[\W\d_]+", core) if x}
            if disguised(word):
                for restored in (self.restorer.restore(word), self.restorer.restore(core)):
                    read.update(restored.split())
                read.update(w for row in SPACED.finditer(core) for way in self.row_readings(row[0]) for w in way)
            found = tuple(sorted(read))
            if len(self.cache) >= self.cached:
                self.cache.clear()
            if self.cached:
                self.cache[word] = found
        return found

    def row_readings(self, row: str) -> tuple[tuple[str, ...], ...]:
        """The readings of a row of single characters: the words of the whole row, with and
        without ends of words at spaces, and of what is left without characters at its ends."""
        if not any(c.isalpha() for c in row):
            return ()
        found = self.rows.get(row)
        if found is None:
            at = [i for i, c in enumerate(row) if c not in SEPARATORS]
            parts = {row, row.strip(EDGE + SEPARATORS)}
            for first in range(APART + 1):
                for last in range(APART + 1):
                    if len(at) - first - last >= 3:
                        parts.add(row[at[first] : at[len(at) - 1 - last] + 1])
            read = {self.restorer.restore(x, bounds) for x in parts for bounds in (False, True)}
            read.add(" ".join(self.restorer.restore(x) for x in re.split(" {2,}", row)))  # a wide gap ends a word
            found = tuple(sorted({tuple(x.split()) for x in read}))
            if len(self.rows) >= CACHED // 100:
                self.rows.clear()
            self.rows[row] = found
        return found

    def spaced(self, text: str) -> Iterator[tuple[tuple[str, ...], ...]]:
        """The readings of each row of single characters that is more than one token."""
        for row in SPACED.finditer(text):
            if " " in row[0]:
                yield self.row_readings(row[0])

    def of(self, text: str) -> set[str]:
        text = text.lower()
        words: set[str] = set()
        for token in set(text.split()):
            words.update(self.readings(token))
        for row in self.spaced(text):
            words.update(w for read in row for w in read)
        return words


@dataclass
class ToxicityModel:
    """The letter counts, the weights of features, and the curve of the score."""

    counts: np.ndarray
    weights: dict[str, float]
    slope: float
    offset: float


class Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.words = Words(model.counts, 0)  # the weights below stand for the readings
        self.cache: dict[str, float] = {}

    def weight(self, token: str) -> float:
        found = self.cache.get(token)
        if found is None:
            get = self.model.weights.get
            found = max([0.0, *(get(f, 0.0) for w in self.words.readings(token) for f in features_of(w))])
            if len(self.cache) >= CACHED:
                self.cache.clear()
            self.cache[token] = found
        return found

    def evidence(self, text: str | None) -> float:
        text = (text or "").lower()
        strong = [w for w in map(self.weight, set(text.split())) if w]
        get = self.model.weights.get
        for row in self.words.spaced(text):
            scored = ([max(get(f, 0.0) for f in features_of(w)) for w in read] for read in row)
            strong += max(scored, key=sum, default=[])
        return sum(heapq.nlargest(3, strong))


def evidence_of(spark: SparkSession, model: ToxicityModel) -> Callable:
    """A column function: the evidence of a text column."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed alphabet and FEATURES weights

    @F.pandas_udf(T.DoubleType())
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(shared.value)  # its caches end with the task
        for batch in texts:
            yield batch.map(own.evidence, na_action=None).astype("float64")

    return run


def toxicity_score(spark: SparkSession, model: ToxicityModel) -> Callable:
    """A column function: the score of a text column, 0 to 1."""
    evidence = evidence_of(spark, model)
    return lambda text: 1 / (1 + F.exp(-(F.lit(model.slope) * evidence(text) + F.lit(model.offset))))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def fit_curve(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (evidence, label, rows), by Newton steps
    with a small penalty that keeps separable samples finite."""
    x = np.array([r[0] for r in rows], float)
    y = np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    beta = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (n * (y - p)) - np.array([0.5, 0.01]) * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.5, 0.01])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    learned: int = LEARNED,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """The model from all texts (letters) and a bounded sample of labelled rows (labels)."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    counts = np.zeros(SIZE**3, np.int64)
    for row in letter_counts(texts, "_text").toLocalIterator():
        counts[row["code"]] = row["n"]
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    )
    total = known.count()
    share = min(1.0, learned / max(1, total))
    place = F.pmod(F.xxhash64("_id"), F.lit(1_000_000))
    sample = known.where(place < int(share * 1_000_000))
    # The sample is bounded by ``learned`` ids, so it may be broadcast.
    labelled = texts.join(F.broadcast(sample), "_id").select("_text", "_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(counts)
        for batch in batches:
            seen = (Counter(), Counter())
            labels_ = batch.column(1).to_pylist()
            for text, label in zip(texts_of(batch.column(0)).to_pylist(), labels_, strict=True):
                own = {f for w in words.of(text) for f in features_of(w)}
                seen[label].update(own)
                seen[label][""] += 1
            names = sorted(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names, pa.string()),
                    pa.array([seen[0][x] for x in names], pa.int64()),
                    pa.array([seen[1][x] for x in names], pa.int64()),
                ],
                ["feature", "clean", "toxic"],
            )

    rows = labelled.mapInArrow(run, "feature string, clean long, toxic long")
    frequency = rows.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    frequency = frequency.where((F.col("toxic") >= LEAST_DOCS) | (F.col("feature") == ""))
    frequency = cut(frequency)
    totals = frequency.where("feature = ''").first()
    n0, n1 = (totals["clean"], totals["toxic"]) if totals else (0, 0)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    best = (
        frequency.where("feature <> ''")
        .withColumn("weight", weight)
        .where(F.col("weight") >= LEAST_WEIGHT)
        .orderBy(F.desc(F.col("toxic") * F.col("weight")), "feature")
        .limit(FEATURES)
    )
    weights = {r["feature"]: r["weight"] for r in best.collect()}
    model = ToxicityModel(counts, weights, 1.0, 0.0)
    evidence = labelled.select(F.round(evidence_of(spark, model)("_text"), 1).alias("x"), "_label")
    grouped = evidence.groupBy("x", "_label").count()
    model.slope, model.offset = fit_curve([(r["x"], r["_label"], r["count"]) for r in grouped.collect()] or [(0.0, 0, 1)])
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, score, predicted`` of every row."""
    score = toxicity_score(docs.sparkSession, model)(F.col(text_col).cast("string"))
    return docs.select(
        F.col(id_col), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
