"""Removal of every byte that a long string covers which also starts anywhere else.

Matches are found over all texts without an index of the whole corpus. Of the hashes of all
``SEED`` bytes, each window of ``length`` bytes has a smallest one, its anchor; equal windows
have equal anchors at the same place, so an anchor stands for a range of window starts, and
only rows of one anchor hash can hold equal windows. Anchors carry a hash of all the bytes
under their windows. Where that is equal in two rows, all their windows are repeated and no
text is needed. Anchors with equal hash and different surroundings are the ends of repeated
passages: only for them the bytes are fetched, and a run-length index of the Burrows-Wheeler
transform (``run_index``) is built over the segments that share an anchor, at most
``INDEX_BYTES`` together; its streamed matching statistics tell which windows stand elsewhere.
An anchor with more than ``INDEX_SEGMENTS`` different surroundings (a passage that a large
part of the corpus shares) is too large for one task: its windows are split by their distance
from the anchor, the bytes that all windows of a part have in common are hashed, parts that
share them are split into single windows, and equal window hashes are counted by an
aggregate. That is exact, too, and no task holds the group.

Texts are UTF-8 bytes, null texts are empty, matches never cross texts, repeated rows are
texts of their own (all of an equal copy of ``length`` bytes or more is removed, in each of
them). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import batches_by, mixed, offsets_of, ranges, texts_of
from tidelog.llm.blocks import block_count, to_blocks, unpacked
from tidelog.llm.context_tree import steps, stored
from tidelog.llm.run_index import build
from tidelog.session import ship

LENGTH = 200
#: Bytes under one hash; a power of two.
SEED = 32
INDEX_BYTES = 1 << 20
INDEX_SEGMENTS = 1500
#: Window distances of one part of a large group.
PART = 13
BASE = np.uint64(0x9E3779B97F4A7C15)


class Hashed:
    """The bytes of several texts, one after the other, with hashes of any range of them."""

    def __init__(self, texts: pa.Array) -> None:
        self.sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = offsets_of(self.sizes)[:-1]
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        n = len(self.data)
        letters = mixed(np.arange(1, 257))
        value = letters[self.data]
        power = np.cumprod(np.full(n + 1, BASE, np.uint64))
        inverse = np.uint64(pow(int(BASE), -1, 2**64))
        self.back = np.cumprod(np.full(n + 1, inverse, np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:n])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each range of bytes."""
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))

    def seeds(self) -> np.ndarray:
        """The hash of the SEED bytes from each place on, over ends of texts as well."""
        n = len(self.data)
        value = mixed(np.arange(1, 257))[self.data]
        width = 1
        while width < SEED:
            longer = value.copy()
            longer[: n - width] = mixed(value[: n - width] * BASE + value[width:]) if n > width else value[:0]
            value, width = longer, 2 * width
        return value


def anchors(texts: Hashed, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor place, first and last window start (places in the joined bytes), and hash
    of the SEED bytes of every anchor."""
    n = len(texts.data)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64)
    seeds = texts.seeds()
    bits = np.uint64(max(1, int(n - 1).bit_length()))
    # Smallest hash first, leftmost place among equal ones.
    key = ((seeds >> bits) << bits) | np.arange(n, dtype=np.uint64)
    width = length - SEED + 1
    least, reach = key, 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    windows = np.maximum(texts.sizes - length + 1, 0)
    at = ranges(texts.starts, windows)
    row = np.repeat(np.arange(len(windows)), windows)
    place = (least[at] & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(first)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return row[first], place[first], at[first], at[last], seeds[place[first]]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``uid, id, text``; the uid tells texts apart, equal rows share it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col(id_col), text).alias("uid"), F.col(id_col).alias("id"), text.alias("text"))


def text_anchors(rows: DataFrame, length: int) -> DataFrame:
    """``seed, uid, place, low, high, bytes_hash`` of every anchor; places count bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_numpy()
            for start, part in steps(texts_of(batch.column(1))):
                texts = Hashed(part)
                row, place, low, high, seed = anchors(texts, length)
                own = mixed(texts.of(low, high + length) + (place - low).astype(np.uint64))
                begin = texts.starts[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(seed.view(np.int64)),
                        pa.array(uids[start + row]),
                        pa.array(place - begin, pa.int32()),
                        pa.array(low - begin, pa.int32()),
                        pa.array(high - begin, pa.int32()),
                        pa.array(own.view(np.int64)),
                    ],
                    ["seed", "uid", "place", "low", "high", "bytes_hash"],
                )

    return rows.select("uid", "text").mapInArrow(
        run, "seed long, uid long, place int, low int, high int, bytes_hash long"
    )


def grouped(found: DataFrame, most_segments: int) -> DataFrame:
    """Rows of anchors that stand in more than one place. Kind 0: all windows are repeated;
    1: to be indexed; 2: to be split, the group is large; 3: as 1, known already, a target.
    Groups are counted by aggregates and met by joins, so no task holds a hot anchor."""
    alike = found.groupBy("seed", "bytes_hash").agg(
        F.count("*").alias("copies"), F.min(F.struct("uid", "place", "low", "high")).alias("first")
    )
    alike = stored(alike, "alike")
    seeds = alike.groupBy("seed").agg(F.count("*").alias("different")).where("different > 1")
    repeated = alike.where("copies > 1").select("seed", "bytes_hash")
    whole = found.join(repeated, ["seed", "bytes_hash"]).select(F.lit(0).alias("kind"), "seed", "uid", "place", "low", "high")
    one_each = alike.join(seeds, "seed")
    kind = F.when(F.col("different") > most_segments, 2).when(F.col("copies") > 1, 3).otherwise(1)
    others = one_each.select(kind.alias("kind"), "seed", "first.uid", "first.place", "first.low", "first.high")
    return whole.unionByName(others)


def fetched(dealt: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes under the windows of wanted anchors (kinds 1 and 3), or the parts of their
    windows (kind 2): ``kind, key, whole, uid, place, low, high, segment``."""
    names = ["kind", "key", "whole", "uid", "place", "low", "high", "segment"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        uid = right.column("uid").to_numpy()
        order = np.argsort(uid, kind="stable")
        uid = uid[order]
        kind, seed, place, low, high = (right.column(c).to_numpy()[order] for c in ("kind", "seed", "place", "low", "high"))
        out: list[list] = [[] for _ in names]
        seen: set[int] = set()
        for packed in unpacked(left.column("load")):
            own = packed.column("uid").to_numpy()
            for start, part in steps(texts_of(packed.column("text"))):
                ids = own[start : start + len(part)]
                firsts = np.array([i for i, u in enumerate(ids.tolist()) if not (u in seen or seen.add(u))], np.int64)
                a, b = np.searchsorted(uid, ids[firsts], "left"), np.searchsorted(uid, ids[firsts], "right")
                rows = ranges(a, b - a)
                if not len(rows):
                    continue
                texts = Hashed(part)
                begin = np.repeat(texts.starts[firsts], b - a)
                small = kind[rows] != 2
                data = texts.data.tobytes()
                i = rows[small]
                from_ = (begin[small] + low[i]).tolist()
                to = (begin[small] + high[i] + length).tolist()
                for into, values in zip(
                    out,
                    (kind[i].tolist(), seed[i].tolist(), [0] * len(i), uid[i].tolist(), place[i].tolist(), low[i].tolist(),
                     high[i].tolist(), [data[x:y] for x, y in zip(from_, to, strict=True)]),
                    strict=True,
                ):
                    into.extend(values)
                i, begin = rows[~small], begin[~small]
                # Parts by distance from the anchor; all windows of a part share its core.
                near, far = (place[i] - high[i]) // PART, (place[i] - low[i]) // PART
                number = far - near + 1
                part_of = ranges(near.astype(np.int64), number)
                i, begin = np.repeat(i, number), np.repeat(begin, number)
                least, most = part_of * PART, part_of * PART + PART - 1
                core_from = begin + place[i] - least
                core_to = begin + place[i] - most + length
                lower, upper = np.maximum(low[i], place[i] - most), np.minimum(high[i], place[i] - least)
                core = mixed(texts.of(core_from, core_to) + part_of.astype(np.uint64)) ^ mixed(seed[i].view(np.uint64))
                whole = mixed(texts.of(begin + lower, begin + upper + length) + (place[i] - lower).astype(np.uint64))
                for into, values in zip(
                    out,
                    (np.full(len(i), 2).tolist(), core.view(np.int64).tolist(), (whole ^ core).view(np.int64).tolist(),
                     uid[i].tolist(), place[i].tolist(), lower.tolist(), upper.tolist(), [None] * len(i)),
                    strict=True,
                ):
                    into.extend(values)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    schema = "kind int, key long, whole long, uid long, place int, low int, high int, segment binary"
    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, schema)


def windows_of(dealt: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``window, uid, start``: the hash of each single window of the wanted parts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        uid = right.column("uid").to_numpy()
        order = np.argsort(uid, kind="stable")
        uid = uid[order]
        low, high = (right.column(c).to_numpy()[order].astype(np.int64) for c in ("low", "high"))
        out, seen = [], set()
        for packed in unpacked(left.column("load")):
            own = packed.column("uid").to_numpy()
            for start, part in steps(texts_of(packed.column("text"))):
                ids = own[start : start + len(part)]
                firsts = np.array([i for i, u in enumerate(ids.tolist()) if not (u in seen or seen.add(u))], np.int64)
                a, b = np.searchsorted(uid, ids[firsts], "left"), np.searchsorted(uid, ids[firsts], "right")
                rows = ranges(a, b - a)
                if len(rows):
                    texts = Hashed(part)
                    number = high[rows] - low[rows] + 1
                    at = ranges(low[rows], number)
                    begin = np.repeat(np.repeat(texts.starts[firsts], b - a), number)
                    window = texts.of(begin + at, begin + at + length)
                    out.append((window.view(np.int64), np.repeat(uid[rows], number), at))
        columns = [np.concatenate([x[k] for x in out] + [np.zeros(0, np.int64)]) for k in range(3)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], ["window", "uid", "start"])

    schema = "window long, uid long, start long"
    return dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, schema)


def indexed(segments: DataFrame, length: int) -> DataFrame:
    """``uid, start, stop``: runs of window starts that the index finds elsewhere."""

    def spans(group: list[tuple]) -> Iterator[tuple[int, int, int]]:
        index, starts = build([g[3] for g in group])
        hit = index.matches() >= length
        edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
        owner = np.searchsorted(starts, edge[::2], side="right") - 1
        for k, a, b in zip(owner.tolist(), edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            kind, uid, low, _ = group[k]
            if kind == 1:
                yield uid, low + a - int(starts[k]), low + b - 1 - int(starts[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size = 0

        def closed() -> pa.RecordBatch:
            found = list(spans(group)) if group else []
            columns = [[f[k] for f in found] for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["uid", "start", "stop"])

        for table in batches_by(batches, "key"):
            columns = [table.column(c).to_pylist() for c in ("kind", "uid", "low", "segment")]
            rows = list(zip(*columns, strict=True))
            more = sum(len(r[3]) for r in rows)
            if size and size + more > INDEX_BYTES:
                yield closed()
                group, size = [], 0
            group += rows
            size += more
        yield closed()

    rows = segments.repartition("key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "uid long, start long, stop long")


def repeated_spans(
    docs: DataFrame,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_segments: int = INDEX_SEGMENTS,
) -> DataFrame:
    """``uid, start, stop``: first and last start of repeated windows of ``length`` bytes, for
    texts known by :func:`keyed`; the ranges may touch or overlap."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs, id_col, text_col)
    blocks = block_count(docs, text_col)
    dealt = to_blocks(rows.select(F.pmod("uid", F.lit(blocks)).cast("int").alias("block"), "uid", "text"), blocks)
    marks = stored(text_anchors(rows, length), "anchors")
    found = stored(grouped(marks, most_segments), "anchors")
    block = F.pmod("uid", F.lit(blocks)).cast("int").alias("block")
    whole = found.where("kind = 0").select("uid", F.col("low").cast("long").alias("start"), F.col("high").cast("long").alias("stop"))
    wanted = found.where("kind > 0").select(block, "kind", "seed", "uid", "place", "low", "high")
    pieces = stored(fetched(dealt, wanted, length), "segments")
    small = indexed(pieces.where("kind <> 2").select("kind", "key", "uid", "low", "segment"), length)
    # Large groups: parts whose bytes are all repeated, then single windows of the others.
    parts = pieces.where("kind = 2").select("key", "whole", "uid", "low", "high")
    if parts.isEmpty():
        return whole.unionByName(small)
    equal = stored(parts.groupBy("key", "whole").count(), "parts")
    cores = equal.groupBy("key").agg(F.sum("count").alias("all")).where("all > 1")
    told = parts.join(equal.where("count > 1").select("key", "whole").withColumn("done", F.lit(True)), ["key", "whole"], "left")
    told = told.join(cores.select("key"), "key")
    told = stored(told.select("uid", "low", "high", F.coalesce("done", F.lit(False)).alias("done")), "parts")
    large = told.where("done").select("uid", F.col("low").cast("long").alias("start"), F.col("high").cast("long").alias("stop"))
    # One row of each repeated part stands for it beside the open ones.
    first = parts.join(equal.where("count > 1").select("key", "whole"), ["key", "whole"], "left_semi")
    first = first.groupBy("key", "whole").agg(F.min(F.struct("uid", "low", "high")).alias("f"))
    targets = first.join(cores, "key").select("f.uid", "f.low", "f.high")
    singles = windows_of(dealt, told.where("not done").select("uid", "low", "high").unionByName(targets).select(block, "uid", "low", "high"), length)
    singles = stored(singles.distinct(), "windows")
    often = singles.groupBy("window").count().where("count > 1").select("window")
    single = singles.join(often, "window").select("uid", "start", F.col("start").alias("stop"))
    return whole.unionByName(small).unionByName(large).unionByName(single)


def covered(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs under the ranges of bytes of one text."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > end[:-1]
    at = np.flatnonzero(fresh)
    return start[at], end[np.append(at[1:], len(start)) - 1]


def without(data: bytes, starts: np.ndarray, stops: np.ndarray, length: int) -> tuple[bytes, int]:
    """The bytes outside all windows, and the number of runs that were taken out."""
    froms, tos = covered(starts, stops + length)
    parts, at = [], 0
    for x, y in zip(froms.tolist(), tos.tolist(), strict=True):
        parts.append(data[at:x])
        at = y
    return b"".join([*parts, data[at:]]), len(froms)


def kept_bytes(
    docs: DataFrame, spans: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row; ``kept`` are
    the remaining bytes, of which a cut character may leave a part."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    blocks = block_count(docs, text_col)
    block = F.pmod("uid", F.lit(blocks)).cast("int").alias("block")
    dealt = to_blocks(rows.select(block, "uid", "id", "text"), blocks)
    keyed_spans = spans.select(block, "uid", "start", "stop")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        uid = right.column("uid").to_numpy()
        order = np.argsort(uid, kind="stable")
        uid = uid[order]
        start, stop = (right.column(c).to_numpy()[order] for c in ("start", "stop"))
        out = []
        for packed in unpacked(left.column("load")):
            own = packed.column("uid").to_numpy()
            firsts, lasts = np.searchsorted(uid, own, "left"), np.searchsorted(uid, own, "right")
            kept, runs, sizes = [], [], []
            for a, b, text in zip(firsts, lasts, packed.column("text").to_pylist(), strict=True):
                data = text.encode()
                rest, n = without(data, start[a:b], stop[a:b], length)
                kept.append(rest)
                runs.append(n)
                sizes.append(len(data))
            gone = [n - len(k) for n, k in zip(sizes, kept, strict=True)]
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            columns = [pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64())]
            columns += [pa.array(digests, pa.string()), pa.array(kept, pa.binary())]
            out.append(pa.Table.from_arrays([pa.chunked_array([packed.column("id")]), *columns], names))
        return pa.concat_tables(out)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return dealt.groupBy("block").cogroup(keyed_spans.groupBy("block")).applyInArrow(run, schema)


def deduplicated(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`kept_bytes` of the repeated spans of all texts."""
    return kept_bytes(docs, stored(repeated_spans(docs, length, id_col, text_col), "spans"), length, id_col, text_col)


def without_spans(
    docs: DataFrame, spans: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows with their texts without the spans; a character that loses a byte is lost."""
    merged = spans.groupBy(F.col("uid").alias("_uid")).agg(F.collect_set(F.struct("start", "stop")).alias("_spans"))
    uid = F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.withColumn("_uid", uid).join(merged, "_uid", "left")

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        out = []
        for text, start, stop in zip(texts, starts, stops, strict=True):
            if start is not None and len(start):
                text = without(text.encode(), np.array(start), np.array(stop), length)[0].decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, dtype=object)

    return rows.withColumn(text_col, cut_out(text_col, "_spans.start", "_spans.stop")).select(*docs.columns)
