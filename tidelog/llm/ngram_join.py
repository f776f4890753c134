"""N-gram Jaccard self-join as a blocked sparse product of the document by n-gram incidence.

Two documents link when the overlap of their shingle sets reaches ``percent`` of the union,
so a set of ``n`` shingles needs an overlap of at least ``percent * n / 100``. That bound is
used before any pair exists: shingles that stand in one set only can be part of no overlap,
and a set with too few others can link with nothing. The incidence is dealt by shingle in
packed arrays that name a set by its pack, the texts read in one step, and its place there;
a directory of the pack travels along. Unique shingles are dropped, the others return to their
packs as packed numbers, sets below their bound are dropped, equal sets become one, and the
same step runs again over what is left. Then each set keeps, in order of
document frequency, the shingles of which two linked sets must share one (the prefix that the
bound leaves); shared prefix shingles make candidate clusters, clusters are cut into cells by
size (linked sets are in the same or in neighbouring cells), cells into blocks, and each pair
of blocks is one product: overlap counts of its rows and columns are summed up over chunks of
shingles, and pairs below the bound are discarded. A block pair returns a spanning forest of
its links, never all of them; the components of all forests are those of all links.

Shingles are 64-bit hashes of lower-cased words between ASCII white space; a document with
fewer words than a shingle has one shingle, the whole sequence; one without words, or a null
text, has none and links with nothing. Equal texts link with each other, ties and repeated ids
included; an empty table gives an empty result.

A set belongs to a key, the 64-bit hash of id and text: rows that share an id but not the text
are sets of their own, and rows without an id take part like others.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.arrays import ascii_words, batches_by, mixed, offsets_of, ranges, texts_of
from tidelog.llm.blocks import release
from tidelog.llm.bpe import blocks
from tidelog.llm.components import connected_components
from tidelog.llm.imatch import term_hashes
from tidelog.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from tidelog.session import cut, ship

#: Text of one range of shingle hashes, about, in bytes.
RANGE_BYTES = 8 << 20
LEAST_RANGES = 64
#: Text whose shingles a task makes at once, about, in bytes; they take some 20 times that.
STEP_BYTES = 4 << 20
#: Shingles of sets that make one pack, about.
STEP_TOKENS = 1 << 20
#: Sets of one block, about.
BLOCK_SETS = 384
#: Shingles whose overlaps are counted at once.
CHUNK = 8192
SALT = np.uint64(0x9E3779B97F4A7C15)


def need(size, percent: int):
    """The least overlap that a set of ``size`` must have with any set it links with."""
    return -(-size * percent // 100)


def shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every distinct shingle of every text, in order of hash, then row."""
    flat, counts = ascii_words(texts)
    encoded = flat.dictionary_encode()
    hashes = term_hashes(encoded.dictionary)
    own = mixed(hashes)[encoded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    starts = offsets_of(counts)[:-1]
    rows, out = [], []
    full = np.maximum(counts - words + 1, 0)
    for length in range(1, words + 1):
        number = full if length == words else (counts == length).astype(np.int64)
        row = np.repeat(np.arange(len(counts)), number)
        at = ranges(starts, number)
        value = np.full(len(at), np.uint64(length))
        for k in range(length):
            value = mixed(value * SALT + own[at + k])
        rows.append(row)
        out.append(value)
    row, value = np.concatenate(rows), np.concatenate(out)
    order = np.argsort(value, kind="stable")  # rows of one length are in order already
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[fresh], value[fresh]


def row_key(id_col: str, text_col: str):
    """The same for rows of the same id (or none) and the same text."""
    return F.xxhash64(F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), F.col(text_col).cast("string"))


def set_directory(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, id, n, k1, k2`` of every row: its key, its id, the size of its set and two hashes
    of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in blocks(batch, "_text", STEP_BYTES):
                row, value = shingles(texts, words)
                n = np.bincount(row, minlength=len(texts))
                k1, k2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
                np.add.at(k1, row, mixed(value))
                np.add.at(k2, row, mixed(value ^ SALT))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        batch.column(1).slice(first, len(texts)),
                        pa.array(n, pa.int64()),
                        pa.array(k1.view(np.int64)),
                        pa.array(k2.view(np.int64)),
                    ],
                    ["doc", "id", "n", "k1", "k2"],
                )

    ids = F.col(id_col).cast("long").alias("id")
    picked = docs.select(row_key(id_col, text_col).alias("doc"), ids, F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, "doc long, id long, n long, k1 long, k2 long")


PACKED = "range int, pack long, docs binary, sizes binary, hashes binary, rows binary"


def packed(docs: np.ndarray, sizes: np.ndarray, row: np.ndarray, value: np.ndarray, bits: int) -> pa.RecordBatch:
    """The incidence of one pack in hash order, cut into ranges of hashes, two arrays for each;
    and the directory of the pack, in any of the ranges. Packs of one name hold the same."""
    docs, sizes = docs.astype(np.int64), sizes.astype(np.uint32)
    pack_id = int.from_bytes(hashlib.blake2b(docs.tobytes(), digest_size=8).digest(), "little", signed=True)
    out: list[list] = [[pack_id % 2**bits], [pack_id], [docs.tobytes()], [sizes.tobytes()], [None], [None]]
    cuts = np.searchsorted(value >> np.uint64(64 - bits), np.arange(2**bits + 1, dtype=np.uint64))
    for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if a < b:
            parts = i, pack_id, None, None, pack_sorted(value[a:b]), pack(row[a:b].astype(np.uint32))
            for into, x in zip(out, parts, strict=True):
                into.append(x)
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["range", "pack", "docs", "sizes", "hashes", "rows"]
    )


def text_incidence(docs: DataFrame, words: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in blocks(batch, "_text", STEP_BYTES):
                row, value = shingles(texts, words)
                sizes = np.bincount(row, minlength=len(texts))
                yield packed(ids[first : first + len(texts)], sizes, row, value, bits)

    picked = docs.select(row_key(id_col, text_col).alias("doc"), F.col(text_col).cast("string").alias("_text"))
    return picked.mapInArrow(run, PACKED)


def set_incidence(sets: DataFrame, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            step = np.cumsum(length) // STEP_TOKENS
            cuts = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                value = part.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                row = np.repeat(np.arange(b - a), length[a:b])
                order = np.argsort(value, kind="stable")
                yield packed(part.column(0).to_numpy(), part.column(1).to_numpy(), row[order], value[order], bits)

    return sets.select("doc", "n", "tokens").mapInArrow(run, PACKED)


def shared_sets(incidence: DataFrame, bits: int, percent: int) -> DataFrame:
    """``doc, n, tokens, dfs`` of the sets that have enough shingles which other rows have
    too; the tokens are numbers of those shingles, in order of their document frequency. A key
    that stands in several packs has a row for each of them."""
    names = ["pack", "docs", "sizes", "range", "tokens", "rows", "dfs"]
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def listed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_range: dict[int, list[tuple]] = {}
        for batch in batches:
            directories = []
            for key, pack_id, docs, sizes, hashes, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs is not None:
                    directories.append((pack_id, docs, sizes, None, None, None, None))
                else:
                    by_range.setdefault(key, []).append((pack_id, hashes, rows))
            yield listed(directories)
        for key, parts in by_range.items():
            values = [unpack_sorted(hashes) for _, hashes, _ in parts]
            source = np.repeat(np.arange(len(parts), dtype=np.int32), [len(v) for v in values])
            row = np.concatenate([unpack(rows, np.uint32) for _, _, rows in parts])
            value = np.concatenate(values)
            del values
            order = np.argsort(value, kind="stable")
            source, row, value = source[order], row[order], value[order]
            starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            times = np.diff(np.append(starts, len(value)))
            df = np.repeat(times, times).astype(np.uint32)
            # A range is whole here: its shared shingles are numbered, which takes fewer bytes
            # than their hashes do.
            number = np.repeat((np.cumsum(times > 1) - 1).astype(np.uint64), times)
            keep = np.flatnonzero(df > 1)
            keep = keep[np.argsort(source[keep], kind="stable")]
            cuts = np.searchsorted(source[keep], np.arange(len(parts) + 1)).tolist()
            out = []
            for (pack_id, _, _), a, b in zip(parts, cuts[:-1], cuts[1:], strict=True):
                own = keep[a:b]
                if len(own):
                    out.append((pack_id, None, None, key, pack_sorted(number[own]), pack(row[own]), pack(df[own])))
                if len(out) == 1000:
                    yield listed(out)
                    out = []
            yield listed(out)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by(batches, "pack"):
            _, docs, sizes, ranges_, tokens, rows, dfs = (c.to_pylist() for c in table.columns)
            doc, n = next(
                (np.frombuffer(d, np.int64), np.frombuffer(s, np.uint32).astype(np.int64))
                for d, s in zip(docs, sizes, strict=True)
                if d is not None
            )
            at = [i for i, x in enumerate(rows) if x is not None]
            if not at:
                continue
            # The upper bits of a token name its range.
            token = np.concatenate([unpack_sorted(tokens[i]) | np.uint64(ranges_[i]) << np.uint64(64 - bits) for i in at])
            token = token.view(np.int64)
            row = np.concatenate([unpack(rows[i], np.uint32) for i in at]).astype(np.int64)
            df = np.concatenate([unpack(dfs[i], np.uint32) for i in at])
            order = np.lexsort((token, df, row))
            token, row, df = token[order], row[order], df[order]
            fresh = np.ones(len(row), bool)  # packs of one name repeat each other
            fresh[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
            number = np.bincount(row[fresh], minlength=len(doc))
            chosen = number >= np.maximum(1, need(n, percent))
            fresh &= chosen[row]
            offsets = pa.array(offsets_of(number[chosen]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(doc[chosen]),
                    pa.array(n[chosen]),
                    pa.ListArray.from_arrays(offsets, pa.array(token[fresh])),
                    pa.ListArray.from_arrays(offsets, pa.array(df[fresh].astype(np.int32))),
                ],
                ["doc", "n", "tokens", "dfs"],
            )

    columns = "pack long, docs binary, sizes binary, range int, tokens binary, rows binary, dfs binary"
    rows = incidence.repartition(2**bits, "range").mapInArrow(shared, columns)
    by_pack = rows.repartition("pack").sortWithinPartitions("pack")
    return by_pack.mapInArrow(gathered, "doc long, n long, tokens array<long>, dfs array<int>")


def product_links(
    left: list[tuple[int, int, np.ndarray]], right: list[tuple[int, int, np.ndarray]] | None, percent: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links between two blocks of sets (doc, size, tokens), or
    within one block."""
    rows = left + (right or [])
    doc = np.array([r[0] for r in rows])
    size = np.array([r[1] for r in rows], np.int64)
    where = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    _, token = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
    shared = np.bincount(token) > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    where, token = where[keep], number[token[keep]]
    order = np.argsort(token, kind="stable")
    where, token = where[order], token[order]
    split = len(left)
    first, second = (slice(0, split), slice(split, None)) if right is not None else (slice(None), slice(None))
    overlap = np.zeros((len(size[first]), len(size[second])), np.float32)
    for start in range(0, int(token[-1]) + 1 if len(token) else 0, CHUNK):
        a, b = np.searchsorted(token, [start, start + CHUNK])
        part = np.zeros((len(rows), CHUNK), np.float32)
        part[where[a:b], token[a:b] - start] = 1
        overlap += part[first] @ part[second].T
    common = overlap.astype(np.int64)
    union = size[first][:, None] + size[second][None, :] - common
    i, j = np.nonzero(100 * common >= percent * union)
    j = j + (split if right is not None else 0)
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if x != y and (rx := root(x)) != (ry := root(y)):
            parent[rx] = ry
            links.append((int(doc[x]), int(doc[y])))
    return links


def block_links(sets: DataFrame, percent: int, block_sets: int) -> DataFrame:
    """``a, b``: links that join the same sets as all links between ``doc, n, tokens, dfs,
    cluster`` rows of one cluster do."""
    step = math.log(100 / percent)
    celled = sets.withColumn("cell", F.floor(F.log(F.col("n").cast("double")) / step).cast("int"))
    sizes = celled.groupBy("cluster", "cell").count()
    sizes = sizes.select("cluster", "cell", F.ceil(F.col("count") / block_sets).cast("int").alias("own"))
    above = sizes.select("cluster", (F.col("cell") - 1).alias("cell"), F.col("own").alias("above"))
    below = sizes.select("cluster", (F.col("cell") + 1).alias("cell"), F.col("own").alias("below"))
    keys = ["cluster", "cell"]
    cells = cut(sizes.join(above, keys, "left").join(below, keys, "left").na.fill(0, ["above", "below"]))
    dealt = celled.join(cells, keys).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("own")).cast("int"))
    # A block is the left side of products with the blocks after it in its own cell and all
    # of the cell above, and the right side of those before it and of the cell below.
    left = F.expr("transform(sequence(block, own - 1), x -> struct(cell as c, block as l, cell as d, x as r, 0 as side))")
    right = F.expr("transform(sequence(0, block), x -> struct(cell as c, x as l, cell as d, block as r, 1 as side))")
    up = F.expr(
        "if(above > 0, transform(sequence(0, above - 1),"
        " x -> struct(cell as c, block as l, cell + 1 as d, x as r, 0 as side)), array())"
    )
    down = F.expr(
        "if(below > 0, transform(sequence(0, below - 1),"
        " x -> struct(cell - 1 as c, x as l, cell as d, block as r, 1 as side)), array())"
    )
    kind = "array<struct<c:int,l:int,d:int,r:int,side:int>>"
    tasks = F.concat(left.cast(kind), F.filter(right.cast(kind), lambda t: t["l"] != t["r"]), up.cast(kind), down.cast(kind))
    rows = dealt.select("cluster", F.explode(tasks).alias("t"), "doc", "n", "tokens")
    key = F.xxhash64("cluster", "t.c", "t.l", "t.d", "t.r")
    rows = rows.select(key.alias("key"), "cluster", "t.c", "t.l", "t.d", "t.r", "t.side", "doc", "n", "tokens")
    rows = rows.repartition("key").sortWithinPartitions("key", "cluster", "c", "l", "d", "r", "side", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_by(batches, "key"):
            groups: dict[tuple, tuple[list, list]] = {}
            names = ["cluster", "c", "l", "d", "r", "side", "doc", "n"]
            columns = [table.column(x).to_pylist() for x in names]
            tokens = table.column("tokens").combine_chunks()
            values, offsets = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            for i, (*task, side, doc, n) in enumerate(zip(*columns, strict=True)):
                one = (doc, n, values[offsets[i] : offsets[i + 1]])
                groups.setdefault(tuple(task), ([], []))[side].append(one)
            links = []
            for (_, c, l_, d, r), (one, other) in groups.items():
                if (c, l_) == (d, r):
                    links += product_links(one, None, percent)
                elif one and other:
                    links += product_links(one, other, percent)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"]
            )

    return rows.mapInArrow(run, "a long, b long")


def ngram_links(docs: DataFrame, directory: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``a, b``: links that join the same sets as all links do; equal sets are one set here,
    known by the smallest key."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")).alias("b")).first()["b"] or 0
    bits = max(LEAST_RANGES, -(-size // RANGE_BYTES)).bit_length()
    first = shared_sets(text_incidence(docs, words, bits, id_col, text_col), bits, percent)
    one_each = directory.where("doc = rep").select("doc")
    # Rows of one key may stand in several packs; their sets are equal.
    first = first.join(one_each, "doc", "left_semi").select("doc", "n", "tokens").dropDuplicates(["doc"])
    sets = cut(first)
    del first
    release(docs.sparkSession)
    sets = cut(shared_sets(set_incidence(sets, bits), bits, percent))
    release(docs.sparkSession)
    # Shingles without another set come first in the order; of the rest, the prefix.
    own = F.col("n") - F.size("tokens")
    most = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)).cast("long") + 1 - own
    prefix = sets.select("doc", F.explode(F.slice("tokens", F.lit(1), F.greatest(most, F.lit(0)).cast("int"))).alias("token"))
    hubs = prefix.groupBy("token").agg(F.min("doc").alias("hub"), F.count("*").alias("m")).where("m > 1")
    candidates = prefix.join(hubs, "token").select(F.col("doc").alias("a"), F.col("hub").alias("b")).distinct()
    clusters = connected_components(cut(candidates)).select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    return cut(block_links(sets.join(clusters, "doc"), percent, BLOCK_SETS))


def ngram_groups(
    docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc, id, n, component`` of every row: its key, its id, the size of its set and the
    smallest key that links reach from it."""
    spark = docs.sparkSession
    ship(spark)
    sized = cut(set_directory(docs, words, id_col, text_col))
    equal = sized.where("n > 0").groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep"))
    directory = sized.where("n > 0").join(equal, ["n", "k1", "k2"]).select("doc", "rep").distinct()
    directory = cut(directory)
    links = ngram_links(docs, directory, words, percent, id_col, text_col)
    joined = links.union(directory.where("doc <> rep").select(F.col("doc").alias("a"), F.col("rep").alias("b")))
    found = connected_components(cut(joined)).select(F.col("node").alias("doc"), "component")
    rows = sized.join(found, "doc", "left")
    return rows.select("doc", "id", "n", F.coalesce("component", "doc").alias("component"))


def ngram_components(
    docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row: the size of its set and the smallest
    id that links reach from it, null if they reach no row with an id."""
    rows = cut(ngram_groups(docs, words, percent, id_col, text_col))
    least = rows.where("id is not null").groupBy("component").agg(F.min("id").alias("component_id"))
    rows = rows.join(least, "component", "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
