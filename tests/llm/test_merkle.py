"""The Merkle manifest against a plain-Python tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
FIELDS = "doc_id", "source", "lang", "n_chars", "text"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + fan])) for i in range(0, len(levels[-1]), fan)])
    return levels


def path(levels, at, fan):
    out = []
    for nodes in levels[:-1]:
        start = at // fan * fan
        out.append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + fan])))
        at //= fan
    return out


def manifest(rows, fan=8):
    """Digest rows as the query must give them."""
    parts = {}
    for row in rows:
        parts.setdefault(row[2], []).append(row)
    names = sorted(parts, key=lambda k: (k is not None, (k or "").encode()))
    for own in parts.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in parts[k]], fan) for k in names]
    crown = tree([t[-1][0] for t in trees], fan)
    out = []
    for j, name in enumerate(names):
        for i, row in enumerate(parts[name]):
            steps = path(trees[j], i, fan) + path(crown, j, fan)
            node = leaf(row)
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                node = leaf((*row[:4], "".join(c.lower() if c.isascii() else c for c in row[4])))
            for before, after in steps:
                node = h(before + node + after)
            proof = h("".join(before + after for before, after in steps))
            out.append((row[0], leaf(row), trees[j][-1][0], crown[-1][0], proof, node, node == crown[-1][0]))
    return sorted(map(str, out))


def found(docs, **options):
    from tidelog.llm.merkle import manifest_digests, tampered_third

    rows = manifest_digests(docs, tampered_third(), **options)
    assert rows.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(str(tuple(r)) for r in rows.collect())


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(docs) == manifest([tuple(r) for r in docs.select(*FIELDS).collect()])


@pytest.mark.parametrize("sizes, fan, every", [((1,), 8, 3), ((8, 9, 64, 65), 8, 1), ((1, 2, 3, 4, 5, 16, 17, 33), 2, 2)])
def test_heights(spark, sizes, fan, every):
    """Parts of every height, more levels than one kept table holds, one part alone."""
    rows = [(100 * k + i, "s", f"l{k}", 1, f"Text {i}") for k, size in enumerate(sizes) for i in range(size)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(docs, fan=fan, every=every) == manifest(rows, fan)


def test_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    rows = [
        (1, "s", "de", 3, "ABC"), (1, "s", "de", 3, "ABC"), (1, "s", "de", 3, "abc"), (None, None, None, None, None),
        (2, None, None, 0, ""), (3, "s", "", 1, None), (4, "s", "ß", 1, "ÄA"), (5, "s", "z", 1, "X" * 300_000), (6, "s", "z", -1, "-"),
    ]
    names = ", part string, node int, load int, leaf string, root string, path string, _at int, pos int"
    docs = spark.createDataFrame(
        [(*r, "x", 1, 2, "y", "z", "p", 3, 4) for r in rows],
        "doc_id long, source string, lang string, n_chars long, text string" + names,
    ).repartition(3)
    assert found(docs) == manifest(rows)
    assert found(docs.limit(0)) == []


def test_equal_rows_in_a_hot_part(spark):
    """Half of all rows are in one part, and all of them are equal up to the part."""
    docs = spark.range(4000).select(
        F.lit(7).cast("long").alias("doc_id"),
        F.lit("s").alias("source"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 5)).alias("lang"),
        F.lit(1).cast("long").alias("n_chars"),
        F.lit("same").alias("text"),
    )
    assert found(docs) == manifest([tuple(r) for r in docs.select(*FIELDS).collect()])
