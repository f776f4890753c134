"""Merkle manifest of a table with inclusion proofs, by checkpoint and recompute.

Every row is a leaf: the SHA-256 of its fields, a field being ``-`` for null and else its
length in UTF-8 bytes, a colon and its value. The leaves of each part of the table ascend by
id; runs of ``fan`` nodes become the hash of their digests until one node, the root of the
part, remains, and the roots of the parts, in order of their names, become the root likewise.

Only every ``every``-th level is kept, as a table with one row for each aligned subtree of
``fan ** every`` nodes. To extract proofs, each row regenerates the levels in between from its
own kept nodes, tells every node its siblings in them, and is done with them; what lies above
comes from the row of the level kept next, found by the number of the subtree. So a proof costs
the work of its subtree once for all leaves of it, and no task sees more than that.

Rows are numbered inside their parts by one range sort over all rows, so a part that holds
most of the table is spread as any other. All work is done by expressions.

Null parts are a part of their own and come first; null ids come first in their part; equal
ids are ordered by their leaves and equal leaves are interchangeable; texts of any length are
one leaf. An empty table has no leaves, no root and no rows. Columns that are not named are not
read, whatever they are called.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.numbering import ROW_BITS, floor_div
from tidelog.plans.joins import attach
from tidelog.session import work_path

FAN = 8
EVERY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field_text(column: Column) -> Column:
    """A field as it enters its leaf."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(fields: list[Column]) -> Column:
    return digest(F.concat(*map(field_text, fields)))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def height_of(rows: str, fan: int) -> Column:
    """How often ``rows`` nodes are grouped until one remains."""
    powers = [f"{fan**k}L" for k in range(63) if fan**k < 1 << 62]
    return F.expr(f"size(filter(array({', '.join(powers)}), p -> p < {rows}))")


def placed(nodes: DataFrame, fan: int) -> DataFrame:
    """``part, node, load`` of a stored table with ``pos``, the place in the part by ``rank``,
    and ``height``, the height of the part's tree. One range sort, stored with the place of
    every row; only the number of rows per part and sort task meets again."""
    at = F.monotonically_increasing_id()
    # Equal rows are interchangeable; their place in the stored files lets a sort split them.
    ordered = nodes.withColumn("_tie", at).orderBy("part", "rank", "node", "_tie")
    ordered = stored(ordered.select("part", "node", "load", at.alias("_at")), "merkle-order")
    ordered = ordered.withColumn("_task", F.shiftright("_at", ROW_BITS))
    counts = ordered.groupBy("part", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    own = Window.partitionBy("part")
    before = own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "part",
        "_task",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(own).alias("_all"),
    )
    shifts = stored(shifts.withColumn("height", height_of("_all", fan)).drop("_all"), "merkle-shifts")
    joined = attach(ordered, shifts, ["part", "_task"], spread=["_at"])
    return joined.select("part", "height", (F.col("_at") + F.col("_shift")).alias("pos"), "node", "load")


def parents(nodes: Column, fan: int) -> Column:
    """The hashes of runs of ``fan`` digests."""
    starts = F.sequence(F.lit(0), floor_div(F.size(nodes) - 1, fan).cast("int"))
    return F.transform(starts, lambda i: digest(F.array_join(F.slice(nodes, i * fan + 1, F.lit(fan)), "")))


def steps(count: Column, every: int) -> Column:
    """1, 2, .. up to ``count``, none for 0."""
    return F.slice(F.array(*[F.lit(k) for k in range(1, every + 1)]), F.lit(1), count)


@dataclass
class Manifest:
    """The kept levels of the trees of all parts, lowest first: ``part, height, block`` and
    the ``rows`` of each aligned subtree; and ``tops``: ``part, top``."""

    levels: list[DataFrame]
    tops: DataFrame
    fan: int
    every: int


def subtrees(nodes: DataFrame, fan: int, every: int) -> DataFrame:
    """One row for each aligned subtree, its nodes in order, at most ``fan ** every``."""
    block = floor_div(F.col("pos"), fan**every)
    members = F.sort_array(F.collect_list(F.struct("pos", "node", "load")))
    return nodes.groupBy("part", "height", block.alias("block")).agg(members.alias("rows"))


def heads(level: DataFrame, base: int, fan: int, every: int) -> DataFrame:
    """The top node of every subtree of the level kept at height ``base``."""
    count = F.least(F.lit(every), F.col("height") - base)
    top = F.aggregate(steps(count, every), F.col("rows.node"), lambda nodes, _: parents(nodes, fan))
    return level.select("part", "height", F.col("block").alias("pos"), top[0].alias("node"))


def build(nodes: DataFrame, fan: int = FAN, every: int = EVERY) -> Manifest:
    """The kept levels over a stored table ``part, rank, node, load``. One pass over the kept nodes for
    every ``every`` levels, each ``fan ** every`` times smaller than the one before."""
    level = stored(subtrees(placed(nodes, fan), fan, every), "merkle-level")
    levels = [level]
    tallest = level.agg(F.max("height")).first()[0] or 0
    tops = []
    for base in range(0, max(tallest, 1), every):
        tips = heads(levels[-1], base, fan, every)
        done = F.col("height") <= base + every
        tops.append(tips.where(done).select("part", F.col("node").alias("top")))
        if base + every < tallest:
            above = tips.where(~done).withColumn("load", F.lit(None).cast("string"))
            levels.append(stored(subtrees(above, fan, every), "merkle-level"))
    whole = tops[0]
    for more in tops[1:]:
        whole = whole.unionByName(more)
    return Manifest(levels, stored(whole, "merkle-tops"), fan, every)


def siblings(level: DataFrame, base: int, fan: int, every: int) -> DataFrame:
    """``part, pos, node, load, path, upper`` of every kept node of a level: its path tells the
    digests ``before`` and ``after`` it in its run, for each height up to the level kept next,
    and goes on with the path of its subtree, ``upper.path``."""
    count = F.least(F.lit(every), F.col("height") - base)
    grown = F.aggregate(
        steps(count - 1, every),
        F.array(F.col("rows.node")),
        lambda made, _: F.concat(made, F.array(parents(F.element_at(made, F.lit(-1)), fan))),
    )
    nothing = F.expr("CAST(array() AS array<array<string>>)")
    powers = F.array(*[F.lit(fan**k) for k in range(every)])

    def path(place: Column) -> Column:
        def around(nodes: Column, height: Column) -> Column:
            at = F.floor(place / F.element_at(powers, height + 1)).cast("int")
            start = at - F.pmod(at, F.lit(fan))
            return F.struct(
                F.array_join(F.slice(nodes, start + 1, at - start), "").alias("before"),
                F.array_join(F.slice(nodes, at + 2, start + F.lit(fan - 1) - at), "").alias("after"),
            )

        return F.transform(F.col("_made"), around)

    told = F.transform(F.col("rows"), lambda row, i: F.struct(row.alias("own"), path(i).alias("path")))
    regrown = level.withColumn("_made", F.when(count > 0, grown).otherwise(nothing))
    rows = regrown.select("part", "upper", F.explode(told).alias("row"))
    whole = F.concat("row.path", "upper.path").alias("path")
    return rows.select("part", "row.own.pos", "row.own.node", "row.own.load", whole, "upper")


def no_path() -> Column:
    return F.expr("CAST(array() AS array<struct<before:string,after:string>>)")


def proofs(manifest: Manifest, above: DataFrame) -> DataFrame:
    """``part, node, load, path`` of every leaf, and the columns of ``above``: one row per part
    with the ``path`` that continues those of its tree. From the highest kept level down, each
    level is joined with the paths of the subtrees above it."""
    upper: DataFrame | None = None
    extra = [c for c in above.columns if c not in ("part", "path")]
    for k in range(len(manifest.levels) - 1, -1, -1):
        level = manifest.levels[k]
        if upper is None:
            level = level.withColumn("_up", no_path())
        else:
            own = upper.select("part", F.col("pos").alias("block"), F.col("path").alias("_up"))
            level = level.join(own, ["part", "block"], "left").withColumn("_up", F.coalesce("_up", no_path()))
        if k == 0:
            level = attach(level, above.withColumnRenamed("path", "_rest"), ["part"], spread=["block"])
            level = level.withColumn("upper", F.struct(F.concat("_up", "_rest").alias("path"), *extra))
        else:
            level = level.withColumn("upper", F.struct(F.col("_up").alias("path")))
        upper = siblings(level, k * manifest.every, manifest.fan, manifest.every)
        if k:
            upper = stored(upper.select("part", "pos", "path"), "merkle-paths")
    return upper.select("part", "node", "load", "path", *[F.col(f"upper.{c}") for c in extra])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, at: digest(F.concat(at["before"], node, at["after"])))


def siblings_text(path: Column) -> Column:
    """All siblings of a proof, level by level."""
    return F.array_join(F.transform(path, lambda at: F.concat(at["before"], at["after"])), "")


def manifest_rows(
    docs: DataFrame,
    tampered: Column | None = None,
    id_col: str = "doc_id",
    part_col: str = "lang",
    text_col: str = "text",
    fields: tuple[str, ...] = FIELDS,
    fan: int = FAN,
    every: int = EVERY,
) -> DataFrame:
    """``id_col, leaf, subroot, root, path, presented, folded_root``: every leaf with its
    proof and the root that the presented leaf folds to. Where ``tampered`` holds, the row is
    presented with its text lower-cased (A to Z only)."""
    own = leaf_of([F.col(c) for c in fields])
    changed = leaf_of([lower_ascii(F.col(c).cast("string")) if c == text_col else F.col(c) for c in fields])
    shown = own if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(own)
    # A null part sorts before all names: they begin with a letter here.
    part = F.coalesce(F.concat(F.lit("p"), F.col(part_col).cast("string")), F.lit(""))
    leaves = docs.select(
        part.alias("part"),
        F.col(id_col).alias("rank"),
        own.alias("node"),
        F.struct(F.col(id_col).alias("id"), shown.alias("presented")).alias("load"),
    )
    trees = build(stored(leaves, "merkle-leaves"), fan, every)
    roots = trees.tops.select(
        F.lit("").alias("part"), F.col("part").alias("rank"), F.col("top").alias("node"), F.col("part").alias("load")
    )
    crown = build(roots, fan, every)
    parts = proofs(crown, crown.tops.select("part", "top", no_path().alias("path")))
    above = stored(
        parts.select(F.col("load").alias("part"), F.col("node").alias("subroot"), F.col("top").alias("root"), "path"), "merkle-parts"
    )
    told = proofs(trees, above)
    return told.select(
        F.col("load.id").alias(id_col),
        F.col("node").alias("leaf"),
        "subroot",
        "root",
        "path",
        F.col("load.presented").alias("presented"),
        folded(F.col("load.presented"), F.col("path")).alias("folded_root"),
    )


def manifest_digests(docs: DataFrame, tampered: Column | None = None, **options) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified``."""
    rows = manifest_rows(docs, tampered, **options)
    return rows.select(
        rows.columns[0],
        "leaf",
        "subroot",
        "root",
        digest(siblings_text(F.col("path"))).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def tampered_third(id_col: str = "doc_id") -> Column:
    """Rows whose CRC of the decimal id is divisible by three."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0

