"""Dotted names and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.joins import BROADCAST_BYTES, attach, kept


def scope_chain(scope: Column) -> Column:
    """``a.b.c`` as ``[a.b.c, a.b, a, '']``, innermost first."""
    parts = F.split(scope, r"\.")
    depth = F.when(F.length(scope) > 0, F.size(parts)).otherwise(0)
    return F.transform(
        F.sequence(F.lit(0), depth), lambda up: F.array_join(F.slice(parts, F.lit(1), depth - up), ".")
    )


def longest_prefix_join(refs: DataFrame, defs: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Each ``scope, name`` of ``refs`` with the ``def`` whose ``full_name`` it means:
    the one in the innermost enclosing scope, else in a parent, else at the root; null
    where none is. Distinct pairs are resolved, then joined back. Sides up to ``limit``
    bytes are broadcast; beyond it a name or pair that many rows share is split.
    """
    known, size = kept(defs.select("full_name", "def").groupBy("full_name").agg(F.min("def").alias("def")))
    pairs = refs.select("scope", "name").distinct()
    if size > limit:  # the tries are read twice: for their hot names, and to be joined
        pairs, _ = kept(pairs)
    tries = pairs.select("scope", "name", F.posexplode(scope_chain(F.col("scope"))).alias("up", "prefix"))
    tries = tries.withColumn("full_name", F.concat_ws(".", F.nullif("prefix", F.lit("")), "name"))
    resolved, found = kept(
        attach(tries, known, ["full_name"], spread=["scope"], limit=limit, size=size)
        .groupBy("scope", "name")
        .agg(F.min_by("def", "up").alias("def"), F.min_by("full_name", "up").alias("full_name"))
    )
    return attach(refs, resolved, ["scope", "name"], "left", limit=limit, size=found)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix in characters."""
    same = F.filter(
        F.sequence(F.lit(0), F.least(F.length(a), F.length(b))),
        lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n),
    )
    return F.substring(a, F.lit(1), F.array_max(same))


def common_root(a: Column, b: Column) -> Column:
    """Deepest folder both paths lie in, by components."""
    left, right = F.split(a, "/"), F.split(b, "/")
    shared = F.filter(
        F.sequence(F.lit(0), F.least(F.size(left), F.size(right)) - 1),
        lambda n: F.slice(left, F.lit(1), n) == F.slice(right, F.lit(1), n),
    )
    return F.array_join(F.slice(left, F.lit(1), F.array_max(shared)), "/")


def common_path(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """``keys, prefix, root``: what all paths of a group share. The smallest and the
    largest path of a group bound all others, so two aggregates are enough."""
    ends = df.groupBy(*keys).agg(F.min(path).alias("_lo"), F.max(path).alias("_hi"))
    return ends.select(
        *keys,
        common_prefix(F.col("_lo"), F.col("_hi")).alias("prefix"),
        common_root(F.col("_lo"), F.col("_hi")).alias("root"),
    )


def file_name(path: Column) -> Column:
    """Last component."""
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """All but the last component."""
    return F.regexp_replace(path, r"/[^/]*$", "")


def subtract_path(path: Column, base: Column) -> Column:
    """What follows ``base`` in ``path``; null when the path lies elsewhere."""
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path)))


def is_absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/"))


def components(path: Column) -> Column:
    """The names a path goes through: a fold over its parts with a stack, where nothing and
    ``.`` stay, ``..`` takes the last name away, and any other part is put on. Above the root
    is the root; a relative path keeps the ``..`` that it begins with."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    nothing = F.expr("CAST(array() AS array<string>)")

    def step(stack: Column, part: Column) -> Column:
        inside = (F.size(stack) > 0) & (F.try_element_at(stack, F.lit(-1)) != "..")
        up = part == ".."
        return (
            F.when(up & inside, F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .when(up & is_absolute(path), stack)
            .otherwise(F.concat(stack, F.array(part)))
        )

    return F.aggregate(parts, nothing, step)


def normal_path(path: Column) -> Column:
    """The shortest path with the same meaning; ``.`` for an empty relative one."""
    joined = F.array_join(components(path), "/")
    return F.when(is_absolute(path), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def shared_components(a: Column, b: Column) -> Column:
    """How many components two arrays begin with in common."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    step = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("same")),
        lambda so_far, p: F.struct(
            (so_far["n"] + F.when(so_far["same"] & p["a"].eqNullSafe(p["b"]), 1).otherwise(0)).alias("n"),
            (so_far["same"] & p["a"].eqNullSafe(p["b"])).alias("same"),
        ),
    )
    return step["n"]


def rest_after(path: Column, base: Column) -> Column:
    """The components of ``path`` after its first difference from ``base``, as a path; empty
    where it lies at or above the base."""
    own = components(path)
    shared = shared_components(own, components(base))
    return F.array_join(F.slice(own, shared + 1, F.size(own)), "/")


def path_rollup(df: DataFrame, path: str) -> DataFrame:
    """``dir, depth, files, names``: rows and distinct file names below each ancestor
    directory, in normal form. Equal paths are counted once before they are spread over
    ancestors."""
    counted = df.groupBy(F.col(path).alias("_path")).agg(F.count(F.lit(1)).alias("_n"))
    folder = dir_name(F.col("_path"))
    # the root is an empty first part, which a folder without any name has too
    rooted = is_absolute(folder) | (F.size(components(folder)) == 0)
    parts = F.when(rooted, F.concat(F.array(F.lit("")), components(folder))).otherwise(components(folder))
    spread = counted.select(
        "_n",
        file_name(F.col("_path")).alias("_file"),
        parts.alias("_parts"),
        F.explode(F.sequence(F.lit(1), F.size(parts))).alias("_depth"),
    )
    return (
        spread.groupBy(
            F.array_join(F.slice("_parts", F.lit(1), F.col("_depth")), "/").alias("dir"),
            (F.col("_depth") - 1).cast("long").alias("depth"),
            "_file",
        )
        .agg(F.sum("_n").alias("_n"))
        .groupBy("dir", "depth")
        .agg(F.sum("_n").alias("files"), F.count(F.lit(1)).alias("names"))
    )
