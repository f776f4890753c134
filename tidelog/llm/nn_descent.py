"""Approximate nearest neighbours by cosine: NN-descent and greedy graph search.

Equal vectors are one node, known by its smallest ids, so a very common vector costs nothing.
The graph starts with random neighbours (along a ring of all nodes in random order, so that all
nodes hang together) and with neighbours along random directions; up to ``degree`` + 1 nodes
all meet each other. In each
round a node's neighbours, in both directions, meet in a local join: they are compared with
each other, and each keeps the nearest it has seen. Neighbour lists are bounded by ``degree``
and a node takes part in at most ``reverse`` local joins of others per round as a reverse
neighbour, so hubs cost no more than other nodes; a pair is compared only when one of its two
links is new. Each query then searches the graph: it starts from its own neighbours and
spread entry points, expands the nearest nodes not yet expanded, and stops when none is left
in its beam. All steps are joins and aggregates; vectors travel with the links, so the rows
of a round are proportional to the links of the graph at every size.

Cosines are computed in double precision on the original vectors. Rows whose vector is null,
empty, zero or holds a null or a non-finite component take no part, nor do rows whose vector
has another length than most. Repeated vectors are neighbours of each other with cosine 1; ties
go to the smaller id; repeated ids count once. Tables with few vectors give all candidates, an
empty table gives an empty result. ``caps`` here bound lists of an approximate method; what
it finds of the true neighbours is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.blocks import release
from tidelog.llm.context_tree import stored
from tidelog.session import ship

DEGREE = 30
SAMPLE = 15
#: The descent ends when a round changes few links; this ceiling is far above its need.
ROUNDS = 60
BEAM = 200
EXPAND = 64
#: The search ends when no node of a beam is left to expand; this ceiling is far above its need.
HOPS = 60
#: What one node of a local join tells another one, and what is passed on for each node.
MEET = 6
TOLD = 40
#: Random links that a node starts with in each direction, and entry points of every search.
RANDOM = 4
ENTRIES = 16
#: Random directions along which nodes meet at the start.
DIRECTIONS = 4
#: Rows of local joins that are held at once, nodes whose joins are computed in one step, and
#: queries whose steps are scored together.
MEET_ROWS = 100_000
GROUPS = 256
BLOCK_QUERIES = 64
#: Ids that a node keeps of its equal vectors: the wanted ones, and the query's own.
SPARE = 1


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a list column of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(vectors: DataFrame, keep: int, id_col: str, vector_col: str) -> DataFrame:
    """``node, vector, ids``: the valid vectors, each once, with its ``keep`` smallest ids;
    the node is the smallest."""
    ids = F.col(id_col).cast("long")
    rows = vectors.select(ids.alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where("id is not null and vector is not null and size(vector) > 0").where(fine)
    rows = rows.where(F.exists("vector", lambda x: x != 0))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    widths = rows.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if widths is None:
        return rows.select(F.col("id").alias("node"), "vector", F.array("id").alias("ids"))
    rows = rows.where(F.size("vector") == widths["width"])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).sort_by("id")
            seen: dict[bytes, list[int]] = {}
            at = []
            values = matrix(table.column("vector"))
            for i, id_ in enumerate(table.column("id").to_pylist()):
                own = seen.setdefault(values[i].tobytes(), [])
                if len(own) < keep and (not own or own[-1] != id_):
                    own.append(id_)
                    at.append(i)
            yield from table.take(at).to_batches()

    few = rows.mapInArrow(smallest, "id long, vector array<double>")
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, keep)
    # At most ``keep`` ids of each vector arrive from each batch of rows.
    return few.groupBy("vector").agg(ids.alias("ids")).select(F.col("ids")[0].alias("node"), "vector", "ids")


def best(rows: DataFrame, key: str, other: str, keep: int, expand: int = 0) -> DataFrame:
    """The ``keep`` rows of each key with the largest cosine, each other node once; ``fresh`` 2
    marks the nearest ``expand`` of those that are fresh. Rows of a key are few: lists and
    local joins are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        a, b, score = (table.column(c).to_numpy() for c in (key, other, "score"))
        fresh = table.column("fresh").to_numpy()
        # An old link wins over the same link found again.
        order = np.lexsort((fresh, b, a))
        once = np.ones(len(order), bool)
        once[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        order = order[once]
        order = order[np.lexsort((b[order], -score[order], a[order]))]
        first, place = places(a[order])
        state = (fresh[order] > 0).astype(np.int32)
        if expand:
            upto = np.cumsum(state)
            turn = upto - (upto - state)[first]
            state[(state == 1) & (turn <= expand)] = 2
        few = place < keep
        kept = table.select([key, other, "score"]).take(order[few])
        yield from kept.append_column(pa.field("fresh", pa.int32()), pa.array(state[few])).to_batches()

    columns = rows.select(key, other, "score", "fresh")
    return columns.repartition(key).mapInArrow(run, f"{key} long, {other} long, score double, fresh int")


def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the run of each row of a sorted column begins, and the place of the row in it."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    first = np.repeat(starts, np.diff(np.append(starts, len(key))))
    return first, np.arange(len(key)) - first


def unit(values: np.ndarray) -> np.ndarray:
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def packed(nodes: DataFrame, width: int) -> DataFrame:
    """``node, half, single, along``: the vectors at length one as bytes of half and single
    precision, which pass through shuffles as they are, and their places along a few random
    directions. Local joins use half precision, the search single; scores of results use the
    original vectors."""
    ways = np.random.default_rng(7).normal(size=(width, DIRECTIONS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                values = unit(matrix(batch.column(1)))
                halves, singles = (
                    pa.array([row.tobytes() for row in values.astype(kind)], pa.binary()) for kind in (np.float16, np.float32)
                )
                along = pa.array((values @ ways).tolist(), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), halves, singles, along], ["node", "half", "single", "along"])

    rows = nodes.select("node", "vector").mapInArrow(run, "node long, half binary, single binary, along array<double>")
    return stored(rows, "packed")


def unpacked(column: pa.Array | pa.ChunkedArray, kind) -> np.ndarray:
    """The vectors of a column of bytes, as rows in single precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.view(kind).reshape(len(column), -1).astype(np.float32)


def initial(vectors: DataFrame, degree: int) -> DataFrame:
    """``a, b, score, fresh``: links along a few random directions: nodes are sorted into
    ranges by their place along each, and each meets the next ones of its range; and random
    links, which also join the ranges."""
    step = max(2, degree // 4)
    links = random_links(vectors, degree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, values = batch.column(0).to_numpy(), unpacked(batch.column(1), np.float16)
                for k in range(1, min(step, len(ids) - 1) + 1):
                    score = np.einsum("ij,ij->i", values[:-k], values[k:])
                    yield from both_ways(ids[:-k], ids[k:], score)

    for way in range(DIRECTIONS):
        ranged = vectors.select("node", "half", F.col("along")[way].alias("way")).repartitionByRange("way")
        links = links.unionByName(ranged.sortWithinPartitions("way").select("node", "half").mapInArrow(run, LINKS))
    return best(links, "a", "b", degree)


def both_ways(x: np.ndarray, y: np.ndarray, score: np.ndarray) -> Iterator[pa.RecordBatch]:
    """New links of pairs, from either end."""
    rest = [pa.array(score.astype(float)), pa.array(np.ones(len(x), np.int32))]
    for a, b in ((x, y), (y, x)):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *rest], ["a", "b", "score", "fresh"])


def random_links(vectors: DataFrame, degree: int) -> DataFrame:
    """``a, b, score, fresh``: all nodes stand on a ring in random order, and each meets the
    next one and a few at random distances; all others if they are ``degree`` at most."""
    placed = vectors.select("node", "half").repartition("node").sortWithinPartitions(F.xxhash64("node", F.lit(11)))
    own = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = stored(placed.select(F.spark_partition_id().alias("part"), own.alias("own"), "node", "half"), "ring")
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy("part").count().collect())  # a row per partition
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    total = before.pop()
    if total <= degree + 1:
        shifts = list(range(1, total))
    else:
        shifts = sorted({1, *np.random.default_rng(11).integers(2, total, RANDOM - 1).tolist()})
    offsets = vectors.sparkSession.createDataFrame(
        [(part, n) for (part, _), n in zip(sizes, before, strict=True)], "part int, before long"
    )
    placed = placed.join(F.broadcast(offsets), "part").select((F.col("own") + F.col("before")).alias("place"), "node", "half")
    ahead = F.explode(F.array(*map(F.lit, shifts)).cast("array<long>"))
    left = placed.select("place", ahead.alias("shift"), F.col("node").alias("a"), F.col("half").alias("left"))
    left = left.withColumn("place", F.pmod(F.col("place") + F.col("shift"), F.lit(total))).drop("shift")
    pairs = left.join(placed, "place").select("a", F.col("node").alias("b"), "left", "half")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (unpacked(batch.column(i), np.float16) for i in (2, 3))
                yield from both_ways(batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.einsum("ij,ij->i", x, y))

    return pairs.mapInArrow(run, LINKS)


def local_joins(graph: DataFrame, vectors: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """``a, b, score, fresh``: for each node, what its neighbours are to each other. Vectors
    travel to the nodes whose neighbours they are, so there are as many rows as links."""
    forward = graph.select(F.col("a").alias("at"), F.col("b").alias("node"), "fresh")
    backward = graph.select(F.col("b").alias("at"), F.col("a").alias("node"), "fresh")
    # A sample of the reverse links, new for each turn, keeps hubs from gathering all rows.
    inward = graph.groupBy("b").count().select(F.col("b").alias("at"), F.col("count").alias("m"))
    draw = F.pmod(F.xxhash64("at", "node", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)
    backward = backward.join(inward, "at").where(draw < F.lit(1.0 * sample) / F.col("m")).drop("m")
    # Where no link is new, all have met before.
    met = F.collect_list(F.struct("node", "fresh")).alias("met")
    meets = forward.unionByName(backward).groupBy("at").agg(met).where(F.exists("met", lambda x: x["fresh"] > 0))
    # A node whose list is full is told only of nodes that are nearer than its last one.
    last = graph.groupBy("a").agg(F.min("score").alias("least"), F.count("*").alias("links"))
    floor = F.when(F.col("links") >= degree, F.col("least")).otherwise(-2.0).alias("floor")
    known = vectors.select("node", "half").join(last.select(F.col("a").alias("node"), floor), "node", "left")
    rows = meets.select("at", F.inline("met")).join(known.na.fill(-2.0, ["floor"]), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= MEET_ROWS:
                table = pa.Table.from_batches(held)
                at = table.column("at").to_numpy()
                whole = int(np.searchsorted(at, at[-1]))  # the last node may go on
                if whole:
                    yield from meetings(table.slice(0, whole)).to_batches()
                held, size = table.slice(whole).to_batches(), len(at) - whole
        if size:
            yield from meetings(pa.Table.from_batches(held)).to_batches()

    rows = rows.select("at", "node", "fresh", "half", "floor").repartition("at").sortWithinPartitions("at")
    return rows.mapInArrow(run, LINKS)


def meetings(table: pa.Table) -> pa.Table:
    """The links that the neighbours of each node ``at`` learn of from each other."""
    at, node, fresh, floor = (table.column(c).to_numpy() for c in ("at", "node", "fresh", "floor"))
    order = np.lexsort((-fresh, node, at))
    once = np.ones(len(order), bool)
    once[1:] = (at[order][1:] != at[order][:-1]) | (node[order][1:] != node[order][:-1])
    order = order[once]
    at, node, fresh, floor = at[order], node[order], fresh[order] > 0, floor[order]
    values = unpacked(table.column("half"), np.float16)[order]
    first, place = places(at)
    starts = np.unique(first)
    sizes = np.diff(np.append(starts, len(at)))
    out: list[list[np.ndarray]] = [[], [], []]
    by_size = np.argsort(sizes, kind="stable")
    for group in np.split(by_size, range(GROUPS, len(by_size), GROUPS)):
        most = int(sizes[group].max())
        if most < 2:
            continue
        at_row = starts[group][:, None] + np.arange(most)
        filled = np.arange(most) < sizes[group][:, None]
        at_row = np.where(filled, at_row, 0)
        own = values[at_row]
        cosine = own @ own.transpose(0, 2, 1)
        new = fresh[at_row] & filled
        able = (new[:, :, None] | new[:, None, :]) & filled[:, :, None] & filled[:, None, :]
        able[:, np.arange(most), np.arange(most)] = False
        cosine[~able] = -3
        k = min(MEET, most - 1)
        near = np.argpartition(-cosine, k - 1, axis=2)[:, :, :k]
        score = np.take_along_axis(cosine, near, 2)
        good = score > floor[at_row][:, :, None]
        g, i, _ = np.nonzero(good)
        out[0].append(node[at_row[g, i]])
        out[1].append(node[at_row[g, near[good]]])
        out[2].append(score[good])
    a, b, score = (np.concatenate([*x, np.zeros(0, kind)]) for x, kind in zip(out, (np.int64, np.int64, float), strict=True))
    return links_table(a, b, score)


LINKS = "a long, b long, score double, fresh int"


def links_table(a: np.ndarray, b: np.ndarray, score: np.ndarray) -> pa.Table:
    """New links: the best that each node was told of, each pair once."""
    order = np.lexsort((b, -score, a))
    a, b, score = a[order], b[order], score[order].astype(float)
    once = np.ones(len(a), bool)
    once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])  # equal pairs have equal scores, or are met again
    a, b, score = a[once], b[once], score[once]
    few = places(a)[1] < TOLD
    ones = np.ones(int(few.sum()), np.int32)
    return pa.Table.from_arrays([pa.array(x) for x in (a[few], b[few], score[few], ones)], ["a", "b", "score", "fresh"])


def neighbour_graph(vectors: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """``a, b, score, fresh``: the nearest neighbours that NN-descent finds for each node of
    ``vectors`` (see ``packed``)."""
    graph = stored(initial(vectors, degree), "graph")
    total = vectors.count()
    if total <= degree + 1:  # all links are there
        return graph
    for turn in range(rounds):
        found = local_joins(graph, vectors, degree, sample, turn)
        old = graph.withColumn("fresh", F.lit(0))
        graph = stored(best(old.unionByName(found), "a", "b", degree), "graph")
        release(graph.sparkSession)
        if (graph.agg(F.sum("fresh")).first()[0] or 0) < 0.005 * degree * total:
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, vectors: DataFrame, beam: int, expand: int, hops: int) -> DataFrame:
    """``query, node, score, fresh``: the beams that greedy search ends with, from ``queries``
    (``node, vector``), which are nodes of the graph themselves."""
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select(F.col("node").alias("query"))
    own = vectors.select(F.col("node").alias("query"), "single").join(asked, "query")
    own = stored(own.select(block, "query", "single"), "asked")
    adjacent = graph.groupBy("a").agg(F.collect_list("b").alias("nodes"))  # of bounded length

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = right.column("query").to_numpy()
        order = np.argsort(known)
        values = unpacked(right.column("single"), np.float32)
        at = order[np.searchsorted(known[order], left.column("query").to_numpy())]
        score = np.empty(len(at))
        for s in range(0, len(at), 50_000):
            near = unpacked(left.column("single").slice(s, 50_000), np.float32)
            score[s : s + 50_000] = np.einsum("ij,ij->i", values[at[s : s + 50_000]], near)
        columns = [left.column("query"), left.column("node"), pa.array(score), pa.array(np.ones(len(at), np.int32))]
        return pa.Table.from_arrays(columns, ["query", "node", "score", "fresh"])

    def scored(pairs: DataFrame) -> DataFrame:
        near = pairs.join(vectors.select("node", "single"), "node").select(block, "query", "node", "single")
        schema = "query long, node long, score double, fresh int"
        return near.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)

    start = graph.select(F.col("a").alias("query"), F.col("b").alias("node")).join(asked, "query")
    state = best(scored(start).unionByName(entries(queries, nodes)), "query", "node", beam, expand)
    state = stored(state, "beam")
    for _ in range(hops):
        pick = state.where("fresh = 2").select("query", "node")
        if pick.isEmpty():
            break
        near = pick.join(adjacent, pick["node"] == adjacent["a"]).select("query", F.explode("nodes").alias("node")).distinct()
        near = near.where("query <> node").join(state.select("query", "node"), ["query", "node"], "left_anti")
        done = state.withColumn("fresh", F.when(F.col("fresh") == 1, 1).otherwise(0))
        state = stored(best(done.unionByName(scored(near)), "query", "node", beam, expand), "beam")
    release(graph.sparkSession)
    return state


def entries(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """``query, node, score, fresh``: every query and the same few random nodes."""
    picked = nodes.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(ENTRIES).select("node", "vector").collect()
    ids = np.array([r["node"] for r in picked], np.int64)
    values = unit(np.array([r["vector"] for r in picked], float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                query = np.repeat(batch.column(0).to_numpy(), len(ids))
                node = np.tile(ids, len(batch))
                score = (unit(matrix(batch.column(1))) @ values.T).ravel()
                other = query != node
                columns = [pa.array(x[other]) for x in (query, node, score, np.ones(len(query), np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["query", "node", "score", "fresh"])

    return queries.select("node", "vector").mapInArrow(run, "query long, node long, score double, fresh int")


def nearest(
    vectors: DataFrame,
    is_query,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    degree: int = DEGREE,
    rounds: int = ROUNDS,
    beam: int = BEAM,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row where ``is_query``
    (a condition on the rows) holds, its own id aside."""
    spark = vectors.sparkSession
    ship(spark)
    nodes = stored(distinct_vectors(vectors, k + SPARE, id_col, vector_col), "nodes")
    wanted = "query_id long, rank int, vec_id long, score double"
    if nodes.isEmpty():
        return spark.createDataFrame([], wanted)
    # Every id and its node; queries that share a vector share their search.
    valid = distinct_ids(vectors.where(is_query), nodes, id_col, vector_col)
    asked = stored(valid, "queries")
    vectors = packed(nodes, len(nodes.first()["vector"]))
    graph = neighbour_graph(vectors, degree, rounds=rounds)
    unique = nodes.join(asked.select("node").distinct(), "node")
    found = best(search(unique, graph, nodes, vectors, beam, EXPAND, HOPS), "query", "node", 4 * k).select("query", "node", "score")
    own = unique.select(F.col("node").alias("query"), "node", F.lit(1.0).alias("score"))
    hits = found.unionByName(own).join(nodes.select("node", "vector", "ids"), "node")
    hits = hits.select("query", F.explode("ids").alias("vec_id"), "vector")
    pairs = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query"), F.col("vector").alias("asked")).join(hits, "query")
    pairs = pairs.where("query_id <> vec_id").select("query_id", "vec_id", "vector", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                a, b = matrix(batch.column(2)), matrix(batch.column(3))
                score = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
                ones = pa.array(np.ones(len(batch)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), ones], ["query_id", "vec_id", "score", "fresh"])

    scored = pairs.mapInArrow(run, "query_id long, vec_id long, score double, fresh int")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    top = best(scored, "query_id", "vec_id", k)
    return top.select("query_id", order.cast("int").alias("rank"), "vec_id", "score")


def distinct_ids(vectors: DataFrame, nodes: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, node, vector`` of every row whose vector is a node."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null and vector is not null")
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    return rows.join(nodes.select("node", "vector"), "vector").select("id", "node", "vector").dropDuplicates(["id", "node"])
