"""Approximate nearest neighbours by NN-descent and greedy graph search.

Every distinct vector is a node.  A graph of near neighbours starts in random
blocks and improves by rounds of Spark joins: each node brings its neighbours
and the nodes that point to it together, and whatever pair among them is
nearer than what one of the two knows becomes an edge.  A query then walks the
graph: a beam of the best nodes found is expanded until no expansion is left.
Scores of the answer are computed on the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few_tasks, free_shuffles, stored

NEIGHBOURS = 20
REVERSE = 20
#: Nodes of a random starting block, and how often blocks are drawn.
BLOCK, DRAWS = 1000, 2
#: Rounds go on until they change less than this share of the edges.
CHANGED = 0.001
#: Limits that fail: what has not settled by then is an error, never a result.
MOST_ROUNDS, MOST_HOPS = 100, 400
#: Candidates a node takes home from each meeting.
TAKEN = 6
BEAM = 256
#: Nodes whose exact scores are compared at the end, a multiple of the wanted.
SPARE = 6

_EDGE = "node long, nbr long, sim float"
#: ``last``: the worst edge of its node; ``fresh``: not an edge of the graph before.
_KEPT = f"{_EDGE}, last boolean, fresh boolean"


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``, many groups at a time."""
    rest: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if rest is None else pa.concat_tables([rest, rows])
        last = len(rows) - 1
        key = [rows[k].to_numpy() for k in keys]
        same = np.flatnonzero(np.any([k != k[last] for k in key], axis=0)) if last >= 0 else []
        cut = int(same[-1]) + 1 if len(same) else 0
        if cut:
            yield rows.slice(0, cut)
        rest = rows.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _starts(column: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]))


def _half_vectors(column: pa.ChunkedArray) -> np.ndarray:
    body = b"".join(column.to_pylist())
    return np.frombuffer(body, np.float16).reshape(len(column), -1).astype(np.float32)


def _edges(node, nbr, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(node, pa.int64()), pa.array(nbr, pa.int64()), pa.array(sim, pa.float32())],
        names=["node", "nbr", "sim"])


def _best(node, nbr, sim, most: int):
    """The ``most`` largest distinct neighbours of each node."""
    order = np.lexsort((-sim, nbr, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1]))) if len(node) else []
    node, nbr, sim = node[new], nbr[new], sim[new]
    order = np.lexsort((nbr, -sim, node))
    node, nbr, sim = node[order], nbr[order], sim[order]
    first = np.maximum.accumulate(np.where(
        np.concatenate(([True], node[1:] != node[:-1])), np.arange(len(node)), 0)) if len(node) else 0
    keep = np.arange(len(node)) - first < most
    return node[keep], nbr[keep], sim[keep]


def _block_edges(nodes: DataFrame, count: int, draw: int) -> DataFrame:
    """Nearest neighbours inside random blocks."""
    blocks = max(1, round(count / BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["block"]):
            edges = _starts(rows["block"].to_numpy())
            ids, x = rows["node"].to_numpy(), _half_vectors(rows["vec"])
            for a, b in zip(edges[:-1], edges[1:]):
                k = min(NEIGHBOURS, b - a - 1)
                if k < 1:
                    continue
                for s in range(a, b, 256):
                    e = min(s + 256, b)
                    sims = x[s:e] @ x[a:b].T
                    sims[np.arange(e - s), np.arange(s, e) - a] = -9
                    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                    yield _edges(np.repeat(ids[s:e], k), ids[a + top].ravel(),
                                 np.take_along_axis(sims, top, 1).ravel())

    block = F.pmod(F.xxhash64("node", F.lit(draw)), F.lit(blocks))
    return (few_tasks(nodes.select("node", "vec", block.alias("block")).repartition("block")
                      .sortWithinPartitions("block")).mapInArrow(run, _EDGE))


def _reduced(edges: DataFrame, most: int, before: DataFrame | None = None) -> DataFrame:
    """The ``most`` largest edges of each node, of ``edges`` and the graph ``before`` (``_KEPT``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["node"]):
            node, nbr, sim, old = (rows[c].to_numpy() for c in ("node", "nbr", "sim", "old"))
            known = np.unique(np.stack([node[old], nbr[old]], 1), axis=0)
            node, nbr, sim = _best(node, nbr, sim, most)
            both = np.concatenate([known, np.stack([node, nbr], 1)])
            order = np.lexsort((both[:, 1], both[:, 0]))  # stable, so a known pair comes first
            again = np.zeros(len(both), bool)
            again[order[1:]] = (both[order[1:]] == both[order[:-1]]).all(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(nbr), pa.array(sim, pa.float32()),
                 pa.array(np.append(node[1:] != node[:-1], True)[:len(node)]),
                 pa.array(~again[len(known):])], names=["node", "nbr", "sim", "last", "fresh"])

    edges = edges.select("node", "nbr", "sim", F.lit(False).alias("old"))
    if before is not None:
        edges = edges.unionByName(before.select("node", "nbr", "sim", F.lit(True).alias("old")))
    return few_tasks(edges.repartition("node").sortWithinPartitions("node")).mapInArrow(run, _KEPT)


def _both_ways(edges: DataFrame, turn: int, reverse: int) -> DataFrame:
    """``(node, nbr)``: neighbours, and at most ``reverse`` random nodes that point to a node."""
    place = Window.partitionBy("node").orderBy(F.xxhash64("nbr", F.lit(turn)), "nbr")
    back = (edges.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))
            .withColumn("place", F.row_number().over(place)).where(F.col("place") <= reverse))
    # dealt by ``nbr``, as the join with its vector wants them
    return (edges.select("node", "nbr").unionByName(few_tasks(back.select("node", "nbr")))
            .repartition("nbr").distinct())


def _round(edges: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """One round of neighbours of neighbours; returns the better edges."""
    worst = edges.where("last").select(F.col("node").alias("nbr"), F.col("sim").alias("worst"))
    known = nodes.select(F.col("node").alias("nbr"), "vec").join(worst, "nbr", "left")
    met = _both_ways(edges, turn, REVERSE).join(known, "nbr")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["node"]):
            cuts = _starts(rows["node"].to_numpy())
            ids, x = rows["nbr"].to_numpy(), _half_vectors(rows["vec"])
            worst = np.nan_to_num(rows["worst"].to_numpy().astype(np.float32), nan=-9)
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = min(TAKEN, b - a - 1)
                if k < 1:
                    continue
                sims = x[a:b] @ x[a:b].T
                np.fill_diagonal(sims, -9)
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                near = np.take_along_axis(sims, top, 1)
                i, j = np.nonzero(near > worst[a:b, None])
                out.append((ids[a + i], ids[a + top[i, j]], near[i, j]))
            if out:
                yield _edges(*_best(*(np.concatenate(c) for c in zip(*out)), NEIGHBOURS))

    better = (few_tasks(few_tasks(met.select("node", "nbr", "vec", "worst")).repartition("node")
                        .sortWithinPartitions("node")).mapInArrow(run, _EDGE))
    return _reduced(better, NEIGHBOURS, edges)


def build_graph(nodes: DataFrame, changed: float = CHANGED, most: int = MOST_ROUNDS) -> DataFrame:
    """Edges ``(node, nbr, sim)``, ``NEIGHBOURS`` per node, from ``(node, vec)``; stored.

    Rounds go on until one replaces less than the share ``changed`` of the edges.
    """
    count = nodes.count()
    edges = _block_edges(nodes, count, 0)
    for draw in range(1, DRAWS if count > BLOCK else 1):
        edges = edges.unionByName(_block_edges(nodes, count, draw))
    edges = stored(_reduced(edges, NEIGHBOURS), "graph")
    if count <= BLOCK:
        return edges
    for turn in range(most):
        edges = stored(_round(edges, nodes, turn), "graph")
        free_shuffles(nodes.sparkSession)
        if _fresh_share(edges) < changed:
            return edges
    raise RuntimeError(f"the neighbour graph has not settled after {most} rounds")


def _fresh_share(edges: DataFrame) -> float:
    """Share of the edges that the graph before did not have, by their marks."""
    row = edges.agg(F.count_if("fresh").alias("fresh"), F.count(F.lit(1)).alias("all")).first()
    return row["fresh"] / max(row["all"], 1)


def _changed_share(before: DataFrame, after: DataFrame) -> float:
    """Share of the edges of ``after`` that ``before`` does not have."""
    def kept(edges: DataFrame, name: str) -> DataFrame:
        return edges.groupBy("node").agg(F.collect_set("nbr").alias(name))

    both = kept(after, "new").join(kept(before, "old"), "node", "left")
    fresh = F.size(F.array_except("new", F.coalesce("old", F.array().cast("array<long>"))))
    row = both.agg(F.sum(fresh).alias("fresh"), F.sum(F.size("new")).alias("all")).first()
    return (row["fresh"] or 0) / max(row["all"] or 0, 1)


def search(edges: DataFrame, nodes: DataFrame, queries: DataFrame, wanted: int,
           beam: int = BEAM, most: int = MOST_HOPS) -> DataFrame:
    """``(query, node)``: the ``wanted`` best nodes of each query ``(query, node, vec)``.

    A query is a node of the graph and starts at its own neighbours.  Every hop
    expands all beam members that were not expanded; an expansion is a join
    with the node's neighbour list, which carries the neighbours' vectors.  The
    hops end when no beam has a member left to expand.
    """
    spark = nodes.sparkSession
    lists = (_both_ways(edges, -1, 2 * REVERSE)
             .join(nodes.select(F.col("node").alias("nbr"), "vec"), "nbr"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["node"]):
            cuts = _starts(rows["node"].to_numpy())
            node, ids, vecs = rows["node"].to_numpy(), rows["nbr"].to_numpy(), rows["vec"].to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[cuts[:-1]]),
                 pa.array([ids[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
                 pa.array([b"".join(vecs[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())],
                names=["node", "ids", "vecs"])

    lists = stored(few_tasks(few_tasks(lists.select("node", "nbr", "vec")).repartition("node")
                             .sortWithinPartitions("node"))
                   .mapInArrow(pack, "node long, ids binary, vecs binary"), "lists")
    free_shuffles(spark)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for query, own, vec, worst, ids, vecs in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(vec, np.float16).astype(np.float32)
                around = np.frombuffer(vecs, np.float16).reshape(-1, len(x)).astype(np.float32)
                sims, found = around @ x, np.frombuffer(ids, np.int64)
                good = (sims > worst) & (found != own)
                out.append((np.full(good.sum(), query), found[good], sims[good]))
            q, n, s = (np.concatenate(c) for c in zip(*out)) if out else (np.empty(0),) * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(q, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.float32()),
                 pa.array(np.zeros(len(q), bool))], names=["query", "node", "sim", "done"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["query"]):
            q, n, s, done = (rows[c].to_numpy() for c in ("query", "node", "sim", "done"))
            order = np.lexsort((~done, n, q))  # of one node's rows, an expanded one first
            q, n, s, done = q[order], n[order], s[order], done[order]
            new = np.concatenate(([True], (q[1:] != q[:-1]) | (n[1:] != n[:-1])))
            q, n, s, done = q[new], n[new], s[new], done[new]
            order = np.lexsort((n, -s, q))
            q, n, s, done = q[order], n[order], s[order], done[order]
            cuts = _starts(q)
            size = np.diff(cuts)
            rank = np.arange(len(q)) - np.repeat(cuts[:-1], size)
            last = np.where(size >= beam, s[np.minimum(cuts[:-1] + beam - 1, len(s) - 1)], -9)
            keep = rank < beam
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[keep]), pa.array(n[keep]), pa.array(s[keep]), pa.array(done[keep]),
                 pa.array(np.repeat(last, size)[keep].astype(np.float32)),
                 pa.array(rank[keep].astype(np.int32))],
                names=["query", "node", "sim", "done", "worst", "rank"])

    state = "query long, node long, sim float, done boolean, worst float, rank int"
    asked = queries.select("query", F.col("node").alias("own"), F.col("vec").alias("query_vec"))
    front = asked.select("query", F.col("own").alias("node"), "own", "query_vec",
                         F.lit(-9.0).cast("float").alias("worst"))
    beams = None
    for _ in range(most):
        reached = (few_tasks(front.join(lists, "node")
                             .select("query", "own", "query_vec", "worst", "ids", "vecs"))
                   .mapInArrow(expand, "query long, node long, sim float, done boolean"))
        if beams is not None:
            reached = reached.unionByName(
                beams.select("query", "node", "sim", F.lit(True).alias("done")))
        beams = stored(few_tasks(reached.repartition("query").sortWithinPartitions("query"))
                       .mapInArrow(merge, state), "beams")
        free_shuffles(spark)
        todo = beams.where("not done")
        if todo.isEmpty():
            return beams.where(F.col("rank") < wanted).select("query", "node")
        front = todo.join(asked, "query").select("query", "node", "own", "query_vec", "worst")
    raise RuntimeError(f"beams have members to expand after {most} hops")


def nearest_neighbours(vectors: DataFrame, is_query, id_col: str = "vec_id",
                       vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest cosine found per query row.

    ``is_query`` is a condition on the id column.  Ties go to the smaller id; a
    query is not its own answer.  Equal vectors are one node, of which only the
    ``k + 1`` smallest ids can be answers (found by a per-partition limit, so a
    vector that a third of the rows share is no hot group).

    Vectors that are null, zero, hold null or non-finite components or are not
    of the most frequent length take no part, nor do rows without an id.
    Repeated rows count once; other columns are ignored; fewer than ``k``
    candidates are all returned; an empty table gives an empty result.
    """
    x = F.col(vector_col)
    rows = (vectors.where(F.col(id_col).isNotNull() & x.isNotNull())
            .select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
            .where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
                   & F.exists("x", lambda v: v != 0)))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("x") == (length["d"] if length else 0))
    rows = rows.select("vec_id", "x", F.xxhash64("x").alias("node"))
    place = Window.partitionBy("node").orderBy("vec_id")
    members = stored(few_tasks(rows.distinct().withColumn("place", F.row_number().over(place))
                               .where(F.col("place") <= k + 1)), "members")
    kinds = rows.schema["vec_id"].dataType.simpleString()
    asked_ids = stored(few_tasks(rows.where(is_query(F.col("vec_id"))).select("vec_id", "node", "x")
                                 .distinct()), "asked")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            v = v / np.abs(v).max(axis=1, keepdims=True)
            v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in v], pa.binary())], names=["node", "vec"])

    nodes = stored(members.where("place = 1").select("node", "x")
                   .mapInArrow(shrink, "node long, vec binary"), "nodes")
    edges = build_graph(nodes)
    # copies of a query vector share the search of its node
    queries = stored(few_tasks(asked_ids.select("node").distinct().join(nodes, "node").select(
        F.col("node").alias("query"), "node", "vec")), "queries")
    found = search(edges, nodes, queries, wanted=SPARE * k)
    found = found.unionByName(queries.select("query", F.col("node").alias("node")))
    pairs = (found.join(members.select("node", F.col("vec_id").alias("hit"), F.col("x").alias("y")), "node")
             .withColumnRenamed("query", "query_node")
             .join(asked_ids.select(F.col("node").alias("query_node"), F.col("vec_id").alias("query_id"), "x"),
                   "query_node")
             .where("hit != query_id").select("query_id", "hit", "x", "y"))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(i).flatten().to_numpy().reshape(batch.num_rows, -1) for i in (2, 3))
            score = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)],
                                             names=["query_id", "vec_id", "score"])

    scored = few_tasks(pairs).mapInArrow(exact, f"query_id {kinds}, vec_id {kinds}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (few_tasks(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
