"""Approximate nearest neighbours: a robust-pruned directed graph in each shard, searched by beams.

Vectors are dealt by a hash of their components to shards of about ``SHARD`` distinct vectors.  A shard's graph is built in
batches: greedy searches from a few entry points propose neighbours, relaxed distance pruning (a candidate goes when
``ALPHA`` times its distance to a kept neighbour is no more than its distance to the node) keeps diverse edges, and nodes
that got too many back edges are pruned the same way.  Every query searches every shard of its dimension with a beam.

Equal vectors are one node.  A node keeps the k + 1 smallest ids only, as no other can be among the k nearest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm.steps import written
from stackloom.llm.words import whole_groups, tidy

SHARD = 4096
DEGREE, BEAM, ALPHA = 24, 64, 1.2
ENTRIES, EXPAND, BATCH = 16, 4, 256
QUERY_BATCH = 512
#: Searches look further than the building does, as vectors that crowd one place need it.
QUERY_BEAM = 128

_INDEX = "dim int, shard int, n int, vectors binary, edges binary, ids array<array<bigint>>"


class Graph(NamedTuple):
    vectors: np.ndarray  # float32
    edges: np.ndarray  # nodes x DEGREE, -1 where there is none
    entries: np.ndarray


def entry_points(n: int) -> np.ndarray:
    return np.unique(np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64))


def beam_search(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of the ``beam`` nearest nodes met, nearest first; -1 and infinity where there are fewer."""
    q, n = len(queries), len(vectors)
    met = np.zeros((q, n + 1), dtype=bool)
    met[:, n] = True
    nodes = np.full((q, beam), -1, dtype=np.int64)
    dist = np.full((q, beam), np.inf, dtype=np.float32)
    done = np.ones((q, beam), dtype=bool)

    def merge(new: np.ndarray) -> None:
        """Adds nodes (n: none) to the beams."""
        nonlocal nodes, dist, done
        fresh = ~np.take_along_axis(met, new, axis=1)
        np.put_along_axis(met, new, True, axis=1)
        d = vectors[np.minimum(new, n - 1)] - queries[:, None, :]
        d = np.where(fresh, np.einsum("qmd,qmd->qm", d, d), np.inf).astype(np.float32)
        # a node that is proposed twice at once counts once
        order = np.argsort(new, axis=1, kind="stable")
        sorted_new = np.take_along_axis(new, order, axis=1)
        twice = np.zeros_like(fresh)
        twice[:, 1:] = sorted_new[:, 1:] == sorted_new[:, :-1]
        np.put_along_axis(d, order, np.where(twice, np.inf, np.take_along_axis(d, order, axis=1)).astype(np.float32), axis=1)
        nodes = np.concatenate([nodes, new], axis=1)
        dist = np.concatenate([dist, d], axis=1)
        done = np.concatenate([done, ~np.isfinite(d)], axis=1)
        order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
        nodes, dist, done = (np.take_along_axis(x, order, axis=1) for x in (nodes, dist, done))

    merge(np.tile(entries, (q, 1)))
    rows = np.arange(q)[:, None]
    while True:
        waiting = ~done
        if not waiting.any():
            break
        at = np.argsort(done, axis=1, kind="stable")[:, :EXPAND]
        use = waiting[rows, at]
        done[rows, at] = True
        near = edges[np.where(use, nodes[rows, at], 0)]
        near = np.where(use[:, :, None] & (near >= 0), near, n).reshape(q, -1)
        merge(near)
    return np.where(np.isfinite(dist), nodes, -1), dist


def robust_prune(vectors: np.ndarray, own: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Kept neighbours (-1: none) of the nodes ``own`` from ``candidates`` (-1: none; repeats allowed)."""
    b, m = candidates.shape
    c = vectors[np.maximum(candidates, 0)]
    away = c - vectors[own][:, None, :]
    d = np.einsum("bmd,bmd->bm", away, away)
    d[(candidates < 0) | (candidates == own[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, candidates = np.take_along_axis(d, order, axis=1), np.take_along_axis(candidates, order, axis=1)
    c = np.take_along_axis(c, order[:, :, None], axis=1)
    norm = np.einsum("bmd,bmd->bm", c, c)
    between = norm[:, :, None] + norm[:, None, :] - 2 * c @ c.transpose(0, 2, 1)
    alive = np.isfinite(d)
    out = np.full((b, degree), -1, dtype=np.int64)
    rows = np.arange(b)
    for k in range(degree):
        some = alive.any(axis=1)
        if not some.any():
            break
        pick = alive.argmax(axis=1)
        out[:, k] = np.where(some, candidates[rows, pick], -1)
        alive &= ~(some[:, None] & (alpha * alpha * np.maximum(between[rows, pick], 0) <= d))
        alive[rows, pick] = False
        # the same node again is at no distance, but for rounding
        alive &= ~(candidates == out[:, k : k + 1])
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> Graph:
    """Graph of distinct vectors, whose order must be random."""
    n = len(vectors)
    edges = np.full((n, degree), -1, dtype=np.int64)
    entries = entry_points(n)
    if n <= 1:
        return Graph(vectors, edges, entries)
    rng = np.random.default_rng(n)
    edges[:, : min(degree, 8)] = rng.integers(0, n, (n, min(degree, 8)))
    for last in (False, True):
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            own = order[low : low + BATCH]
            found, _ = beam_search(vectors, edges, entries, vectors[own], beam)
            edges[own] = robust_prune(vectors, own, np.concatenate([found, edges[own]], axis=1), degree, alpha if last else 1.0)
            # back edges
            source = np.repeat(own, degree)
            target = edges[own].ravel()
            source, target = source[target >= 0], target[target >= 0]
            by = np.argsort(target, kind="stable")
            source, target = source[by], target[by]
            nodes, first, count = np.unique(target, return_index=True, return_counts=True)
            place = np.arange(len(target)) - np.repeat(first, count)
            index = np.repeat(np.arange(len(nodes)), count)
            width = 2 * degree
            for start in range(0, int(count.max(initial=0)), width):  # all back edges of a node meet the pruning, in rounds
                ok = (place >= start) & (place < start + width)
                here = np.unique(index[ok])
                back = np.full((len(nodes), width), -1, dtype=np.int64)
                back[index[ok], place[ok] - start] = source[ok]
                for a in range(0, len(here), 2 * BATCH):
                    part = here[a : a + 2 * BATCH]
                    edges[nodes[part]] = robust_prune(vectors, nodes[part], np.concatenate([edges[nodes[part]], back[part]], axis=1), degree, alpha if last else 1.0)
    return Graph(vectors, connect(vectors, edges, entries, beam), entries)


def reached(edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Whether each node can be reached from the entries."""
    seen = np.zeros(len(edges), dtype=bool)
    seen[entries] = True
    front = entries
    while len(front):
        near = edges[front].ravel()
        near = np.unique(near[near >= 0])
        front = near[~seen[near]]
        seen[front] = True
    return seen


def connect(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, beam: int) -> np.ndarray:
    """The edges, and an edge to each node that no entry reaches, from a node that a search for it meets.

    It takes a free place of the nearest node that has one; if none has, all nodes get a place more.
    """
    while len(lost := np.flatnonzero(~reached(edges, entries))):
        lost = lost[:BATCH]
        found, _ = beam_search(vectors, edges, entries, vectors[lost], beam)
        for node, near in zip(lost, found, strict=True):
            near = near[near >= 0]
            free = (edges[near] < 0).any(axis=1)
            if not free.any():
                edges = np.concatenate([edges, np.full((len(edges), 1), -1, dtype=np.int64)], axis=1)
            at = near[free.argmax()]
            edges[at, (edges[at] < 0).argmax()] = node
    return edges


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["dim", "shard"], 1 << 20):
        keys = sorted(set(zip(table.column("dim").to_pylist(), table.column("shard").to_pylist(), strict=True)))
        dims, shards = table.column("dim").to_numpy(), table.column("shard").to_numpy()
        for dim, shard in keys:
            own = table.filter(pa.array((dims == dim) & (shards == shard)))
            vectors = _matrix(own.column("vector"), dim)
            graph = build_graph(vectors.astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dim], pa.int32()),
                    pa.array([shard], pa.int32()),
                    pa.array([len(vectors)], pa.int32()),
                    pa.array([vectors.tobytes()], pa.binary()),
                    pa.array([graph.edges.astype("<i4").tobytes()], pa.binary()),
                    pa.array([own.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))),
                ],
                names=["dim", "shard", "n", "vectors", "edges", "ids"],
            )


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v: doubles, dim) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v")).distinct()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as little-endian doubles."""
    for batch in batches:
        names = batch.schema.names
        lists = batch.column(names.index("v"))
        flat, bounds = lists.values.to_numpy(zero_copy_only=False).astype("<f8"), lists.offsets.to_numpy()
        raw = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [pa.array(raw, pa.binary()) if c == "v" else batch.column(i) for i, c in enumerate(names)]
        yield pa.RecordBatch.from_arrays(columns, names=["vector" if c == "v" else c for c in names])


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, shard_size: int = SHARD) -> DataFrame:
    """One row for each shard, written: dim, shard, n, vectors (doubles), edges (32-bit), ids of each node."""
    rows = _valid(vectors, id_col, vector_col)
    # only the k + 1 smallest ids of a vector are kept, which tasks do before the shuffle
    rank = F.row_number().over(Window.partitionBy("v", "dim").orderBy("vec_id"))
    nodes = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("v", "dim").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.mapInArrow(tidy(_packed), "vector binary, dim int, ids array<bigint>"))
    shards = max(1, -(-nodes.count() // shard_size))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))
    nodes = nodes.repartition("dim", "shard").sortWithinPartitions("dim", "shard", F.xxhash64("vector", F.lit(1)), "vector")
    return written(nodes.select("dim", "shard", "vector", "ids").mapInArrow(tidy(_build), _INDEX))


def _search(k: int, beam: int):
    """Streams the queries of a shard (kind 1) through its graph (kind 0), which precedes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, graph, exact, ids = None, None, None, None
        waiting: list[tuple[int, bytes]] = []

        def answers() -> Iterator[pa.RecordBatch]:
            if waiting:
                yield _nearest(graph, exact, ids, waiting, k, beam)
                waiting.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                here = (dim, batch.column("shard")[r].as_py())
                if here != key:
                    yield from answers()
                    key, graph = here, None
                if batch.column("kind")[r].as_py() == 0:
                    exact = np.frombuffer(batch.column("vectors")[r].as_py(), dtype="<f8").reshape(-1, dim)
                    edges = np.frombuffer(batch.column("edges")[r].as_py(), dtype="<i4").reshape(len(exact), -1).astype(np.int64)
                    graph = Graph(exact.astype(np.float32), edges, entry_points(len(exact)))
                    ids = batch.column("ids")[r].as_py()
                    continue
                if graph is None:
                    continue  # no vector of this length in this shard
                waiting.append((batch.column("query_id")[r].as_py(), batch.column("vectors")[r].as_py()))
                if len(waiting) >= QUERY_BATCH:
                    yield from answers()
        yield from answers()

    return run


def _nearest(graph: Graph, exact: np.ndarray, ids: list, waiting: list, k: int, beam: int) -> pa.RecordBatch:
    queries = np.frombuffer(b"".join(v for _, v in waiting), dtype="<f8").reshape(len(waiting), -1)
    nodes, _ = beam_search(graph.vectors, graph.edges, graph.entries, queries.astype(np.float32), beam)
    away = exact[np.maximum(nodes, 0)] - queries[:, None, :]
    dist = np.where(nodes < 0, np.inf, np.sqrt((away * away).sum(axis=2)))
    out: list[tuple[int, int, float]] = []
    for (query, _), own, d in zip(waiting, nodes, dist, strict=True):
        order = np.argsort(d, kind="stable")[: 2 * k + 2]
        near = [(d[j], i) for j in order if own[j] >= 0 for i in ids[own[j]] if i != query]
        out += [(query, i, float(x)) for x, i in sorted(near)[:k]]
    query_id, vec_id, score = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(query_id, pa.int64()), pa.array(vec_id, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, beam: int = QUERY_BEAM, shard_size: int = SHARD
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which ``is_query`` holds, by Euclidean distance.

    Distances are exact, in double precision; ties go to the smaller id; a query finds no row with its own id.  Rows with a
    null id, and vectors that are null, empty, zero or hold a null or non-finite component take no part.  Vectors of
    different length never meet.  Repeated rows count once; an id with several vectors counts with its nearest.
    """
    index = build_index(vectors, id_col, vector_col, k, shard_size)
    queries = _valid(vectors.filter(is_query), id_col, vector_col).mapInArrow(tidy(_packed), "vec_id long, vector binary, dim int")
    blank = index.select("dim", "shard", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("query_id"), "vectors", "edges", "ids")
    # a stated query set meets every shard
    last = index.agg(F.max("shard")).first()[0] or 0
    met = queries.select(
        "dim",
        F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard"),
        F.lit(1).alias("kind"),
        F.col("vec_id").alias("query_id"),
        F.col("vector").alias("vectors"),
        F.lit(None).cast("binary").alias("edges"),
        F.lit(None).cast("array<array<bigint>>").alias("ids"),
    )
    dealt = blank.unionByName(met).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "kind", "query_id")
    found = dealt.mapInArrow(tidy(_search(k, beam)), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
