"""Exact recall over a tree of balls (F8, D5): a query visits fewer blocks of a large history than with one level of pivots.

A node cuts its vectors among its pivots, each going to the nearest one, and knows for every pivot and every child between which
angles to that pivot the child's vectors lie.  A match within ``reach`` of a query lies in a child only if the query's angle to
each of the node's pivots is within ``reach`` of the child's range (triangle inequality on the sphere).  Children with too many
rows are nodes of the next level, until blocks are small or the tree has as many bytes as tasks should share.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.functions import fixed
from stackloom.operators.similarity import (
    BLOCK_ROWS,
    QUERY_CHUNK_ROWS,
    check_dimension,
    join_blocks,
    match_schema,
    pack_blocks,
    reach_of,
    sides,
    unit_rows,
    with_known,
)

FANOUT = 16
LEVELS = 8
#: Bytes of pivots and ranges that every task holds.
TREE_BYTES = 64 * 1024 * 1024


class Node(NamedTuple):
    """Pivots (rows), the cell of each child, and the least and largest angle of a child (column) to each pivot (row)."""

    pivots: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray


class Tree(NamedTuple):
    """Nodes by the cell they cut up; cells without a node are blocks, of so many rows."""

    nodes: dict[int, Node]
    rows: dict[int, int]


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0))


def place(nodes: dict[int, Node], vectors: np.ndarray) -> np.ndarray:
    """The block of each vector."""
    cell = np.zeros(len(vectors), np.int64)
    open_cells = [0]
    while open_cells:
        node = nodes.get(own := open_cells.pop())
        rows = np.flatnonzero(cell == own) if node is not None else ()
        if len(rows):
            cell[rows] = node.cells[_angles(vectors[rows], node.pivots).argmin(axis=1)]
            open_cells.extend(int(c) for c in np.unique(cell[rows]))
    return cell


def _visits(tree: Tree, reach: float, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(vectors, block) for each block that can hold a match of some."""
    waiting = [(0, np.arange(len(vectors)))]
    while waiting:
        own, rows = waiting.pop()
        node = tree.nodes.get(own)
        if node is None:
            yield rows, own
            continue
        angles = _angles(vectors[rows], node.pivots)[:, :, None]
        possible = ((angles >= node.low - reach) & (angles <= node.high + reach)).all(axis=1)
        for child in range(possible.shape[1]):
            if possible[:, child].any():
                waiting.append((int(node.cells[child]), rows[possible[:, child]]))


def visit(tree: Tree, vectors: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(vector, block) pairs that can hold a match, in order of the vectors."""
    pairs = [(rows, np.full(len(rows), own)) for rows, own in _visits(tree, reach, vectors)]
    rows, cells = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    order = np.lexsort((cells, rows))
    return rows[order], cells[order]


def _new_pivots(history: DataFrame, nodes: dict[int, Node], large: set[int], fanout: int, dim: int) -> dict[int, np.ndarray]:
    """Up to ``fanout`` different vectors of each large cell, chosen by a hash of their ids."""
    shared = history.sparkSession.sparkContext.broadcast((nodes, large))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, wanted = shared.value
        for batch in batches:
            cell = place(known, unit_rows(batch.column("embedding"), dim))
            keep = np.flatnonzero(np.isin(cell, list(wanted)))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(keep)) for c in batch.columns), pa.array(cell[keep])], names=[*batch.schema.names, "cell"])

    mixed = history.select(F.xxhash64("sig_id").alias("mixed"), "embedding")
    placed = mixed.mapInArrow(choose, T.StructType([*mixed.schema.fields, T.StructField("cell", T.LongType())]))
    first = placed.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("mixed"))).where(F.col("n") <= fanout)
    found: dict[int, list] = {}
    for row in first.orderBy("cell", "n").collect():  # bounded: fanout vectors a cell, and cells by the bytes of the tree
        found.setdefault(row["cell"], []).append(row["embedding"])
    out = {}
    for cell, rows in found.items():
        vectors = np.array(rows, dtype=float)
        vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
        _, first = np.unique(np.round(vectors, 12), axis=0, return_index=True)
        out[cell] = vectors[np.sort(first)]
    return out


def _ranges(history: DataFrame, nodes: dict[int, Node], new: dict[int, Node], dim: int) -> list:
    """(cell, pivot, low, high, rows) of the children of new nodes."""
    shared = history.sparkSession.sparkContext.broadcast((nodes, new))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, added = shared.value
        found: dict[int, list] = {}
        for batch in batches:
            vectors = unit_rows(batch.column("embedding"), dim)
            parent = place(known, vectors)
            for own in np.unique(parent):
                node = added.get(int(own))
                if node is None:
                    continue
                angles = _angles(vectors[parent == own], node.pivots)
                child = angles.argmin(axis=1)
                for c in np.unique(child):
                    part = angles[child == c]
                    low, high, rows = found.get(int(node.cells[c]), (np.inf, -np.inf, 0))
                    found[int(node.cells[c])] = (np.minimum(low, part.min(axis=0)), np.maximum(high, part.max(axis=0)), rows + len(part))
        rows = [(cell, i, float(low[i]), float(high[i]), n) for cell, (low, high, n) in found.items() for i in range(len(low))]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["cell", "pivot", "low", "high", "rows"])

    parts = history.select("embedding").mapInArrow(measure, "cell long, pivot int, low double, high double, rows long")
    return parts.groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("rows").alias("rows")).collect()


def build(history: DataFrame, rows: int, dim: int, block_rows: int = BLOCK_ROWS, fanout: int = FANOUT, tree_bytes: int = TREE_BYTES) -> Tree:
    """The tree of a history (sig_id, embedding) with so many rows; one pass for pivots and one for ranges a level.

    The history is not moved: tasks pass on a few vectors and ranges a cell.  A cell of equal vectors can't be cut.
    """
    nodes: dict[int, Node] = {}
    sizes = {0: rows}
    large = {0} if rows > block_rows else set()
    # of a node: its pivots, two ranges of each pivot and child, and the cells
    node_bytes = 8 * (fanout * dim + 2 * fanout * fanout + fanout)
    for _ in range(LEVELS):
        room = max(0, tree_bytes // node_bytes - len(nodes))
        large = set(sorted(large, key=lambda c: (-sizes[c], c))[:room])
        if not large:
            break
        new, next_cell = {}, max(sizes) + 1
        for cell, pivots in sorted(_new_pivots(history, nodes, large, fanout, dim).items()):
            # no more children than make small blocks
            n = min(len(pivots), max(2, -(-2 * sizes[cell] // block_rows)))
            if len(pivots) > 1:
                pivots = pivots[:n]
                new[cell] = Node(pivots, np.arange(next_cell, next_cell + n), np.full((n, n), np.inf), np.full((n, n), -np.inf))
                next_cell += n
        parents = {int(c): (node, i) for node in new.values() for i, c in enumerate(node.cells)}
        sizes |= dict.fromkeys(parents, 0)
        for row in _ranges(history, nodes, new, dim):  # bounded: fanout rows a cell
            node, child = parents[row["cell"]]
            node.low[row["pivot"], child], node.high[row["pivot"], child] = row["low"], row["high"]
            sizes[row["cell"]] = row["rows"]
        nodes |= new
        large = {c for c in parents if sizes[c] > block_rows}
    return Tree(nodes, {c: n for c, n in sizes.items() if c not in nodes})


def _with_block(df: DataFrame, tree: Tree, dim: int, reach: float | None) -> DataFrame:
    """Adds ``cell``, or with ``reach`` the ``cells`` that can hold a match."""
    kind = T.StructField("cell", T.IntegerType()) if reach is None else T.StructField("cells", T.ArrayType(T.IntegerType()))
    shared = df.sparkSession.sparkContext.broadcast(tree)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = unit_rows(batch.column("embedding"), dim)
            if reach is None:
                extra = pa.array(place(shared.value.nodes, vectors).astype(np.int32))
            else:
                rows, cells = visit(shared.value, vectors, reach)
                ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(vectors)))).astype(np.int32)
                extra = pa.ListArray.from_arrays(pa.array(ends), pa.array(cells.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, extra], names=[*batch.schema.names, kind.name])

    return df.mapInArrow(assign, T.StructType([*df.schema.fields, kind]))


def _prepared(queries: DataFrame, history: DataFrame, as_of: bool, dim: int | None, sizes: dict) -> tuple | None:
    asked, stored = sides(queries, history, as_of)
    rows, found = stored.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not rows:
        return None
    dim = dim or found
    asked, stored = check_dimension(asked, dim), check_dimension(stored, dim)
    return asked, stored, dim, build(stored, rows, dim, **sizes)


def nearest_in_tree(
    queries: DataFrame,
    history: DataFrame,
    k: int = fixed.RECALL_K,
    threshold: float = fixed.RECALL_THRESHOLD,
    as_of: bool = False,
    dim: int | None = None,
    chunk_rows: int = QUERY_CHUNK_ROWS,
    **sizes: int,
) -> DataFrame:
    """What ``similarity.nearest`` gives, whole at any threshold.  ``sizes`` are those of ``build``."""
    schema = match_schema(queries, history)
    ready = _prepared(queries, history, as_of, dim, sizes)
    if ready is None:
        return queries.sparkSession.createDataFrame([], schema)
    asked, stored, dim, tree = ready
    block_rows = sizes.get("block_rows", BLOCK_ROWS)
    rows = np.array([tree.rows.get(c, 0) for c in range(max(tree.rows) + 1)])
    visits = partial(_visits, tree, reach_of(threshold))
    packing = pack_blocks(rows, block_rows, asked.count(), chunk_rows, dim, queries.sparkSession.sparkContext.defaultParallelism)
    return join_blocks(_with_block(stored, tree, dim, None), asked, visits, packing, dim, k, threshold, as_of, schema)


def recall_in_tree(queries: DataFrame, history: DataFrame, k: int = fixed.RECALL_K, threshold: float = fixed.RECALL_THRESHOLD, as_of: bool = False, **sizes: int) -> DataFrame:
    """``recall`` by the tree."""
    return with_known(nearest_in_tree(queries, history, k, threshold, as_of, **sizes), history)


def visits(queries: DataFrame, history: DataFrame, threshold: float = fixed.RECALL_THRESHOLD, dim: int | None = None, **sizes: int) -> DataFrame:
    """What a recall costs: for each query the blocks it visits (``blocks``) and the rows they hold (``rows``)."""
    ready = _prepared(queries, history, False, dim, sizes)
    if ready is None:
        return queries.select("doc_id", F.lit(0).alias("blocks"), F.lit(0).cast("bigint").alias("rows"))
    asked, _, dim, tree = ready
    block_rows = sizes.get("block_rows", BLOCK_ROWS)
    counts = [tree.rows.get(c, 0) for c in range(max(tree.rows) + 1)]
    held, parts = F.lit([int(n) for n in counts]), F.lit([max(1, -(-n // block_rows)) for n in counts])

    def total(of):
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda done, c: done + F.get(of, c))

    return _with_block(asked, tree, dim, reach_of(threshold)).select("doc_id", total(parts).cast("int").alias("blocks"), total(held).alias("rows"))
