"""Recall of similar past errors by cosine similarity (A8, B19, D5, D10, F8, K).

The answer is exact at any size.  While the history's vectors fit a checked byte budget they go to every task as one
matrix and the queries are not shuffled.  Beyond that the history is cut into bounded blocks around pivot vectors and a
query is sent only to blocks that can hold a match; no cross join, and no pair leaves a task unless it is among the
query's best of that block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.functions import fixed

BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 50_000
QUERY_CHUNK_ROWS = 1_000_000
PIVOTS = 64
TILE_ROWS = 4096
QUERY_ROWS = 1024
# Blocks are packed, so that a query is moved once to a task and not once to each block: bytes of history vectors and tiles
# (bits of a long) in a pack, and comparisons in a task.
PACK_BYTES = 64 * 1024 * 1024
PACK_TILES = 62
TASK_PAIRS = 2**32
# Scores are compared at this precision, so that equal vectors tie whatever order a dot product was summed in.
SCORE_DIGITS = 12


def check_dimension(df: DataFrame, dim: int, col: str = "embedding") -> DataFrame:
    """The same rows; a vector of another dimension fails the job and names both."""
    size = F.size(col)
    message = F.concat(F.lit("vector has size "), size.cast("string"), F.lit(f", want {dim}"))
    return df.withColumn(col, F.when(size == dim, F.col(col)).otherwise(F.raise_error(message)))


def dimensions(df: DataFrame, col: str = "embedding") -> DataFrame:
    """How many vectors there are of each dimension."""
    return df.groupBy(F.size(col).alias("dim")).agg(F.count(F.lit(1)).alias("vectors"))


def with_vector(df: DataFrame, col: str = "embedding") -> DataFrame:
    """Only rows that have a vector."""
    return df.where(F.col(col).isNotNull() & (F.size(col) > 0))


def hash_embed(df: DataFrame, dim: int = 256, text: str = "text") -> DataFrame:
    """K: a lexical stand-in for a model's embedding: word counts of unit length, words placed by their md5.

    The default recall threshold is not calibrated for it.  A text without words gets no vector.
    """
    words = F.filter(F.split(F.lower(text), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    places = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dim).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_places", outputCol="_counts")
    counts = counter.transform(df.withColumn("_places", F.coalesce(places, F.array().cast("array<string>"))))
    unit = Normalizer(inputCol="_counts", outputCol="_unit").transform(counts)
    return unit.withColumn(
        "embedding", F.when(F.size("_places") > 0, vector_to_array("_unit")).otherwise(F.array().cast("array<double>"))
    ).drop("_places", "_counts", "_unit")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors, for single pairs."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def unit_rows(vectors: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dim)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms == 0, 1.0, norms)


def _first_k(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int):
    """The k best per row; rows of equal score keep the order of ``cols``."""
    order = np.lexsort((cols, -scores, rows))
    rows, cols, scores = rows[order], cols[order], scores[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") < k
    return rows[kept], cols[kept], scores[kept]


def _hidden(asked: tuple, since: tuple, until: tuple, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Of which pairs of a query (row) and a history row (column) the query may not see the latter; sides are (times, ids or None).

    A row counts for queries after its ``since`` and up to its ``until``.  Equal times are told apart by ids, if there
    are any; only pairs of equal times look at them.
    """
    time, start, end = asked[0][rows], since[0][cols], until[0][cols]
    over = end < time
    hidden = (start >= time) | over
    if since[1] is not None:
        same = np.flatnonzero(start == time)
        hidden[same] = (since[1][cols[same]] >= asked[1][rows[same]]) | over[same]
        same = np.flatnonzero((end == time) & ~hidden)
        hidden[same] = until[1][cols[same]] < asked[1][rows[same]]
    return hidden


def top_matches(queries, history, k, threshold, asked=None, valid=None):
    """Row numbers of queries and history and their scores: per query the k best at or above the threshold.

    With ``asked`` only what a query may see counts (``_hidden``).  Queries of about one time are then taken together, against the
    history rows that count at some time of theirs: of the versions of a family few do, however many there are.
    """
    if asked is None:
        return _top_seen(queries, history, k, threshold)
    order = np.argsort(asked[0], kind="stable")
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for q in range(0, len(order), QUERY_ROWS):
        own = order[q : q + QUERY_ROWS]
        cols = np.flatnonzero((valid[0][0] <= asked[0][own[-1]]) & (valid[1][0] >= asked[0][own[0]]))
        mine = tuple(x if x is None else x[own] for x in asked)
        sides = tuple(tuple(x if x is None else x[cols] for x in side) for side in valid)
        found = _top_seen(queries[own], history if len(cols) == len(history) else history[cols], k, threshold, mine, sides)
        parts.append((own[found[0]], cols[found[1]], found[2]))
    rows, cols, scores = (np.concatenate(column) for column in zip(*parts))
    back = np.argsort(rows, kind="stable")
    return rows[back], cols[back], scores[back]


def _top_seen(queries, history, k, threshold, asked=None, valid=None):
    """``top_matches`` against all history rows given.  Once a query has k matches only better ones are looked at."""
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for q in range(0, len(queries), QUERY_ROWS):
        own = queries[q : q + QUERY_ROWS]
        mine = None if asked is None else tuple(x if x is None else x[q : q + QUERY_ROWS] for x in asked)
        floor = np.full(len(own), float(threshold))
        best = parts[0]
        for h in range(0, len(history), TILE_ROWS):
            scores = own @ history[h : h + TILE_ROWS].T
            # what rounding may lift to the floor is looked at as well
            near = scores >= (floor - 2 * 10.0**-SCORE_DIGITS)[:, None]
            rows, cols = np.nonzero(near)
            if asked is not None:
                seen = ~_hidden(mine, *(tuple(x if x is None else x[h : h + TILE_ROWS] for x in side) for side in valid), rows, cols)
                rows, cols = rows[seen], cols[seen]
            if len(rows) > 16 * k * len(own) and scores.shape[1] > k:
                kept = np.full(scores.shape, -2.0)
                kept[rows, cols] = np.round(scores[rows, cols], SCORE_DIGITS)
                rows, cols = np.nonzero(kept >= np.maximum(np.partition(kept, -k, axis=1)[:, -k], floor)[:, None])
            found = np.round(scores[rows, cols], SCORE_DIGITS)
            enough = found >= floor[rows]
            if not enough.any():
                continue
            new = (rows[enough], cols[enough] + h, found[enough])
            best = _first_k(*(np.concatenate(pair) for pair in zip(best, new)), k)
            full = np.bincount(best[0], minlength=len(own)) >= k
            floor[full] = best[2][np.searchsorted(best[0], np.flatnonzero(full), side="right") - 1]
        parts.append((best[0] + q, best[1], best[2]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _micros(batch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def match_schema(queries: DataFrame, history: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("doc_id", queries.schema["doc_id"].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("sig_id", history.schema["sig_id"].dataType),
            T.StructField("version", T.LongType()),
            T.StructField("score", T.DoubleType()),
        ]
    )


def _matched(doc_ids: pa.Array, held: tuple, found: tuple) -> pa.RecordBatch:
    """The matches of one batch of queries as rows; ``found`` is ordered by query and rank."""
    rows, cols, scores = found
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
    taken = pa.array(cols)
    return pa.RecordBatch.from_arrays(
        [doc_ids.take(pa.array(rows)), pa.array(rank.astype(np.int32)), held[0].take(taken), held[1].take(taken), pa.array(scores)],
        names=["doc_id", "rank", "sig_id", "version", "score"],
    )


def _held(table: pa.Table, dim: int) -> tuple:
    """History rows as tasks use them: ids, versions, unit vectors, times (and ids) of validity."""
    table = table.combine_chunks()
    ids, versions = (table.column(name).combine_chunks() for name in ("sig_id", "version"))
    valid = ((_micros(table, "time"), _texts(table, "since_id")), (_micros(table, "until"), _texts(table, "until_id")))
    return ids, versions, unit_rows(table.column("embedding"), dim), valid


def _texts(batch, name: str) -> np.ndarray | None:
    """A column of ids as Python texts, a missing one as the empty text; None if there is no such column."""
    if name not in batch.schema.names:
        return None
    return np.array([x or "" for x in batch.column(name).to_pylist()], dtype=object)


def _asked(batch, held: tuple, as_of: bool) -> tuple | None:
    if not as_of:
        return None
    named = held[3][0][1] is not None
    return _micros(batch, "time"), np.array([str(x) for x in batch.column("doc_id").to_pylist()], dtype=object) if named else None


def _broadcast_matches(queries, small: pa.Table, dim, k, threshold, as_of, schema) -> DataFrame:
    """Queries against one matrix that every task holds."""
    shared = queries.sparkSession.sparkContext.broadcast(_held(small.sort_by("sig_id"), dim))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            asked = _asked(batch, held, as_of)
            found = top_matches(unit_rows(batch.column("embedding"), dim), held[2], k, threshold, asked, held[3])
            yield _matched(batch.column("doc_id"), held, found)

    return queries.mapInArrow(match, schema)


def _with_cells(df: DataFrame, pivots: np.ndarray, dim: int) -> DataFrame:
    """Adds ``cell`` (the nearest pivot) and ``angle``."""
    added = [T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = np.arccos(np.clip(unit_rows(batch.column("embedding"), dim) @ pivots.T, -1.0, 1.0))
            cell = angles.argmin(axis=1)
            extra = [pa.array(cell.astype(np.int32)), pa.array(angles[np.arange(len(cell)), cell])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *(f.name for f in added)])

    return df.mapInArrow(assign, T.StructType([*df.schema.fields, *added]))


def _visits(pivots: np.ndarray, radii: np.ndarray, reach: float, vectors: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """(vectors, cell) for each cell that can hold a match of some.

    Angles on the unit sphere obey the triangle inequality: a vector within ``reach`` of the query whose distance to
    pivot p is at most radii[p] forces angle(query, p) <= radii[p] + reach.
    """
    possible = np.arccos(np.clip(vectors @ pivots.T, -1.0, 1.0)) <= radii + reach
    for cell in range(len(pivots)):
        yield np.flatnonzero(possible[:, cell]), cell


def _blocked_matches(queries, history, dim, k, threshold, as_of, schema, block_rows, chunk_rows, pivot_count) -> DataFrame:
    """Queries against a history that is too large to share.

    A history row lives in one (cell, part); a cell with many rows has many parts, so near copies that fill one cell
    are split as well.  Tasks get a block's history rows first and stream the block's queries past them.
    """
    pivot_rows = (
        history.select("embedding").orderBy(F.xxhash64("sig_id"), "sig_id").limit(pivot_count).collect()
    )  # bounded: pivot_count vectors
    pivots = np.array([row.embedding for row in pivot_rows], dtype=float)
    pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-300)

    placed = _with_cells(history, pivots, dim)
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius")).collect()
    radii = np.full(len(pivots), -np.inf)  # an empty cell admits no query
    rows = np.zeros(len(pivots), np.int64)
    for row in stats:  # bounded: one row per pivot
        radii[row.cell], rows[row.cell] = row.radius, row.rows
    visits = partial(_visits, pivots, radii, reach_of(threshold))
    packing = pack_blocks(rows, block_rows, queries.count(), chunk_rows, dim, queries.sparkSession.sparkContext.defaultParallelism)
    return join_blocks(placed, queries, visits, packing, dim, k, threshold, as_of, schema)


def reach_of(threshold: float) -> float:
    """The largest angle to a match."""
    return float(np.arccos(np.clip(threshold, -1.0, 1.0))) + 1e-6


class Packing(NamedTuple):
    """Of each cell its first block and number of blocks, of each block its pack and its tile there, and how often queries are cut."""

    first: np.ndarray
    parts: np.ndarray
    pack: np.ndarray
    tile: np.ndarray
    chunks: int

    @property
    def packs(self) -> int:
        return int(self.pack.max()) + 1


def pack_blocks(rows: np.ndarray, block_rows: int, queries: int, chunk_rows: int, dim: int, cores: int) -> Packing:
    """Where blocks of at most ``block_rows`` of the rows of each cell, and chunks of at most ``chunk_rows`` queries, meet.

    What a block and a chunk have to be small for is their task, which any number of small ones can share: a task gets
    ``TASK_PAIRS`` comparisons at most, and more tasks than twice the cores are not made for fewer.  Neighbouring cells
    share a tile, tiles a pack.  A query is moved once a pack and a history row once a chunk, which are about as many.
    """
    rows = np.asarray(rows, np.int64)
    parts = np.maximum(1, -(-rows // block_rows))
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    total, blocks = max(1, int(rows.sum())), int(parts.sum())
    units = blocks * max(1, -(-queries // chunk_rows))
    tasks = max(-(-total * queries // TASK_PAIRS), min(2 * cores, units), 1)
    most = max(1, PACK_BYTES // (8 * (dim + 6)))
    pack_rows = min(most, -(-total // math.ceil(math.sqrt(tasks))))
    tile_rows = min(pack_rows, max(TILE_ROWS, -(-2 * pack_rows // PACK_TILES)))
    pack, tile = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    p = t = in_pack = in_tile = 0
    for block, size in enumerate(np.repeat(-(-rows // parts), parts).tolist()):
        if in_pack and (in_pack + size > pack_rows or (in_tile + size > tile_rows and t + 1 == PACK_TILES)):
            p, t, in_pack, in_tile = p + 1, 0, 0, 0
        elif in_tile and in_tile + size > tile_rows:
            t, in_tile = t + 1, 0
        pack[block], tile[block] = p, t
        in_pack, in_tile = in_pack + size, in_tile + size
    return Packing(first, parts, pack, tile, -(-tasks // (p + 1)))


def _routed(queries: DataFrame, visits: Callable, packing: Packing, dim: int) -> DataFrame:
    """One row for each query and pack that it visits, with the ``tiles`` it visits there."""
    shared = queries.sparkSession.sparkContext.broadcast((visits, packing))
    added = [T.StructField("pack", T.LongType()), T.StructField("tiles", T.LongType())]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visited, laid = shared.value
        bits: list[dict[int, int]] = []
        for start, count in zip(laid.first.tolist(), laid.parts.tolist()):
            own: dict[int, int] = {}
            for block in range(start, start + count):
                own[int(laid.pack[block])] = own.get(int(laid.pack[block]), 0) | 1 << int(laid.tile[block])
            bits.append(own)
        step = max(1, 100_000 // laid.packs)
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                tiles = np.zeros((batch.num_rows, laid.packs), np.int64)
                for rows, cell in visited(unit_rows(batch.column("embedding"), dim)):
                    for pack, mask in bits[cell].items():
                        tiles[rows, pack] |= mask
                rows, packs = np.nonzero(tiles)
                extra = [pa.array(packs.astype(np.int64)), pa.array(tiles[rows, packs])]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in batch.columns), *extra], names=[*batch.schema.names, "pack", "tiles"])

    return queries.mapInArrow(route, T.StructType([*queries.schema.fields, *added]))


def _tile_matches(run: pa.RecordBatch, held: tuple, tiles: list, rank: np.ndarray, by_rank: np.ndarray, k: int, threshold: float, asked: tuple | None, dim: int):
    """``top_matches`` of queries and the tiles (number, start, end) of a pack that they visit; ties by the rank of history rows."""
    vectors, visited = unit_rows(run.column("embedding"), dim), _micros(run, "tiles")
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for tile, start, end in tiles:
        rows = np.flatnonzero((visited >> tile) & 1)
        if len(rows):
            mine = None if asked is None else tuple(x if x is None else x[rows] for x in asked)
            valid = tuple(tuple(x if x is None else x[start:end] for x in side) for side in held[3])
            found = top_matches(vectors[rows], held[2][start:end], k, threshold, mine, valid)
            parts.append((rows[found[0]], rank[found[1] + start], found[2]))
    rows, ranks, scores = _first_k(*(np.concatenate(column) for column in zip(*parts)), k)
    return rows, by_rank[ranks], scores


def match_packs(arranged: DataFrame, dim: int, k: int, threshold: float, as_of: bool, schema: T.StructType) -> DataFrame:
    """The k best matches of each query in each pack; history rows (``side`` 0) come first in order of tiles and ids."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stored, held = None, [], None
        for batch in batches:
            block = np.stack([_micros(batch, name) for name in ("pack", "chunk", "side")], axis=1)
            starts = np.concatenate([[0], np.nonzero((block[1:] != block[:-1]).any(axis=1))[0] + 1, [len(block)]])
            for start, end in zip(starts[:-1], starts[1:]):
                key, run = tuple(block[start][:2]), batch.slice(start, end - start)
                if key != current:
                    current, stored, held = key, [], None
                if block[start][2] == 0:
                    stored.append(run)
                    continue
                if not stored:
                    continue
                if held is None:
                    table = pa.Table.from_batches(stored)
                    held, stored = _held(table, dim), [run.slice(0, 0)]
                    numbers, first = np.unique(_micros(table, "tile"), return_index=True)
                    tiles = list(zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(table)]))
                    by_rank = pc.sort_indices(table, sort_keys=[("sig_id", "ascending")]).to_numpy()
                    rank = np.empty(len(by_rank), np.int64)
                    rank[by_rank] = np.arange(len(by_rank))
                found = _tile_matches(run, held, tiles, rank, by_rank, k, threshold, _asked(run, held, as_of), dim)
                yield _matched(run.column("doc_id"), held, found)

    return arranged.mapInArrow(match, schema)


def join_blocks(placed, queries, visits, packing: Packing, dim, k, threshold, as_of, schema) -> DataFrame:
    """History rows with their ``cell`` against queries; ``visits`` gives (vectors, cell) for the cells that can hold a match of theirs.

    A history row goes to one block of its cell, that block's pack and all its chunks, a query to its chunk of all packs it visits.
    """
    chunks = F.lit(packing.chunks).cast("bigint")
    first, parts, pack, tile = (F.lit(x.astype(np.int64)) for x in packing[:4])
    block = F.get(first, F.col("cell")) + F.pmod(F.xxhash64("sig_id", "version"), F.get(parts, F.col("cell")))
    history_side = placed.withColumn("block", block.cast("int")).select(
        F.get(pack, F.col("block")).alias("pack"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), chunks - 1)).alias("chunk"),
        F.lit(0).alias("side"),
        F.get(tile, F.col("block")).alias("tile"),
        "sig_id",
        "version",
        "embedding",
        "time",
        "until",
        *(c for c in ("since_id", "until_id") if c in placed.columns),
    )
    query_side = _routed(queries, visits, packing, dim).select(
        "pack", F.pmod(F.xxhash64("doc_id"), chunks).alias("chunk"), F.lit(1).alias("side"), "tiles", "doc_id", "embedding", "time"
    )
    both = history_side.unionByName(query_side, allowMissingColumns=True)
    # a partition for each pack and chunk, of about equal work
    arranged = both.repartitionById(packing.packs * packing.chunks, (F.col("pack") * chunks + F.col("chunk")).cast("int"))
    arranged = arranged.sortWithinPartitions("pack", "chunk", "side", "tile", "sig_id", "time")  # queries by time

    # At most k candidates per pack are left of a query.
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "sig_id")
    best = match_packs(arranged, dim, k, threshold, as_of, schema).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k)


def sides(queries: DataFrame, history: DataFrame, as_of: bool) -> tuple[DataFrame, DataFrame]:
    """Queries and history rows that have a vector, with the times between which they count."""
    versioned = "version" in history.columns

    def micros(name: str) -> Column:
        return F.unix_micros(F.col(name).cast("timestamp"))

    def side(df: DataFrame, *more: Column | str) -> DataFrame:
        return with_vector(df).select(*more, F.col("embedding").cast("array<double>").alias("embedding"))

    zero, forever = F.lit(0).cast("bigint"), F.lit(2**63 - 1).cast("bigint")
    asked = side(queries, "doc_id", (micros("ts") if as_of else zero).alias("time"))
    stored = side(
        history,
        "sig_id",
        (F.col("version") if versioned else zero).alias("version"),
        (micros("first_seen") if as_of else zero).alias("time"),
        (F.coalesce(micros("valid_until"), forever) if as_of and versioned else forever).alias("until"),
        *(("since_id", "until_id") if as_of and "since_id" in history.columns else ()),
    )
    return asked, stored


def nearest(
    queries: DataFrame,
    history: DataFrame,
    k: int = fixed.RECALL_K,
    threshold: float = fixed.RECALL_THRESHOLD,
    as_of: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
    chunk_rows: int = QUERY_CHUNK_ROWS,
    pivots: int = PIVOTS,
    dim: int | None = None,
) -> DataFrame:
    """doc_id, rank, sig_id, version, score of the k most similar history rows at or above the threshold.

    ``as_of`` (D10) lets a query (column ``ts``) see only what was there before it: history rows whose ``first_seen``
    is earlier, and of the rows that ``history_versions`` gives those whose (time, id) is earlier than its own and which
    none that is earlier replaces.  Ties go to the smaller sig_id.  ``dim`` is the vectors' size, by default the largest that
    is stored; others fail the job.  The history is computed twice, to count and to match it.
    """
    asked, stored = sides(queries, history, as_of)
    schema = match_schema(queries, history)
    rows, found = stored.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    if not rows:
        return queries.sparkSession.createDataFrame([], schema)
    dim = dim or found
    asked, stored = check_dimension(asked, dim), check_dimension(stored, dim)

    fits = max(1, broadcast_bytes // (8 * (dim + 6)))
    if rows <= fits:  # counted where the rows are; only what fits the byte budget is fetched
        return _broadcast_matches(asked, stored.toArrow(), dim, k, threshold, as_of, schema)
    return _blocked_matches(asked, stored, dim, k, threshold, as_of, schema, block_rows, chunk_rows, pivots)


def recall(
    queries: DataFrame,
    history: DataFrame,
    k: int = fixed.RECALL_K,
    threshold: float = fixed.RECALL_THRESHOLD,
    as_of: bool = False,
    **sizes: int,
) -> DataFrame:
    """The nearest past errors with what is known about them: count, last_seen, cause, fixes."""
    return with_known(nearest(queries, history, k, threshold, as_of, **sizes), history)


def with_known(matches: DataFrame, history: DataFrame) -> DataFrame:
    version = F.col("version") if "version" in history.columns else F.lit(0).cast("bigint")
    known = history.select("sig_id", version.alias("version"), "count", "last_seen", "cause", "fixes")
    return matches.join(known, ["sig_id", "version"]).select(
        "doc_id", "rank", "sig_id", "score", "count", "last_seen", "cause", "fixes"
    )
