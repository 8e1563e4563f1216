"""Approximate recall over a history that is too large to visit (D5, F8): hash tables of sign projections.

A table cuts space by random planes; the sides a vector is on are its key.  Vectors of a small angle share most sides, so they
often share the key of some table, or differ only at planes that the query is close to: those are probed as well.  Only
vectors that meet are compared, and the comparison is exact: every score is right, what can be missing are matches.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.functions import fixed
from stackloom.operators.similarity import PACK_BYTES, _asked, _first_k, _held, _matched, check_dimension, match_schema, sides, top_matches, unit_rows, with_known

TABLES = 16
#: Planes of a table closest to a query, whose other side is probed too: 2 ** PROBE_BITS keys a table.
PROBE_BITS = 4
#: History rows that a bucket holds on average, and queries that look buckets up together.
BUCKET_ROWS = 256
WAITING_ROWS = 50_000
#: History rows that are compared at once at most, and of a task, if a pack of ``PACK_BYTES`` does not hold more.
PART_ROWS = 50_000
MAX_BITS = 40
# Which side of a plane a vector is on is told at this precision, whatever order a product was summed in.
_DIGITS = 9


def planes(tables: int, bits: int, dim: int) -> np.ndarray:
    """Normals of ``bits`` planes for each table, of plus and minus ones that follow from their place."""

    def sign(place: str) -> int:
        return 1 - 2 * (int(hashlib.md5(place.encode()).hexdigest()[:8], 16) & 1)

    return np.array([[[sign(f"{t},{b},{d}") for d in range(dim)] for b in range(bits)] for t in range(tables)], dtype=float)


def key_bits(rows: int, bucket_rows: int) -> int:
    """Planes that cut ``rows`` vectors into buckets of about ``bucket_rows``."""
    return min(MAX_BITS, max(1, math.ceil(math.log2(max(1, rows) / bucket_rows))))


def keys(vectors: np.ndarray, normals: np.ndarray, probe_bits: int) -> np.ndarray:
    """Keys of unit vectors (rows) in each table (columns), its own first and then with up to ``probe_bits`` sides changed."""
    tables, bits, dim = normals.shape
    away = np.round(vectors @ normals.reshape(-1, dim).T, _DIGITS).reshape(len(vectors), tables, bits)
    weights = np.int64(1) << np.arange(bits, dtype=np.int64)
    own = ((away >= 0) * weights).sum(axis=2)
    near = np.argsort(np.abs(away), axis=2, kind="stable")[:, :, : min(probe_bits, bits)]
    chosen = (np.arange(1 << near.shape[2])[:, None] >> np.arange(near.shape[2])) & 1
    flips = (weights[near][:, :, None, :] * chosen).sum(axis=3)
    return own[:, :, None] ^ flips


def pack_bits(rows: int, bits: int, tables: int, pack_rows: int, cores: int) -> int:
    """Sides that tell the packs of a table apart: enough for packs of at most ``pack_rows`` and for two tasks a core."""
    wanted = max(math.ceil(math.log2(max(1, rows / pack_rows))), math.ceil(math.log2(max(1, 2 * cores / tables))))
    return min(bits, wanted)


def _with_keys(df: DataFrame, normals: np.ndarray, probe_bits: int) -> DataFrame:
    """One row for each table and key of a vector."""
    dim = normals.shape[2]
    shared = df.sparkSession.sparkContext.broadcast(normals)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys(unit_rows(batch.column("embedding"), dim), shared.value, probe_bits)
            n, tables, probes = found.shape
            each = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (tables * probes)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, each], names=[*batch.schema.names, "keys"])

    keyed = df.mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))]))
    probes = 1 << min(probe_bits, normals.shape[1])
    rows = keyed.select(*df.columns, F.posexplode("keys").alias("place", "key"))
    return rows.withColumn("table", F.floor(F.col("place") / probes).cast("int")).drop("place")


def _with_visits(df: DataFrame, normals: np.ndarray, probe_bits: int, pack_sides: int) -> DataFrame:
    """One row for each table and pack that a vector's keys lie in, with those ``keys``."""
    dim = normals.shape[2]
    shared = df.sparkSession.sparkContext.broadcast(normals)
    visit = T.StructType([T.StructField("table", T.IntegerType()), T.StructField("pack", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys(unit_rows(batch.column("embedding"), dim), shared.value, probe_bits)
            # keys of one pack next to each other
            order = np.argsort(found & ((1 << pack_sides) - 1), axis=2, kind="stable")
            found = np.take_along_axis(found, order, axis=2)
            packs = found & ((1 << pack_sides) - 1)
            first = np.ones(packs.shape, bool)
            first[:, :, 1:] = packs[:, :, 1:] != packs[:, :, :-1]
            starts = np.flatnonzero(first)
            ends = np.append(starts, found.size).astype(np.int32)
            tables = (starts // found.shape[2] % found.shape[1]).astype(np.int32)
            visited = pa.StructArray.from_arrays(
                [pa.array(tables), pa.array(packs.reshape(-1)[starts]), pa.ListArray.from_arrays(pa.array(ends), pa.array(found.reshape(-1)))],
                names=["table", "pack", "keys"],
            )
            ends = np.append(0, np.cumsum(first.sum(axis=(1, 2)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), visited)], names=[*batch.schema.names, "visits"])

    keyed = df.mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("visits", T.ArrayType(visit))]))
    return keyed.select(*df.columns, F.explode("visits").alias("visit")).select(*df.columns, "visit.*")


def _bucket_matches(run: pa.Table, held: tuple, buckets: tuple, by_rank: tuple, dim: int, k: int, threshold: float, as_of: bool) -> pa.RecordBatch:
    """The k best matches of queries in the blocks of those buckets of a pack that they have the keys of; ties by the rank of history rows."""
    vectors, asked = unit_rows(run.column("embedding"), dim), _asked(run, held, as_of)
    lists = run.column("keys").combine_chunks()
    probed = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    numbers, blocks = buckets
    slot = np.minimum(np.searchsorted(numbers, probed), len(numbers) - 1)
    met = np.flatnonzero(numbers[slot] == probed)
    met = met[np.argsort(slot[met], kind="stable")]
    rows, slot = rows[met], slot[met]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(slot)) + 1, [len(slot)]]) if len(slot) else np.zeros(1, np.int64)
    parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
        own = rows[low:high]
        mine = None if asked is None else tuple(x if x is None else x[own] for x in asked)
        for start, end in blocks[slot[low]]:
            valid = tuple(tuple(x if x is None else x[start:end] for x in side) for side in held[3])
            found = top_matches(vectors[own], held[2][start:end], k, threshold, mine, valid)
            parts.append((own[found[0]], by_rank[1][found[1] + start], found[2]))
    rows, ranks, scores = (np.concatenate(column) for column in zip(*parts))
    # rows that repeat an id take one of the k places together
    order = np.lexsort((ranks, -scores, rows))
    same = rows[order] * np.int64(len(by_rank[0])) + by_rank[2][ranks[order]]
    kept = order[np.unique(same, return_index=True)[1]]
    rows, ranks, scores = _first_k(rows[kept], ranks[kept], scores[kept], k)
    return _matched(run.column("doc_id").combine_chunks(), held, (rows, by_rank[0][ranks], scores))


def match_blocks(arranged: DataFrame, places: list[str], dim: int, k: int, threshold: float, as_of: bool, schema: T.StructType) -> DataFrame:
    """The k best matches of each query in each pack; history rows (``side`` 0) come first in order of ``places``, which tell blocks apart."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stored, held, waiting = None, [], None, []

        def matched() -> pa.RecordBatch:
            run = pa.Table.from_batches(waiting)
            waiting.clear()
            return _bucket_matches(run, held, buckets, by_rank, dim, k, threshold, as_of)

        for batch in batches:
            block = np.stack([batch.column(name).to_numpy(zero_copy_only=False) for name in ("table", "pack", "slice", "side")], axis=1)
            starts = np.concatenate([[0], np.nonzero((block[1:] != block[:-1]).any(axis=1))[0] + 1, [len(block)]])
            for start, end in zip(starts[:-1], starts[1:]):
                key, run = tuple(block[start][:3]), batch.slice(start, end - start)
                if key != current:
                    if waiting:
                        yield matched()
                    current, stored, held = key, [], None
                if block[start][3] == 0:
                    stored.append(run)
                    continue
                if not stored:
                    continue
                if held is None:
                    table = pa.Table.from_batches(stored)
                    held, stored = _held(table, dim), [run.slice(0, 0)]
                    lies = np.stack([table.column(name).to_numpy() for name in places], axis=1)
                    first = np.concatenate([[0], np.nonzero((lies[1:] != lies[:-1]).any(axis=1))[0] + 1])
                    numbers, heads = np.unique(table.column("key").to_numpy()[first], return_index=True)
                    ranges = list(zip(first.tolist(), [*first[1:].tolist(), len(table)]))
                    buckets = numbers, [ranges[low:high] for low, high in zip(heads.tolist(), [*heads[1:].tolist(), len(ranges)])]
                    ordered = pc.sort_indices(table, sort_keys=[("sig_id", "ascending"), ("version", "ascending")]).to_numpy()
                    rank = np.empty(len(ordered), np.int64)
                    rank[ordered] = np.arange(len(ordered))
                    ids = [table.column(name).take(pa.array(ordered)) for name in ("sig_id", "version")]
                    other = [pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True).to_numpy() for x in ids]
                    by_rank = ordered, rank, np.concatenate([[0], np.cumsum(other[0] | other[1])]).astype(np.int64)
                waiting.append(run)
                # a block is looked at once for all of them
                if sum(w.num_rows for w in waiting) >= WAITING_ROWS:
                    yield matched()
        if waiting:
            yield matched()

    return arranged.mapInArrow(match, schema)


def arrange(asked: DataFrame, stored: DataFrame, normals: np.ndarray, probe_bits: int, pack_sides: int, pack_rows: int, part_rows: int, element: T.DataType) -> DataFrame:
    """History rows once a table and queries once a table and pack they probe, together by (table, pack, slice).

    History rows lie there by block, which is (table, key, part).  Vectors travel as ``element``, which must hold them without loss.
    """
    moved = F.col("embedding").cast(T.ArrayType(element))
    bucket, pack = ["table", "key"], ["table", "pack"]
    one, whole = F.lit(1).cast("bigint"), F.xxhash64("sig_id", "version")

    def over(rows: DataFrame, keys: list[str], most: int, name: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias(name)).where(F.col(name) > 1)

    placed = _with_keys(stored, normals, 0).withColumn("pack", F.col("key").bitwiseAND(F.lit((1 << pack_sides) - 1)))
    hot = over(placed, bucket, part_rows, "parts")
    full = over(placed, pack, pack_rows, "slices")
    slices = F.coalesce(F.col("slices"), one)
    history_side = placed.join(hot, bucket, "left").join(full, pack, "left").withColumns(
        {"slice": F.pmod(F.shiftright(whole, 20), slices), "part": F.pmod(whole, F.coalesce(F.col("parts"), one)), "side": F.lit(0), "embedding": moved}
    ).drop("parts", "slices")
    query_side = _with_visits(asked, normals, probe_bits, pack_sides).join(full, pack, "left").withColumns(
        {"slice": F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)), "side": F.lit(1), "embedding": moved}
    ).drop("slices")
    both = history_side.unionByName(query_side, allowMissingColumns=True)
    task = [*pack, "slice"]
    return both.repartition(*task).sortWithinPartitions(*task, "side", "key", "part", "sig_id")


def nearest_approx(
    queries: DataFrame,
    history: DataFrame,
    k: int = fixed.RECALL_K,
    threshold: float = fixed.RECALL_THRESHOLD,
    as_of: bool = False,
    dim: int | None = None,
    tables: int = TABLES,
    probe_bits: int = PROBE_BITS,
    bucket_rows: int = BUCKET_ROWS,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """What ``nearest`` gives, without matches that no probed bucket holds.

    A query meets about tables * 2 ** probe_bits * bucket_rows vectors, however large the history is.  A bucket with more than
    ``part_rows`` rows (near copies) is split into blocks, which are compared one by one.  Buckets of a table whose keys begin alike
    share a pack, so that a query is moved once a pack and not once a bucket and block.  A pack with more rows than ``PACK_BYTES``
    hold, or than ``part_rows`` if that is more, is split into slices, each of which its queries visit, so no task holds more; of
    every query and slice at most k matches are passed on.  ``dim`` is the vectors' size, by default that of any stored one.
    """
    asked, stored = sides(queries, history, as_of)
    schema = match_schema(queries, history)
    rows, found = stored.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dim = dim or found
    if not rows:
        return queries.sparkSession.createDataFrame([], schema)
    asked, stored = check_dimension(asked, dim), check_dimension(stored, dim)
    normals = planes(tables, key_bits(rows, bucket_rows), dim)
    pack_rows = max(part_rows, PACK_BYTES // (8 * (dim + 6)))
    pack_sides = pack_bits(rows, normals.shape[1], tables, pack_rows, queries.sparkSession.sparkContext.defaultParallelism)
    single = all(df.schema["embedding"].dataType.elementType == T.FloatType() for df in (queries, history))
    arranged = arrange(asked, stored, normals, probe_bits, pack_sides, pack_rows, part_rows, T.FloatType() if single else T.DoubleType())

    met = match_blocks(arranged, ["table", "key", "part"], dim, k, threshold, as_of, schema).repartition("doc_id")
    single_rows = met.groupBy("doc_id", "sig_id", "version").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "sig_id"))
    return single_rows.withColumn("rank", rank).where(F.col("rank") <= k).select(*schema.names)


def recall_approx(queries: DataFrame, history: DataFrame, k: int = fixed.RECALL_K, threshold: float = fixed.RECALL_THRESHOLD, as_of: bool = False, **sizes: int) -> DataFrame:
    """``recall`` by approximate search."""
    return with_known(nearest_approx(queries, history, k, threshold, as_of, **sizes), history)
