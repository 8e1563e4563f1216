"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters and digits, and single characters of scripts without spaces.  Items of fewer than
``MIN_MATCH`` words are found where all their words follow each other.  Else, a document and a benchmark item that share enough hashes of
``MIN_MATCH`` consecutive words (seeds) are tiled: Karp-Rabin hashes of the words that are not marked yet give the common
runs, the longest are marked on both sides without overlap, and the search runs again until no run of ``MIN_MATCH`` words is
left.  The share of the item's words that lie in tiles is its coverage.  As tiles may lie in any order, reordered passages
count in full.

The benchmark is a stated set of queries: it is cut into blocks of bounded size, each of which is shared with all tasks and
meets all documents in one scan, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.words import ALNUM_BYTES, Words, find_words, gram_hashes, group_bounds, lowered, text_slices, tidy

MIN_MATCH = 5
COVERAGE = 0.6
BLOCK_BYTES = 8 << 20



class Block(NamedTuple):
    """Items of a block: ids, word hashes of all, first word of each, and the seeds in order of their hash."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    seed: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray


def make_block(ids: list, texts: list[str], k: int) -> Block:
    data, offsets = lowered(pa.array(texts, pa.string()))
    words = find_words(data, offsets, ALNUM_BYTES)
    h, at = gram_hashes(words, k)
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    return Block(ids, words.hash, words.first, h, words.row[at], at - words.first[words.row[at]])


def tile(p: np.ndarray, t_hash: np.ndarray, i: np.ndarray, j: np.ndarray, k: int) -> tuple[int, int]:
    """(words covered, tiles) of the words ``p`` by greedy tiling.

    ``t_hash`` are the other side's words; ``i``, ``j`` are all positions at which k words agree by hash.
    """
    equal = np.ones(len(i), dtype=bool)
    for s in range(k):
        equal &= p[i + s] == t_hash[j + s]
    i, j = i[equal], j[equal]
    marked_p, marked_t = np.zeros(len(p), dtype=bool), np.zeros(len(t_hash), dtype=bool)
    tiles = 0
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    while len(i):
        # runs of neighbours on one diagonal are the maximal matches of unmarked words
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)]))
        length = np.diff(np.append(heads, len(i))) + k - 1
        longest = int(length.max())
        best = heads[length == longest]
        for a, b in sorted(zip(i[best].tolist(), j[best].tolist(), strict=True)):
            if not (marked_p[a : a + longest].any() or marked_t[b : b + longest].any()):
                marked_p[a : a + longest] = True
                marked_t[b : b + longest] = True
                tiles += 1
        free_p = np.concatenate([[0], np.cumsum(marked_p)])
        free_t = np.concatenate([[0], np.cumsum(marked_t)])
        free = (free_p[i + k] == free_p[i]) & (free_t[j + k] == free_t[j])
        i, j = i[free], j[free]
    return int(marked_p.sum()), tiles


def _found(block: Block, column: pa.Array, k: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, words of the item, covered words, tiles) of what reaches the coverage."""
    size = np.diff(block.first)
    needed = np.maximum(1, np.ceil(coverage * size / k - 1e-9)).astype(np.int64)
    row0 = 0
    for low, high, _, _ in text_slices(column):
        data, offsets = lowered(column.slice(low, high - low))
        words = find_words(data, offsets, ALNUM_BYTES)
        h, at = gram_hashes(words, k)
        a = np.searchsorted(block.seed, h, side="left")
        hit = np.flatnonzero((a < len(block.seed)) & (block.seed[np.minimum(a, len(block.seed) - 1)] == h))
        if not len(hit):
            continue
        a, h = a[hit], h[hit]
        many = np.searchsorted(block.seed, h, side="right") - a
        seed = np.repeat(a - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
        where = np.repeat(at[hit], many)
        item, i, row = block.seed_item[seed], block.seed_at[seed], words.row[where]
        order = np.lexsort((i, item, row))
        item, i, row, where = item[order], i[order], row[order], where[order]
        bounds = group_bounds(row, item)
        for b, e in zip(bounds[:-1], bounds[1:], strict=True):
            q = int(item[b])
            if len(np.unique(i[b:e])) < needed[q]:
                continue
            r = int(row[b])
            t = words.hash[words.first[r] : words.first[r + 1]]
            p = block.words[block.first[q] : block.first[q + 1]]
            covered, tiles = tile(p, t, i[b:e], where[b:e] - words.first[r], k)
            if covered >= coverage * len(p) - 1e-9:
                yield row0 + low + r, q, len(p), covered, tiles


def _found_short(block: Block, column: pa.Array, k: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The same of the items of fewer than k words that a row has whole."""
    size = np.diff(block.first)
    lengths = np.unique(size[(size > 0) & (size < k)]).tolist()
    items = Words(None, None, None, np.repeat(np.arange(len(size)), size), block.words, block.first)
    short = []
    for m in lengths:
        h, at = gram_hashes(items, m)
        whole = size[items.row[at]] == m
        order = np.argsort(h[whole], kind="stable")
        short.append((m, h[whole][order], items.row[at[whole]][order]))
    for low, high, _, _ in text_slices(column) if short else ():
        words = find_words(*lowered(column.slice(low, high - low)), ALNUM_BYTES)
        for m, seed, item in short:
            h, at = gram_hashes(words, m)
            a, b = (np.searchsorted(seed, h, side=side) for side in ("left", "right"))
            seen = set()
            for x in np.flatnonzero(b > a).tolist():
                row, place = int(words.row[at[x]]), int(at[x])
                for q in item[a[x] : b[x]].tolist():
                    p = block.words[block.first[q] : block.first[q] + m]
                    if (row, q) not in seen and np.array_equal(p, words.hash[place : place + m]):
                        seen.add((row, q))
                        yield low + row, q, m, m, 1


def _hits(block: Block, column: pa.Array, k: int, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    if len(block.seed):
        yield from _found(block, column, k, coverage)
    yield from _found_short(block, column, k)


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, k: int) -> Iterator[Block]:
    """The items in blocks of about ``BLOCK_BYTES``, one at a time on the driver."""
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = items.filter("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    for n in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).orderBy("id", "text").collect()
        if rows:
            yield make_block([r["id"] for r in rows], [r["text"] for r in rows], k)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row for each document row and item of which at least ``coverage`` is found in it.

    Columns: doc_id, item_id, item_words, covered_words, coverage, tiles.  Defined results: null or empty texts and items
    without a word are found nowhere; items of fewer than ``min_match`` words are found whole or not at all; repeated document rows are reported each, repeated items once; a null
    id is reported as null; other columns are ignored; empty tables give an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    context = docs.sparkSession.sparkContext
    schema = "doc_id long, item_id long, item_words int, covered_words int, coverage double, tiles int"
    out = None
    for block in benchmark_blocks(benchmark, item_col, item_text_col, min_match):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                rows = list(_hits(own, batch.column(1), min_match, coverage))
                if rows:
                    r, q, n, covered, tiles = (np.array(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(r)),
                            pa.array([own.ids[x] for x in q], pa.int64()),
                            pa.array(n, pa.int32()),
                            pa.array(covered, pa.int32()),
                            pa.array(covered / n),
                            pa.array(tiles, pa.int32()),
                        ],
                        names=["doc_id", "item_id", "item_words", "covered_words", "coverage", "tiles"],
                    )

        part = base.mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE
) -> DataFrame:
    """``docs`` without the rows in which an item reaches ``coverage``; one scan for each block, no shuffle."""
    context = docs.sparkSession.sparkContext
    for block in benchmark_blocks(benchmark, "item_id", "text", min_match):
        shared = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                column = batch.column(batch.schema.names.index(text_col)).cast(pa.string())
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[r[0] for r in _hits(own, column, min_match, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
