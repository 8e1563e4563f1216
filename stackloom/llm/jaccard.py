"""Similarity join on word shingles (Jaccard), with Bayesian pruning of candidates.

Every text becomes the set of its five-word shingles and ``N_HASHES`` MinHash values.  Texts that agree in one of
``BANDS`` bands of ``ROWS`` values are candidates.  A pair's values are compared ``STEP`` at a time; after each step the
posterior of "the similarity is at least the threshold", given the agreements so far and a uniform prior, is
P(Binomial(n + 1, threshold) <= agreements), and a pair for which it falls below ``TOLERANCE`` is dropped.  What is left
is verified exactly on whole shingle sets.

Copies: rows with one word sequence are one class, and only classes are compared.  A group of m near copies never becomes
m * m / 2 rows: candidates leave the bands as spanning edges, and the sets of a cluster meet in blocks of bounded size,
which count their links and pass on one row for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.phrases import repeated_ids
from stackloom.llm.steps import components, fresh, numbered, release, written
from stackloom.llm.words import (
    tidy,
    U,
    Words,
    find_words,
    gram_hashes,
    group_bounds,
    mix,
    sequence_hashes,
    text_slices,
    whole_groups,
)

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 25, 4
N_HASHES = BANDS * ROWS
STEP = 20
TOLERANCE = 1e-8
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1 << 19
SEED = 20240607


def least_agreements(threshold: float, tolerance: float, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, agreements below which a pair is dropped)."""
    out = []
    for n in range(step, N_HASHES + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, row after row, and where each row begins (one more at the end).

    A text of one to k - 1 words has one shingle, the whole of it.
    """
    rows = len(words.first) - 1
    h, at = gram_hashes(words, k)
    row = words.row[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.concatenate([h, sequence_hashes(words, 0xA0761D6478BD642F)[short]])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(rows + 1))


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint64 MinHash values, one row for each set; all ones for an empty set."""
    rows = len(first) - 1
    out = np.full((rows, N_HASHES), np.iinfo(np.uint64).max, dtype=U)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 63, N_HASHES, dtype=np.uint64) * U(2) + U(1)
    masks = rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)
    starts = first[full]
    for j in range(N_HASHES):
        v = (h ^ masks[j]) * factors[j]
        out[full, j] = np.minimum.reduceat(v ^ (v >> U(32)), starts)
    return out


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in text_slices(batch.column(1)):
                words = find_words(data, offsets)
                h, first = shingle_sets(words, k)
                sig = signatures(h, first)
                bands = np.full((high - low, BANDS), 0x51, dtype=U)
                for j in range(ROWS):
                    bands = mix(bands * U(31) + sig[:, j::ROWS])
                small = mix(sig).astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low),
                        pa.array(sequence_hashes(words, 0x8BB84B93962EACC9).view(np.int64)),
                        pa.array(sequence_hashes(words, 0x2D358DCCAA6C78A5).view(np.int64)),
                        pa.array(np.diff(first).astype(np.int32)),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(2 * N_HASHES), high - low, [None, pa.py_buffer(small.tobytes())]
                        ).cast(pa.binary()),
                        pa.ListArray.from_arrays(
                            np.arange(0, BANDS * (high - low) + 1, BANDS, dtype=np.int32), pa.array(bands.view(np.int64).ravel())
                        ),
                    ],
                    names=["doc_id", "h1", "h2", "n", "sig", "bands"],
                )

    return run


def _sig_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), N_HASHES)


def _surviving(bounds: np.ndarray, sides: np.ndarray, crossed: np.ndarray, sig: np.ndarray, node: np.ndarray, need):
    """Row pairs (i < j) of one group that Bayesian pruning lets through, found lag by lag over all groups at once.

    ``crossed`` groups hold two sides and compare rows of different sides only.
    """
    size = np.diff(bounds)
    group = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(group))
    last = bounds[1:][group]
    lag = 1
    rows = at[at + lag < last]
    while len(rows):
        i, j = rows, rows + lag
        ok = (node[i] != node[j]) & (~crossed[group[i]] | (sides[i] != sides[j]))
        i, j = i[ok], j[ok]
        agreed = np.zeros(len(i), dtype=np.int64)
        for n, least in need:
            if not len(i):
                break
            agreed = agreed + (sig[i, n - STEP : n] == sig[j, n - STEP : n]).sum(axis=1)
            keep = agreed >= least
            i, j, agreed = i[keep], j[keep], agreed[keep]
        if len(i):
            yield i, j
        lag += 1
        rows = rows[rows + lag < last[rows]]


class _Forest:
    """Union-find over the rows of a table."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], dtype=np.int64)


def _band_edges(need):
    """Spanning edges (a, b) of the pairs that survive in each group of (band, key, i, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["band", "key", "i", "j"], 1 << 22):
            col = {c: table.column(c).to_numpy() for c in ("band", "key", "i", "j", "side", "rep")}
            bounds = group_bounds(col["band"], col["key"], col["i"], col["j"])
            sig = _sig_matrix(table.column("sig").combine_chunks())
            crossed = (col["i"] != col["j"])[bounds[:-1]]
            forest = _Forest(table.num_rows)
            for i, j in _surviving(bounds, col["side"], crossed, sig, col["rep"], need):
                forest.join(i, j)
            root = forest.roots()
            at = np.flatnonzero(root != np.arange(len(root)))
            rep = col["rep"]
            yield pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[root[at]])], names=["a", "b"])

    return run


def _shingled(k: int):
    """Adds the shingle set and signature of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                h, first = shingle_sets(find_words(data, offsets), k)
                sig = mix(signatures(h, first)).astype(np.uint16)
                rows = batch.slice(low, high - low)
                sets = [h[first[r] : first[r + 1]].tobytes() for r in range(high - low)]
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("cluster", "rep", "size", "chunks")), pa.array(sets, pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary())],
                    names=["cluster", "rep", "size", "chunks", "shingles", "sig"],
                )

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of a block, by products of slices of its 0/1 matrix."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, local = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(local, kind="stable")
    rows, local = rows[order], local[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = 2048
    for low in range(0, int(local[-1]) + 1 if len(local) else 0, width):
        a, b = np.searchsorted(local, [low, low + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[rows[a:b], local[a:b] - low] = 1
        out += part @ part.T
    return out


def _verify(threshold: float, need):
    """Exact links of each group of (cluster, i, j): for every text its links, linked documents and root in the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["cluster", "i", "j"], 1 << 22):
            col = {c: table.column(c).to_numpy() for c in ("cluster", "i", "j", "side", "rep", "size")}
            bounds = group_bounds(col["cluster"], col["i"], col["j"])
            sig = _sig_matrix(table.column("sig").combine_chunks())
            sets = [np.frombuffer(x.as_py(), dtype=np.uint64) for x in table.column("shingles")]
            count = np.array([len(s) for s in sets], dtype=np.float64)
            crossed = (col["i"] != col["j"])[bounds[:-1]]
            links, docs = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            forest = _Forest(len(sets))
            group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            big = np.diff(bounds) > 24
            for i, j in _surviving(bounds, col["side"], crossed, sig, col["rep"], need):
                large = big[group[i]]
                for g in np.unique(group[i][large]):
                    own = group[i] == g
                    found.setdefault(int(g), []).append((i[own], j[own]))
                i, j = i[~large], j[~large]
                if not len(i):
                    continue
                both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.float64)
                _count(i, j, both, count, threshold, links, docs, col["size"], forest)
            for g, pairs in found.items():
                low = int(bounds[g])
                i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
                both = _overlaps(sets[low : int(bounds[g + 1])])[i - low, j - low]
                _count(i, j, both, count, threshold, links, docs, col["size"], forest)
            root = forest.roots()
            yield pa.RecordBatch.from_arrays(
                [pa.array(col["rep"]), pa.array(col["rep"][root]), pa.array(links), pa.array(docs)],
                names=["rep", "root", "links", "docs"],
            )

    return run


def _count(i, j, both, count, threshold, links, docs, size, forest) -> None:
    linked = both >= threshold * (count[i] + count[j] - both) - 1e-9
    i, j = i[linked], j[linked]
    np.add.at(links, i, 1)
    np.add.at(links, j, 1)
    np.add.at(docs, i, size[j])
    np.add.at(docs, j, size[i])
    forest.join(i, j)


def _in_blocks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Deals rows of groups of ``chunks`` chunks out to pairs of chunks (i <= j), so that each pair of rows meets once."""
    side = F.pmod(F.xxhash64("rep"), F.col("chunks"))
    dealt = df.withColumn("side", side.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumn("i", F.least("side", "other")).withColumn("j", F.greatest("side", "other")).drop("other", "chunks")
    return dealt.repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j", "rep")


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    shingle: int = SHINGLE,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """Near-duplicate classes and link counts of all documents.

    Returns one row for each id: ``doc_id``, ``text_id`` (smallest id with the same word sequence), ``class_id`` (smallest
    id that links of ``threshold`` or more reach), ``n_copies`` (ids with the same words, itself included), ``n_links``
    (other texts that are linked) and ``n_linked_docs`` (other ids that are copies or linked).

    Defined results: a null text is an empty one; texts without words are copies of each other; a text of fewer words than
    a shingle has one shingle; rows that repeat an id are one document, linked wherever one of its rows is; rows without an
    id can be no partner and are left out; other columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    need = least_agreements(threshold, tolerance)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL")
    features = written(
        base.mapInArrow(tidy(_features(shingle)), "doc_id long, h1 long, h2 long, n int, sig binary, bands array<bigint>")
    )
    copies = written(features.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("size"), F.max("n").alias("n")))
    texts = copies.filter("n > 0")

    # bands that several texts share
    keys = features.filter("n > 0").join(texts.select(F.col("rep").alias("doc_id"), "h1", "h2"), ["doc_id", "h1", "h2"], "left_semi")
    keys = keys.select(F.col("doc_id").alias("rep"), "n", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("band", "key").agg(F.count("*").alias("m"), F.min("rep").alias("a"), F.max("rep").alias("b"))
    shared = shared.filter("a != b").select("band", "key", F.ceil(F.col("m") / BLOCK_TEXTS).cast("int").alias("chunks"))
    met = keys.select("rep", "band", "key").join(shared, ["band", "key"])
    sigs = features.select(F.col("doc_id").alias("rep"), "h1", "h2", "sig").dropDuplicates(["rep", "h1", "h2"]).drop("h1", "h2")
    met = met.join(sigs, "rep")
    edges = _in_blocks(met, ["band", "key"]).select("band", "key", "i", "j", "side", "rep", "sig")
    edges = written(edges.mapInArrow(tidy(_band_edges(need)), "a long, b long").distinct())
    release(spark)

    # clusters of candidates, whose sets meet in blocks
    cluster = written(components(edges, "a", "b").select(F.col("node").alias("rep"), F.col("root").alias("cluster")))
    members = cluster.join(texts.groupBy("rep").agg(F.max("n").alias("n"), F.sum("size").alias("size")), "rep")
    sizes = members.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("chunks")
    )
    members = members.join(sizes, "cluster").select("rep", "cluster", "size", "chunks")
    sets = base.withColumnRenamed("doc_id", "rep").join(members, "rep").select("cluster", "rep", "size", "chunks", "text")
    sets = sets.mapInArrow(tidy(_shingled(shingle)), "cluster long, rep long, size long, chunks int, shingles binary, sig binary")
    blocks = _in_blocks(sets, ["cluster"]).select("cluster", "i", "j", "side", "rep", "size", "shingles", "sig")
    found = written(blocks.mapInArrow(tidy(_verify(threshold, need)), "rep long, root long, links long, docs long"))
    release(spark)
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"), F.sum("docs").alias("docs"))
    roots = components(found.filter("rep != root"), "rep", "root").select(F.col("node").alias("rep"), "root")

    classes = copies.groupBy("rep").agg(F.max("size").alias("size")).join(linked, "rep", "left").join(roots, "rep", "left")
    byid = features.select("doc_id", "h1", "h2").join(copies.select("h1", "h2", "rep"), ["h1", "h2"])
    # a document with several texts takes part through each of them
    out = byid.select("doc_id", "rep").distinct().join(classes, "rep")
    return out.groupBy("doc_id").agg(
        F.min("rep").alias("text_id"),
        F.min(F.coalesce("root", "rep")).alias("class_id"),
        F.max("size").alias("n_copies"),
        F.max(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.max(F.coalesce("docs", F.lit(0)) + F.col("size") - 1).cast("long").alias("n_linked_docs"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Keeps the row with the smallest id of each near-duplicate class.

    Rows without an id belong to no class and stay.  Rows that repeat an id are judged one by one, by their own texts; of
    rows that are equal in id and text one stays, which a hash of all columns chooses.
    """
    repeated = repeated_ids(docs, id_col)
    if repeated is None:
        kept = jaccard_classes(docs, id_col, text_col, threshold).filter("doc_id = class_id").select(F.col("doc_id").alias(id_col))
        return docs.join(kept, id_col, "left_semi").unionByName(docs.filter(F.col(id_col).isNull()))
    # each different (id, text) gets a number of its own, in order of the ids
    key, t, row = (fresh(name, docs.columns) for name in ("_key", "_t", "_row"))
    own = docs.filter(F.col(id_col).isNotNull()).withColumns({key: F.col(id_col).cast("long"), t: F.xxhash64(F.col(text_col).cast("string"))})
    numbers = numbered(own.select(F.lit("").alias("tree"), F.col(key).alias("id"), F.col(t).alias("t")).distinct(), "tree", ["id", "t"])
    numbers = written(numbers.select(F.col("id").alias(key), F.col("t").alias(t), F.col("pos").alias(row)))
    several = own.groupBy(key, t).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns))))).alias("kept"))
    single = written(several.join(numbers, [key, t]).select(row, "kept.*"))
    kept = jaccard_classes(single, row, text_col, threshold).filter("doc_id = class_id").select(F.col("doc_id").alias(row))
    return single.join(kept, row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)).unionByName(docs.filter(F.col(id_col).isNull()))
