"""Substring deduplication: recurring passages of 13 words, located by sharded Aho-Corasick automata.

1. *Anchors.*  Each window of ``WINDOW`` words picks the smallest hash of its ``ANCHOR``-word grams.  Equal windows pick
   equal anchors, and about a fifth of the positions are picked, so far fewer rows than windows are shuffled.  Anchors
   of at least two documents are found by a hash aggregation that is combined before the shuffle.  Copies of a document
   with a smaller id, told by a 128-bit digest of their words, go as a whole.
2. *Segments.*  The words around each occurrence of such an anchor are cut out: the only text that can recur.
3. *Automata.*  Segments are dealt by anchor, so that all occurrences of a window meet.  A task takes whole anchors of
   bounded size as a shard: windows of at least two documents are confirmed, the smallest id is their owner, their
   automaton is compiled, and the shard's segments are streamed past it.
4. *Frequent anchors* (of over ``HOT`` documents) are not gathered anywhere: their windows are confirmed by a combined
   aggregation, only the owners' segments are compiled, and the segments of frequent shards are streamed by several tasks.
5. Each document gets its covered word ranges back.

Anchors and windows of frequent anchors are told apart by 64-bit hashes, whole documents by 128 bits, all other windows by
their words.  Ranges belong to a row: rows that repeat an id with other texts are told apart by ``t``, which is 0 for all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.llm.steps import fresh, release, written
from stackloom.llm.words import U, WORD_BYTES, Words, find_words, gram_hashes, group_bounds, mix, text_slices, tidy, whole_groups

WINDOW, ANCHOR = 13, 5
HOT = 5000
SHARD_BYTES = 1 << 20
SHARD_PATTERNS = 8000
HEAVY = 256
_RANGES = "doc_id long, t long, low int, high int"


def _runs(words, window: int, anchor: int):
    """(row, anchor hash, first window, windows) of each run of windows that pick the same anchor, in order."""
    none = np.zeros(0, np.int64)
    grams, at = gram_hashes(words, anchor)
    span = window - anchor + 1
    if len(grams) < span:
        return none, none, none, none
    # grams of one row lie side by side, so a window is ``span`` neighbours of one row
    ok = np.flatnonzero(at[span - 1 :] - at[: len(at) - span + 1] == span - 1)
    ok = ok[words.row[at[ok]] == words.row[at[ok] + window - 1]]
    if not len(ok):
        return none, none, none, none
    pick = ok + np.lib.stride_tricks.sliding_window_view(grams, span)[ok].argmin(axis=1)
    row = words.row[at[ok]]
    bounds = group_bounds(row, pick)
    head = bounds[:-1]
    return row[head], grams[pick[head]].view(np.int64), at[ok[head]] - words.first[row[head]], np.diff(bounds)


def _anchors(window: int, anchor: int, place: bool):
    """Anchors: (h, smallest id, largest id, rows) of a slice, or with ``place`` (h, id, t, first window * 256 + windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for low, _, data, offsets in text_slices(batch.column(1)):
                row, h, first, count = _runs(find_words(data, offsets), window, anchor)
                doc = ids[low + row]
                if place:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h), pa.array(doc), pa.array(t[low + row]), pa.array(first * 256 + count)], names=["h", "doc_id", "t", "at"]
                    )
                elif len(h):
                    order = np.lexsort((doc, h))
                    h, doc = h[order], doc[order]
                    cut = group_bounds(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[cut[:-1]]), pa.array(doc[cut[:-1]]), pa.array(doc[cut[1:] - 1]), pa.array(np.diff(cut))], names=["h", "a", "b", "n"]
                    )

    return run


def _digests(window: int):
    """(digest of the words, doc_id, t, words) of each text of at least ``window`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for low, _, data, offsets in text_slices(batch.column(1)):
                inside = WORD_BYTES[data]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                edges = offsets[1:-1][offsets[1:-1] < len(data)]
                begins[edges] = inside[edges]
                # words, and one blank in front of each: a text's bytes say where its words end
                keep, marked = inside.copy(), data.copy()
                gap = np.flatnonzero(begins[1:] & ~inside[:-1])
                keep[gap], marked[gap] = True, 0x20
                ends = np.append(0, np.cumsum(keep))[offsets]
                size = np.diff(np.append(0, np.cumsum(begins))[offsets])
                kept = marked[keep].tobytes()
                rows = np.flatnonzero(size >= window)
                digest = [hashlib.blake2b(kept[ends[r] : ends[r + 1]].strip(b" "), digest_size=16).digest() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest, pa.binary()), pa.array(ids[low + rows]), pa.array(t[low + rows]), pa.array(size[rows])], names=["digest", "doc_id", "t", "n"]
                )

    return run


def _segments(window: int):
    """Cuts the words of runs ``marks`` (anchor, place, is it frequent) out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, t, texts = batch.column("doc_id").to_numpy(), batch.column("t").to_numpy(), batch.column("text")
            marks = batch.column("marks")
            bounds = marks.offsets.to_numpy()
            flat = marks.values
            h, at, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            for low, high, data, offsets in text_slices(texts, 1 << 20):
                inside = WORD_BYTES[data]
                edges = offsets[1:-1][offsets[1:-1] < len(data)]
                begins, stops = inside.copy(), inside.copy()
                begins[1:] &= ~inside[:-1]
                begins[edges] = inside[edges]
                stops[:-1] &= ~inside[1:]
                stops[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
                start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
                word = np.searchsorted(start, offsets[:-1])
                own = slice(bounds[low], bounds[high])
                row = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
                first = at[own] // 256
                head, tail = word[row] + first, word[row] + first + at[own] % 256 + window - 2
                raw = data.tobytes()
                parts = [b" ".join(raw[a:b].split()) for a, b in zip(start[head].tolist(), end[tail].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[own]),
                        pa.array(ids[low + row]),
                        pa.array(t[low + row]),
                        pa.array(first.astype(np.int32)),
                        pa.array(hot[own].astype(bool)),
                        pa.array(parts, pa.binary()).cast(pa.string()),
                    ],
                    names=["h", "doc_id", "t", "first", "hot", "text"],
                )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = batch.column("doc_id").to_numpy(), batch.column("first").to_numpy()
            for low, _, data, offsets in text_slices(batch.column("text")):
                words = find_words(data, offsets)
                h, at = gram_hashes(words, window)
                row = low + words.row[at]
                yield pa.RecordBatch.from_arrays([pa.array(mix(h).view(np.int64)), pa.array(ids[row]), pa.array(first[row])], names=["w", "doc_id", "first"])

    return run


class _Vocabulary(dict):
    """Numbers words of a shard from 1 as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self) + 1
        return number

    def add(self, text: str) -> tuple[int, ...]:
        return tuple(map(self.__getitem__, text.split(" ")))

    def read(self, text: str) -> tuple[int, ...]:
        """The same, but 0 for new words."""
        return tuple([self.get(w, 0) for w in text.split(" ")])


def _compiled(owners: dict[tuple[int, ...], int]):
    """Automaton over word numbers; it has far fewer states than one over characters."""
    import ahocorasick

    if not owners:
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, owner in owners.items():
        automaton.add_word(phrase, owner)
    automaton.make_automaton()
    return automaton


def _add_ranges(hits: list[tuple[int, int]], doc: int, t: int, first: int, window: int, out: list) -> None:
    """Adds the word ranges of a segment whose windows (last word, owner) a smaller id owns."""
    low = high = -1
    for last, owner in hits:
        if owner >= doc:
            continue
        stop = first + last + 1
        if low < 0 or stop - window > high:
            if low >= 0:
                out.append((doc, t, low, high))
            low = stop - window
        high = stop
    if low >= 0:
        if out and out[-1][:2] == (doc, t) and out[-1][2] <= low <= out[-1][3]:
            low, high = out[-1][2], max(high, out.pop()[3])
        out.append((doc, t, low, high))


def _range_batch(ranges: list) -> pa.RecordBatch:
    doc, t, low, high = zip(*ranges, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, pa.int64()), pa.array(t, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["doc_id", "t", "low", "high"]
    )


def _number_words(texts: pa.Array) -> Words:
    """Words of texts that are joined by single blanks; ``hash`` is a number for each different word, mixed."""
    _, _, data, offsets = next(text_slices(texts, 1 << 62, 1 << 62))
    inside = data != 0x20
    edges = offsets[1:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] = True
    start = np.flatnonzero(begins)
    row = np.searchsorted(offsets, start, side="right") - 1
    sums = np.append(0, np.cumsum(inside))
    bounds = np.append(sums[start], sums[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    number = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(U)
    return Words(data, start, start, row, number, np.searchsorted(row, np.arange(len(texts) + 1)))


def _confirmed(words: Words, low: np.ndarray, high: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and owners of the different windows of two or more documents; ``low`` and ``high`` are ids of each text."""
    h, at = gram_hashes(words._replace(hash=mix(words.hash + U(1))), window)
    if not len(at):
        return at, at
    order = np.argsort(h, kind="stable")
    h, at = h[order], at[order]
    same = h[1:] == h[:-1]
    pair = np.flatnonzero(same)
    equal = np.ones(len(pair), bool)
    for j in range(window):
        equal &= words.hash[at[pair] + j] == words.hash[at[pair + 1] + j]
    if not equal.all():  # different windows of one hash: order by the words themselves
        order = np.lexsort([words.hash[at + j] for j in range(window)])
        at = at[order]
        same = np.logical_and.reduce([words.hash[at[1:] + j] == words.hash[at[:-1] + j] for j in range(window)])
    begin = np.flatnonzero(np.append(True, ~same))
    owner, last = np.minimum.reduceat(low[words.row[at]], begin), np.maximum.reduceat(high[words.row[at]], begin)
    shared = owner < last
    return at[begin[shared]], owner[shared]


def _shards(window: int):
    """Confirms, compiles and streams shards of whole anchors; rows come by anchor and id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        for table in whole_groups(batches, ["h"], SHARD_BYTES):
            doc, t, first = (table.column(c).to_numpy() for c in ("doc_id", "t", "first"))
            # equal segments are read once: they have a smallest and a largest document
            coded = table.column("text").combine_chunks().dictionary_encode()
            if isinstance(coded, pa.ChunkedArray):
                coded = coded.combine_chunks()
            texts, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), np.iinfo(np.int64).min)
            np.minimum.at(low, index, doc)
            np.maximum.at(high, index, doc)
            words = _number_words(texts)
            at, owner = _confirmed(words, low, high, window)
            if not len(at):
                continue
            # over word numbers an automaton has far fewer states than over characters
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            numbers = words.hash.astype(np.int64).tolist()
            for a, who in zip(at.tolist(), owner.tolist(), strict=True):
                automaton.add_word(tuple(numbers[a : a + window]), who)
            automaton.make_automaton()
            bounds = words.first.tolist()
            hits = [list(automaton.iter(tuple(numbers[a:b]))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            ranges: list = []
            for i, who, own_t, begin in zip(index.tolist(), doc.tolist(), t.tolist(), first.tolist(), strict=True):
                if hits[i]:
                    _add_ranges(hits[i], who, own_t, begin, window, ranges)
            if ranges:
                yield _range_batch(ranges)

    return run


def _located(window: int):
    """Streams segments (kind 1) past the automaton of the owners' windows (kind 0) that precede them in their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, vocabulary, owners, automaton, compiled = None, _Vocabulary(), {}, None, False
        for batch in batches:
            ranges: list = []
            columns = (batch.column(c).to_pylist() for c in ("shard", "salt", "kind", "doc_id", "t", "first", "text"))
            for key_shard, salt, kind, doc, t, first, text in zip(*columns, strict=True):
                if shard != (key_shard, salt):
                    shard, vocabulary, owners, compiled = (key_shard, salt), _Vocabulary(), {}, False
                if kind == 0:
                    words = vocabulary.add(text)
                    for i in range(len(words) - window + 1):
                        phrase = words[i : i + window]
                        owners[phrase] = min(owners.get(phrase, doc), doc)
                    continue
                if not compiled:
                    automaton, owners, compiled = _compiled(owners), {}, True
                if automaton is not None:
                    _add_ranges(automaton.iter(vocabulary.read(text)), doc, t, first, window, ranges)
            if ranges:
                yield _range_batch(ranges)

    return run


def _hot_ranges(segments: DataFrame, window: int) -> DataFrame:
    """Ranges of segments of frequent anchors: combined confirmation, owners' patterns, streams that several tasks share."""
    windows = segments.mapInArrow(tidy(_windows(window)), "w long, doc_id long, first int")
    owned = windows.groupBy("w").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"))
    owned = owned.filter("doc_id < last").select("w", "doc_id")
    owners = windows.join(owned, ["w", "doc_id"], "left_semi").select("doc_id", "first").distinct()
    # of rows that repeat an id, segments at one place may be more than the owner's; they hold windows of the same id
    patterns = written(segments.join(owners, ["doc_id", "first"], "left_semi"))
    n = patterns.agg(F.sum(F.size(F.split("text", " ")) - (window - 1))).first()[0] or 0
    shards = max(1, -(-int(n) // SHARD_PATTERNS))
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)).cast("int").alias("shard")
    total = segments.count()
    counts = segments.groupBy(shard).count().filter(F.col("count") > max(1000, total // HEAVY))
    heavy = {r["shard"]: -(-r["count"] * HEAVY // max(1, total)) for r in counts.collect()}  # HEAVY rows at most
    salts = F.lit(1)
    for key, k in heavy.items():
        salts = F.when(F.col("shard") == key, F.lit(k)).otherwise(salts)
    columns = ["shard", "salt", "kind", "doc_id", "t", "first", "text"]
    rules = patterns.select(shard, "doc_id", "t", "first", "text").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("kind", F.lit(0))
    streamed = segments.select(shard, "doc_id", "t", "first", "text").withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int"))
    streamed = streamed.withColumn("kind", F.lit(1))
    dealt = rules.select(columns).unionByName(streamed.select(columns))
    dealt = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind", "doc_id", "first")
    return dealt.mapInArrow(tidy(_located(window)), _RANGES)


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame | None:
    """(doc_id, repeated) of ids that several rows have; None if there is none."""
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    found = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("repeated")))
    return None if found.isEmpty() else found


def _rows(docs: DataFrame, repeated: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, t) of rows with an id; ``t`` is a hash of the text for rows that repeat an id, else 0; equal rows are one."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    if repeated is None:
        return base.withColumn("t", F.lit(0).cast("long"))
    marked = base.join(repeated, "doc_id", "left")
    several = marked.filter("repeated").select("doc_id", "text", F.xxhash64("text").alias("t")).dropDuplicates(["doc_id", "t"])
    return written(marked.filter("repeated IS NULL").select("doc_id", "text", F.lit(0).cast("long").alias("t")).unionByName(several))


def repeated_ranges(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT, repeated: DataFrame | None = None
) -> DataFrame:
    """(doc_id, t, low, high): word ranges [low, high) covered by windows that also start in a document with a smaller id.

    Ranges of one row may touch or overlap.  Rows without an id are neither owners nor judged.  Rows that repeat an id are
    judged one by one, against smaller ids only; ``t``, a hash of their text, tells them apart.  ``repeated`` are these ids, as
    ``repeated_ids`` gives them.
    """
    spark = docs.sparkSession
    anchor = min(ANCHOR, window)
    base = _rows(docs, repeated, id_col, text_col)

    digests = base.mapInArrow(tidy(_digests(window)), "digest binary, doc_id long, t long, n long")
    digests = written(digests)
    least = digests.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).filter("least < last")
    # the first of several copies is no copy
    copies = written(digests.join(least, "digest").filter("doc_id > least").select("doc_id", "t", "n").distinct())
    release(spark)

    common = base.mapInArrow(tidy(_anchors(window, anchor, False)), "h long, a long, b long, n long")
    common = common.groupBy("h").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.sum("n").alias("n"))
    common = written(common.filter("a < b").select("h", "a", (F.col("n") > hot).alias("hot")))
    release(spark)

    placed = base.mapInArrow(tidy(_anchors(window, anchor, True)), "h long, doc_id long, t long, at long").join(common.hint("shuffle_hash"), "h")
    # (frequent anchors of one passage mostly have the same first document, by which they are dealt together)
    placed = placed.select("doc_id", "t", F.when(F.col("hot"), F.col("a")).otherwise(F.col("h")).alias("h"), "at", "hot")
    placed = written(placed)
    release(spark)

    # whole copies need no segments; they are not the owners of anything
    marks = placed.join(copies.select("doc_id", "t"), ["doc_id", "t"], "left_anti")
    marks = marks.groupBy("doc_id", "t").agg(F.collect_list(F.struct("h", "at", "hot")).alias("marks"))
    segments = base.join(marks, ["doc_id", "t"]).select("doc_id", "t", "text", "marks")
    segments = written(segments.mapInArrow(tidy(_segments(window)), "h long, doc_id long, t long, first int, hot boolean, text string"))
    release(spark)

    cold = segments.filter("NOT hot").select("h", "doc_id", "t", "first", "text").repartition("h").sortWithinPartitions("h", "doc_id", "first")
    found = written(cold.mapInArrow(tidy(_shards(window)), _RANGES))
    release(spark)
    frequent = written(_hot_ranges(segments.filter("hot"), window))
    release(spark)
    whole = copies.select("doc_id", "t", F.lit(0).alias("low"), F.col("n").cast("int").alias("high"))
    return found.unionByName(frequent).unionByName(whole)


def _cut(text_col: str, spans_col: str, names: tuple[str, str], rejoin: bool):
    """Removes the words of the ranges ``spans_col`` from ``text_col``; adds the number of words and of removed ones.

    ``rejoin`` joins the words of every text by one space; else a text that loses nothing stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, 512) for b in batches for low in range(0, b.num_rows, 512)):
            columns = batch.schema.names
            texts, ranges = batch.column(columns.index(text_col)), batch.column(columns.index(spans_col))
            new, words_of, removed_of = [], [], []
            for text, own in zip(texts, ranges, strict=True):
                text = text.as_py()
                words = (text or "").encode().split()
                spans = own.as_py() or ()
                if spans:
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    for s in spans:
                        edge[min(s["low"], len(words))] += 1
                        edge[min(s["high"], len(words))] -= 1
                    kept = np.cumsum(edge[:-1]) == 0
                    left = list(compress(words, kept.tolist()))
                else:
                    left = words
                words_of.append(len(words))
                removed_of.append(len(words) - len(left))
                new.append(b" ".join(left).decode() if rejoin or len(left) < len(words) else text)
            kept_columns = [batch.column(i) if name != text_col else pa.array(new, pa.string()) for i, name in enumerate(columns) if name != spans_col]
            yield pa.RecordBatch.from_arrays(
                [*kept_columns, pa.array(words_of, pa.int64()), pa.array(removed_of, pa.int64())],
                names=[*(x for x in columns if x != spans_col), *names],
            )

    return run


def _removed(docs: DataFrame, id_col: str, text_col: str, window: int, rejoin: bool) -> tuple[DataFrame, str, str]:
    """``remove_repeats``, and the names of the columns it adds."""
    key, t, spans, words, gone = (fresh(name, docs.columns) for name in ("_id", "_t", "_ranges", "_n_words", "_n_removed"))
    repeated = repeated_ids(docs, id_col)
    found = repeated_ranges(docs, id_col, text_col, window, repeated=repeated)
    ranges = found.groupBy(F.col("doc_id").alias(key), F.col("t").alias(t)).agg(F.collect_list(F.struct("low", "high")).alias(spans))
    keyed = docs.withColumn(key, F.col(f"`{id_col}`").cast("long"))
    if repeated is None:
        joined = keyed.join(ranges.drop(t), key, "left")
    else:
        mark = fresh("_repeated", docs.columns)
        keyed = keyed.join(repeated.select(F.col("doc_id").alias(key), F.col("repeated").alias(mark)), key, "left")
        keyed = keyed.withColumn(t, F.when(F.col(mark), F.xxhash64(F.col(f"`{text_col}`").cast("string"))).otherwise(F.lit(0).cast("long")))
        joined = keyed.join(ranges, [key, t], "left")
    shown = [F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
    counts = [T.StructField(c, T.LongType()) for c in (words, gone)]
    cut = joined.select(*shown, spans).mapInArrow(tidy(_cut(text_col, spans, (words, gone), rejoin)), T.StructType([*fields, *counts]))
    return cut, words, gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, rejoin: bool = False) -> DataFrame:
    """``docs`` without the words that windows of smaller ids repeat, plus ``_n_words`` and ``_n_removed``.

    Windows are judged on the input, not on what is left, and row by row.  Texts that lose words are what is left, joined by
    one space; other texts stay unless ``rejoin``.  A null text has no words, a row without an id keeps all of its own.  All
    other columns are kept as they are; if one is called as an added one, that gets an underscore more.
    """
    return _removed(docs, id_col, text_col, window, rejoin)[0]


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``remove_repeats`` for a pipeline: the same columns; texts of which nothing is left go."""
    cut, words, gone = _removed(docs, id_col, text_col, window, False)
    return cut.filter((F.col(gone) == 0) | (F.col(gone) < F.col(words))).drop(words, gone)
