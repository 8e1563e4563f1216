"""Phrase collocations: phrases whose parts meet far more often than chance, from exact counts of all n-grams.

Words are counted first.  Only words that are frequent themselves can be part of a frequent phrase; they get ids, and n-grams
of ids are counted in counting quotient filters (``quotient``), which tasks fill, Spark deals out by shard, and one task a
shard merges.  Pairs come first: a bitmap of fixed size of the frequent ones (a superset, by hash) spares longer n-grams that
cannot be frequent.  It changes no result, only how much is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.llm import quotient as q
from stackloom.llm.steps import numbered, release, written
from stackloom.llm.words import U, group_bounds, mix, text_slices, tidy

UNKNOWN = "und"
#: Frequent words that are shared with every task; more are joined.
SHARED_WORDS = 1 << 20
SHARED_BYTES = 1 << 26
#: Bits of the bitmap of frequent pairs.
PAIR_BITS = 1 << 26
_SLICE = 1 << 21
_HELD = 1 << 20
_BLOCK = 1 << 16
#: Kind of each byte: 0 between words, 1 of a word, 2 between pieces.
_KIND = np.ones(256, np.uint8)
_KIND[[0x20, 0x09]] = 0
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _split(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Lower-cased words of texts, the row of each, and a number that two words share if they are of one piece."""
    data = _LOWER[data]
    kind = _KIND[data]
    inside = kind == 1
    edges = offsets[1:-1][offsets[1:-1] < len(data)]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[edges] = inside[edges]
    stop[:-1] &= ~inside[1:]
    inner = edges[edges > 0]
    stop[inner - 1] = inside[inner - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    bounds = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=bounds[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    row = np.searchsorted(offsets, start, side="right") - 1
    return words, row, np.cumsum(kind == 2)[start] + row


def _coded(langs: pa.Array, low: int, data: np.ndarray, offsets: np.ndarray):
    """(lang, word) pairs that occur, as two arrays; for each word the index of its pair; its row; its piece."""
    words, row, piece = _split(data, offsets)
    coded = words.dictionary_encode()
    of = langs.slice(low, len(offsets) - 1).dictionary_encode()
    width = max(1, len(coded.dictionary))
    key = of.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * width + coded.indices.to_numpy(zero_copy_only=False)
    pairs, index = np.unique(key, return_inverse=True)
    return of.dictionary.take(pa.array(pairs // width)), coded.dictionary.take(pa.array(pairs % width)), index, row, piece


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for low, _, data, offsets in text_slices(batch.column(1), _SLICE):
            if len(data):
                yield _coded(batch.column(0), low, data, offsets)


def _source(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    lang, text = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    return docs.select(F.coalesce(lang, F.lit(UNKNOWN)).alias("lang"), text.alias("text"))


def word_counts(source: DataFrame) -> DataFrame:
    """(lang, word, f) of every word, and with a null word the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def joined() -> pa.Table:
            return pa.concat_tables(held).group_by(["lang", "word"]).aggregate([("f", "sum")]).select(["lang", "word", "f_sum"]).rename_columns(["lang", "word", "f"])

        for lang, word, index, _, _ in _slices(batches):
            f = np.bincount(index, minlength=len(word))
            own = pa.table({"lang": lang.cast(pa.string()), "word": word.cast(pa.large_string()).cast(pa.string()), "f": f})
            whole = own.group_by("lang").aggregate([("f", "sum")])
            held += [own, pa.table({"lang": whole["lang"], "word": pa.nulls(len(whole), pa.string()), "f": whole["f_sum"]})]
            size += len(own)
            if size > _HELD:
                held = [joined()]
                size = len(held[0])
                if size > _HELD // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held, size = [], 0
        if held:
            yield from joined().combine_chunks().to_batches()

    counted = source.mapInArrow(tidy(run), "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _ids_shared(source: DataFrame, words: DataFrame):
    """Stretches of word ids (0: not frequent) and pieces, by a dictionary that every task has."""
    known: dict[str, dict[bytes, int]] = {}
    for row in words.select("lang", "word", "id").toLocalIterator():
        known.setdefault(row["lang"], {})[row["word"].encode()] = row["id"]
    shared = source.sparkSession.sparkContext.broadcast(known)

    def stretches(batches: Iterator[pa.RecordBatch]):
        table, none = shared.value, {}
        for lang, word, index, _, piece in _slices(batches):
            ids = (table.get(a, none).get(b, 0) for a, b in zip(lang.to_pylist(), word.to_pylist(), strict=True))
            found = np.fromiter(ids, np.int64, len(word))
            yield found[index], piece, len(piece)

    return source, stretches


def _ids_joined(source: DataFrame, words: DataFrame):
    """The same by a join: each block of words sends its distinct words with their places, and gets the frequent ones' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        for lang, word, index, _, piece in _slices(batches):
            words = word.cast(pa.large_string()).cast(pa.string())
            for low in range(0, len(piece), _BLOCK):
                # the last words of a block are also the first of the next one: n-grams belong to the block they start in
                own = index[low : low + _BLOCK + q.SLOTS - 1]
                order = np.argsort(own, kind="stable")
                bounds = group_bounds(own[order])
                places = [order[a:b].astype("<i4").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                pairs = pa.array(own[order][bounds[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(pairs) + 1, block)),
                        pa.concat_arrays([lang.take(pairs).cast(pa.string()), pa.nulls(1, pa.string())]),
                        pa.concat_arrays([words.take(pairs), pa.nulls(1, pa.string())]),
                        pa.array([*places, piece[low : low + len(own)].astype("<i8").tobytes()], pa.binary()),
                    ],
                    names=["block", "lang", "word", "places"],
                )
                block += 1

    sent = written(source.mapInArrow(tidy(run), "block long, lang string, word string, places binary"))
    found = sent.filter("word IS NOT NULL").join(words.select("lang", "word", "id"), ["lang", "word"]).select("block", "id", "places")
    pieces = sent.filter("word IS NULL").select("block", F.lit(0).cast("long").alias("id"), "places")
    blocks = found.unionByName(pieces).groupBy("block").agg(F.collect_list(F.struct("id", "places")).alias("own"))
    blocks = written(blocks.select("own"))

    def stretches(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for own in batch.column(0):
                rows = own.as_py()
                piece = next(np.frombuffer(r["places"], "<i8") for r in rows if not r["id"])
                ids = np.zeros(len(piece), np.int64)
                for r in rows:
                    if r["id"]:
                        ids[np.frombuffer(r["places"], "<i4")] = r["id"]
                yield ids, piece, _BLOCK

    return blocks, stretches


def _pair_slots(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    return (mix(first.astype(U) * U(0x9E3779B97F4A7C15) + second.astype(U)) % U(bits)).astype(np.int64)


def _grams(ids: np.ndarray, piece: np.ndarray, limit: int, sizes: tuple[int, ...], pairs: np.ndarray | None) -> Iterator[np.ndarray]:
    """Id rows of the n-grams of frequent words within a piece that start before ``limit``."""
    link = (ids[:-1] > 0) & (ids[1:] > 0) & (piece[1:] == piece[:-1])
    if pairs is not None:
        at = np.flatnonzero(link)
        slot = _pair_slots(ids[at], ids[at + 1], len(pairs) * 8)
        link[at] = pairs[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 > 0
    for n in sizes:
        size = len(ids) - n + 1
        if size <= 0:
            break
        whole = np.logical_and.reduce([link[j : j + size] for j in range(n - 1)])
        at = np.flatnonzero(whole[:limit])
        yield np.stack([ids[at + j] for j in range(n)], axis=1)


def _counted(source: DataFrame, stretches, form: q.Layout, sizes: tuple[int, ...], least: int, pairs: np.ndarray | None) -> DataFrame:
    """(ids, f) of the n-grams of these sizes that occur ``least`` times or more."""
    shared = source.sparkSession.sparkContext.broadcast(pairs)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = q.Counter(form)

        def given(filters) -> Iterator[pa.RecordBatch]:
            shards, parts, size = [], [], 0
            for shard, data in filters:
                shards.append(shard)
                parts.append(data)
                size += len(data)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(parts, pa.binary())], names=["shard", "filter"])
                    shards, parts, size = [], [], 0
            if shards:
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(parts, pa.binary())], names=["shard", "filter"])

        for ids, piece, limit in stretches(batches):
            for rows in _grams(ids, piece, limit, sizes, shared.value):
                yield from given(counter.add(rows))
        yield from given(counter.filters())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(merger: q.Merger) -> pa.RecordBatch:
            ids, counts = merger.counts(least)
            used = np.count_nonzero(ids, axis=1)
            ends = np.append(0, np.cumsum(used)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[ids > 0])), pa.array(counts)], names=["ids", "f"])

        merger = None
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if merger is None or merger.shard != shard:
                    if merger is not None:
                        yield out(merger)
                    merger = q.Merger(shard, form)
                merger.add(data.as_py())
        if merger is not None:
            yield out(merger)

    filters = source.mapInArrow(tidy(fill), "shard long, filter binary")
    return filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(merge), "ids array<long>, f long")


def _pair_bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """One bit for each slot that a frequent pair has, at most ``bits / 8`` bytes whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pc.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).reshape(-1, 2)
            slot = _pair_slots(ids[:, 0], ids[:, 1], bits)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.int64(1), slot & 63))], names=["at", "bits"])

    found = pairs.select("ids").mapInArrow(tidy(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, "<i8")
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, least: int = 100, lang_col: str = "lang", text_col: str = "text", sizes: tuple[int, ...] = (2, 3, 4, 5)) -> tuple[DataFrame, DataFrame]:
    """(id, lang, word, f, n) of the words and (ids, f) of the phrases that occur ``least`` times or more in a language.

    ``n`` counts all words of the language.  Counts are exact and cover every text; see ``collocations`` for the rules.
    """
    source = _source(docs, lang_col, text_col)
    counted = written(word_counts(source).filter((F.col("f") >= least) | F.col("word").isNull()))
    totals = counted.filter("word IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.filter("word IS NOT NULL").withColumn("tree", F.lit(""))
    words = numbered(words, "tree", ["lang", "word"]).select((F.col("pos") + 1).alias("id"), "lang", "word", "f").join(totals, "lang")
    words = written(words)
    number, size, total = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word")), F.lit(0)), F.coalesce(F.sum("f"), F.lit(0))).first()
    source, stretches = (_ids_shared if number <= SHARED_WORDS and size <= SHARED_BYTES else _ids_joined)(source, words)
    form = q.layout(number, min(16, max(2, int(total >> 15).bit_length())))
    pairs = written(_counted(source, stretches, form, (2,), least, None))
    longer = tuple(n for n in sizes if n > 2)
    phrases = pairs
    if longer:
        phrases = pairs.unionByName(written(_counted(source, stretches, form, longer, least, _pair_bitmap(pairs, PAIR_BITS))))
    release(docs.sparkSession)
    return words, phrases


def _part(first: int | Column, size: int | Column) -> Column:
    return F.slice("ids", first, size)


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, absorb: int = 100, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut at ``.,;:!?`` and line ends into pieces and at blanks and tabs into words.  A phrase is 2
    to 5 neighbouring words of a piece that occur ``a >= least`` times in the language.  Of its cuts into two parts, with
    counts l and r, the one with the smallest floor(1000 a n / (l r)) gives its score, the first of equal ones.  A phrase goes
    if a longer one that holds it has at least ``absorb`` percent of its count.  Order: score and count, largest first, then
    the phrase by its bytes.  Null texts are empty, a null language is ``und``; repeated rows count as often as they are there;
    other columns and ids are of no account; without a phrase there are no rows.
    """
    words, found = phrase_counts(docs, least, lang_col, text_col)
    phrases = found.withColumnRenamed("f", "a")
    counts = found.unionByName(words.select(F.array("id").alias("ids"), "f"))
    size = F.size("ids")

    inner = phrases.filter(size > 2).select("ids", "a", F.explode(F.sequence(F.lit(2), size - 1)).alias("k"))
    inner = inner.select("ids", "a", "k", F.explode(F.sequence(F.lit(1), size - F.col("k") + 1)).alias("at"))
    inner = inner.groupBy(_part(F.col("at"), F.col("k")).alias("ids")).agg(F.max("a").alias("_longer"))
    kept = phrases.join(inner, "ids", "left").filter(F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * absorb)).drop("_longer")

    first = words.select(F.col("id").alias("_first"), "lang", "n")
    kept = kept.withColumn("_first", F.element_at("ids", 1)).join(first, "_first").drop("_first")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"_left": _part(1, F.col("k")), "_right": _part(F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(counts.select(F.col("ids").alias("_left"), F.col("f").alias("l")), "_left")
    cuts = cuts.join(counts.select(F.col("ids").alias("_right"), F.col("f").alias("r")), "_right")
    # 1000 a n and l r may pass 64 bits; decimals hold 38 digits
    score = F.expr("(CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0)) * 1000) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))")
    best = cuts.withColumn("score", score).groupBy("ids", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_best"))
    best = best.select("ids", "lang", "a", "n", F.col("_best.l").alias("l"), F.col("_best.r").alias("r"), F.col("_best.score").alias("score"))

    # words are looked up only for what may be among the first
    order = [F.desc("score"), F.desc("a")]
    own = Window.partitionBy("lang")
    near = best.withColumn("_place", F.rank().over(own.orderBy(*order))).filter(F.col("_place") <= top).drop("_place")
    spelt = near.select("*", F.posexplode("ids").alias("_at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("ids", "lang", "a", "n", "l", "r", "score").agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))
    named = spelt.withColumn("phrase", F.array_join(F.col("_words.word"), " "))
    ranked = named.withColumn("rank", F.row_number().over(own.orderBy(*order, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
