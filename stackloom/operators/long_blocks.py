"""Error groups of logs whose blocks are of any length.

A block is never put together.  What its groups need is an associative state of its lines: a fingerprint of its signature's
words, how many words and bytes there are, and the first bytes of signature and text.  Each split folds its part of a block,
and the parts of a block, one a split, are merged in order; a log without any block start is as parallel as any other.

Signatures are normalised line by line, so a time stamp that stands indented below a line of nothing but a time stamp is taken
out, which ``groups.normalize`` leaves in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.text import cut_bytes, normalize, starts_block, strip
from stackloom.operators.ranking import places

#: Fingerprints are polynomials over the words, modulo this prime, one for each base: 93 bits.
PRIME = 2**31 - 1
BASES = (1_103_515_245, 1_220_703_125, 1_664_525_003)
_POWER_BITS = 44


def _power(base: int, exponent: Column) -> Column:
    """``base`` to the ``exponent``, modulo ``PRIME``."""
    squares = [pow(base, 2**k, PRIME) for k in range(_POWER_BITS)]
    steps = F.sequence(F.lit(0), F.length(F.bin(exponent)) - 1)
    table = F.lit(squares)
    return F.aggregate(
        steps,
        F.lit(1).cast("bigint"),
        lambda done, k: F.when(F.call_function("shiftright", exponent, k) % 2 == 1, done * F.get(table, k) % PRIME).otherwise(done),
    )


def _fold_words(words: Column, base: int) -> Column:
    """Fingerprint of the words of one line."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda done, w: (done * base + F.pmod(F.xxhash64(w, F.lit(base)), F.lit(PRIME))) % PRIME)


def _merged(fingerprint: Column, base: int, words_after: Column) -> Column:
    """What a part adds to the fingerprint of a whole in which so many words follow it; sums of it are taken modulo ``PRIME``."""
    return fingerprint * _power(base, words_after) % PRIME


def _first(text: Column, at: Column, max_bytes: int, *order: str) -> Column:
    """Aggregate: the texts that begin in the first bytes, in order; each is at least a byte long, so they are bounded."""
    return F.sort_array(F.collect_list(F.when(at <= max_bytes, F.struct(*order, cut_bytes(text, max_bytes).alias("text")))))


def block_states(lines: DataFrame, max_bytes: int) -> DataFrame:
    """One row for each block of the lines (file, split, row, line) that ``log_lines`` gives.

    file, block_no, fingerprint, words, signature (its first ``max_bytes`` bytes), bytes (of the block, stripped) and
    representative (its first ``max_bytes`` bytes).  Blocks are those of ``groups.line_blocks``.
    """
    own = Window.partitionBy("file", "split").orderBy("row")
    marked = lines.select("file", "split", "row", "line", (strip(F.col("line")) == "").alias("blank"))
    marked = marked.withColumn("after_blank", F.lag("blank").over(own))
    # NULL for the first line of a split that begins a block only if a blank line is in front of it
    marked = marked.withColumn("begins", ~F.col("blank") & (starts_block(F.col("line")) | F.col("after_blank")))
    begins = F.coalesce(F.col("begins"), F.lit(False)).cast("int")
    numbered = marked.withColumn("number", F.sum(begins).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("blank"))

    # each split folds its lines, block by block
    part = Window.partitionBy("file", "split", "number").orderBy("row")
    before, whole = part.rowsBetween(Window.unboundedPreceding, -1), part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the white space in front of a block is not part of it; whether a split's first line begins one is told below
    head = F.lag("line").over(part).isNull() & F.coalesce(F.col("begins"), F.lit(True))
    text = F.when(head, F.ltrim("line", F.lit(fixed.WHITE_SPACE))).otherwise(F.col("line"))
    signed = numbered.withColumn("text", text).withColumn("signed", normalize(F.col("line")))
    indent = F.substring("line", F.lit(1), F.length("line") - F.length("text"))
    signed = signed.withColumn("indent", F.when(F.isnull("begins"), indent).otherwise(""))
    signed = signed.withColumn("words", F.when(F.col("signed") == "", F.array().cast("array<string>")).otherwise(F.split("signed", " ")))
    count, size, raw = F.size("words"), F.octet_length("signed") + (F.col("signed") != "").cast("int"), F.octet_length("text") + 1
    placed = signed.select(
        "file", "split", "number", "row", "line", "text", "indent", "signed", "words", size.cast("bigint").alias("size"), raw.cast("bigint").alias("raw"),
        (F.sum(count).over(whole) - F.sum(count).over(part)).alias("words_after"),
        F.coalesce(F.sum(size).over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum(raw).over(before), F.lit(0)).alias("raw_at"),
    )
    prints = [(F.sum(_merged(_fold_words(F.col("words"), b), b, F.col("words_after"))) % PRIME).alias(f"print{i}") for i, b in enumerate(BASES)]
    parts = placed.groupBy("file", "split", "number").agg(
        *prints,
        F.sum(F.size("words")).alias("words"),
        F.sum("size").alias("size"),
        F.sum("raw").alias("raw"),
        F.min_by(cut_bytes(F.col("indent"), max_bytes), "row").alias("indent"),
        F.min_by(F.octet_length("indent"), "row").alias("indented"),
        F.max_by(F.octet_length("line") - F.octet_length(F.rtrim("line", F.lit(fixed.WHITE_SPACE))), "row").alias("tail"),
        _first(F.when(F.col("signed") != "", F.col("signed")), F.when(F.col("signed") != "", F.col("at")), max_bytes, "row").alias("signed"),
        _first(F.col("text"), F.col("raw_at"), max_bytes, "row").alias("texts"),
    )

    # splits are numbered as in line_blocks: by the blocks that begin in the file's splits before
    slices = marked.groupBy("file", "split").agg(
        F.sum(begins).alias("own"),
        F.min(F.struct("row", "blank", F.isnull("begins").alias("depends"))).alias("first"),
        F.max(F.struct("row", "blank")).alias("last"),
    )
    order = Window.partitionBy("file").orderBy("split")
    slices = slices.withColumn("opened", (F.col("first.depends") & F.lag("last.blank", 1, True).over(order)).cast("int"))
    earlier = F.sum(F.col("own") + F.col("opened")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("file", "split", (F.coalesce(earlier, F.lit(0)) + F.col("opened")).alias("shift"))
    parts = parts.join(slices, ["file", "split"]).withColumn("block_no", F.col("shift") + F.col("number") - 1)

    # the parts of a block are merged in order of their splits
    block = Window.partitionBy("file", "block_no").orderBy("split")
    before, whole = block.rowsBetween(Window.unboundedPreceding, -1), block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goes_on = F.lag("split").over(block).isNotNull()
    parts = parts.withColumns({"indent": F.when(goes_on, F.col("indent")).otherwise(""), "raw": F.col("raw") + F.when(goes_on, F.col("indented")).otherwise(0)})
    placed = parts.select(
        "*",
        (F.sum("words").over(whole) - F.sum("words").over(block)).alias("words_after"),
        F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at"),
        F.coalesce(F.sum("raw").over(before), F.lit(0)).alias("raw_at"),
    )
    prints = [(F.sum(_merged(F.col(f"print{i}"), b, F.col("words_after"))) % PRIME).alias(f"print{i}") for i, b in enumerate(BASES)]

    def joined(texts: str, at: str, front: Column) -> Column:
        own = F.transform(F.col(texts)["text"], lambda t, i: F.when(i == 0, F.concat(front, t)).otherwise(t))
        return F.sort_array(F.collect_list(F.when((F.col(at) <= max_bytes) & (F.size(texts) > 0), F.struct("split", own.alias("own")))))

    merged = placed.groupBy("file", "block_no").agg(
        *prints,
        F.sum("words").alias("words"),
        (F.sum("raw") - 1 - F.max_by("tail", "split")).alias("bytes"),
        joined("signed", "at", F.lit("")).alias("signed"),
        joined("texts", "raw_at", F.col("indent")).alias("texts"),
    )

    def beginning(name: str, separator: str) -> Column:
        return cut_bytes(F.array_join(F.flatten(F.transform(name, lambda p: p["own"])), separator), max_bytes)

    shown = F.when(F.col("bytes") <= max_bytes, F.rtrim(beginning("texts", "\n"), F.lit(fixed.WHITE_SPACE))).otherwise(beginning("texts", "\n"))
    return merged.select(
        "file",
        "block_no",
        F.struct(*(f"print{i}" for i in range(len(BASES)))).alias("fingerprint"),
        "words",
        beginning("signed", " ").alias("signature"),
        "bytes",
        shown.alias("representative"),
    )


def long_file_groups(lines: DataFrame, max_bytes: int = 4096) -> DataFrame:
    """File, rank, signature, count, representative of the groups of log files with blocks of any length.

    What ``groups.file_groups`` gives, with signatures and representatives cut to ``max_bytes``; groups are still told apart by
    their whole signatures, by fingerprint and number of words.
    """
    states = block_states(lines, max_bytes).where(F.col("words") > 0)
    groups = states.groupBy("file", "fingerprint", "words").agg(
        F.count(F.lit(1)).alias("count"), F.min(F.struct("block_no", "signature", "bytes", "representative")).alias("first")
    )
    kept = groups.where((F.col("count") > 1) | (F.col("first.bytes") >= fixed.NOISE_BYTES))
    ranked = places(kept.select("file", "count", "first.*"), ["file"], [F.desc("count"), F.col("block_no")])
    return ranked.select("file", F.col("rank").cast("int").alias("rank"), "signature", "count", "representative")
