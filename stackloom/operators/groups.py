"""Log blocks and error groups.

A document is one row, so everything that concerns a single document is a column expression over that row: no shuffle, no
window, and the same expression works on a stream.  Only the roll-up across documents (E10) moves data.  Limits are
arguments; none holds unless it is given, and roll-ups take none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.text import UNICODE_SPACE, excerpt, let, normalize, normalize_all, starts_block, strip
from stackloom.operators.ranking import places
from stackloom.operators.rows import once, unfold

# A break is a run of blank lines, or a newline in front of a line that starts an entry.
BLOCK_BREAK = rf"(?d)\n(?:{UNICODE_SPACE}*\n|(?={fixed.BLOCK_START}))"

GROUPS_TYPE = "array<struct<rank:int,signature:string,count:bigint,representative:string>>"


def lines(df: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    numbered = unfold(df, F.split("text", "\n"), "doc_id", position="line_no", item="line")
    return numbered.withColumn("line_no", F.col("line_no") + 1)


def block_pieces(text: Column) -> Column:
    """The blocks of a text, blank ones left out."""
    return F.filter(F.split(text, BLOCK_BREAK), lambda b: strip(b) != "")


def blocks(df: DataFrame) -> DataFrame:
    """One row per block, numbered from 0, without the blank lines around it."""
    edges = rf"(?d)\A{UNICODE_SPACE}*\n|\n{UNICODE_SPACE}*\z"
    pieces = unfold(df, block_pieces(F.col("text")), "doc_id", position="block_no", item="block")
    return pieces.withColumn("block", F.regexp_replace("block", edges, ""))


def error_groups(
    text: Column, max_groups: int | None = None, max_bytes: int | None = None, noise: bool = False
) -> Column:
    """The blocks of a text collapsed by signature, most frequent first, then first seen.

    A single short block is noise and left out unless ``noise``; roll-ups need it, as it may be frequent elsewhere.

    Sorting the (signature, block number) pairs puts equal signatures next to each other; the heads of those runs are
    the groups.  That is n log n in the blocks of one document.
    """

    def shortened(block: Column) -> Column:
        return block if max_bytes is None else excerpt(block, max_bytes)

    def signed(pieces: Column) -> Column:
        pairs = F.transform(normalize_all(pieces), lambda s, i: F.struct(s.alias("signature"), i.alias("block_no")))
        return F.sort_array(F.filter(pairs, lambda p: p["signature"] != ""))

    def heads(pairs: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(pairs) - 1, F.lit(0))),
            lambda i: (i < F.size(pairs))
            & ((i == 0) | (F.get(pairs, i)["signature"] != F.get(pairs, i - 1)["signature"])),
        )
        return starts

    def counted(pieces: Column, pairs: Column, starts: Column) -> Column:
        groups = F.transform(
            starts,
            lambda start, i: F.struct(
                (start - F.coalesce(F.get(starts, i + 1), F.size(pairs))).alias("minus_count"),
                F.get(pairs, start)["block_no"].alias("block_no"),
                F.get(pairs, start)["signature"].alias("signature"),
            ),
        )
        if not noise:
            groups = F.filter(
                groups,
                lambda g: (g["minus_count"] < -1)
                | (F.octet_length(F.get(pieces, g["block_no"])) >= fixed.NOISE_BYTES),
            )
        ordered = F.sort_array(groups)
        if max_groups is not None:
            ordered = F.slice(ordered, 1, max_groups)
        return F.transform(
            ordered,
            lambda g, i: F.struct(
                (i + 1).alias("rank"),
                g["signature"].alias("signature"),
                (-g["minus_count"]).cast("bigint").alias("count"),
                shortened(F.get(pieces, g["block_no"])).alias("representative"),
            ),
        )

    # arrays of one state, each made of the one before, as in normalize_all
    trimmed = F.filter(F.transform(F.split(text, BLOCK_BREAK), strip), lambda b: b != "")
    state = F.transform(F.array(trimmed), lambda pieces: F.struct(pieces.alias("pieces"), signed(pieces).alias("pairs")))
    state = F.transform(state, lambda s: F.struct(s["pieces"].alias("pieces"), s["pairs"].alias("pairs"), heads(s["pairs"]).alias("starts")))
    return F.get(F.transform(state, lambda s: counted(s["pieces"], s["pairs"], s["starts"])), F.lit(0))


def group_errors(df: DataFrame, max_groups: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """One row per document and error group, or per document the first ``max_groups``."""
    return unfold(df, error_groups(F.col("text"), max_groups, max_bytes), "doc_id").select("doc_id", "item.*")


def top_signature(text: Column, groups: Column) -> Column:
    """Signature and representative of a text; the whole text stands in when it has no group."""

    def start() -> Column:
        return F.struct(normalize(text).alias("signature"), text.alias("representative"))

    first = let(
        F.get(groups, F.lit(0)), lambda g: F.when(g.isNotNull(), F.struct(g["signature"], g["representative"]))
    )
    return F.coalesce(first, start())


def doc_signature(df: DataFrame) -> DataFrame:
    """One signature and representative per document."""
    top = top_signature(F.col("text"), error_groups(F.col("text"), 1))
    return df.select("doc_id", once(top).alias("top")).select("doc_id", "top.signature", "top.representative")


def embed_text(text: Column, groups: Column) -> Column:
    """What to embed: the top group's representative, or the whole text."""
    return F.coalesce(F.get(groups, F.lit(0))["representative"], text)


def counted_families(per_doc: DataFrame, *keys: str | Column) -> DataFrame:
    """Families over (ts, signature, count, representative) rows, noise left out by what is counted over all of them."""
    rolled = per_doc.withColumn("bytes", F.octet_length("representative")).groupBy(*keys, "signature").agg(
        F.sum("count").alias("occurrences"),
        F.count(F.lit(1)).alias("documents"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max("bytes").alias("bytes"),
    )
    return rolled.where((F.col("occurrences") > 1) | (F.col("bytes") >= fixed.NOISE_BYTES)).drop("bytes")


def error_families(df: DataFrame) -> DataFrame:
    """One row per signature over all documents (``df`` has doc_id, text, ts).

    Each document contributes one row per signature, so counting documents needs no distinct.  All aggregates combine
    on the map side: a family that makes up a third of all rows arrives as one row per task.
    """
    return counted_families(unfold(df, error_groups(F.col("text"), noise=True), "ts").select("ts", "item.*"))


def line_blocks(lines: DataFrame) -> DataFrame:
    """C1/C2 for logs of any length: file, block_no, block of the lines (file, split, row, line) that ``log_lines`` gives.

    Every split is numbered on its own and shifted by the blocks that begin in the file's earlier splits, a table of one row
    per split; whether a split's first line begins a block is told by the last line of the split before.  So a file of
    any length is the work of as many tasks as it has splits.  A block itself is one value.
    """
    own = Window.partitionBy("file", "split").orderBy("row")
    marked = lines.withColumn("blank", strip(F.col("line")) == "").withColumn("after_blank", F.lag("blank").over(own))
    opens = starts_block(F.col("line"))
    # NULL for the first line of a split that begins a block only if a blank line is in front of it
    marked = marked.withColumn("begins", ~F.col("blank") & (opens | F.col("after_blank")))
    begins = F.coalesce(F.col("begins"), F.lit(False)).cast("int")
    first = F.struct("row", "blank", F.isnull("begins").alias("depends"))
    slices = marked.groupBy("file", "split").agg(
        F.sum(begins).alias("own"), F.min(first).alias("first"), F.max(F.struct("row", "blank")).alias("last")
    )
    order = Window.partitionBy("file").orderBy("split")
    slices = slices.withColumn("opened", (F.col("first.depends") & F.lag("last.blank", 1, True).over(order)).cast("int"))
    before = F.sum(F.col("own") + F.col("opened")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select("file", "split", (F.coalesce(before, F.lit(0)) + F.col("opened")).alias("shift"))
    numbered = marked.withColumn("number", F.sum(begins).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("blank"))
    placed = numbered.join(slices, ["file", "split"]).withColumn("block_no", F.col("shift") + F.col("number") - 1)
    gathered = placed.groupBy("file", "block_no").agg(F.sort_array(F.collect_list(F.struct("split", "row", "line"))).alias("l"))
    return gathered.select("file", "block_no", F.array_join("l.line", "\n").alias("block"))


def file_groups(blocks_of_files: DataFrame) -> DataFrame:
    """E1 for logs of any length: file, rank, signature, count, representative, as ``error_groups`` ranks them.

    Groups are counted by a hash aggregation; the blocks that stand for them are fetched afterwards.  A file of very many
    groups is ranked by as many tasks as it needs.
    """
    trimmed = strip(F.col("block"))
    signed = blocks_of_files.select("file", "block_no", trimmed.alias("block"), normalize(trimmed).alias("signature"))
    counted = signed.where(F.col("signature") != "").groupBy("file", "signature").agg(
        F.count(F.lit(1)).alias("count"), F.min("block_no").alias("block_no")
    )
    shown = counted.join(signed.select("file", "block_no", F.col("block").alias("representative")), ["file", "block_no"])
    kept = shown.where((F.col("count") > 1) | (F.octet_length("representative") >= fixed.NOISE_BYTES))
    ranked = places(kept, ["file"], [F.desc("count"), F.col("block_no")])
    return ranked.select("file", F.col("rank").cast("int").alias("rank"), "signature", "count", "representative")
