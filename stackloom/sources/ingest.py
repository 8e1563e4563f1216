"""Where texts and source files come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.functions.text import cut_bytes
from stackloom.operators.rows import unfold

def cap_input(df: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """A4: cut ``text`` at ``max_bytes``, if given, and flag the rows that were cut, now or before."""
    before = F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in df.columns else F.lit(False)
    if max_bytes is None:
        return df.withColumn("truncated", before)
    over = F.octet_length("text") > max_bytes
    return df.withColumn("truncated", over | before).withColumn("text", cut_bytes(F.col("text"), max_bytes))


def from_texts(spark: SparkSession, texts: list[str], max_bytes: int | None = None) -> DataFrame:
    """A3: literal texts, numbered from 0."""
    rows = [(str(number), text, "inline") for number, text in enumerate(texts)]
    return cap_input(spark.createDataFrame(rows, "doc_id string, text string, origin string"), max_bytes)


def read_error_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """A1/A4/A5: one document per file, its path as id and origin.

    A file is one value here, which Spark bounds at 2 GiB; logs of any length are read by ``log_lines`` instead.
    """
    content = F.col("content")
    if max_bytes is not None:
        # Four spare bytes let the cut see whether it falls inside a character.
        content = F.substring(content, 1, max_bytes + 4)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("path").alias("doc_id"),
            F.make_valid_utf8(content.cast("string")).alias("text"),
            F.col("path").alias("origin"),
            (F.lit(False) if max_bytes is None else F.col("length") > max_bytes).alias("truncated"),
            F.col("modificationTime").alias("ts"),
        )
    )
    return cap_input(files, max_bytes).select("doc_id", "text", "origin", "truncated", "ts")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A1/A2: the lines of log files of any length: file, split, row, line.

    Files are read from all their splits.  ``split`` is where a line's split begins in its file and ``row`` orders the lines
    of a split, so that (split, row) orders the lines of a file.
    """
    return (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("row"),
            F.make_valid_utf8(F.col("value")).alias("line"),
        )
    )


def read_error_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    file_format: str = "text",
    max_bytes: int | None = None,
) -> DataFrame:
    """A2: a stream of documents: each new text file is one, or each row of files that carry ``schema``."""
    if file_format == "text":
        files = spark.readStream.format("text").option("wholetext", "true").load(path)
        return cap_input(
            files.select(
                F.col("_metadata.file_path").alias("doc_id"),
                F.col("value").alias("text"),
                F.lit("stdin").alias("origin"),
                F.col("_metadata.file_modification_time").alias("ts"),
            ),
            max_bytes,
        )
    return cap_input(spark.readStream.format(file_format).schema(schema).load(path), max_bytes)


def task_count(df: DataFrame, rows_per_task: int = 20_000) -> int:
    """How many tasks an input is worth: all cores, and no more rows in a task than these; files tell them without being read."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def spread(df: DataFrame, *keys: str, rows_per_task: int = 20_000) -> DataFrame:
    """Use all cores for an input of few splits, such as one file with one row group, and bound what a task gets.

    Taking a text apart costs far more than moving it, so that a split that is quickly read may be long work: tasks grow in
    number with the rows, not in size.  An input with enough splits is left as it is.
    """
    wanted = task_count(df, rows_per_task)
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted, *keys)


def line_count(content: Column) -> Column:
    """Lines of a text, counted on bytes without splitting it."""
    return F.octet_length(content) - F.octet_length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def source_lines(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Source files as numbered lines; files over ``max_bytes``, if given, are skipped."""
    if max_bytes is not None:
        files = files.where(F.col("size") <= max_bytes)
    numbered = unfold(files, F.split("content", "\n"), "repo", "path", position="line_no", item="text")
    return numbered.withColumn("line_no", F.col("line_no") + 1)
