"""From a path in a trace to a file of the repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.text import let, strip, strip_container
from stackloom.operators.rows import unfold
from stackloom.sources.ingest import line_count


def clean_path(path: Column) -> Column:
    """A path below the repository root: no empty or ``.`` parts, ``..`` applied; one that leaves the root keeps it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def add(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        return F.when(
            (part == "..") & (F.coalesce(last, F.lit("..")) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)
        ).otherwise(F.concat(done, F.array(part)))

    simple = ~F.exists(parts, lambda p: p == "..")
    return F.array_join(
        F.when(simple, parts).otherwise(F.aggregate(parts, F.array().cast("array<string>"), add)), "/"
    )


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)/*\z", 1)


def path_candidates(path: Column) -> Column:
    """What a trace path may be called in the repository, best first, as array<struct<kind, name>>.

    In order: without its container root, as it is, without one, two, ... leading parts, and by its file name alone
    unless that name is too common to mean anything.
    """

    def by_path(name: Column) -> Column:
        return F.struct(F.lit("path").alias("kind"), clean_path(name).alias("name"))

    def listed(p: Column) -> Column:
        parts = F.split(p, "/")
        shorter = F.transform(
            F.sequence(F.lit(2), F.size(parts) + 1),
            lambda i: by_path(F.array_join(F.slice(parts, i, F.greatest(F.size(parts) - i + 1, F.lit(0))), "/")),
        )
        stripped = strip_container(p)
        by_name = F.struct(F.lit("base").alias("kind"), basename(p).alias("name"))
        every = F.concat(
            F.when(stripped != p, F.array(by_path(stripped))).otherwise(
                F.array().cast("array<struct<kind:string,name:string>>")
            ),
            F.array(by_path(p)),
            shorter,
            F.array(by_name),
        )
        return F.filter(
            every,
            lambda c: (c["name"] != "") & ((c["kind"] == "path") | ~c["name"].isin(*fixed.GENERIC_BASENAMES)),
        )

    return let(strip(path), listed)


def file_index(source_files: DataFrame) -> DataFrame:
    """Files without their text: repo, path, name, size, n_lines."""
    return source_files.select(
        "repo", "path", basename(F.col("path")).alias("name"), "size", line_count(F.col("content")).alias("n_lines")
    )


def unique_basenames(source_files: DataFrame) -> DataFrame:
    """File names that occur exactly once in their repository."""
    return (
        source_files.select("repo", "path", basename(F.col("path")).alias("name"))
        .groupBy("repo", "name")
        .agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("path"))
        .where(F.col("files") == 1)
        .select("repo", "name", "path")
    )


def resolve_distinct(trace_paths: DataFrame, source_files: DataFrame) -> DataFrame:
    """Each distinct (repo, file) that resolves, with path, size and n_lines of what it resolves to.

    All rules are one equi join: a trace path is unfolded into its candidates, and the hit of the best candidate wins.
    """
    names = F.array(
        F.struct(F.lit("path").alias("kind"), F.col("path").alias("name")), F.struct(F.lit("base").alias("kind"), F.col("name"))
    )
    # one scan and one shuffle for both rules: a file by its path, and by its name if no other file has it
    lookup = (
        unfold(file_index(source_files), names, "repo", "path", "size", "n_lines", position="_")
        .select("repo", "path", "size", "n_lines", "item.*")
        .groupBy("repo", "kind", "name")
        .agg(F.count(F.lit(1)).alias("files"), *(F.min(c).alias(c) for c in ("path", "size", "n_lines")))
        .where((F.col("kind") == "path") | (F.col("files") == 1))
        .drop("files")
    )
    wanted = trace_paths.select("repo", "file").distinct()
    candidates = unfold(wanted, path_candidates(F.col("file")), "repo", "file", position="priority").select(
        "repo", "file", "priority", "item.*"
    )
    hits = candidates.join(lookup, ["repo", "kind", "name"])
    best = F.min_by(F.struct("path", "size", "n_lines"), "priority").alias("hit")
    return hits.groupBy("repo", "file").agg(best).select("repo", "file", "hit.*")


def resolve_paths(frames: DataFrame, source_files: DataFrame) -> DataFrame:
    """Frames (doc_id, repo, pos, file, ...) whose file is in the repository, with its path, size and n_lines.

    Every distinct trace path is resolved once, however many frames carry it.
    """
    resolved = resolve_distinct(frames, source_files)
    return frames.join(resolved, ["repo", "file"])


def unresolved_frames(frames: DataFrame, source_files: DataFrame) -> DataFrame:
    """The frames that resolve_paths leaves out."""
    resolved = resolve_distinct(frames, source_files).select("repo", "file")
    return frames.join(resolved, ["repo", "file"], "left_anti")
