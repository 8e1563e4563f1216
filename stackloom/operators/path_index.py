"""Path resolution over sorted reversed paths (C6, D2): a file is one row, and so is a trace path, however deep they are.

A trace path may name any file whose path is the end of it.  Written backwards, part by part, that file's key is a beginning of
the trace path's key, and all keys with a common beginning lie next to each other in sorted order.  So files and trace paths
are range-partitioned by their keys, and one pass over a slice holds the files that begin the current key on a stack.  What a
slice cannot know are files of earlier slices that begin its own first key; they are looked up once a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.text import strip, strip_container
from stackloom.operators.paths import basename, clean_path, file_index
from stackloom.session import materialize

_HIT = "struct<key:string,by_name:boolean,path:string,size:bigint,n_lines:bigint>"
_FOUND = f"part int, first boolean, repo string, key string, file string, short_key string, named boolean, hits array<{_HIT}>"
FILE, NAME, TRACE = 0, 1, 2


def path_key(path: Column) -> Column:
    """The parts of a path in reverse order, each followed by a slash."""
    return F.concat(F.array_join(F.reverse(F.split(path, "/")), "/"), F.lit("/"))


def _file_rows(source_files: DataFrame) -> DataFrame:
    """Files by their keys, and once more by their name alone if no other file of the repository has it."""
    files = file_index(source_files).where(F.col("path").isNotNull()).groupBy("repo", "path", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.min("size").cast("bigint").alias("size"), F.min("n_lines").cast("bigint").alias("n_lines")
    )
    names = files.groupBy("repo", "name").agg(F.sum("rows").alias("rows"), *(F.min(c).alias(c) for c in ("path", "size", "n_lines")))
    by_path = files.select("repo", path_key(F.col("path")).alias("key"), F.lit(FILE).alias("kind"), "path", "size", "n_lines")
    by_name = names.where((F.col("rows") == 1) & ~F.col("name").isin(*fixed.GENERIC_BASENAMES)).select(
        "repo", F.concat("name", F.lit("/")).alias("key"), F.lit(NAME).alias("kind"), "path", "size", "n_lines"
    )
    return by_path.unionByName(by_name)


def _trace_rows(trace_paths: DataFrame) -> DataFrame:
    """Distinct trace paths by their keys; ``short_key`` is that of the path without its container root."""
    path = strip(F.col("file"))
    short = strip_container(path)
    wanted = trace_paths.select("repo", "file").distinct().select(
        "repo",
        path_key(clean_path(path)).alias("key"),
        F.lit(TRACE).alias("kind"),
        "file",
        F.when(short != path, path_key(clean_path(short))).alias("short_key"),
        basename(path).alias("name"),
    )
    return wanted.where(F.col("key") != "/").withColumn("named", F.startswith("key", F.concat("name", F.lit("/")))).drop("name")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each trace path the files on the stack; and the slice's first key."""
    part, repo, stack, started = TaskContext.get().partitionId(), None, [], False
    names = ["repo", "key", "kind", "path", "size", "n_lines", "file", "short_key", "named"]
    for batch in batches:
        out = []
        for own, key, kind, path, size, n_lines, file, short_key, named in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if not started:
                out.append((part, True, own, key, None, None, None, None))
                started = True
            if own != repo:
                repo, stack = own, []
            while stack and not key.startswith(stack[-1]["key"]):
                stack.pop()
            if kind == TRACE:
                out.append((part, False, own, key, file, short_key, named, list(stack)))
            else:
                stack.append({"key": key, "by_name": kind == NAME, "path": path, "size": size, "n_lines": n_lines})
        columns = list(zip(*out, strict=True)) or [()] * 8
        hit = pa.struct([("key", pa.string()), ("by_name", pa.bool_()), ("path", pa.string()), ("size", pa.int64()), ("n_lines", pa.int64())])
        kinds = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(hit)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["part", "first", "repo", "key", "file", "short_key", "named", "hits"],
        )


def resolve_indexed(trace_paths: DataFrame, source_files: DataFrame) -> DataFrame:
    """What ``paths.resolve_distinct`` gives: each distinct (repo, file) that resolves, with path, size and n_lines.

    The order of preference is the same: the path without its container root, else the longest end of the path that is a file,
    else its file name, if only one file has it and it is not too common to mean anything.  A null repository matches nothing.
    """
    files = materialize(_file_rows(source_files))
    both = files.unionByName(_trace_rows(trace_paths), allowMissingColumns=True).where(F.col("repo").isNotNull())
    order = ["repo", "key"]
    arranged = both.repartitionByRange(*order).sortWithinPartitions(*order, "kind")
    found = materialize(arranged.mapInArrow(_scan, _FOUND))

    # files of earlier slices that begin the first key of a slice: at most one row a slice and part of its path
    starts = found.where("first").select("part", "repo", F.split("key", "/").alias("parts"))
    begins = starts.select("part", "repo", F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n"), "parts").select(
        "part", "repo", F.concat(F.array_join(F.slice("parts", F.lit(1), F.col("n")), "/"), F.lit("/")).alias("key")
    )
    hit = F.struct("key", (F.col("kind") == NAME).alias("by_name"), "path", "size", "n_lines").cast(_HIT)
    carried = files.join(F.broadcast(begins), order).groupBy("part").agg(F.collect_list(F.struct("repo", hit.alias("hit"))).alias("carried"))

    rows = found.where(~F.col("first")).join(F.broadcast(carried), "part", "left")
    here = F.filter(F.col("carried"), lambda c: (c["repo"] == F.col("repo")) & F.startswith(F.col("key"), c["hit"]["key"]))
    none = F.array().cast(f"array<{_HIT}>")
    hits = F.concat(F.coalesce("hits", none), F.coalesce(F.transform(here, lambda c: c["hit"]), none))
    hits = F.filter(hits, lambda h: ~h["by_name"] | F.col("named"))
    best = F.array_max(
        F.transform(
            hits,
            lambda h: F.struct(
                (~h["by_name"] & F.coalesce(h["key"] == F.col("short_key"), F.lit(False))).alias("short"),
                (~h["by_name"]).alias("by_path"),
                F.length(h["key"]).alias("length"),
                h.alias("hit"),
            ),
        )
    )
    chosen = rows.select("repo", "file", best["hit"].alias("hit")).where(F.col("hit").isNotNull())
    return chosen.select("repo", "file", "hit.path", "hit.size", "hit.n_lines")


def resolve_paths_indexed(frames: DataFrame, source_files: DataFrame) -> DataFrame:
    """``paths.resolve_paths`` by the sorted index."""
    return frames.join(resolve_indexed(frames, source_files), ["repo", "file"])
