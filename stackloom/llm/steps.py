"""Steps that jobs of this package share: a written table that replaces its lineage, freeing it, row numbers, connected components."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackloom.llm.words import tidy
from stackloom.session import materialize


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    return materialize(df)


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished steps, which it does once their plans are garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in their tree by ``order`` (nulls first), and ``size``, the rows of the tree.

    Rows are range-partitioned by tree, order and a number of their own, so neither a large tree nor equal rows land in one
    task; each part counts, and its numbers are shifted by the sizes of the parts before it.
    """
    keys = [tree, *order, "_row"]
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    names, at = ranged.columns, ranged.columns.index(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            of = batch.column(at).to_numpy(zero_copy_only=False)
            begins = np.append(0, np.flatnonzero(of[1:] != of[:-1]) + 1)
            place = np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))
            if of[0] == last:
                place[: begins[1] if len(begins) > 1 else n] += seen
            last, seen = of[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(place)], names=[*names, "_part", "_at"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    placed = written(ranged.mapInArrow(tidy(count), f"{kinds}, _part int, _at long"))
    parts = placed.groupBy(tree, "_part").agg(F.count("*").alias("_rows"))
    own = Window.partitionBy(tree)
    before = F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(tree, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_rows").over(own).alias("size"))
    return placed.join(parts, [tree, "_part"]).withColumn("pos", F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of the connected component of every node of an edge.

    Alternating large-star and small-star steps: each node hands its neighbours to the smallest one it knows.  Edges only
    become fewer or lower; the number of rounds grows with the logarithm of the number of nodes.  Each round is written,
    so that a lost executor repeats one round.  Self-loops are allowed and give a component of one.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = written(pairs)
    last = None
    for _ in range(rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.filter("v >= u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps an edge to the smallest it knows
        large = large.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = pairs.agg(F.count("*"), F.sum(F.col("u") - F.col("v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    release(spark)
    return pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
