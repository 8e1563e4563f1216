"""Places within a group of any size, without a window over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom.session import materialize


def places(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` with their place from 1 in their group of ``keys``, by ``order``, which should tell all rows of a group apart.

    Rows are range-partitioned by keys and order, so that a large group is the work of many tasks; each slice is numbered on
    its own and shifted by the sizes of the slices of its group before it, a table of one row a group and slice.  The written
    table pins the slices.
    """
    sliced = materialize(rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()))
    slices = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    shifts = sizes.select(*keys, "_slice", F.coalesce(F.sum("_rows").over(slices), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_place", F.row_number().over(within))
    return numbered.join(shifts, [*keys, "_slice"]).withColumn(name, F.col("_before") + F.col("_place")).drop("_slice", "_place", "_before")
