"""From an array column to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfold(df: DataFrame, array: Column, *keep: str | Column, position: str = "pos", item: str = "item") -> DataFrame:
    """One row per element: the ``keep`` columns, ``position`` from 0, and ``item``.

    For a plain explode Spark infers the filter ``size(array) > 0`` and pushes it below the projection that computes
    the array, so that an expensive array is computed twice.  The outer form leaves the plan as it is written.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, item)).where(F.col(position).isNotNull())


def once(value: Column) -> Column:
    """A value that is computed once per row, however many later steps look at it.

    Spark moves filters below the projection that computes their columns and so computes these twice; they are not
    moved through an explode.  For select() only.
    """
    return F.explode_outer(F.array(value))
