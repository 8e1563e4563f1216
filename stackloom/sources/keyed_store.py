"""The history as bucketed tables (A7, D6): look-ups and upserts by ``sig_id`` leave what is stored where it is.

A folder ``buckets=N`` holds versions; each is hashed by ``sig_id`` into the same N buckets, in the layout of Spark's bucketed
tables.  Rows of one family are in files of one bucket whatever the version, so versions fold bucket by bucket, a join by
``sig_id`` moves only its other side, and a look-up of a few ids reads only their buckets.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators.history import HISTORY_COLUMNS, HISTORY_SCHEMA, fold_history, new_history
from stackloom.operators.rows import once

BUCKETS = 64


def _folders(spark: SparkSession, path: str) -> tuple[int | None, dict[str, str]]:
    """The number of buckets, and name and folder of all complete versions and compactions."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/buckets=*/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    folders = [status.getPath().getParent() for status in found]
    buckets = {int(f.getParent().getName().partition("=")[2]) for f in folders}
    if len(buckets) > 1:
        raise ValueError(f"{path} holds histories of {sorted(buckets)} buckets")
    return next(iter(buckets), None), {f.getName(): f.toString() for f in folders}


def _rows(spark: SparkSession, path: str, before: str | None = None) -> DataFrame | None:
    """Rows of the last compaction and the versions after it, as one bucketed table of this session."""
    buckets, found = _folders(spark, path)
    if before is not None:
        found = {n: folder for n, folder in found.items() if n.partition("=")[2] < before}
    base = max((n for n in found if n.startswith("upto=")), default="upto=")
    names = [n for n in found if n.startswith("version=") and n.partition("=")[2] > base.partition("=")[2]]
    names += [base] if base in found else []
    if not names:
        return None
    root = found[names[0]].rpartition("/")[0]
    # versions never change, so a session knows each set of them by one name
    table = "stackloom_history_" + hashlib.md5("\n".join([root, *sorted(names)]).encode()).hexdigest()
    if not spark.catalog.tableExists(table):
        layout = f"CLUSTERED BY (sig_id) SORTED BY (sig_id) INTO {buckets} BUCKETS"
        spark.sql(f"CREATE TABLE {table} ({HISTORY_SCHEMA}, part string) USING parquet PARTITIONED BY (part) {layout} LOCATION '{root}'")
    places = " ".join(f"PARTITION (part = '{n}') LOCATION '{found[n]}'" for n in sorted(names))
    spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {places}")
    return spark.table(table).drop("part")


def read_keyed(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """One row per family from all complete versions, or those ``before`` one; no row is moved."""
    rows = _rows(spark, path, before)
    return spark.createDataFrame([], HISTORY_SCHEMA) if rows is None else fold_history(rows)


def lookup(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The stored rows of ``ids`` (column ``sig_id``); repeated ids give one row.

    Only the ids are moved: to the buckets, or to every task if they are few enough for Spark to share.
    """
    rows = _rows(spark, path)
    if rows is None:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    # else Spark computes the ids twice, the first time to tell in front of whatever made them distinct if they are missing
    wanted = ids.select(once(F.col("sig_id").cast("decimal(20,0)")).alias("sig_id"))
    return fold_history(rows.join(wanted, "sig_id", "left_semi"))


def point(spark: SparkSession, path: str, sig_ids: list[int]) -> DataFrame:
    """The stored rows of a few ids that the caller has at hand; only their buckets are read."""
    rows = _rows(spark, path)
    if rows is None or not sig_ids:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    wanted = ", ".join(f"CAST({int(i)} AS DECIMAL(20,0))" for i in sig_ids)
    return fold_history(rows.where(F.expr(f"sig_id IN ({wanted})")))


def _write(df: DataFrame, folder: str, buckets: int) -> None:
    table = f"stackloom_write_{uuid.uuid4().hex}"
    spread = df.select(*HISTORY_COLUMNS).repartition(buckets, "sig_id")
    spread.write.mode("overwrite").format("parquet").bucketBy(buckets, "sig_id").sortBy("sig_id").option("path", folder).saveAsTable(table)
    df.sparkSession.sql(f"DROP TABLE {table}")


def write_keyed(df: DataFrame, path: str, version: int | str, buckets: int | None = None) -> bool:
    """Adds history rows as one version; False when it is already there.

    The first version fixes the number of buckets (``BUCKETS`` by default).  Rules of ``history_store.write_history`` hold: a
    write that broke off is overwritten by the next try, versions are ordered as texts.
    """
    known, done = _folders(df.sparkSession, path)
    if known is not None and buckets is not None and buckets != known:
        raise ValueError(f"{path} has {known} buckets, not {buckets}")
    compacted = max((n.partition("=")[2] for n in done if n.startswith("upto=")), default="")
    if f"version={version}" in done or str(version) <= compacted:
        return False
    buckets = known or buckets or BUCKETS
    _write(df, f"{path}/buckets={buckets}/version={version}", buckets)
    return True


def upsert(occurrences: DataFrame, path: str, version: int | str, buckets: int | None = None) -> bool:
    """Occurrences as one version: only they are hashed and moved, counts add up when rows are read."""
    return write_keyed(new_history(occurrences), path, version, buckets)


def compact_keyed(spark: SparkSession, path: str) -> str | None:
    """Folds all versions into one, bucket by bucket, which readers use instead of them; its name, or None without a version."""
    buckets, found = _folders(spark, path)
    names = [n.partition("=")[2] for n in found if n.startswith("version=")]
    if not names:
        return None
    _write(read_keyed(spark, path), f"{path}/buckets={buckets}/upto={max(names)}", buckets)
    return f"upto={max(names)}"
