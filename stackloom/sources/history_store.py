"""The history table on disk (A7): a folder of versions, each a parquet table of history rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stackloom.operators.history import HISTORY_SCHEMA, fold_history


def _complete(spark: SparkSession, path: str) -> dict[str, str]:
    """Name and folder of all versions and compactions that were written to the end; one listing for all of them."""
    jvm = spark._jvm
    marks = jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    folders = [status.getPath().getParent() for status in found]
    return {f.getName(): f.toString() for f in folders}


def _versions(spark: SparkSession, path: str, before: str | None = None) -> list[str]:
    """Folders that make up the history: the last compaction and the versions after it, all ``before`` a version if given."""
    found = _complete(spark, path)
    if before is not None:
        found = {n: folder for n, folder in found.items() if n.partition("=")[2] < before}
    base = max((n for n in found if n.startswith("upto=")), default="upto=")
    after = [n for n in found if n.startswith("version=") and n.partition("=")[2] > base.partition("=")[2]]
    return [found[n] for n in ([base] if base in found else []) + sorted(after)]


def read_history(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """All complete versions, or those ``before`` one, folded to one row per family; empty when there is none."""
    versions = _versions(spark, path, before)
    if not versions:
        return spark.createDataFrame([], HISTORY_SCHEMA)
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(*versions)
    return rows if len(versions) == 1 else fold_history(rows)


def write_history(df: DataFrame, path: str, version: int | str) -> bool:
    """Write history rows as one version; False when that version is already there.

    A version holds only what it adds: an upsert writes the families it touched, not the table.  A write that broke
    off leaves no ``_SUCCESS`` and is overwritten by the next try, so nothing is counted twice.  Versions are ordered as
    texts, so numbers need leading zeros.
    """
    done = _complete(df.sparkSession, path)
    compacted = max((n.partition("=")[2] for n in done if n.startswith("upto=")), default="")
    if f"version={version}" in done or str(version) <= compacted:
        return False
    df.write.mode("overwrite").parquet(f"{path}/version={version}")
    return True


def compact_history(spark: SparkSession, path: str) -> str | None:
    """Folds all versions into one table, which readers use instead of them; the name it got, or None if there is no version.

    Versions up to it may be deleted once no reader that began before uses them.  A compaction that broke off is ignored.
    """
    names = [n.partition("=")[2] for n in _complete(spark, path) if n.startswith("version=")]
    if not names:
        return None
    read_history(spark, path).write.mode("overwrite").parquet(f"{path}/upto={max(names)}")
    return f"upto={max(names)}"
