"""Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackloom.functions import fixed
from stackloom.operators.context import analyze
from stackloom.operators.groups import counted_families, error_groups
from stackloom.operators.history import new_history
from stackloom.operators.rows import unfold
from stackloom.operators.similarity import recall
from stackloom.sources.history_store import read_history, write_history


def analyze_stream(errors: DataFrame) -> DataFrame:
    """Language, frames and groups of each arriving document.  Columns only, so it runs in any output mode."""
    return analyze(errors)


def family_counts(errors: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """How often each error family occurs per window of event time (``ts``).

    State is one row per open window and family; the watermark closes windows and drops rows later than ``lateness``.
    Noise is told by the counts of a whole window, so the result is for append mode, which gives closed windows only.
    """
    late = errors.withWatermark("ts", lateness)
    grouped = unfold(late, error_groups(F.col("text"), noise=True), "ts").select("ts", "item.*")
    counts = counted_families(grouped, F.window("ts", window))
    return counts.select("window.start", "window.end", "signature", "occurrences", "documents")


def stream_history(
    occurrences: DataFrame,
    path: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    **trigger: object,
) -> StreamingQuery:
    """Fold each micro-batch of occurrences into the history at ``path``, one version per batch.

    A batch that is run again finds its version complete and is skipped, or incomplete and writes it anew: nothing is
    counted twice.  ``checkpoint`` must be on storage that outlives the driver.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        write_history(new_history(prepare(batch) if prepare else batch), path, f"{batch_id:010d}")

    return (
        occurrences.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_recall(
    occurrences: DataFrame,
    path: str,
    out: str,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    k: int = fixed.RECALL_K,
    threshold: float = fixed.RECALL_THRESHOLD,
    **trigger: object,
) -> StreamingQuery:
    """Each micro-batch of occurrences recalls what the batches before it recorded at ``path``, and is recorded then.

    Priors (doc_id, rank, sig_id, score, count, last_seen, cause, fixes) of a batch are written to a folder of its own below
    ``out``.  A batch that is run again looks at the versions before its own, as it did the first time, writes the same priors
    over the old ones and finds its version there: nothing changes.
    """

    def turn(batch: DataFrame, batch_id: int) -> None:
        version = f"{batch_id:010d}"
        rows = (prepare(batch) if prepare else batch).persist()
        try:
            priors = recall(rows, read_history(rows.sparkSession, path, before=version), k, threshold)
            priors.write.mode("overwrite").parquet(f"{out}/batch={version}")
            write_history(new_history(rows), path, version)
        finally:
            rows.unpersist()

    return (
        occurrences.writeStream.foreachBatch(turn)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
