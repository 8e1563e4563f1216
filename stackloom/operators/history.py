"""History of error families: fold, occurrence numbers, payload rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.functions.text import payload as parsed_payload
from stackloom.functions.text import payload_int, payload_text, payload_time, sig_id
from stackloom.operators.rows import once
from stackloom.operators.similarity import check_dimension
from stackloom.session import materialize

HISTORY_SCHEMA = (
    "sig_id decimal(20,0), signature string, representative string, language string, cause string, fixes string, "
    "model string, count bigint, first_seen timestamp, last_seen timestamp, last_doc_id string, embedding array<double>"
)
HISTORY_COLUMNS = [field.split(" ")[0] for field in HISTORY_SCHEMA.split(", ")]
LATEST = ["representative", "language", "cause", "fixes", "model", "embedding"]


def _fold(df: DataFrame, key: str, latest: list[str]) -> DataFrame:
    """One row per key: counts add up, times widen, the rest is taken from the latest row.

    (last_seen, last_doc_id) orders rows totally, so the fold is associative and commutative: it combines on the map
    side, over batches and in any order.
    """
    return (
        df.groupBy(key)
        .agg(
            F.sum(F.coalesce("count", F.lit(0).cast("bigint"))).alias("count"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.max_by(
                F.struct("last_doc_id", *latest), F.struct("last_seen", F.coalesce("last_doc_id", F.lit("")))
            ).alias("latest"),
        )
        .select(key, "count", "first_seen", "last_seen", "latest.*")
    )


def storable(occurrences: DataFrame) -> DataFrame:
    """Occurrences that have a signature and a vector."""
    return occurrences.where((F.col("signature") != "") & (F.size("embedding") > 0))


def rejected(occurrences: DataFrame) -> DataFrame:
    """The other occurrences, with the reason."""
    no_signature = F.coalesce(F.col("signature"), F.lit("")) == ""
    no_vector = F.col("embedding").isNull() | (F.size("embedding") <= 0)
    return occurrences.where(no_signature | no_vector).select(
        "doc_id",
        F.when(no_signature, "refusing to store an empty signature").otherwise("empty vector").alias("reason"),
    )


def fold_history(df: DataFrame) -> DataFrame:
    """History rows of several versions as one row per family."""
    return _fold(df, "sig_id", ["signature", *LATEST]).select(*HISTORY_COLUMNS)


def new_history(occurrences: DataFrame, dim: int | None = None) -> DataFrame:
    """Occurrences (doc_id, ts, signature, representative, language, cause, fixes, model, embedding) as history rows.

    Grouping is by the signature itself; the id is hashed afterwards, once per family instead of once per row.  With
    ``dim`` a vector of another dimension fails the job (A8).
    """
    kept = storable(occurrences)
    fields = F.struct(
        "signature",
        F.lit(1).cast("bigint").alias("count"),
        F.col("ts").alias("first_seen"),
        F.col("ts").alias("last_seen"),
        F.col("doc_id").cast("string").alias("last_doc_id"),
        *LATEST[:-1],
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    # a boundary: else Spark sorts what the columns are computed from, whole texts, and computes them in the aggregation
    rows = (kept if dim is None else check_dimension(kept, dim)).select(once(fields).alias("row")).select("row.*")
    return _fold(rows, "signature", LATEST).withColumn("sig_id", sig_id(F.col("signature"))).select(*HISTORY_COLUMNS)


def record(history: DataFrame, occurrences: DataFrame, dim: int | None = None) -> DataFrame:
    """The history after these occurrences: counts bumped, first_seen kept, the rest from the latest one.

    All vectors must have one dimension: ``dim``, or else that of the stored history, one row of which is looked at, which
    computes a history that is not a table.
    """
    stored = history.select(*HISTORY_COLUMNS)
    if dim is None:
        first = stored.where(F.size("embedding") > 0).select(F.size("embedding").alias("dim")).first()
        dim = None if first is None else first["dim"]
    if dim is not None:
        stored = check_dimension(stored, dim)
    return fold_history(stored.unionByName(new_history(occurrences, dim)))


def history_from_payloads(df: DataFrame) -> DataFrame:
    """Stored points (sig_id, payload JSON, embedding) as history rows; what cannot be read counts as missing."""
    df = df.withColumn("payload", parsed_payload(F.col("payload")))
    payload = F.col("payload")
    texts = [payload_text(payload, name).alias(name) for name in ("signature", *LATEST[:-1])]
    times = [payload_time(payload, name).alias(name) for name in ("first_seen", "last_seen")]
    return df.select(
        F.col("sig_id").cast("decimal(20,0)").alias("sig_id"),
        *texts,
        payload_int(payload, "count").alias("count"),
        *times,
        F.lit(None).cast("string").alias("last_doc_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).select(*HISTORY_COLUMNS)


def occurrence_numbers(occurrences: DataFrame) -> DataFrame:
    """for each (doc_id, ts, signature) its number within the family, the time before and the (time, id) after.

    A window over a family would put a hot one into a single task.  Instead rows are range partitioned by
    (signature, ts, doc_id), which splits a family over as many tasks as it needs; each slice is numbered on its own
    and shifted by the sizes of the family's earlier slices, a table of one row per family and slice.  The rows are
    computed and written once, as partitioning by range looks at its input twice; the second table pins the slices, so
    numbering and sizes agree even when a task is run again.
    """
    order = ["ts", "doc_id"]
    narrow = materialize(occurrences.select("signature", *order))
    sliced = materialize(narrow.repartitionByRange("signature", *order).withColumn("slice", F.spark_partition_id()))
    slices = Window.partitionBy("signature").orderBy("slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        sliced.groupBy("signature", "slice")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(F.struct(*order)).alias("first_row"),
            F.max("ts").alias("last_ts"),
        )
        .select(
            "signature",
            "slice",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("shift"),
            F.lag("last_ts").over(slices).alias("ts_before"),
            F.lead("first_row").over(slices).alias("row_after"),
        )
    )
    within = Window.partitionBy("signature", "slice").orderBy(*order)
    numbered = sliced.select(
        "*",
        F.row_number().over(within).alias("number"),
        F.lag("ts").over(within).alias("lag_ts"),
        F.lead(F.struct(*order)).over(within).alias("lead_row"),
    )
    return numbered.join(sizes, ["signature", "slice"]).select(
        "doc_id",
        "ts",
        "signature",
        (F.col("shift") + F.col("number")).alias("occurrence"),
        F.coalesce("lag_ts", "ts_before").alias("previous_ts"),
        F.coalesce("lead_row", "row_after").alias("next"),
    ).select("doc_id", "ts", "signature", "occurrence", "previous_ts", F.col("next.ts").alias("next_ts"), F.col("next.doc_id").alias("next_doc_id"))


def history_versions(occurrences: DataFrame) -> DataFrame:
    """What the history said about each family after each of its occurrences, until the next one.

    Recalling against these rows with ``as_of`` gives every text the answer it would have had in its turn, counts and
    causes included, although all texts are processed at once.  Turns go by (time, id), so texts of one time have an
    order as well.  Ids are hashed once per family.
    """
    kept = storable(occurrences)
    numbered = occurrence_numbers(kept).select("doc_id", "occurrence", "next_ts", "next_doc_id")
    ids = kept.select("signature").distinct().withColumn("sig_id", sig_id(F.col("signature")))
    return kept.join(numbered, "doc_id").join(ids, "signature").select(
        "sig_id",
        "signature",
        F.col("doc_id").cast("string").alias("since_id"),
        F.col("next_doc_id").cast("string").alias("until_id"),
        F.col("occurrence").cast("bigint").alias("version"),
        F.col("occurrence").cast("bigint").alias("count"),
        F.col("ts").alias("first_seen"),
        F.col("next_ts").alias("valid_until"),
        F.col("ts").alias("last_seen"),
        "cause",
        "fixes",
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def recurrence_gaps(occurrences: DataFrame) -> DataFrame:
    """how often each family came back and the shortest and longest gap in seconds."""
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))) / 1000000
    return (
        occurrence_numbers(occurrences)
        .where(F.col("previous_ts").isNotNull())
        .groupBy("signature")
        .agg(
            F.count(F.lit(1)).alias("recurrences"),
            F.min(gap).alias("min_gap_sec"),
            F.max(gap).alias("max_gap_sec"),
        )
    )
