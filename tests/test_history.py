import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stackloom.functions.text import rfc3339
from stackloom.operators import history
from stackloom.sources import history_store
from stackloom.streaming import jobs

OCCURRENCE = (
    "doc_id string, ts timestamp, signature string, representative string, language string, cause string, fixes string, "
    "model string, embedding array<double>"
)
T0 = dt.datetime(2026, 8, 1)


def occurrence(doc, sig, minutes, cause="c", vector=(1.0, 2.0)):
    return (doc, T0 + dt.timedelta(minutes=minutes), sig, "rep " + doc, "go", cause, "- fix", "m", list(vector))


def shown(df):
    rows = df.select("signature", "count", rfc3339(F.col("first_seen")), rfc3339(F.col("last_seen")), "cause", "last_doc_id").collect()
    return sorted(tuple(r) for r in rows)


def test_record_new_and_again(spark):
    first = spark.createDataFrame([occurrence("d1", "sig-A", 0, "old")], OCCURRENCE)
    stored = history.new_history(first)
    assert shown(stored) == [("sig-A", 1, "2026-08-01T00:00:00Z", "2026-08-01T00:00:00Z", "old", "d1")]
    more = spark.createDataFrame([occurrence("d2", "sig-A", 5, "new"), occurrence("d3", "sig-A", 3, "mid"), occurrence("d4", "sig-B", 1)], OCCURRENCE)
    assert shown(history.record(stored, more)) == [
        ("sig-A", 3, "2026-08-01T00:00:00Z", "2026-08-01T00:05:00Z", "new", "d2"),
        ("sig-B", 1, "2026-08-01T00:01:00Z", "2026-08-01T00:01:00Z", "c", "d4"),
    ]


def test_missing_count_and_first_seen(spark):
    payload = '{"signature":"sig-A","cause":"c0","first_seen":"soon","last_seen":"2026-07-01T00:00:00Z"}'
    sig = history.new_history(spark.createDataFrame([occurrence("d1", "sig-A", 0)], OCCURRENCE))
    stored = sig.select("sig_id", F.lit(payload).alias("payload"), "embedding")
    after = history.record(history.history_from_payloads(stored), spark.createDataFrame([occurrence("d1", "sig-A", 0)], OCCURRENCE))
    assert shown(after) == [("sig-A", 1, "2026-08-01T00:00:00Z", "2026-08-01T00:00:00Z", "c", "d1")]


def test_rejects(spark):
    rows = [occurrence("ok", "s", 0), occurrence("nosig", "", 0), occurrence("novec", "s", 0, vector=())]
    df = spark.createDataFrame(rows, OCCURRENCE)
    assert [r.doc_id for r in history.storable(df).collect()] == ["ok"]
    assert sorted(tuple(r) for r in history.rejected(df).collect()) == [
        ("nosig", "refusing to store an empty signature"), ("novec", "empty vector"),
    ]


def random_occurrences(n, seed=1):
    rng = random.Random(seed)
    # One family holds more than a third of the rows, many at the same time.
    return [occurrence(f"d{i:04d}", "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 30)}", rng.randint(0, 40)) for i in range(n)]


def test_occurrence_numbers_with_a_hot_family(spark):
    rows = random_occurrences(600)
    df = spark.createDataFrame(rows, OCCURRENCE).repartition(5)
    got = {r.doc_id: (r.occurrence, r.previous_ts) for r in history.occurrence_numbers(df).collect()}
    seen = {}
    for row in sorted(rows, key=lambda r: (r[1], r[0])):
        before = seen.setdefault(row[2], [])
        assert got[row[0]] == (len(before) + 1, before[-1] if before else None)
        before.append(row[1])
    gaps = {r.signature: (r.recurrences, r.min_gap_sec, r.max_gap_sec) for r in history.recurrence_gaps(df).collect()}
    for sig, times in seen.items():
        deltas = [(b - a).total_seconds() for a, b in zip(times, times[1:])]
        assert gaps.get(sig) == ((len(deltas), min(deltas), max(deltas)) if deltas else None)


def test_fold_in_any_order_and_over_versions(spark, tmp_path):
    df = spark.createDataFrame(random_occurrences(300), OCCURRENCE).withColumn("part", F.xxhash64("doc_id") % 3)
    once = shown(history.new_history(df))
    path = str(tmp_path / "history")
    for version, part in enumerate((2, 0, 1, -1, -2)):
        assert history_store.write_history(history.new_history(df.where(F.col("part") == part)), path, version)
    assert not history_store.write_history(history.new_history(df), path, 1)
    assert shown(history_store.read_history(spark, path)) == once
    # A version that broke off does not count.
    (tmp_path / "history" / "version=9").mkdir()
    history.new_history(df).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path + "/version=9")
    assert shown(history_store.read_history(spark, path)) == once
    compact = str(tmp_path / "compact")
    history_store.write_history(history_store.read_history(spark, path), compact, 0)
    assert shown(history_store.read_history(spark, compact)) == once
    assert history_store.read_history(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_batches_gives_the_batch_answer(spark, tmp_path):
    df = spark.createDataFrame(random_occurrences(200), OCCURRENCE)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "history")
    jobs.stream_history(stream, path, str(tmp_path / "cp")).awaitTermination()
    assert len(list((tmp_path / "history").glob("version=*"))) == 4
    assert shown(history_store.read_history(spark, path)) == shown(history.new_history(df))
    # Run again with nothing new.
    jobs.stream_history(stream, path, str(tmp_path / "cp")).awaitTermination()
    assert shown(history_store.read_history(spark, path)) == shown(history.new_history(df))


def test_family_counts_drop_late_rows(spark, tmp_path):
    def write(name, rows):
        df = spark.createDataFrame([(d, t, T0 + dt.timedelta(minutes=m)) for d, t, m in rows], "doc_id string, text string, ts timestamp")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        return df.schema

    schema = write("1", [("a", "ERROR disk full\nERROR disk full", 5), ("b", "ERROR disk full", 50)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))

    def run():
        query = (
            jobs.family_counts(stream, "1 hour", "10 minutes").writeStream.outputMode("append").format("parquet")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination()

    run()
    write("2", [("c", "ERROR disk full", 200)])
    run()
    write("3", [("late", "ERROR disk full", 10), ("d", "ERROR disk full", 400)])
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert [(r.signature, r.occurrences, r.documents) for r in rows] == [("ERROR disk full", 3, 2), ("ERROR disk full", 1, 1)]


def test_stream_analysis_and_text_files(spark, tmp_path):
    from stackloom.sources.ingest import read_error_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text('Traceback (most recent call last):\n  File "app.py", line 42, in run\n')
    stream = jobs.analyze_stream(read_error_stream(spark, str(tmp_path / "in")))
    query = (
        stream.select("origin", "language", F.size("stack_frames").alias("n")).writeStream.format("memory").queryName("analysed")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("analysed").collect()] == [("stdin", "python", 1)]


def test_a_second_dimension_fails(spark):
    stored = history.new_history(spark.createDataFrame([occurrence("d1", "sig-A", 0)], OCCURRENCE))
    other = spark.createDataFrame([occurrence("d2", "sig-A", 5, vector=(1.0, 2.0, 3.0))], OCCURRENCE)
    with pytest.raises(Exception, match="vector has size 3, want 2"):
        history.record(stored, other).collect()
    with pytest.raises(Exception, match="vector has size 3, want 4"):
        history.new_history(other, dim=4).collect()


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "h")
    assert history_store.compact_history(spark, path) is None
    for n in range(3):
        history_store.write_history(history.new_history(spark.createDataFrame([occurrence(f"d{n}", "sig-A", n)], OCCURRENCE)), path, f"{n:03d}")
    before = shown(history_store.read_history(spark, path))
    assert history_store.compact_history(spark, path) == "upto=002"
    assert shown(history_store.read_history(spark, path)) == before
    late = history.new_history(spark.createDataFrame([occurrence("d9", "sig-A", 9)], OCCURRENCE))
    assert not history_store.write_history(late, path, "001") and history_store.write_history(late, path, "003")
    assert [r[1] for r in shown(history_store.read_history(spark, path))] == [4]
