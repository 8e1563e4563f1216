import random

import pytest
from pyspark.sql import functions as F

from stackloom.operators import history
from stackloom.streaming.numbering import keyed_state, number_occurrences

SCHEMA = "doc_id string, t double, signature string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("t").cast("timestamp")).drop("t")


def made(n=240, seed=1):
    rng = random.Random(seed)
    return [(f"d{i:03d}", 1000 + i // 3 + rng.choice([0.0, 0.0005, 0.0007]), "hot" if rng.random() < 0.4 else f"family {rng.randrange(9)}") for i in range(n)]


def run(spark, folder, out, lateness):
    schema = "doc_id string, signature string, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    with keyed_state(spark):
        query = (
            number_occurrences(stream, lateness).writeStream.format("parquet").option("path", f"{out}/rows")
            .option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        )
    query.awaitTermination()


def shown(df):
    return sorted((r.signature, r.occurrence, r.doc_id, str(r.ts), str(r.previous_ts)) for r in df.where("doc_id <> 'end'").collect())


@pytest.mark.parametrize("lateness", ["0 seconds", "20 seconds"])
def test_equals_the_batch_answer_also_after_a_restart(spark, tmp_path, lateness):
    rows = made()
    if lateness != "0 seconds":  # in any order within the lateness
        rows.sort(key=lambda r: r[1] + random.Random(r[0]).random() * 15)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")

    def write(part):
        frame(spark, part).coalesce(1).select("doc_id", "signature", "ts").write.mode("append").parquet(folder)

    write(rows[:60])
    write(rows[60:120])
    run(spark, folder, out, lateness)
    first = shown(spark.read.parquet(f"{out}/rows"))
    write(rows[120:200])
    write(rows[200:])
    write([("end", 1e6, "end")])
    run(spark, folder, out, lateness)
    run(spark, folder, out, lateness)
    want = shown(history.occurrence_numbers(frame(spark, rows)))
    got = shown(spark.read.parquet(f"{out}/rows"))
    assert got == want
    # what came out before the restart was part of it
    assert first and set(first) <= set(want)


def test_calls_to_the_state_do_not_grow_with_the_rows():
    """A thousand rows of a family that arrive and pass together are a handful of calls, whatever their times."""
    from datetime import datetime, timedelta, timezone
    from types import SimpleNamespace

    from pyspark.sql import Row

    from stackloom.streaming.numbering import NumberInOrder

    calls, timers, kept, seen = [], set(), [], []

    def call(name, do, value=None):
        calls.append(name)
        return do(value) if value is not None else do()

    def reset(rows=()):
        kept[:] = list(rows)

    listed = SimpleNamespace(
        appendList=lambda rows: call("append", kept.extend, rows), get=lambda: call("get", lambda: iter(list(kept))),
        put=lambda rows: call("put", reset, rows), clear=lambda: call("clear", reset),
    )
    valued = SimpleNamespace(exists=lambda: bool(seen), get=lambda: seen[-1], update=lambda v: call("update", seen.append, v))
    handle = SimpleNamespace(getValueState=lambda *_: valued, getListState=lambda *_: listed, registerTimer=lambda at: call("timer", timers.add, at))
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [Row(at=n, ts=start + timedelta(milliseconds=n), doc_id=f"d{n}") for n in reversed(range(1000))]
    processor = NumberInOrder()
    processor.init(handle)
    list(processor.handleInputRows(("f",), iter(rows), None))
    at = SimpleNamespace(getExpiryTimeInMs=lambda: min(timers))
    out = list(processor.handleExpiredTimer(("f",), SimpleNamespace(getCurrentWatermarkInMs=lambda: 900), at))
    assert [(r.doc_id, r.occurrence) for r in out] == [(f"d{n}", n + 1) for n in range(900)]
    assert len(kept) == 100 and 900 in timers and len(calls) <= 8


def test_families_of_a_bucket_share_calls_to_the_state():
    """A thousand families of a few rows cost as many calls as one; numbers go on from batch to batch, null is a family."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from stackloom.streaming.numbering import NumberBuckets

    calls, timers, kept, seen, out = [], set(), [], [], []

    def call(do, *value):
        calls.append(do)
        return do(*value)

    listed = SimpleNamespace(
        appendList=lambda rows: call(kept.extend, rows), get=lambda: call(iter, list(kept)),
        put=lambda rows: call(lambda: kept.__setitem__(slice(None), rows)), clear=lambda: call(kept.clear),
    )
    valued = SimpleNamespace(exists=lambda: bool(seen), get=lambda: seen[-1], update=lambda v: call(seen.append, v))
    handle = SimpleNamespace(getValueState=lambda *_: valued, getListState=lambda *_: listed, registerTimer=lambda at: call(timers.add, at))
    processor = NumberBuckets()
    processor.init(handle)
    rng = random.Random(3)
    rows = [(rng.choice([None, *(f"family {n}" for n in range(1000))]), rng.randrange(2000) * 500, rng.choice([None, "é", *(f"d{n}" for n in range(50))])) for _ in range(4000)]
    for low, high, mark in ((0, 500_000, 400), (500_000, 1_000_000, 3000)):
        part = [Row(signature=s, micros=t, doc_id=d) for s, t, d in rows if low <= t < high]
        list(processor.handleInputRows((7,), iter(part), None))
        at = SimpleNamespace(getExpiryTimeInMs=lambda: min(timers))
        for _ in range(2):  # a second timer finds nothing to do
            out += processor.handleExpiredTimer((7,), SimpleNamespace(getCurrentWatermarkInMs=lambda mark=mark: mark), at)
    want, last = [], {}
    for s, t, d in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2] is not None, r[2] or "")):
        number, before = last.get(s, (0, None))
        want.append((s, number + 1, d, t, before))
        last[s] = (number + 1, t)
    assert sorted(map(str, ((r.signature, r.occurrence, r.doc_id, r.micros, r.previous) for r in out))) == sorted(map(str, want))
    assert not kept and len(calls) <= 20


def test_a_family_on_its_own_gives_the_same(spark, tmp_path):
    rows = made(60)
    frame(spark, [*rows, ("end", 1e6, "end")]).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = []
    for buckets in (None, 3):
        stream = spark.readStream.schema("doc_id string, signature string, ts timestamp").parquet(str(tmp_path / "in"))
        out = str(tmp_path / str(buckets))
        with keyed_state(spark):
            number_occurrences(stream, buckets=buckets).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
        found.append(shown(spark.read.parquet(f"{out}/rows")))
    assert found[0] == found[1] == shown(history.occurrence_numbers(frame(spark, rows)))
