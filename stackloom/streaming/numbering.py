"""Occurrence numbers on a stream (F10): keyed state, and timers that put rows in order of time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_KEYED = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUTPUT = "doc_id string, ts timestamp, signature string, occurrence bigint, previous_ts timestamp"
_NUMBERED = "doc_id string, micros bigint, signature string, occurrence bigint, previous bigint"
#: Families are kept together in so many buckets; a query that is started again needs the same number.
BUCKETS = 1 << 12
#: Rows of a piece of state.
PIECE_ROWS = 100_000
_ROWS = pa.schema([("signature", pa.string()), ("micros", pa.int64()), ("doc_id", pa.string())])
_SEEN = pa.schema([("signature", pa.string()), ("number", pa.int64()), ("last", pa.int64())])


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in the store that timers need; state may exceed memory there."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _KEYED)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class NumberInOrder(StatefulProcessor):
    """Rows of a family wait until the watermark has passed their time, so that they are numbered in order.

    State of a family is how often it was seen and when last, and the rows that wait, as one list: a batch adds its rows at
    once, and a timer at the earliest of them takes out all that the watermark has passed.  So calls to the state are a few a
    family and batch, not a few a row.  A row that is late by more than the watermark allows is dropped by Spark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "number bigint, last timestamp")
        self._waiting = handle.getListState("waiting", "at bigint, ts timestamp, doc_id string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        arrived = [(row["at"], row["ts"], row["doc_id"]) for row in rows]
        if arrived:
            self._waiting.appendList(arrived)
            self._handle.registerTimer(min(row[0] for row in arrived))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        ready, later = [], []
        for row in self._waiting.get():
            (ready if row[0] <= passed else later).append(tuple(row))
        if not ready:  # an earlier timer took them
            return
        number, last = self._seen.get() if self._seen.exists() else (0, None)
        for _, ts, doc_id in sorted(ready, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
            number += 1
            yield Row(doc_id=doc_id, ts=ts, signature=key[0], occurrence=number, previous_ts=last)
            last = ts
        self._seen.update((number, last))
        if later:
            self._waiting.put(later)
            self._handle.registerTimer(min(row[0] for row in later))
        else:
            self._waiting.clear()

    def close(self) -> None:
        pass


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _pieces(table: pa.Table) -> list[tuple[bytes]]:
    return [(_packed(table.slice(start, PIECE_ROWS)),) for start in range(0, table.num_rows, PIECE_ROWS)]


def number_rows(rows: pa.Table, seen: dict[str | None, tuple[int, int]]) -> pa.Table:
    """Rows (signature, micros, doc_id) in order, numbered after what ``seen`` has of their families, which goes on with them."""
    order = [("signature", "ascending"), ("micros", "ascending"), ("doc_id", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_start")).combine_chunks()
    micros, count = rows["micros"].to_numpy(), rows.num_rows
    families = pc.dictionary_encode(rows["signature"], null_encoding="encode").combine_chunks().indices.to_numpy()
    starts = np.flatnonzero(np.diff(families, prepend=-1))
    ends = np.append(starts[1:], count)
    names = rows["signature"].take(pa.array(starts)).to_pylist()
    before = [seen.get(name, (0, None)) for name in names]
    numbers = np.arange(1, count + 1) + np.repeat(np.array([n for n, _ in before], np.int64) - starts, ends - starts)
    previous, first = np.roll(micros, 1), np.zeros(count, bool)
    previous[starts] = [0 if last is None else last for _, last in before]
    first[starts] = [last is None for _, last in before]
    seen.update((name, (int(numbers[end - 1]), int(micros[end - 1]))) for name, end in zip(names, ends, strict=True))
    return rows.append_column("occurrence", pa.array(numbers)).append_column("previous", pa.array(previous, mask=first))


class NumberBuckets(StatefulProcessor):
    """What ``NumberInOrder`` does for one family, for the families of a bucket together.

    Most families may be of a row or two, so that calls to the state, which cost far more than a row does, are a few a bucket and
    batch.  Rows that wait are pieces of a table, and so is what was seen of the bucket's families, which is written anew when one
    of them goes on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._seen = handle.getValueState("seen", "families binary")
        self._waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        arrived = [(row["signature"], row["micros"], row["doc_id"]) for row in rows]
        if arrived:
            self._waiting.appendList(_pieces(pa.table([pa.array(column, kind) for column, kind in zip(zip(*arrived, strict=True), _ROWS.types, strict=True)], schema=_ROWS)))
            self._handle.registerTimer(min(row[1] for row in arrived) // 1000)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        pieces = [_unpacked(piece) for (piece,) in self._waiting.get()]
        if not pieces:  # an earlier timer took them
            return
        rows = pa.concat_tables(pieces)
        taken = pc.less(rows["micros"], (passed + 1) * 1000)
        ready, later = rows.filter(taken), rows.filter(pc.invert(taken))
        if not ready.num_rows:
            return
        seen = {}
        if self._seen.exists():
            table = _unpacked(self._seen.get()[0])
            seen = dict(zip(table["signature"].to_pylist(), zip(table["number"].to_pylist(), table["last"].to_pylist(), strict=True), strict=True))
        numbered = number_rows(ready, seen)
        counts, lasts = zip(*seen.values(), strict=True)
        self._seen.update((_packed(pa.table([list(seen), counts, lasts], schema=_SEEN)),))
        if later.num_rows:
            self._waiting.put(_pieces(later))
            self._handle.registerTimer(pc.min(later["micros"]).as_py() // 1000)
        else:
            self._waiting.clear()
        names = [field.split(" ")[0] for field in _NUMBERED.split(", ")]
        row = Row(*names)
        for batch in numbered.select(names).to_batches(max_chunksize=PIECE_ROWS):
            yield from (row(*values) for values in zip(*(column.to_pylist() for column in batch.columns), strict=True))

    def close(self) -> None:
        pass


def number_occurrences(occurrences: DataFrame, lateness: str = "0 seconds", buckets: int | None = BUCKETS) -> DataFrame:
    """``history.occurrence_numbers`` of a stream: doc_id, ts, signature, occurrence, previous_ts.

    A row comes out once the watermark, the latest time seen less ``lateness``, has passed its own time, so numbers are those
    of the order (ts, doc_id) in whatever order rows arrive within ``lateness``.  The latest rows wait for later ones; with no
    lateness, rows of one millisecond have to arrive in one batch.  State is what was seen of each family and the rows that wait,
    in ``buckets`` of families, or with None a family on its own.  A family is one task's work, as its numbers follow from each
    other; batches split it (``history.occurrence_numbers``).  Null signatures are a family of their own.  For append mode,
    started within ``keyed_state``.
    """
    time = F.col("ts").cast("timestamp")
    rows = occurrences.select("signature", time.alias("ts"), F.col("doc_id").cast("string").alias("doc_id"), F.unix_millis(time).alias("at"))
    if buckets is None:
        return rows.withWatermark("ts", lateness).groupBy("signature").transformWithState(
            statefulProcessor=NumberInOrder(), outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime"
        )
    # times go as numbers: those of a session's time zone need not tell an hour from the next
    told = rows.select("signature", "ts", "doc_id", F.unix_micros("ts").alias("micros"), F.pmod(F.xxhash64("signature"), F.lit(buckets)).alias("bucket"))
    numbered = told.withWatermark("ts", lateness).groupBy("bucket").transformWithState(
        statefulProcessor=NumberBuckets(), outputStructType=_NUMBERED, outputMode="Append", timeMode="EventTime"
    )
    return numbered.select(
        "doc_id", F.timestamp_micros("micros").alias("ts"), "signature", "occurrence", F.timestamp_micros("previous").alias("previous_ts")
    )
