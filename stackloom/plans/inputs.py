"""Error texts, traces, replies, source files and vectors derived from the given tables.

The tables hold no traces, so these views spell them from ``events`` and ``documents`` with plain string functions;
``oracle`` spells the same texts in SQL.  Every row of the tables is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.operators.rows import once
from stackloom.sources.ingest import spread, task_count

LOG_EVENTS = 40
EXTENSIONS = ("go", "py", "java", "js", "rb", "rs", "cs")


KEYS = {"events": ["event_id"], "documents": ["doc_id"], "conversations": ["conv_id", "turn"], "embeddings": ["vec_id"]}
#: Rows of a task, fewer of the longer texts.
TASK_ROWS = {"documents": 2_000}


def table(spark: SparkSession, sf_dir: str, name: str, rows_per_task: int | None = None) -> DataFrame:
    rows = rows_per_task or TASK_ROWS.get(name, 20_000)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *KEYS[name], rows_per_task=rows)


def _text(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _choice(number: Column, options: list[Column]) -> Column:
    result = options[-1]
    for place in reversed(range(len(options) - 1)):
        result = F.when(number == place, options[place]).otherwise(result)
    return result


def _hex(number: Column) -> Column:
    return F.lower(F.hex(number))


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log entry per event: event_id, ts, line."""
    n = F.col("event_id")
    message = _choice(
        n % 5,
        [
            _text("connection ", n % 97, " refused pid=", n),
            _text("bad pointer 0x", _hex(n), " in unit ", n % 89),
            _text("worker [", n, "] died at job.py:", n % 90),
            _text("goroutine ", n, " stuck"),
            _text(F.col("event_type"), " failed at step ", n % 83),
        ],
    )
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("WARN")
    # now and then a short error of its own, which is noise in a log but not over all logs
    gap = F.when(n % 35 == 0, "\n\nERR 1\n").when(n % 7 == 0, "\n").otherwise("")
    line = _text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " ", level, " ", message, gap)
    return table(spark, sf_dir, "events").select("event_id", "ts", line.alias("line"))


def log_folder(spark: SparkSession, sf_dir: str, folder: str, events: int = 4000, turn: int | None = None, turns: int = 1) -> None:
    """Writes the entries as log files of so many events, each in a folder of its own; all, or those of one of several turns."""
    entries = log_entries(spark, sf_dir).withColumn("log", F.floor(F.col("event_id") / events))
    if turn is not None:
        entries = entries.where(F.col("log") % turns == turn)
    rows = entries.repartition("log").sortWithinPartitions("log", "event_id")
    rows.select("log", "line").write.mode("append").partitionBy("log").text(folder)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log per 40 consecutive events, so no log grows with the data."""
    tasks = task_count(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return (
        log_entries(spark, sf_dir)
        .withColumn("log", F.floor(F.col("event_id") / LOG_EVENTS))
        .repartition(tasks, "log")  # a number of its own, else Spark merges them into few tasks
        .groupBy("log")
        .agg(F.max(F.col("ts").cast("timestamp")).alias("ts"), F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("lines"))
        .select(
            _text("log-", F.col("log")).alias("doc_id"),
            F.array_join(F.col("lines.line"), "\n").alias("text"),
            F.lit("stdin").alias("origin"),
            "ts",
        )
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per event, in one of eight languages."""
    return traces_of(table(spark, sf_dir, "events"))


def traces_of(events: DataFrame) -> DataFrame:
    """``traces`` of a table or stream of events."""
    n = F.col("event_id")
    kind = n % 8
    file = 7 * (n % 28) + kind
    other = file + 14
    line, line2 = 1 + n % 40, 3 + n % 17
    fn, fn2 = _text("f", n % 10), _text("f", (n + 3) % 10)
    # longer than what tools commonly look at: 30 frames; and a text of 6 KB whose only word comes last
    calls = F.transform(
        F.sequence(F.lit(0), F.lit(29)),
        lambda i: _text('  File "src/doc_', 7 * ((n + i) % 28) + 1, '.py", line ', 1 + (n + i) % 40, ", in f", (n + i) % 10),
    )
    deep = _text("Traceback (most recent call last):\n", F.array_join(calls, "\n"), "\nKeyError: ", n)
    late = F.lit("2024-01-01 00:00:00\n" * 300 + "\n\nE1")
    text = _choice(
        kind,
        [
            _text(
                "panic: runtime error: index out of range [", n % 9, "]\n\ngoroutine ", n, " [running]:\nmain.", fn, "(0x",
                _hex(n), ")\n\t/workspace/src/doc_", file, ".go:", line, " +0x3a\nmain.", fn2, "()\n\t/workspace/src/doc_",
                other, ".go:", line2, " +0x12\n",
            ),
            F.when(n % 40 == 1, deep).otherwise(_text(
                'Traceback (most recent call last):\n  File "src/doc_', file, '.py", line ', line, ", in ", fn,
                "\n    x[", n % 6, "]\nIndexError: list index out of range",
            )),
            _text(
                'Exception in thread "main" java.lang.NullPointerException\n\tat com.acme.Bar.', fn, "(doc_", file, ".java:",
                line, ")\n\tat java.base/java.lang.Thread.run(Thread.java:840)\nCaused by: java.io.IOException: pid=", n,
            ),
            _text(
                "TypeError: Cannot read properties of null\n    at Object.", fn, " (/home/ci/proj/src/doc_", file, ".js:", line,
                ":15)\n    at /home/ci/proj/src/doc_", file, ".js:", line2,
                ":3\n    at Module._compile (node:internal/modules/cjs/loader:1101:14)",
            ),
            _text(
                "./src/doc_", file, ".rb:", line, ":in '", fn, "'\nsrc/doc_", file, ".rb:", line2,
                ":in 'run': undefined method (NoMethodError)",
            ),
            _text(
                "thread 'main' panicked at src/doc_", file, ".rs:", line,
                ":7:\nindex out of bounds\nstack backtrace:\n   0: rust_begin_unwind\n"
                "             at /rustc/abc/library/std/src/panicking.rs:645:5",
            ),
            _text(
                "Unhandled exception. System.NullReferenceException: Object reference not set\n   at Acme.Program.", fn,
                "() in /app/src/doc_", file, ".cs:line ", line, "\n   at Acme.Program.Main() in /app/src/doc_", other,
                ".cs:line ", line2,
            ),
            F.when(n % 56 == 7, late).otherwise(_text(
                F.col("event_type"), " failed near lib/part_", n % 25, ".txt:", line, " after helper.c:", line2, ", code ", n,
            )),
        ],
    )
    return events.select(
        _text("trace-", n).alias("doc_id"),
        once(text).alias("text"),
        F.lit("inline").alias("origin"),
        F.col("ts").cast("timestamp").alias("ts"),
        _text("r", file % 2).alias("repo"),
        n.alias("event_id"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves, as error texts."""
    return table(spark, sf_dir, "documents").select(
        _text("doc-", F.col("doc_id")).alias("doc_id"),
        "text",
        _text("logs/", F.col("source"), ".log").alias("origin"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ts"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the above: doc_id, text, origin, ts."""
    cols = ["doc_id", "text", "origin", "ts"]
    parts = [view(spark, sf_dir).select(*cols) for view in (logs, traces, texts)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per event; some repeat a section, some have no markers."""
    n = F.col("event_id")
    cause = _text("PROBABLE CAUSE:\ncause ", n % 10, "\n\n")
    full = _text(
        "Sure.\nWHAT HAPPENED:\nevent ", n, " failed\n\n", cause, "## Evidence:\nline ", n % 40, "\n\n- INVESTIGATE\ncheck ",
        F.col("event_type"), "\n\n", F.when(n % 11 == 0, _text("PROBABLE CAUSE:\nsecond cause ", n % 4, "\n\n")).otherwise(""),
        "**Potential fixes:\n- fix ", n % 3, "\n- retry\n",
    )
    content = F.when(n % 13 == 0, _text("no idea about ", n, "\nEVIDENCE: none")).otherwise(full)
    return table(spark, sf_dir, "events").select(
        _text("trace-", n).alias("doc_id"), once(content).alias("content"), F.lit("m1").alias("model")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as replies."""
    return table(spark, sf_dir, "conversations").select(
        _text("turn-", F.col("conv_id"), "-", F.col("turn")).alias("doc_id"), F.col("text").alias("content"), F.lit("m0").alias("model")
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per document: its text inside definitions of the language of its extension.

    Every 500th file repeats its text to over 2 MiB.
    """
    n, text = F.col("doc_id"), F.col("text")
    times = F.floor(F.lit(2_200_000) / (F.octet_length(text) + 1)).cast("int") + 1
    text = F.when(n % 500 == 0, F.repeat(F.concat(text, F.lit("\n")), times)).otherwise(text)
    kind = n % 7
    fn, fn2 = _text("f", n % 10), _text("f", (n + 1) % 10)
    content = _choice(
        kind,
        [
            _text("package p\n\nfunc ", fn, "(x int) {\n", text, "\n}\n\nfunc (s *Server) ", fn2, "() {\n}\n"),
            _text("import os\n\ndef ", fn, "(x):\n", text, "\n\n    def ", fn2, "(y):\n"),
            _text("public class Doc {\npublic static int ", fn, " (int x) {\n", text, "\n}\nvoid ", fn2, "() {}\n}\n"),
            _text("function ", fn, "(x) {\n", text, "\n}\nconst my", fn2, " = (y) => y;\n"),
            _text("def ", fn, "(x)\n", text, "\nend\n"),
            _text("fn ", fn, "(x: i32) {\n", text, "\n}\npub fn ", fn2, "() {}\n"),
            _text("class Doc {\npublic void ", fn, "() {\n", text, "\n}\n}\n"),
        ],
    )
    extension = _choice(kind, [F.lit(e) for e in EXTENSIONS])
    # the files are read several times, and moving them each time takes more room than they do: no more than all cores need
    return table(spark, sf_dir, "documents", rows_per_task=1 << 30).select(
        _text("r", n % 2).alias("repo"),
        _text("src/doc_", n, ".", extension).alias("path"),
        once(content).alias("content"),
    ).withColumn("size", F.octet_length("content").cast("bigint"))


def vectors(spark: SparkSession, sf_dir: str, at_once: int = 1) -> DataFrame:
    """The embeddings as queries: doc_id, embedding, ts; ``at_once`` of them have one time."""
    n = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        _text("trace-", n).alias("doc_id"), "embedding", F.timestamp_seconds(F.lit(1704067200) + F.floor(n / at_once) * 60).alias("ts")
    )


def perturbed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of the embeddings as queries."""
    n = F.col("vec_id")
    moved = F.transform("embedding", lambda x, i: x.cast("double") + ((n + i) % 5 - 2) * 0.02)
    return table(spark, sf_dir, "embeddings").select(_text("near-", n).alias("doc_id"), moved.alias("embedding"))


def vector_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as history rows."""
    n = F.col("vec_id")
    seen = F.timestamp_seconds(F.lit(1704067200) + n * 60)
    return table(spark, sf_dir, "embeddings").select(
        n.cast("decimal(20,0)").alias("sig_id"),
        _text("family ", n).alias("signature"),
        _text("cause ", n % 10).alias("cause"),
        F.when(n % 4 == 0, "").otherwise(_text("- fix ", n % 3)).alias("fixes"),
        (1 + n % 5).alias("count"),
        seen.alias("first_seen"),
        (seen + F.expr("INTERVAL 1 DAY")).alias("last_seen"),
        "embedding",
    )


def vector_occurrences(spark: SparkSession, sf_dir: str, at_once: int = 1) -> DataFrame:
    """The embeddings as occurrences, those of one label forming a family; ``at_once`` of them have one time."""
    return vector_occurrences_of(table(spark, sf_dir, "embeddings"), at_once)


def vector_occurrences_of(embeddings: DataFrame, at_once: int = 1) -> DataFrame:
    """``vector_occurrences`` of a table or stream of embeddings."""
    n = F.col("vec_id")
    return embeddings.select(
        _text("trace-", n).alias("doc_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.floor(n / at_once) * 60).alias("ts"),
        _text("family ", F.col("label")).alias("signature"),
        _text("cause ", n % 10).alias("cause"),
        F.when(n % 4 == 0, "").otherwise(_text("- fix ", n % 3)).alias("fixes"),
        "embedding",
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stored point per event, some with fields of the wrong kind."""
    n = F.col("event_id")
    count = F.when(n % 6 == 0, _text('"', n, '"')).when(n % 6 == 1, F.lit("null")).otherwise((n % 50).cast("string"))
    first = F.when(n % 9 == 0, F.lit('"soon"')).otherwise(
        _text('"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"')
    )
    payload = _text(
        '{"meta":{"count":"5","cause":7,"model":{}},"signature":"family ', n % 100,
        '","representative":"r","language":"go","cause":',
        F.when(n % 12 == 5, F.lit('{"cause":"x"}')).otherwise(_text('"cause ', n % 10, '"')), ',"fixes":', F.when(n % 8 == 0, F.lit("3")).otherwise(F.lit('"- fix"')), ',"model":"m1","count":', count,
        ',"first_seen":', first, ',"last_seen":"', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), '"}',
    )
    return table(spark, sf_dir, "events").select(
        n.alias("sig_id"), once(payload).alias("payload"), F.array(F.lit(1.0), (n % 10).cast("double")).alias("embedding")
    )
