"""Every registered query: what the operators give on the derived inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.functions import fixed
from stackloom.functions.language import detect_language, language_scores
from stackloom.functions.text import day, excerpt, normalize, rfc3339, sig_id, symbol_name
from stackloom.operators import approximate, context, frames, groups, history, long_blocks, path_index, paths, pivot_tree, prompts, rules, sections, similarity, source, symbols
from stackloom.operators.rows import once, unfold
from stackloom.plans import inputs
from stackloom.session import materialize, work_folder
from stackloom.sources import history_store, ingest, keyed_store
from stackloom.sources.log_source import LogSource
from stackloom.streaming import jobs, numbering

Query = Callable[[SparkSession, str], DataFrame]
RECALL = {"k": 3, "threshold": 0.3}


# --- inputs shared by several queries ---------------------------------------------------------------------------------


def framed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with their frames."""
    traces = inputs.traces(spark, sf_dir).withColumn("language", detect_language(F.col("text")))
    return traces.select(
        "doc_id", "repo", "language", frames.stack_frames(F.col("text"), F.col("language")).alias("stack_frames")
    )


def analysed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table: the source joins use it several times."""
    return materialize(framed_traces(spark, sf_dir))


def trace_frames(spark: SparkSession, sf_dir: str, once_only: bool = False) -> DataFrame:
    """Frames of all traces, from a table unless they are used ``once_only``."""
    traces = framed_traces(spark, sf_dir) if once_only else analysed_traces(spark, sf_dir)
    return unfold(traces, F.col("stack_frames"), "doc_id", "repo").select("doc_id", "repo", "pos", "item.*")


def occurrences(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text, ts) as occurrences of their top family."""
    top = groups.top_signature(F.col("text"), groups.error_groups(F.col("text"), 1))
    signed = documents.select("*", once(top).alias("top"))
    number = F.octet_length("text")
    return signed.select(
        "doc_id",
        "ts",
        "top.signature",
        "top.representative",
        detect_language(F.col("text")).alias("language"),
        F.concat(F.lit("cause of "), "doc_id").alias("cause"),
        F.lit("- fix").alias("fixes"),
        F.lit("m1").alias("model"),
        F.array(F.lit(1.0), (number % 10).cast("double")).alias("embedding"),
    )


def shown_history(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("sig_id").cast("string").alias("sig_id"),
        "signature",
        "representative",
        "language",
        "cause",
        "fixes",
        "model",
        "count",
        rfc3339(F.col("first_seen")).alias("first_seen"),
        rfc3339(F.col("last_seen")).alias("last_seen"),
        F.get("embedding", F.lit(1)).alias("embedding_1"),
    )


# --- A: inputs --------------------------------------------------------------------------------------------------------


def cap_input(spark, sf_dir):
    return ingest.cap_input(inputs.errors(spark, sf_dir), 2000).select("doc_id", "origin", "truncated", "text")


def literal_texts(spark, sf_dir):
    """A3: the names of the nations, a table that never grows, handed over as literal texts."""
    names = [row.n_name for row in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect()]
    return ingest.from_texts(spark, names)


def _shown_files(files: DataFrame) -> DataFrame:
    log = F.regexp_extract("doc_id", "/log=([0-9]+)/", 1).cast("bigint").alias("log")
    return files.select(log, F.octet_length("text").cast("bigint").alias("bytes"), F.md5("text").alias("text_md5"), "truncated")


def error_files(spark, sf_dir):
    """A1/A5: log files as one document each."""
    folder = work_folder(spark)
    inputs.log_folder(spark, sf_dir, folder, events=1000)
    return _shown_files(ingest.read_error_files(spark, folder))


def stream_error_files(spark, sf_dir):
    """A2: the same files as they arrive."""
    folder = work_folder(spark)
    inputs.log_folder(spark, sf_dir, folder, events=1000)
    return _finished(spark, _shown_files(ingest.read_error_stream(spark, f"{folder}/*")))


def source_lines(spark, sf_dir):
    return ingest.source_lines(inputs.source_files(spark, sf_dir))


def context_json(spark, sf_dir):
    return context.contexts(inputs.errors(spark, sf_dir))


# --- B, C, E: texts and groups ------------------------------------------------------------------------------------------


def excerpt_bytes(spark, sf_dir):
    return inputs.errors(spark, sf_dir).select("doc_id", excerpt(F.col("text"), 500).alias("excerpt"))


def normalize_signature(spark, sf_dir):
    return inputs.errors(spark, sf_dir).select("doc_id", normalize(F.col("text")).alias("signature"))


def signature_id(spark, sf_dir):
    families = groups.doc_signature(inputs.errors(spark, sf_dir)).select("signature").distinct()
    return families.select("signature", sig_id(F.col("signature")).cast("string").alias("sig_id"))


def numbered_lines(spark, sf_dir):
    return groups.lines(inputs.errors(spark, sf_dir))


def split_blocks(spark, sf_dir):
    return groups.blocks(inputs.errors(spark, sf_dir))


def error_groups(spark, sf_dir):
    return groups.group_errors(inputs.errors(spark, sf_dir))


def error_groups_top(spark, sf_dir):
    """the 20 most frequent groups of a text, shortened to 500 bytes."""
    return groups.group_errors(inputs.errors(spark, sf_dir), max_groups=20, max_bytes=500)


def log_file_groups(spark, sf_dir):
    """E1 over log files, which are read line by line from all their splits."""
    folder = work_folder(spark)
    inputs.log_folder(spark, sf_dir, folder)
    found = groups.file_groups(groups.line_blocks(ingest.log_lines(spark, folder)))
    log = F.regexp_extract("file", "/log=([0-9]+)/", 1).cast("bigint").alias("log")
    return found.select(log, "rank", "signature", "count", "representative")


def log_groups_merged(spark, sf_dir):
    """C2/E1 over log files whose blocks may be of any length: folded split by split, never put together."""
    folder = work_folder(spark)
    inputs.log_folder(spark, sf_dir, folder)
    found = long_blocks.long_file_groups(ingest.log_lines(spark, folder), max_bytes=50)
    log = F.regexp_extract("file", "/log=([0-9]+)/", 1).cast("bigint").alias("log")
    return found.select(log, "rank", "signature", "count", "representative")


def doc_signature(spark, sf_dir):
    return groups.doc_signature(inputs.errors(spark, sf_dir))


def embed_text(spark, sf_dir):
    text = F.col("text")
    return inputs.errors(spark, sf_dir).select("doc_id", groups.embed_text(text, groups.error_groups(text, 1)).alias("embed_text"))


def error_families(spark, sf_dir):
    return groups.error_families(inputs.errors(spark, sf_dir)).select(
        "signature",
        "occurrences",
        "documents",
        rfc3339(F.col("first_seen")).alias("first_seen"),
        rfc3339(F.col("last_seen")).alias("last_seen"),
    )


# --- D, E: language -----------------------------------------------------------------------------------------------------


def detect(spark, sf_dir):
    return inputs.errors(spark, sf_dir).select("doc_id", detect_language(F.col("text")).alias("language"))


def score_languages(spark, sf_dir):
    scores = [score.alias(f"{name}_score") for name, score in language_scores(F.col("text")).items()]
    return inputs.errors(spark, sf_dir).select("doc_id", *scores)


def rule_scores(spark, sf_dir):
    """The same scores from rules that are a table."""
    scored = rules.score_rules(inputs.errors(spark, sf_dir), rules.language_rules(spark))
    shown = [F.coalesce(F.col("scores")[name], F.lit(0)).alias(f"{name}_score") for name in fixed.LANGUAGE_PRIORITY]
    return scored.select("doc_id", *shown)


def rule_language(spark, sf_dir):
    """The language that rules of a table name."""
    return rules.score_rules(inputs.errors(spark, sf_dir), rules.language_rules(spark)).select("doc_id", "language")


def language_mix(spark, sf_dir):
    return detect(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("documents"))


# --- C: frames ----------------------------------------------------------------------------------------------------------


def parse_frames(spark, sf_dir):
    return frames.parse_frames(inputs.errors(spark, sf_dir))


def frames_of(language: str) -> Query:
    def query(spark, sf_dir):
        return frames.parse_frames(inputs.errors(spark, sf_dir)).where(F.col("language") == language).drop("language")

    return query


def frame_hotspots(spark, sf_dir):
    return frames.frame_hotspots(inputs.errors(spark, sf_dir))


# --- D: repository ------------------------------------------------------------------------------------------------------


def path_candidates(spark, sf_dir):
    found = unfold(
        trace_frames(spark, sf_dir, once_only=True), paths.path_candidates(F.col("file")), "doc_id", "pos", position="priority"
    )
    return found.select("doc_id", "pos", "priority", "item.*")


def unique_basenames(spark, sf_dir):
    return paths.unique_basenames(inputs.source_files(spark, sf_dir))


def resolve_paths(spark, sf_dir):
    found = paths.resolve_paths(trace_frames(spark, sf_dir), inputs.source_files(spark, sf_dir))
    return found.select("doc_id", "repo", "pos", "file", "line", "path", "n_lines")


def resolve_indexed(spark, sf_dir):
    """The same answer from the index of reversed paths."""
    found = path_index.resolve_paths_indexed(trace_frames(spark, sf_dir), inputs.source_files(spark, sf_dir))
    return found.select("doc_id", "repo", "pos", "file", "line", "path", "n_lines")


def unresolved_frames(spark, sf_dir):
    missing = paths.unresolved_frames(trace_frames(spark, sf_dir), inputs.source_files(spark, sf_dir))
    return missing.select("doc_id", "repo", "pos", "file", "line")


def docs_with_source(spark, sf_dir):
    """Documents with at least one resolved frame."""
    resolved = resolve_paths(spark, sf_dir).select("doc_id").distinct()
    return inputs.traces(spark, sf_dir).select("doc_id", rfc3339(F.col("ts")).alias("ts")).join(resolved, "doc_id", "left_semi")


def collect_symbols(spark, sf_dir):
    return symbols.collect_symbols(framed_traces(spark, sf_dir))


def frame_symbols(spark, sf_dir):
    return trace_frames(spark, sf_dir, once_only=True).select(
        "doc_id", "pos", "function", symbol_name(F.coalesce("function", F.lit(""))).alias("symbol")
    )


def symbol_defs(spark, sf_dir):
    wanted = symbols.collect_symbols(analysed_traces(spark, sf_dir))
    found = symbols.symbol_definitions(wanted, inputs.source_files(spark, sf_dir))
    return found.select("repo", "language", "symbol", "path", "line_no")


def source_windows(spark, sf_dir):
    windows = source.source_windows(analysed_traces(spark, sf_dir), inputs.source_files(spark, sf_dir))
    return windows.select(
        "doc_id",
        "file_rank",
        "path",
        F.array_join(F.transform("marked", lambda m: m.cast("string")), ",").alias("marked"),
        "start_line",
        "end_line",
    )


def source_blocks(spark, sf_dir):
    return source.extract_source(analysed_traces(spark, sf_dir), inputs.source_files(spark, sf_dir))


def source_budget(spark, sf_dir):
    """The same with a budget small enough to bite."""
    return source.extract_source(analysed_traces(spark, sf_dir), inputs.source_files(spark, sf_dir), max_bytes=4000).select(
        "doc_id", "files", "bytes", "truncated"
    )


# --- D, F: recall -------------------------------------------------------------------------------------------------------


def _shown_priors(priors: DataFrame) -> DataFrame:
    return priors.select(
        "doc_id",
        "rank",
        F.col("sig_id").cast("string").alias("sig_id"),
        F.round("score", 6).alias("score"),
        "count",
        day(F.col("last_seen")).alias("last_seen"),
        "cause",
        "fixes",
    )


def recall_topk(spark, sf_dir):
    return _shown_priors(similarity.recall(inputs.vectors(spark, sf_dir), inputs.vector_history(spark, sf_dir), **RECALL))


def recall_blocked(spark, sf_dir):
    """The same answer from the strategy for histories that are too large to share."""
    return _shown_priors(
        similarity.recall(
            inputs.vectors(spark, sf_dir),
            inputs.vector_history(spark, sf_dir),
            **RECALL,
            broadcast_bytes=0,
            block_rows=200,
            chunk_rows=200,
            pivots=8,
        )
    )


def recall_tree(spark, sf_dir):
    """The same answer from blocks that are the leaves of a tree."""
    return _shown_priors(
        pivot_tree.recall_in_tree(
            inputs.vectors(spark, sf_dir), inputs.vector_history(spark, sf_dir), **RECALL, block_rows=100, fanout=8
        )
    )


APPROXIMATE = {"tables": 8, "probe_bits": 3, "bucket_rows": 32}


def recall_approx(spark, sf_dir):
    """The nearest ones that hash tables find; small buckets, so that even small tables are cut up."""
    return _shown_priors(
        approximate.recall_approx(
            inputs.vectors(spark, sf_dir), inputs.vector_history(spark, sf_dir), **RECALL, **APPROXIMATE, part_rows=40
        )
    )


def recall_as_of(spark, sf_dir):
    return _shown_priors(
        similarity.recall(inputs.vectors(spark, sf_dir), inputs.vector_history(spark, sf_dir), **RECALL, as_of=True)
    )


def recall_in_turn(spark, sf_dir):
    """Each vector recalls what earlier ones left behind, with the counts of that moment; five have one time each."""
    versions = history.history_versions(inputs.vector_occurrences(spark, sf_dir, at_once=5))
    return _shown_priors(similarity.recall(inputs.vectors(spark, sf_dir, at_once=5), versions, **RECALL, as_of=True)).drop("sig_id")


def recall_threshold(spark, sf_dir):
    """The default threshold, with near copies as queries."""
    found = similarity.nearest(inputs.perturbed_vectors(spark, sf_dir), inputs.vector_history(spark, sf_dir))
    return found.select("doc_id", "rank", F.col("sig_id").cast("string").alias("sig_id"), F.round("score", 6).alias("score"))


def dimension_check(spark, sf_dir):
    return similarity.dimensions(similarity.check_dimension(inputs.vectors(spark, sf_dir), 64))


def hash_embed(spark, sf_dir):
    embedded = similarity.hash_embed(inputs.errors(spark, sf_dir), 64)
    shown = F.transform("embedding", lambda x: F.round(x * 1_000_000).cast("bigint").cast("string"))
    return embedded.select("doc_id", F.size("embedding").alias("dim"), F.array_join(shown, ",").alias("millionths"))


def prior_blocks(spark, sf_dir):
    return prompts.prior_block(
        similarity.recall(inputs.vectors(spark, sf_dir), inputs.vector_history(spark, sf_dir), **RECALL)
    )


# --- E, F: history ------------------------------------------------------------------------------------------------------


def history_new(spark, sf_dir):
    return shown_history(history.new_history(occurrences(inputs.traces(spark, sf_dir))))


def history_upsert(spark, sf_dir):
    stored = history.new_history(occurrences(inputs.logs(spark, sf_dir)))
    return shown_history(history.record(stored, occurrences(inputs.errors(spark, sf_dir)), dim=2))


def _keyed_history(spark: SparkSession, sf_dir: str) -> str:
    """Logs, then all texts, as two versions of a bucketed history."""
    folder = work_folder(spark)
    keyed_store.upsert(occurrences(inputs.logs(spark, sf_dir)), folder, "000", buckets=16)
    keyed_store.upsert(occurrences(inputs.errors(spark, sf_dir)), folder, "001")
    return folder


def history_keyed(spark, sf_dir):
    """What ``history_upsert`` gives, from tables that are bucketed by family."""
    return shown_history(keyed_store.read_keyed(spark, _keyed_history(spark, sf_dir)))


def history_lookup(spark, sf_dir):
    """What is stored about the families of all traces."""
    families = groups.doc_signature(inputs.traces(spark, sf_dir)).select("signature").distinct()
    ids = families.select(sig_id(F.col("signature")).alias("sig_id"))
    return shown_history(keyed_store.lookup(spark, _keyed_history(spark, sf_dir), ids))


def history_payloads(spark, sf_dir):
    return shown_history(history.history_from_payloads(inputs.payloads(spark, sf_dir)))


def history_rejected(spark, sf_dir):
    rows = occurrences(inputs.errors(spark, sf_dir))
    # Texts of even length stand for those whose embedding failed.
    return history.rejected(
        rows.withColumn("embedding", F.when(F.length("cause") % 2 == 0, F.array().cast("array<double>")).otherwise(F.col("embedding")))
    )


def occurrence_number(spark, sf_dir):
    numbered = history.occurrence_numbers(occurrences(inputs.traces(spark, sf_dir)))
    return numbered.select("doc_id", "signature", "occurrence", rfc3339(F.col("previous_ts")).alias("previous_ts"))


def recurrence_gap(spark, sf_dir):
    gaps = history.recurrence_gaps(occurrences(inputs.traces(spark, sf_dir)))
    return gaps.select(
        "signature", "recurrences", F.round("min_gap_sec", 3).alias("min_gap_sec"), F.round("max_gap_sec", 3).alias("max_gap_sec")
    )


# --- C, D, E: replies and prompts -----------------------------------------------------------------------------------------


def all_replies(spark, sf_dir):
    return inputs.responses(spark, sf_dir).unionByName(inputs.turns(spark, sf_dir))


def parse_sections(spark, sf_dir):
    return sections.parse_sections(all_replies(spark, sf_dir))


def cause_fixes(spark, sf_dir):
    return sections.cause_fixes(all_replies(spark, sf_dir)).select("doc_id", "model", "cause", "fixes")


def build_prompts(spark, sf_dir):
    n = F.col("event_id")
    origin = F.when(n % 4 == 0, "stdin").when(n % 4 == 1, F.concat(F.lit("logs/"), n.cast("string"), F.lit(".log"))).otherwise("inline")
    traces = inputs.traces(spark, sf_dir).withColumn("origin", origin).withColumn("truncated", n % 6 == 0)
    analysis = context.analyze(traces).withColumn(
        "context_json", context.context_json(F.col("language"), F.col("stack_frames"), F.col("error_groups"))
    )
    errors = materialize(source.keyed_traces(analysis.drop("error_groups")))
    keys, blocks = source.shared_source(errors, inputs.source_files(spark, sf_dir))
    return prompts.build_prompts(errors.drop("stack_frames", "language"), blocks, prior_blocks(spark, sf_dir), keys)


def prompt_texts(spark, sf_dir):
    """User prompts of texts of all origins; of the instruction, which is the same in every row, the md5."""
    return build_prompts(spark, sf_dir).select("doc_id", "user_prompt", F.md5("system_prompt").alias("instruction_md5"))


def explained_history(spark, sf_dir):
    """What replies say about their traces goes into the history."""
    replies = sections.cause_fixes(inputs.responses(spark, sf_dir)).select("doc_id", "cause", "fixes", "model")
    rows = occurrences(inputs.traces(spark, sf_dir)).drop("cause", "fixes", "model").join(replies, "doc_id")
    return shown_history(history.new_history(rows))


# --- J: streams -----------------------------------------------------------------------------------------------------------


TURNS = 4


def _in_turns(spark: SparkSession, parts: list[DataFrame], key: str, closing: DataFrame | None = None) -> DataFrame:
    """A stream of files that arrive one part after the other, a part to a micro-batch; its files are read in parallel."""
    folder = work_folder(spark)
    files = max(1, min(spark.sparkContext.defaultParallelism, *(part.count() for part in parts)))
    for number, part in enumerate(parts):
        part.repartitionByRange(files, key).write.parquet(f"{folder}/turn={number}")
    if closing is not None:
        closing.coalesce(1).write.parquet(f"{folder}/turn={len(parts)}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(folder).drop("turn")


def _event_turns(spark: SparkSession, sf_dir: str, close: bool = False) -> DataFrame:
    """The events in ``TURNS`` parts, in order of time.

    With ``close`` an event follows that is so much later that the watermark passes all others.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = F.unix_micros(F.col("ts").cast("timestamp"))
    bounds = events.select(time.cast("double").alias("t")).approxQuantile("t", [i / TURNS for i in range(1, TURNS)], 0.01)
    parts = []
    for low, high in zip([None, *bounds], [*bounds, None], strict=True):
        part = events if low is None else events.where(time >= low)
        parts.append(part if high is None else part.where(time < high))
    last = events.agg(F.max("ts").alias("ts")).select(
        *(
            {"event_id": F.lit(-1), "ts": F.col("ts") + F.expr("INTERVAL 30 DAYS"), "event_type": F.lit("end")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in events.schema
        )
    )
    return _in_turns(spark, parts, "event_id", last if close else None)


def _finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream in append mode over all there is and give back the table it wrote."""
    out = work_folder(spark)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def stream_analysis(spark, sf_dir):
    """The frames of every trace, found on the stream."""
    analysed = jobs.analyze_stream(inputs.traces_of(_event_turns(spark, sf_dir)))
    found = unfold(analysed, F.col("stack_frames"), "doc_id", "language")
    return _finished(spark, found.select("doc_id", "language", "pos", "item.*"))


def stream_family_counts(spark, sf_dir):
    """Hourly counts of every family over several micro-batches; a window comes out when it is closed."""
    counts = jobs.family_counts(inputs.traces_of(_event_turns(spark, sf_dir, close=True)))
    return _finished(spark, counts).select(
        rfc3339(F.col("start")).alias("window_start"), "signature", "occurrences", "documents"
    )


def stream_history(spark, sf_dir):
    """The history that a stream of traces leaves behind."""
    out = work_folder(spark)
    jobs.stream_history(
        inputs.traces_of(_event_turns(spark, sf_dir)), f"{out}/history", f"{out}/checkpoint", prepare=occurrences
    ).awaitTermination()
    return shown_history(history_store.read_history(spark, f"{out}/history"))


def stream_occurrence_number(spark, sf_dir):
    """F10 on a stream: every trace's number within its family, from state that is kept between micro-batches."""
    rows = numbering.number_occurrences(occurrences(inputs.traces_of(_event_turns(spark, sf_dir, close=True))))
    with numbering.keyed_state(spark):
        numbered = _finished(spark, rows)
    return numbered.where(F.col("doc_id") != "trace--1").select(
        "doc_id", "signature", "occurrence", rfc3339(F.col("previous_ts")).alias("previous_ts")
    )


def stream_log_lines(spark, sf_dir):
    """A2: log files that appear in three turns, read by a stream that is started anew for each."""
    spark.dataSource.register(LogSource)
    folder, out = work_folder(spark), work_folder(spark)
    for turn in range(3):
        inputs.log_folder(spark, sf_dir, folder, events=1000, turn=turn, turns=3)
        stream = spark.readStream.format("log_lines").load(folder)
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(
            availableNow=True
        ).start().awaitTermination()
    lines = spark.read.schema("file string, offset bigint, line string").parquet(f"{out}/rows")
    return lines.select(F.regexp_extract("file", "/log=([0-9]+)/", 1).cast("bigint").alias("log"), "offset", "line")


def stream_recall(spark, sf_dir):
    """D10 on a stream: vectors arrive in four turns, and each turn recalls what the turns before it recorded."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    stream = _in_turns(spark, [vectors.where(F.col("vec_id") % TURNS == turn) for turn in range(TURNS)], "vec_id")

    def prepared(batch: DataFrame) -> DataFrame:
        rows = inputs.vector_occurrences_of(batch, at_once=5)
        return rows.withColumns({"representative": F.col("signature"), "language": F.lit("generic"), "model": F.lit("m1")})

    out = work_folder(spark)
    jobs.stream_recall(stream, f"{out}/history", f"{out}/priors", f"{out}/checkpoint", prepared, **RECALL).awaitTermination()
    return _shown_priors(spark.read.parquet(f"{out}/priors")).drop("sig_id")


QUERIES: dict[str, Query] = {
    "literal_texts": literal_texts,
    "error_files": error_files,
    "stream_error_files": stream_error_files,
    "cap_input": cap_input,
    "excerpt_bytes": excerpt_bytes,
    "normalize_signature": normalize_signature,
    "signature_id": signature_id,
    "numbered_lines": numbered_lines,
    "source_lines": source_lines,
    "split_blocks": split_blocks,
    "error_groups": error_groups,
    "error_groups_top": error_groups_top,
    "log_file_groups": log_file_groups,
    "log_groups_merged": log_groups_merged,
    "doc_signature": doc_signature,
    "embed_text": embed_text,
    "error_families": error_families,
    "detect_language": detect,
    "language_scores": score_languages,
    "rule_scores": rule_scores,
    "rule_language": rule_language,
    "language_mix": language_mix,
    "parse_frames": parse_frames,
    **{f"frames_{name}": frames_of(name) for name in ("go", "python", "java", "node", "ruby", "rust", "dotnet", "generic")},
    "frame_hotspots": frame_hotspots,
    "context_json": context_json,
    "path_candidates": path_candidates,
    "unique_basenames": unique_basenames,
    "resolve_paths": resolve_paths,
    "resolve_indexed": resolve_indexed,
    "unresolved_frames": unresolved_frames,
    "docs_with_source": docs_with_source,
    "frame_symbols": frame_symbols,
    "collect_symbols": collect_symbols,
    "symbol_defs": symbol_defs,
    "source_windows": source_windows,
    "source_blocks": source_blocks,
    "source_budget": source_budget,
    "recall_topk": recall_topk,
    "recall_blocked": recall_blocked,
    "recall_tree": recall_tree,
    "recall_approx": recall_approx,
    "recall_as_of": recall_as_of,
    "recall_in_turn": recall_in_turn,
    "recall_threshold": recall_threshold,
    "dimension_check": dimension_check,
    "hash_embed": hash_embed,
    "prior_blocks": prior_blocks,
    "history_new": history_new,
    "history_upsert": history_upsert,
    "history_keyed": history_keyed,
    "history_lookup": history_lookup,
    "history_payloads": history_payloads,
    "history_rejected": history_rejected,
    "occurrence_number": occurrence_number,
    "recurrence_gap": recurrence_gap,
    "parse_sections": parse_sections,
    "cause_fixes": cause_fixes,
    "build_prompts": prompt_texts,
    "explained_history": explained_history,
    "stream_analysis": stream_analysis,
    "stream_family_counts": stream_family_counts,
    "stream_history": stream_history,
    "stream_occurrence_number": stream_occurrence_number,
    "stream_log_lines": stream_log_lines,
    "stream_recall": stream_recall,
}
