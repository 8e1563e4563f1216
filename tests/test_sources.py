import random

from pyspark.sql import functions as F

from stackloom.operators import groups
from stackloom.sources import ingest


def test_cap_input(spark):
    df = ingest.cap_input(spark.createDataFrame([("a" * 10,), ("é" * 6,), ("short",)], "text string"), 9)
    assert [(r.text, r.truncated) for r in df.collect()] == [("a" * 9, True), ("é" * 4, True), ("short", False)]


def test_from_texts(spark):
    whole = ingest.from_texts(spark, ["boom", "a" * 300_000]).orderBy("doc_id").collect()
    assert [(r.truncated, len(r.text)) for r in whole] == [(False, 4), (False, 300_000)]
    rows = ingest.from_texts(spark, ["boom", "a" * 300_000], max_bytes=262_144).orderBy("doc_id").collect()
    assert [(r.origin, r.truncated, len(r.text)) for r in rows] == [("inline", False, 4), ("inline", True, 262_144)]


def test_error_files(spark, tmp_path):
    contents = {"a.log": "one\r\ntwo\n\nthree é\n" * 50, "b.log": "x" * 50 + "\n", "c.log": "é\n" * 400}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content.encode())
    rows = ingest.read_error_files(spark, str(tmp_path), max_bytes=101).collect()
    got = {r.origin.rsplit("/", 1)[1]: (r.text, r.truncated) for r in rows}
    assert got == {
        name: (content.encode()[:101].decode(errors="ignore"), len(content.encode()) > 101) for name, content in contents.items()
    }
    whole = {r.origin.rsplit("/", 1)[1]: (r.text, r.truncated) for r in ingest.read_error_files(spark, str(tmp_path)).collect()}
    assert whole == {name: (content, False) for name, content in contents.items()}


def test_source_lines(spark):
    files = spark.createDataFrame([("r", "a", "x\ny\n", 4), ("r", "big", "z", 3_000_000)], "repo string, path string, content string, size bigint")
    assert ingest.source_lines(files).count() == 4
    rows = ingest.source_lines(files, 2_000_000).orderBy("line_no").collect()
    assert [(r.path, r.line_no, r.text) for r in rows] == [("a", 1, "x"), ("a", 2, "y"), ("a", 3, "")]
    counts = files.select(ingest.line_count(F.col("content")).alias("n")).collect()
    assert [r.n for r in counts] == [3, 1]


def test_logs_of_any_length(spark, tmp_path):
    """Files that lie in many splits give what the same texts give as one value each."""
    rng = random.Random(3)
    kinds = ["ERROR disk full", "", "  ", "continued é", "2024-01-01 10:00:00 WARN slow pid=%d", "Traceback", "x", "goroutine %d stuck"]
    texts = {}
    for name in ("a.log", "b.log", "c.log"):
        lines = [rng.choice(kinds) for _ in range(300)]
        texts[name] = "\n".join(k % rng.randint(0, 9) if "%" in k else k for k in lines)
        (tmp_path / name).write_text(texts[name])
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    want = sorted(tuple(r) for r in groups.group_errors(docs).collect())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "700b", "97b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)
        try:
            lines = ingest.log_lines(spark, str(tmp_path))
            splits = lines.select("file", "split").distinct().count()
            found = groups.file_groups(groups.line_blocks(lines)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert splits == 3 if size == "128m" else splits > 10
        got = sorted((r["file"].rsplit("/", 1)[1], r["rank"], r["signature"], r["count"], r["representative"]) for r in found)
        assert got == want


def test_tasks_grow_in_number_with_the_rows(spark):
    from stackloom.sources.ingest import spread

    df = spark.range(0, 1000, 1, 6).withColumnRenamed("id", "event_id")
    assert spread(df, "event_id").rdd.getNumPartitions() == 6
    many = spread(df, "event_id", rows_per_task=50)
    assert many.rdd.getNumPartitions() == 20 and many.count() == 1000
