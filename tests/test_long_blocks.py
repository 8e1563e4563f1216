import random

import pytest
from pyspark.sql import functions as F

from stackloom.functions.text import cut_bytes
from stackloom.operators import groups, long_blocks
from stackloom.operators.ranking import places
from stackloom.sources import ingest


def found(spark, path, size, max_bytes):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", size)
    try:
        lines = ingest.log_lines(spark, str(path))
        splits = lines.select("file", "split").distinct().count()
        rows = long_blocks.long_file_groups(lines, max_bytes).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    return splits, sorted((r["file"].rsplit("/", 1)[1], r["rank"], r["signature"], r["count"], r["representative"]) for r in rows)


def whole(spark, texts, max_bytes):
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    rows = groups.group_errors(docs)
    rows = rows.withColumns({c: cut_bytes(F.col(c), max_bytes) for c in ("signature", "representative")})
    return sorted((r["doc_id"], r["rank"], r["signature"], r["count"], r["representative"]) for r in rows.collect())


@pytest.mark.parametrize("max_bytes", [16, 100_000])
def test_the_same_groups_from_any_splits(spark, tmp_path, max_bytes):
    rng = random.Random(3)
    kinds = ["ERROR disk full", "", "  ", "  continued é 0x1f  ", "2024-01-01 10:00:00 WARN slow pid=%d", "Traceback", "x", " 漢字 " * 9, "goroutine %d stuck", "10:00:00"]
    texts = {}
    for name in ("a.log", "b.log", "c.log"):
        lines = [rng.choice(kinds) for _ in range(300)]
        texts[name] = "\n".join(k % rng.randint(0, 9) if "%" in k else k for k in lines)
        (tmp_path / name).write_text(texts[name])
    want = whole(spark, texts, max_bytes)
    assert len(want) > 30
    for size in ("128m", "700b", "97b"):
        splits, got = found(spark, tmp_path, size, max_bytes)
        assert splits == 3 if size == "128m" else splits > 10
        assert got == want


def test_a_log_without_any_block_start(spark, tmp_path):
    """One block of all lines, cut into many splits; a second file differs in its last word only, a third is the first again."""
    lines = [f"   at step [{i}] of code{i % 7}.py:{i}, value {i % 3}  " for i in range(4000)]
    texts = {"a.log": "\n".join(lines), "b.log": "\n".join([*lines[:-1], "other"]), "c.log": "\n\n".join(["\n".join(lines)] * 2) + "\n\nE1"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    want = whole(spark, texts, 64)
    for size in ("128m", "9000b"):
        splits, got = found(spark, tmp_path, size, 64)
        assert splits == 3 if size == "128m" else splits > 60
        assert got == want
    assert [r[3] for r in got] == [1, 1, 2]
    states = long_blocks.block_states(ingest.log_lines(spark, str(tmp_path)), 64).collect()
    prints = {}
    for r in states:
        prints.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["fingerprint"], r["words"], r["bytes"]))
    assert prints["a.log"][0] != prints["b.log"][0] and prints["c.log"].count(prints["a.log"][0]) == 2


def test_fingerprints_do_not_depend_on_line_ends(spark):
    lines = spark.createDataFrame([("f", 0, 1, "a b"), ("f", 0, 2, "c"), ("g", 0, 1, "a"), ("g", 5, 2, "b c"), ("h", 0, 1, "a c b")], "file string, split long, row long, line string")
    rows = {r["file"]: r for r in long_blocks.block_states(lines, 99).collect()}
    assert rows["f"]["fingerprint"] == rows["g"]["fingerprint"] != rows["h"]["fingerprint"]
    assert rows["f"]["signature"] == rows["g"]["signature"] == "a b c" and rows["g"]["representative"] == "a\nb c"
    assert long_blocks.long_file_groups(lines.limit(0)).count() == 0


def test_places(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else rng.choice([None, "a", "b"]), rng.randint(0, 50), i) for i in range(500)]
    got = places(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], [F.desc("v"), F.col("i")]).collect()
    want = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        want |= {r[2]: n + 1 for n, r in enumerate(own)}
    assert {r["i"]: r["rank"] for r in got if r["k"] is not None} == {i: n for i, n in want.items() if rows[i][0] is not None}
