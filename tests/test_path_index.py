import random

import pytest
from pyspark.sql import functions as F

from stackloom.operators import path_index, paths


def tables(spark, seed=1):
    rng = random.Random(seed)
    parts = ["src", "lib", "a", "b", "app", "..", ".", "", "é", "x.y", "workspace"]
    names = ["main.go", "a.go", "b.go", "index.js", "only.py", "a", "src"]

    def path(depth, clean):
        middle = [p for p in (rng.choice(parts) for _ in range(rng.randint(0, depth))) if not clean or p not in ("", ".", "..")]
        return "/".join([*middle, rng.choice([*names, f"f{rng.randrange(60)}.go"])])

    files = {(rng.choice(["r1", "r2"]), path(4, True)) for _ in range(300)} | {("r1", f"one/only{i}.rb") for i in range(9)} | {("r2", "a.go"), ("r2", "src/a.go")}
    files = [(r, p, f"{p}\n" * rng.randint(0, 3), rng.randint(1, 9)) for r, p in sorted(files)]
    files += files[:5]
    traces = [(rng.choice(["r1", "r2", "r3", None]), rng.choice(["", "/", "./", "/workspace/", "/app/", "  ", "/root/"]) + path(5, False)) for _ in range(900)]
    traces += [("r1", p) for p in ("", "/", "..", "only3.rb", "x/only4.rb/", "x/only5.rb/.", "/app/one/only6.rb", "../a.go", "a/../src/a.go")] + [("r2", None)]
    f = spark.createDataFrame(files, "repo string, path string, content string, size long")
    t = spark.createDataFrame([(i, r, p) for i, (r, p) in enumerate(traces)], "pos int, repo string, file string").repartition(3)
    return t, f


def answers(df):
    return sorted((r.repo, r.file, r.path, r.size, r.n_lines) for r in df.collect())


@pytest.mark.parametrize("partitions", ["1", "4", "40"])
def test_equals_the_candidate_join(spark, partitions):
    t, f = tables(spark)
    want = answers(paths.resolve_distinct(t, f))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert answers(path_index.resolve_indexed(t, f)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(want) > 300 and len({w[2] for w in want}) > 60


def test_one_row_a_path_is_moved(spark):
    t, f = tables(spark)
    rows = path_index._trace_rows(t)
    assert rows.groupBy("repo", "file").count().where("count > 1").count() == 0
    assert rows.count() <= t.select("repo", "file").distinct().count()
    assert path_index._file_rows(f).count() <= 2 * f.select("repo", "path").distinct().count()


def test_empty_sides(spark):
    t, f = tables(spark)
    assert path_index.resolve_indexed(t.limit(0), f).count() == 0
    assert path_index.resolve_indexed(t, f.limit(0)).count() == 0


def test_very_many_copies_of_one_name(spark):
    """A name that a third of all files have lies in many slices."""
    files = [("r", f"d{i}/e{i % 7}/index.js", "x", 1) for i in range(900)] + [("r", f"d{i}/other{i}.js", "x", 1) for i in range(100)]
    f = spark.createDataFrame(files, "repo string, path string, content string, size long")
    t = spark.createDataFrame([("r", f"/home/ci/d{i}/e{i % 7}/index.js") for i in range(900)] + [("r", "q/index.js"), ("r", "q/other7.js")], "repo string, file string")
    got = {r.file: r.path for r in path_index.resolve_indexed(t, f).collect()}
    assert got == {f"/home/ci/d{i}/e{i % 7}/index.js": f"d{i}/e{i % 7}/index.js" for i in range(900)} | {"q/other7.js": "d7/other7.js"}
