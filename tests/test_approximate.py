import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.operators import approximate, similarity

FIELDS = "embedding array<double>, cause string, fixes string, count bigint, first_seen timestamp, last_seen timestamp"


def tables(spark, rows=3000, dim=32, hot=0.34, seed=5):
    """A history of which a third are near copies of one vector, and queries close to some of its rows."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=dim)
    vectors = rng.normal(size=(rows, dim))
    copies = rng.random(rows) < hot
    vectors[copies] = base + rng.normal(size=(copies.sum(), dim)) * 0.02
    asked = vectors[rng.integers(0, rows, 200)] + rng.normal(size=(200, dim)) * 0.2
    h = spark.createDataFrame([(n, v.tolist(), f"c{n}", "", 1 + n) for n, v in enumerate(vectors)], "sig_id bigint, embedding array<double>, cause string, fixes string, count bigint")
    h = h.withColumn("first_seen", F.timestamp_seconds("sig_id")).withColumn("last_seen", F.col("first_seen"))
    q = spark.createDataFrame([(f"q{n}", v.tolist(), n * 15) for n, v in enumerate(asked)], "doc_id string, embedding array<double>, t bigint")
    return q.withColumn("ts", F.timestamp_seconds("t")).drop("t"), h


def answers(df):
    return {(r.doc_id, r.sig_id): (r["rank"], r.score) for r in df.collect()}


@pytest.mark.parametrize("as_of", [False, True])
def test_recall_against_the_exact_answer(spark, as_of):
    q, h = tables(spark)
    exact = answers(similarity.nearest(q, h, 3, 0.85, as_of))
    found = answers(approximate.nearest_approx(q, h, 3, 0.85, as_of, bucket_rows=64, part_rows=100))
    assert len(exact) >= (120 if as_of else 250)
    assert len(set(found) & set(exact)) >= 0.95 * len(exact)
    # scores are exact, so a pair of both answers has the same one
    assert all(abs(found[p][1] - exact[p][1]) < 1e-11 for p in set(found) & set(exact))


def test_split_buckets_give_the_same(spark):
    q, h = tables(spark, rows=800)
    whole = answers(approximate.nearest_approx(q, h, 5, 0.3, bucket_rows=100))
    assert answers(approximate.nearest_approx(q, h, 5, 0.3, bucket_rows=100, part_rows=7)) == whole


def test_no_task_holds_more_than_a_part(spark, monkeypatch):
    """Blocks of the hot bucket, counted where they are matched."""
    q, h = tables(spark, rows=800)
    normals = approximate.planes(2, 3, 32)
    placed = approximate._with_keys(similarity.sides(q, h, False)[1], normals, 0)
    sizes = [r["count"] for r in placed.groupBy("table", "key").count().collect()]
    assert max(sizes) > 260
    seen = []

    def counted(arranged, keys, *rest):
        seen.append(max(r["count"] for r in arranged.where("side = 0").groupBy(*keys).count().collect()))
        return match(arranged, keys, *rest)

    match = approximate.match_blocks
    monkeypatch.setattr(approximate, "match_blocks", counted)
    approximate.nearest_approx(q, h, bucket_rows=100, part_rows=30, tables=2).collect()
    assert seen[0] < 80


def test_keys_equal_a_plain_loop():
    rng = np.random.default_rng(1)
    vectors = similarity.unit_rows(similarity.pa.array(rng.normal(size=(20, 6)).tolist()), 6)
    normals = approximate.planes(3, 5, 6)
    found = approximate.keys(vectors, normals, 2)
    assert found.shape == (20, 3, 4)
    for n, v in enumerate(vectors):
        for t in range(3):
            away = [round(float(v @ normals[t, b]), 9) for b in range(5)]
            own = sum(1 << b for b in range(5) if away[b] >= 0)
            a, b = sorted(range(5), key=lambda b: (abs(away[b]), b))[:2]
            assert found[n, t].tolist() == [own, own ^ 1 << a, own ^ 1 << b, own ^ 1 << a ^ 1 << b]
    assert approximate.key_bits(0, 10) == approximate.key_bits(10, 10) == 1 and approximate.key_bits(10**9, 256) == 22


def test_ties_copies_and_empty_sides(spark):
    same = [1.0, 2.0, 3.0]
    h = spark.createDataFrame([(n, same if n != 4 else [], f"c{n}", "", 1, None, None) for n in (9, 3, 7, 4)], "sig_id bigint, " + FIELDS)
    q = spark.createDataFrame([("q", [2.0, 4.0, 6.0]), ("none", None)], "doc_id string, embedding array<double>")
    rows = approximate.recall_approx(q, h, 2, 0.9).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"], r.sig_id, r.cause) for r in rows] == [("q", 1, 3, "c3"), ("q", 2, 7, "c7")]
    assert approximate.nearest_approx(q, h.where("sig_id = 4")).count() == 0
    assert approximate.nearest_approx(q.limit(0), h).count() == 0
    with pytest.raises(Exception, match="vector has size 3, want 2"):
        approximate.nearest_approx(q, h, dim=2).collect()


def test_queries_move_once_a_pack(spark, monkeypatch):
    """a query is moved a few times a table, not once a bucket and part; vectors of floats travel as floats."""
    q, h = tables(spark, rows=1500)
    floats = F.col("embedding").cast("array<float>").alias("embedding")
    q, h = (df.withColumn("embedding", floats) for df in (q, h))
    seen = []

    def counted(arranged, *rest):
        seen.append((arranged.where("side = 1").count(), arranged.schema["embedding"].dataType.elementType.simpleString()))
        return match(arranged, *rest)

    match = approximate.match_blocks
    monkeypatch.setattr(approximate, "match_blocks", counted)
    approximate.nearest_approx(q, h, bucket_rows=16, part_rows=20, tables=4, probe_bits=3).collect()
    assert seen[0][0] <= 200 * 4 * 4 and seen[0][1] == "float"


def test_repeated_rows_take_one_place(spark):
    q, h = tables(spark, rows=400, hot=0)
    once = answers(approximate.nearest_approx(q, h, 3, 0.2, bucket_rows=400, part_rows=1000))
    twice = answers(approximate.nearest_approx(q, h.unionByName(h), 6, 0.2, bucket_rows=800, part_rows=1000))
    assert {p for p, (rank, _) in twice.items() if rank <= 3} == {p for p in once}
