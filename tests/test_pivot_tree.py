import numpy as np
import pytest
from pyspark.sql import functions as F
from test_similarity import brute, make

from stackloom.operators import pivot_tree, similarity


@pytest.mark.parametrize("threshold", [0.85, 0.3, -1.0])
@pytest.mark.parametrize("as_of", [False, True])
@pytest.mark.parametrize("sizes", [{"block_rows": 8, "fanout": 4}, {"block_rows": 50, "fanout": 3, "chunk_rows": 30}, {"block_rows": 8, "fanout": 4, "tree_bytes": 1200}, {}], ids=["deep", "chunks", "few-bytes", "one-block"])
def test_the_answer_is_exact(spark, threshold, as_of, sizes):
    q, h, queries, history = make(spark)
    got = pivot_tree.nearest_in_tree(q, h, 3, threshold, as_of, **sizes).collect()
    assert {(r.doc_id, r["rank"], r.sig_id) for r in got} == brute(queries, history, 3, threshold, as_of)


def clustered(spark, rows=4000, dim=16, seed=2, spread=0.6):
    """Clusters within clusters, as errors of one kind are."""
    rng = np.random.default_rng(seed)
    tops = rng.normal(size=(12, dim))
    centers = tops[rng.integers(0, 12, 150)] + rng.normal(size=(150, dim)) * spread
    vectors = centers[rng.integers(0, 150, rows)] + rng.normal(size=(rows, dim)) * 0.05
    h = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(vectors)], "sig_id bigint, embedding array<double>")
    q = spark.createDataFrame([(f"q{n}", (v + rng.normal(size=dim) * 0.02).tolist()) for n, v in enumerate(vectors[::40])], "doc_id string, embedding array<double>")
    return q, h


def flat_visits(q, h, threshold, block_rows, pivots, dim):
    """Pairs of the layout with one level of pivots, counted by its own rules."""
    vectors = np.array([r.embedding for r in h.orderBy(F.xxhash64("sig_id"), "sig_id").collect()])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = np.array([r.embedding for r in q.collect()])
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    p = vectors[:pivots]
    angles = pivot_tree._angles(vectors, p)
    cell = angles.argmin(axis=1)
    radius = np.array([angles[cell == c, c].max() for c in range(pivots)])
    possible = pivot_tree._angles(asked, p) <= radius + similarity.reach_of(threshold)
    sizes = np.bincount(cell, minlength=pivots)
    return int((possible * -(-sizes // block_rows)).sum()), int((possible * sizes).sum())


@pytest.mark.parametrize("threshold", [0.95, 0.85])
def test_fewer_blocks_are_visited_than_with_flat_pivots(spark, threshold):
    q, h = clustered(spark)
    cost = pivot_tree.visits(q, h, threshold, block_rows=20, fanout=16).agg(F.sum("blocks"), F.sum("rows")).first()
    flat = flat_visits(q, h, threshold, 20, 64, 16)
    print("visited (query, block) pairs and rows:", tuple(cost), "flat:", flat)
    assert cost[0] < 0.7 * flat[0] and cost[1] < 0.7 * flat[1]


def test_blocks_are_small(spark):
    q, h = clustered(spark, 2000)
    tree = pivot_tree.build(h, 2000, 16, block_rows=40, fanout=8)
    assert max(tree.rows.values()) <= 40 and sum(tree.rows.values()) == 2000
    few = pivot_tree.build(h, 2000, 16, block_rows=40, fanout=8, tree_bytes=3 * 8 * (8 * 16 + 128 + 8))
    assert len(few.nodes) == 3 and sum(few.rows.values()) == 2000


def test_equal_vectors_and_empty_sides(spark):
    h = spark.createDataFrame([(n, [1.0, 2.0]) for n in range(50)] + [(99, [])], "sig_id bigint, embedding array<double>")
    q = spark.createDataFrame([("q", [2.0, 4.0]), ("none", None)], "doc_id string, embedding array<double>")
    rows = pivot_tree.nearest_in_tree(q, h, 2, 0.9, block_rows=5, fanout=4).orderBy("rank").collect()
    assert [(r.doc_id, r.sig_id) for r in rows] == [("q", 0), ("q", 1)]
    assert pivot_tree.nearest_in_tree(q, h.where("sig_id = 99")).count() == 0
    assert pivot_tree.nearest_in_tree(q.limit(0), h, block_rows=5).count() == 0
    assert [tuple(r) for r in pivot_tree.visits(q, h.limit(0)).collect()] == [("q", 0, 0), ("none", 0, 0)]
