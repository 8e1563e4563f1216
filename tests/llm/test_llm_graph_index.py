import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm import graph_index as g


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((12, dim)) * 2
    return centers[rng.integers(0, 12, n)] + rng.standard_normal((n, dim))


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        d = np.sqrt(((vectors - vectors[ids == q][0]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:k]
        out[q] = [(int(ids[i]), d[i]) for i in order if np.isfinite(d[i])]
    return out


def test_beam_search_finds_the_nearest():
    v = clustered(1500, 16, 1).astype(np.float32)
    graph = g.build_graph(v)
    assert graph.edges.max() < len(v) and not (graph.edges == np.arange(len(v))[:, None]).any()
    rows = [e[e >= 0] for e in graph.edges]
    assert all(len(set(r.tolist())) == len(r) for r in rows)
    nodes, dist = g.beam_search(graph.vectors, graph.edges, graph.entries, v[:200], 64)
    true = np.argsort(((v[:200, None] - v[None]) ** 2).sum(axis=2), axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(true, nodes, strict=True)]) > 0.95
    assert (np.diff(dist, axis=1) >= 0).all()


def test_pruning_keeps_diverse_edges():
    v = np.array([[0, 0], [1, 0], [1.1, 0], [0, 1], [-5, 0]], np.float32)
    kept = g.robust_prune(v, np.array([0]), np.array([[2, 1, 3, 4, -1, 1]]), 4, 1.2)
    assert kept.tolist() == [[1, 3, 4, -1]] or kept.tolist() == [[3, 1, 4, -1]]


def test_recall_over_shards(spark):
    v = clustered(2500, 16, 2)
    ids = np.arange(2500) * 7 - 300
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>").repartition(4)
    found = g.nearest(df, F.col("vec_id") % 50 == 0, shard_size=600).collect()
    truth = brute(ids, v, [int(i) for i in ids if i % 50 == 0], 10)
    assert len(found) == 10 * len(truth)
    hits = 0
    for r in found:
        hits += r["vec_id"] in {i for i, _ in truth[r["query_id"]]}
        true = np.sqrt(((v[ids == r["vec_id"]][0] - v[ids == r["query_id"]][0]) ** 2).sum())
        assert abs(true - r["score"]) < 1e-12
    assert hits >= 0.9 * len(found)


def test_awkward_vectors(spark):
    rows = [
        (0, [1.0, 0.0]),
        (1, [1.0, 0.0]),
        (1, [1.0, 0.0]),
        (2, [1.0, 0.0]),
        (3, [0.0, 0.0]),
        (4, None),
        (5, [1.0, None]),
        (6, [float("nan"), 1.0]),
        (7, [float("inf"), 1.0]),
        (8, [1.0, 1.0, 1.0]),
        (9, [2.0, 0.0]),
        (10, []),
        (100, [0.0, 3.0]),
        (None, [1.0, 0.0]),
        (200, [1.0, 2.0, 3.0]),
        (300, [0.0, 0.0]),
        (400, [1.0, 2.0, 3.0, 4.0]),
    ]
    rows += [(1000 + i, [5.0, 5.0]) for i in range(1, 60)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, shard int")
    found = sorted(g.nearest(df, F.col("vec_id") % 100 == 0).collect(), key=lambda r: (r["query_id"], r["rank"]))
    got = {q: [r["vec_id"] for r in found if r["query_id"] == q] for q in {r["query_id"] for r in found}}
    assert got[0] == [1, 2, 9, 100, *range(1001, 1007)]
    assert got[100] == [0, 1, 2, 9, *range(1001, 1007)] and got[200] == [8]
    assert set(got) == {0, 100, 200}
    assert g.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sd", [0.01, 0.0001])
def test_crowded_vectors_are_reached_and_found(sd):
    """A shard in 64 dimensions of which most vectors crowd one centre."""
    rng = np.random.default_rng(1)
    v = rng.normal(size=(4096, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    center = rng.normal(size=64)
    v[:3500] = center / np.linalg.norm(center) + rng.normal(size=(3500, 64)) * sd
    v = v[rng.permutation(4096)].astype(np.float32)
    graph = g.build_graph(v)
    assert g.reached(graph.edges, graph.entries).all()
    asked = v[::40]
    away = ((asked[:, None].astype(float) - v[None].astype(float)) ** 2).sum(axis=2)
    want = np.argsort(away, axis=1, kind="stable")[:, :11]
    found, _ = g.beam_search(graph.vectors, graph.edges, graph.entries, asked, g.QUERY_BEAM)
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(found[:, :11], want, strict=True)]) >= 0.95


def test_nodes_without_an_in_edge_are_connected():
    v = np.random.default_rng(2).normal(size=(50, 4)).astype(np.float32)
    edges = np.full((50, 2), -1, dtype=np.int64)
    entries = g.entry_points(50)
    edges[entries] = entries[:2]
    whole = g.connect(v, edges, entries, 8)
    assert not g.reached(edges, entries).all() and g.reached(whole, entries).all()
    assert (whole[:, :2][entries] == edges[entries]).all()
