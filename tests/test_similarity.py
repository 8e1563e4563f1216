import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.operators import similarity


def make(spark, seed=3, hot=0.34):
    """Vectors of which a third are near copies of one, so that one cell and one query group are hot."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(1, 12))
    rows = []
    for n in range(240):
        v = base[0] + rng.normal(size=12) * 0.05 if rng.random() < hot else rng.normal(size=12)
        rows.append(v)
    rows[7] = rows[3]  # an exact copy: the smaller id wins
    history = [(n, v.tolist(), 1000 + n, f"c{n}", "", 1 + n) for n, v in enumerate(rows)]
    queries = [(f"q{n}", (v + rng.normal(size=12) * 0.1).tolist(), 1000 + 2 * n) for n, v in enumerate(rows[:120])]
    h = spark.createDataFrame(history, "sig_id bigint, embedding array<double>, t bigint, cause string, fixes string, count bigint")
    h = h.withColumn("first_seen", F.timestamp_seconds("t")).withColumn("last_seen", F.col("first_seen")).drop("t")
    q = spark.createDataFrame(queries, "doc_id string, embedding array<double>, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    return q, h, queries, history


def brute(queries, history, k, threshold, as_of=False):
    found = set()
    for name, v, t in queries:
        scores = []
        for n, w, first, *_ in history:
            s = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12)
            if s >= threshold and (not as_of or first < t):
                scores.append((-s, n))
        found |= {(name, rank + 1, n) for rank, (s, n) in enumerate(sorted(scores)[:k])}
    return found


@pytest.mark.parametrize("threshold", [0.85, 0.3, -1.0])
@pytest.mark.parametrize("as_of", [False, True])
@pytest.mark.parametrize(
    "sizes",
    [{}, {"broadcast_bytes": 0, "block_rows": 10, "chunk_rows": 30, "pivots": 6}, {"broadcast_bytes": 0, "pivots": 1}],
    ids=["shared", "blocked", "one-pivot"],
)
def test_nearest_is_exact(spark, threshold, as_of, sizes):
    q, h, queries, history = make(spark)
    got = similarity.nearest(q, h, 3, threshold, as_of, **sizes).collect()
    assert {(r.doc_id, r["rank"], r.sig_id) for r in got} == brute(queries, history, 3, threshold, as_of)


def test_threshold_is_inclusive_and_ties_take_the_smaller_id(spark):
    h = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])], "sig_id bigint, embedding array<double>")
    q = spark.createDataFrame([("q", [3.0, 4.0])], "doc_id string, embedding array<double>")
    rows = similarity.nearest(q, h, 3, 0.6).orderBy("rank").collect()
    assert [(r.sig_id, round(r.score, 9)) for r in rows] == [(3, 0.8), (1, 0.6), (2, 0.6)]


def test_recall_joins_what_is_known(spark):
    q, h, queries, history = make(spark)
    rows = similarity.recall(q, h, 2, 0.85).collect()
    assert rows and all(r.cause == f"c{r.sig_id}" and r["count"] == r.sig_id + 1 for r in rows)


def test_empty_history_and_missing_vectors(spark):
    q, h, *_ = make(spark)
    assert similarity.nearest(q, h.limit(0)).count() == 0
    blank = q.withColumn("embedding", F.array().cast("array<double>"))
    assert similarity.nearest(blank, h).count() == 0


def test_dimension_mismatch_fails_with_both_sizes(spark):
    df = spark.createDataFrame([([0.0] * 128,)], "embedding array<double>")
    with pytest.raises(Exception, match="vector has size 128, want 768"):
        similarity.check_dimension(df, 768).collect()
    assert [tuple(r) for r in similarity.dimensions(df).collect()] == [(128, 1)]


def test_hash_embed(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("x y z",), (" ",)], "text string")
    rows = [r.embedding for r in similarity.hash_embed(df, 64).collect()]
    assert rows[0] == rows[1] and abs(np.linalg.norm(rows[0]) - 1) < 1e-9
    assert np.dot(rows[0], rows[2]) < 0.9 and rows[3] == []


def test_cosine_column(spark):
    row = spark.range(1).select(similarity.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("c")).first()
    assert round(row.c, 6) == 0.707107


@pytest.mark.parametrize("sizes", [{}, {"broadcast_bytes": 0, "block_rows": 9, "chunk_rows": 20, "pivots": 5}], ids=["shared", "blocked"])
def test_recall_in_turn_equals_one_by_one(spark, sizes):
    """All texts at once give what recalling and recording them one after the other gives."""
    from stackloom.functions.text import sig_id
    from stackloom.operators import history

    rng = np.random.default_rng(8)
    centers = rng.normal(size=(4, 6))
    rows = []
    for n in range(160):
        family = 0 if rng.random() < 0.4 else int(rng.integers(0, 12))
        vector = centers[family % 4] + rng.normal(size=6) * 0.2
        rows.append((f"d{n:03d}", int(n // 2), f"family {family}", f"cause {n}", "", vector.tolist()))
    df = spark.createDataFrame(rows, "doc_id string, t int, signature string, cause string, fixes string, embedding array<double>")
    df = df.withColumn("ts", F.timestamp_seconds("t")).drop("t")
    ids = {r.signature: int(r.id) for r in df.select("signature", sig_id(F.col("signature")).alias("id")).distinct().collect()}

    got = similarity.recall(df, history.history_versions(df), 3, 0.9, as_of=True, **sizes).collect()
    want = set()
    for doc, t, _, _, _, v in rows:
        points = {}
        for _, _, sig, cause, _, w in (r for r in rows if (r[1], r[0]) < (t, doc)):
            points[sig] = (points.get(sig, (0,))[0] + 1, cause, w)
        scored = []
        for sig, (count, cause, w) in points.items():
            score = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 12)
            if score >= 0.9:
                scored.append((-score, ids[sig], count, cause))
        want |= {(doc, rank + 1, i, n, c) for rank, (_, i, n, c) in enumerate(sorted(scored)[:3])}
    assert {(r.doc_id, r["rank"], int(r.sig_id), r["count"], r.cause) for r in got} == want


def test_shared_recall_is_not_shuffled(spark):
    q, h, *_ = make(spark)
    plan = similarity.nearest(q, h)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_small_blocks_share_a_task(spark, monkeypatch):
    """A query moves to tasks, not to each of a hundred blocks, and a history row not to each of forty chunks."""
    q, h, queries, history = make(spark)
    moved = []
    match = similarity.match_packs

    def counted(arranged, *more):
        moved.append(arranged.count())
        return match(arranged, *more)

    monkeypatch.setattr(similarity, "match_packs", counted)
    got = similarity.nearest(q, h, 3, 0.3, broadcast_bytes=0, block_rows=3, chunk_rows=3, pivots=20).collect()
    assert {(r.doc_id, r["rank"], r.sig_id) for r in got} == brute(queries, history, 3, 0.3)
    assert moved[0] < 6 * (len(queries) + len(history))


def test_moves_grow_with_the_input_and_tasks_are_bounded():
    def moved(rows):
        packing = similarity.pack_blocks(np.full(rows // 100, 100), 100, rows, 200, 64, 12)
        sizes = np.bincount(packing.pack, minlength=packing.packs) * 100
        assert sizes.max() * 8 * 70 <= similarity.PACK_BYTES and packing.tile.max() < similarity.PACK_TILES
        assert sizes.max() * rows / packing.chunks <= 2 * similarity.TASK_PAIRS
        return packing.packs + packing.chunks

    assert moved(100_000) <= 12 and moved(600_000) <= 30


def test_versions_out_of_time_are_not_compared(monkeypatch):
    """queries meet the versions of about their time, not all there are; the answer is that of all pairs."""
    rng = np.random.default_rng(2)
    n = 6000
    vectors = similarity.unit_rows(similarity.pa.array(rng.normal(size=(n, 4)).tolist()), 4)
    since = np.arange(n, dtype=np.int64)
    until = np.where(since + 3 < n, since + 3, 2**63 - 1)
    order = rng.permutation(n)[:3000]
    compared = []
    plain = similarity._top_seen

    def counted(queries, history, *rest):
        compared.append(len(queries) * len(history))
        return plain(queries, history, *rest)

    monkeypatch.setattr(similarity, "_top_seen", counted)
    valid = ((since, None), (until, None))
    rows, cols, scores = similarity.top_matches(vectors[order], vectors, 2, 0.1, (since[order], None), valid)
    assert sum(compared) < 0.45 * n * len(order)
    want = plain(vectors[order], vectors, 2, 0.1, (since[order], None), valid)
    assert all((a == b).all() for a, b in zip((rows, cols, scores), want))
