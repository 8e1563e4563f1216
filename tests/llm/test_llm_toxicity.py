import random

import numpy as np
import pyarrow as pa
from llm_texts import prose
from pyspark.sql import functions as F

from stackloom.llm import toxicity as t


def labelled(n, seed):
    """Texts in which forms of a few stems mark label 1."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = prose(rng, rng.randint(1, 90)).split()
        if i % 3 == 0:
            for _ in range(1 + len(words) // 20):
                words.insert(rng.randint(0, len(words)), rng.choice(["vermin", "grotz"]) + rng.choice(["", "ish", "ling", str(rng.randint(0, 99))]))
        out.append((" ".join(words), int(i % 3 == 0)))
    return out


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) * 3 for k, v in t.start_params().items()}
    words = t.find_words(*t.lowered(pa.array(["the idiot walks home", "a dog sees the moon", "x", ""])), t.ALNUM_BYTES)
    x, which = t.distinct_inputs(words)
    none = len(x.word)
    windows, row = t.make_windows(words, which, none)
    assert row.tolist() == [0, 1, 2, 3]
    y, drop = np.array([1.0, 0.0, 1.0, 0.0]), np.arange(none) == 1

    def loss():
        v = t.word_inputs(p, x)
        v[drop, : t.WORD_DIM] = 0
        return np.mean(np.logaddexp(0, -t._forward(p, t.project(p, v), windows, none) * (2 * y - 1)))

    g = t._gradients(p, x, windows, none, y, drop)
    for k in ("w", "v", "A", "ca", "Wf", "Ub", "cf"):
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-3
        up = loss()
        p[k][at] = old - 1e-3
        down = loss()
        p[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-3 * (1 + abs(g[k][at]))


def test_every_window_is_scored():
    p = t.train([([a], b) for a, b in labelled(400, 1)])
    rng = random.Random(9)
    far = prose(rng, 4000) + " grotzling vermin " + prose(rng, 4000)
    texts = [far, prose(rng, 8000), None, "", "vermins", "grotz9999"]
    scores = np.concatenate([s for _, _, s in t.score_slices(p, pa.array(texts))])
    assert scores[0] > 0.7 > scores[1] and scores[2] == scores[3] < 0.7 and (scores[4:] > 0.7).all()
    one_by_one = [np.concatenate([s for _, _, s in t.score_slices(p, pa.array([x], pa.string()))])[0] for x in texts]
    assert np.allclose(scores, one_by_one, atol=1e-5)


def test_held_out_accuracy(spark, awkward):
    rows = [(i, x, y) for i, (x, y) in enumerate(labelled(700, 2))]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = [(i, y, 1) for i, _, y in rows] + [(None, 1, 1), (5, None, 0), (10**9, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, text int")
    p = t.fit(docs, labels, F.col("doc_id") % 3 != 1, per_class=(200, 200))
    held = {i: y for i, _, y in rows if i % 3 == 1}
    right = [int(r["score"] >= 0.7) == held[r["doc_id"]] for r in t.score(docs, p).collect() if r["doc_id"] in held]
    assert len(right) == len(held) and np.mean(right) > 0.93
    scored = t.score(awkward, p).collect()
    assert len(scored) == awkward.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert t.drop_toxic(awkward, p).columns == awkward.columns


def test_without_labels(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    p = t.fit(nothing, none, F.lit(True))
    assert t.score(nothing, p).count() == 0 and t.drop_toxic(nothing, p).count() == 0
