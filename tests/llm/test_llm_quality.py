import random

import numpy as np
from llm_texts import prose
from pyspark.sql import functions as F

from stackloom.llm import quality as q


def labelled(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text, bad = prose(rng, rng.randint(5, 90)), i % 4 == 0
        if bad:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), " ".join(text.split()[:2] * 30)])
        out.append((i, text, int(not bad)))
    return out


def test_held_out_accuracy(spark, awkward):
    rows = labelled(600, 3)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y, "x") for i, _, y in rows] + [(None, 1, ""), (7, None, "")], "doc_id long, quality int, text string")
    model = q.fit(docs, labels, F.col("doc_id") % 5 != 0)
    held = {i: y for i, _, y in rows if i % 5 == 0}
    scores = {r["doc_id"]: r["score"] for r in q.score(docs, model).collect()}
    right = [int(scores[i] >= 0.3) == y for i, y in held.items()]
    assert np.mean(right) > 0.93 and 0.2 < model.temperature < 8.1
    again = q.fit(docs.repartition(5), labels, F.col("doc_id") % 5 != 0)
    assert np.allclose(again.vectors, model.vectors, atol=1e-5)
    out = q.score(awkward, model).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (4, 5, 6)}) == 1


def test_word_vectors_are_sums_over_all_neighbours(spark):
    texts = ["a b c", "b a", None, "c !! c"]
    vectors = q.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    index = q.index_vectors()
    bucket = {}
    for word in ("a", "b", "c", "!!"):
        data = np.frombuffer(word.encode(), np.uint8)
        bucket[word] = int(q._tokens(data, np.array([0, len(data)]))[1][0])
    near = {"a": ["b", "c", "b"], "b": ["a", "c", "a"], "c": ["a", "b", "!!", "c", "!!", "c"], "!!": ["c", "c"]}
    for word, others in near.items():
        total = sum(index[bucket[x]] for x in others)
        assert np.allclose(vectors[bucket[word]], total / np.linalg.norm(total), atol=1e-6)


def test_without_labels(spark, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = q.fit(nothing, none, F.lit(True))
    assert q.score(nothing, model).count() == 0
