import random
from collections import Counter, defaultdict

import pytest
from llm_texts import prose, varied

from stackloom.llm import jaccard
from stackloom.llm.steps import components


def shingles(words, k=5):
    if len(words) < k:
        return {words} if words else set()
    return {words[i : i + k] for i in range(len(words) - k + 1)}


def brute(rows, threshold=0.8):
    classes = defaultdict(set)
    for doc, text in rows:
        classes[tuple((text or "").encode().split())].add(doc)
    rep = {w: min(ids) for w, ids in classes.items()}
    sets = {r: shingles(w) for w, r in rep.items()}
    size = {rep[w]: len(ids) for w, ids in classes.items()}
    links, linked, up = Counter(), Counter(), {r: r for r in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                linked[a] += size[b]
                linked[b] += size[a]
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {(d, rep[w], root(rep[w]), size[rep[w]], links[rep[w]], linked[rep[w]] + size[rep[w]] - 1) for w, own in classes.items() for d in own}


def got(df):
    return {tuple(r) for r in df.select("doc_id", "text_id", "class_id", "n_copies", "n_links", "n_linked_docs").collect()}


@pytest.mark.parametrize("block", [1024, 7])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_TEXTS", block)
    rng = random.Random(block)
    rows, n = [], 0
    for _ in range(6):
        base = prose(rng, rng.choice([4, 30, 150]))
        for _ in range(rng.choice([1, 3, 40])):
            rows.append((n, varied(rng, base, rng.choice([0, 1, 2, 5]))))
            n += 1
    rows += [(n + i, prose(rng, 50)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(jaccard.jaccard_classes(df)) == brute(rows)


def test_awkward_rows(awkward):
    result = jaccard.jaccard_classes(awkward).collect()
    by = {r["doc_id"]: r for r in result}
    assert len(result) == len(by) == 14
    assert by[2]["class_id"] == by[3]["class_id"] == 1 and by[2]["n_copies"] == 2
    assert by[5]["text_id"] == by[4]["text_id"] == by[6]["text_id"] == 4 and by[4]["n_copies"] == 3
    assert by[8]["class_id"] == 7 and by[11]["class_id"] == 11 and by[9]["n_links"] == 0
    kept = jaccard.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 7, 9, 10, 11, 12, 13, 14] and ids.count(None) == 2


def test_empty_table(nothing):
    assert jaccard.jaccard_classes(nothing).count() == 0
    assert jaccard.drop_near_duplicates(nothing).count() == 0


def test_pruning_table():
    need = dict(jaccard.least_agreements(0.8, 1e-8))
    assert 0 < need[20] < need[100] < 80
    assert dict(jaccard.least_agreements(0.8, 0.05))[100] > need[100]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(200, 200), (900, 300)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    found = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {(r["node"], r["root"]) for r in found} == {(x, root(x)) for x in up} and len(found) == len(up)


def test_rows_that_repeat_an_id_are_judged_one_by_one(spark):
    rng = random.Random(12)
    x, y, z = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, x, "a"), (2, x, "b"), (2, y, "c"), (2, y, "c"), (3, varied(rng, y, 1), "d"), (3, z, "e"), (3, z, "f"), (None, x, "g"), (4, None, "h"), (4, "", "i"), (5, z, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string").repartition(3)
    out = [tuple(r) for r in jaccard.drop_near_duplicates(df).collect()]
    assert sorted((str(i), t) for i, t, _ in out if t) == sorted([("1", x), ("2", y), ("3", z), ("None", x)])
    assert len([r for r in out if not r[1]]) == 1 and jaccard.drop_near_duplicates(df).columns == df.columns
    assert {tuple(r) for r in jaccard.drop_near_duplicates(df.repartition(7)).collect()} == set(out)
