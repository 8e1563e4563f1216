import random

import pytest
from llm_texts import prose, varied

from stackloom.llm import phrases


def brute(rows, window=13):
    first: dict[tuple, int] = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        if doc is not None:
            for i in range(len(words) - window + 1):
                if first[tuple(words[i : i + window])] < doc:
                    gone |= set(range(i, i + window))
        left = [w for i, w in enumerate(words) if i not in gone]
        out.append((doc, len(words), len(words) - len(left), b" ".join(left).decode()))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["doc_id"], r["_n_words"], r["_n_removed"], r["text"]) for r in df.collect()), key=repr)


def sample(seed):
    rng = random.Random(seed)
    shared = [prose(rng, n) for n in (12, 13, 14, 40, 80)]
    rows = []
    for i in range(90):
        parts = [rng.choice(shared) if rng.random() < 0.4 else prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(0, 5))]
        text = " ".join(parts)
        rows.append((i, varied(rng, text, rng.choice([0, 0, 1, 3])) if text else text))
    rows += [(100 + i, rows[i][1]) for i in range(0, 20)]
    rows += [(130, "same " * 200), (131, "same " * 40), (132, "same " * 12), (133, "a b " * 30), (134, "b a " * 9)]
    return rows


@pytest.mark.parametrize("hot", [5000, 2])
@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, hot, small):
    if small:
        monkeypatch.setattr(phrases, "SHARD_BYTES", 200)
        monkeypatch.setattr(phrases, "SHARD_PATTERNS", 5)
        monkeypatch.setattr(phrases, "HEAVY", 3)
    monkeypatch.setattr(phrases.repeated_ranges, "__defaults__", ("doc_id", "text", 13, hot, None))
    rows = sample(hot)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(phrases.remove_repeats(df, rejoin=True)) == brute(rows)


def test_awkward_rows(awkward):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    cut = phrases.remove_repeats(awkward, rejoin=True)
    assert got(cut) == brute(rows)
    kept = phrases.drop_repeats(awkward)
    assert kept.columns == awkward.columns
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert (4, None) in texts and (6, " \t\n") in texts and (9, dict(rows)[9]) in texts and 2 not in {d for d, _ in texts}


@pytest.mark.parametrize("hot", [5000, 1])
def test_rows_that_repeat_an_id_are_judged_one_by_one(spark, monkeypatch, hot):
    monkeypatch.setattr(phrases.repeated_ranges, "__defaults__", ("doc_id", "text", 13, hot, None))
    rng = random.Random(8)
    p, other, tail = prose(rng, 40), prose(rng, 60), prose(rng, 20)
    rows = [(1, p), (5, p), (5, other), (5, other), (5, tail + " " + p), (5, p[:-1]), (7, other), (7, None), (7, ""), (None, p)] + [(9, p)] * 30
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = got(phrases.remove_repeats(df, rejoin=True))
    assert found == brute(rows)
    assert (5, 60, 0, other) in found


def test_names_that_clash(spark):
    rng = random.Random(9)
    p = prose(rng, 30)
    names = ["_id", "_ranges", "_n_words", "_N_removed", "_t", "h", "marks", "low", "digest", "a b"]
    rows = [(1, p, *names), (2, p + " x", *names), (2, "y", *names)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    cut = phrases.remove_repeats(df)
    assert cut.columns == [*df.columns, "_n_words_", "_n_removed_"]
    assert sorted(r["text"] for r in cut.collect()) == sorted([p, "x", "y"])
    kept = phrases.drop_repeats(df)
    assert kept.columns == df.columns and kept.count() == 3 and kept.first()["_ranges"] == "_ranges"


def test_windows_of_one_hash_are_told_apart(spark, monkeypatch):
    """With a hash that tells nothing apart the words decide."""
    monkeypatch.setattr(phrases, "gram_hashes", lambda words, k: (lambda h, at: (h * 0, at))(*real(words, k)))
    from stackloom.llm.words import gram_hashes as real

    words = phrases._number_words(phrases.pa.array(["a b c d", "b c d e", "a b c"]))
    at, owner = phrases._confirmed(words, phrases.np.array([3, 1, 2]), phrases.np.array([3, 1, 2]), 3)
    assert sorted((words.row[a], a - words.first[words.row[a]], o) for a, o in zip(at.tolist(), owner.tolist(), strict=True)) in (
        [(0, 0, 2), (0, 1, 1)], [(0, 0, 2), (1, 0, 1)], [(0, 1, 1), (2, 0, 2)], [(1, 0, 1), (2, 0, 2)]
    )


def test_empty_table(nothing):
    assert phrases.remove_repeats(nothing).count() == 0
