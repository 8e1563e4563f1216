import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.llm import collocations as c
from stackloom.llm import quotient as q


def plain(rows, least, top, absorb=100):
    """The rules of ``collocations`` in plain Python, on (lang, text) rows."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in candidates.items():
        if any(o == lang and len(x) > len(p) and 100 * b >= absorb * a and any(x[i : i + len(p)] == p for i in range(len(x) - len(p) + 1)) for (o, x), b in candidates.items()):
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, p[:k]], f[lang, p[k:]]
            cuts.append((1000 * a * total[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, " ".join(p), a, l, r, total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen, ranked = Counter(), []
    for row in out:
        seen[row[0]] += 1
        if seen[row[0]] <= top:
            ranked.append((row[0], seen[row[0]], *row[1:]))
    return ranked


def ours(df, least, top, absorb=100):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r[x] for x in names) for r in c.collocations(df, least, top, absorb).collect())


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["New", "york", "of", "the", "THE", "é", "Éa", "漢字", "x\x01", "x", "x\x01y", " ", "co-op", "1"]
    fixed = ["new york", "the end of the day", "of the x", "x x x x x x"]
    rows = []
    for i in range(300):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 40))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "; "]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", "und", None, ""]), rng.choice([text] * 9 + [None, ""]), i))
    return rows + rows[:20] + [("en", "the end " * 9000, 0), ("de", "very very long text without end , " * 9000, 1)]


def frame(spark, rows):
    extra = {x: F.lit(1) for x in ("ids", "f", "word", "id", "n", "k", "a", "shard", "filter", "rank", "phrase")}
    return spark.createDataFrame(rows, "lang string, text string, doc_id long").withColumns(extra).repartition(3)


@pytest.mark.parametrize("shared", [True, False])
def test_equals_plain_counting(spark, monkeypatch, shared):
    if not shared:
        monkeypatch.setattr(c, "SHARED_WORDS", 0)
        monkeypatch.setattr(c, "_BLOCK", 1000)
    rows = corpus()
    pairs = [(lang, text) for lang, text, _ in rows]
    df = frame(spark, rows)
    assert ours(df, 5, 2000) == plain(pairs, 5, 2000)
    assert ours(df, 20, 3, 50) == plain(pairs, 20, 3, 50)


def test_small_memory_and_a_full_bitmap_change_nothing(spark, monkeypatch):
    rows = corpus(2)
    df, want = frame(spark, rows), plain([r[:2] for r in rows], 4, 2000)
    monkeypatch.setattr(c, "PAIR_BITS", 64)
    monkeypatch.setattr(c, "_SLICE", 200)
    monkeypatch.setattr(c, "_HELD", 50)
    assert ours(df, 4, 2000) == want


def test_empty_and_awkward_tables(spark, nothing, awkward):
    assert ours(nothing, 1, 5) == []
    assert ours(spark.createDataFrame([("en", None), (None, "...")], "lang string, text string"), 1, 5) == []
    rows = [(r["lang"], r["text"]) for r in awkward.collect()]
    assert ours(awkward, 3, 50) == plain(rows, 3, 50)


@pytest.mark.parametrize(("largest", "shard_bits"), [(1, 2), (300, 5), (70_000, 9), ((1 << 25) - 1, 16), ((1 << 31) + 7, 3), ((1 << 38) - 1, 4)])
def test_filters_are_lossless(largest, shard_bits):
    rng = np.random.default_rng(largest)
    form = q.layout(largest, shard_bits)
    ids = rng.integers(1, largest, (4000, 5), endpoint=True)
    ids[:1500] = ids[rng.integers(0, 40, 1500)]
    ids[rng.random(4000) < 0.3, 4] = 0
    ids[rng.random(4000) < 0.2, 2:] = 0
    lanes = q.pack(ids, form)
    assert all((lane <= q._mask(form.width)).all() for lane in lanes)
    assert (q.unpack(q.restore(q.permute(lanes, form), form), form) == ids).all()
    mergers, size, filters = {}, 0, 0
    for part in np.array_split(ids, 3):
        counter = q.Counter(form, limit=700)
        found = [x for rows in np.array_split(part, 9) for x in counter.add(rows)] + list(counter.filters())
        for shard, data in found:
            mergers.setdefault(shard, q.Merger(shard, form)).add(data)
            size, filters = size + len(data), filters + 1
    got = Counter()
    for merger in mergers.values():
        for row, n in zip(*merger.counts(1), strict=True):
            got[tuple(row)] += int(n)
    assert got == Counter(map(tuple, ids))
    # an entry takes its full key, less what its place says, and its count
    assert size <= 4000 * (form.lanes * -(-form.width // 8) + 2) + filters * 8


def test_large_counts_and_too_many_ids():
    form = q.layout(9, 2)
    lanes, counts = q.combine(q.permute(q.pack(np.array([[1, 2], [3, 4]]), form), form), np.array([10**12, 254]))
    for lane0, n in zip(lanes[0], counts, strict=True):
        at = int(np.flatnonzero(lanes[0] == lane0)[0])
        one = [lane[at : at + 1] for lane in lanes]
        shard = int(lane0) >> (form.width - 2)
        back, count = q.decode(q.encode(one, np.array([n]), form), shard, form)
        assert count.tolist() == [n] and all((a == b).all() for a, b in zip(back, one, strict=True))
    with pytest.raises(ValueError):
        q.layout(1 << 39, 2)


def test_scores_beyond_64_bits(spark, monkeypatch):
    words = spark.createDataFrame([(1, "en", "a", 3 * 10**12, 9 * 10**12), (2, "en", "b", 4 * 10**12, 9 * 10**12)], "id long, lang string, word string, f long, n long")
    found = spark.createDataFrame([([1, 2], 2 * 10**12)], "ids array<long>, f long")
    monkeypatch.setattr(c, "phrase_counts", lambda *_: (words, found))
    want = 1000 * 2 * 10**12 * 9 * 10**12 // (12 * 10**24)
    assert ours(words, 1, 5) == [("en", 1, "a b", 2 * 10**12, 3 * 10**12, 4 * 10**12, 9 * 10**12, want)]
