import random

import numpy as np
import pyarrow as pa

from stackloom.llm import words as w

TEXTS = ["a b c", "", None, "  x\ty\n a b c ", "x" * 9, "é 漢 b", "a b c d"]


def test_words_are_those_of_split():
    for limit in (1, 7, 1 << 20):
        got = []
        for low, high, data, offsets in w.text_slices(pa.array(TEXTS), limit):
            found = w.find_words(data, offsets)
            for r in range(high - low):
                part = range(found.first[r], found.first[r + 1])
                got.append([bytes(data[found.start[i] : found.end[i]]) for i in part])
        assert got == [(t or "").encode().split() for t in TEXTS]


def test_equal_words_have_equal_hashes_in_any_slice():
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["ab", "ba", "abc", "c"]) for _ in range(rng.randint(0, 50))) for _ in range(40)]
    known: dict[bytes, int] = {}
    for limit in (1, 100, 1 << 20):
        for _, _, data, offsets in w.text_slices(pa.array(texts), limit):
            found = w.find_words(data, offsets)
            for a, b, h in zip(found.start, found.end, found.hash, strict=True):
                assert known.setdefault(bytes(data[a:b]), int(h)) == int(h)
    assert len(set(known.values())) == len(known)


def test_grams_do_not_cross_texts():
    _, _, data, offsets = next(w.text_slices(pa.array(["a b c", "a b", "c a b c"])))
    h, at = w.gram_hashes(w.find_words(data, offsets), 3)
    assert at.tolist() == [0, 5, 6] and h[0] == h[2] != h[1]


def test_whole_groups_keep_groups_together():
    keys = np.sort(np.random.default_rng(0).integers(0, 40, 1000))
    batches = pa.Table.from_arrays([pa.array(keys), pa.array(np.arange(1000))], names=["k", "v"]).to_batches(37)
    tables = list(w.whole_groups(iter(batches), ["k"], 1500))
    assert len(tables) > 3
    seen = [set(t.column("k").to_pylist()) for t in tables]
    assert sum(map(len, seen)) == len(set(keys.tolist()))
    assert [x for t in tables for x in t.column("v").to_pylist()] == list(range(1000))


def letters(text):
    data, offsets = w.lowered(pa.array(text if isinstance(text, list) else [text]))
    found = w.find_words(data, offsets, w.ALNUM_BYTES)
    return [bytes(data[a:b]).decode() for a, b in zip(found.start, found.end, strict=True)]


def test_letters_beyond_ascii():
    assert letters("a b—c “Über” ét naïve 한국어 4٣") == ["a", "b", "c", "über", "ét", "naïve", "한국어", "4٣"]
    assert letters("機械学習。ab語x") == [*"機械学習", "ab", "語", "x"]
    assert letters("ที่กา \U00020000\U00020001") == ["ที่", "ก", "า", "\U00020000", "\U00020001"]
    # a mark does not reach into the text before it
    assert letters(["é", "́a", "漢", "字"]) == ["é", "a", "漢", "字"]
