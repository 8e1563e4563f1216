import random

import numpy as np
import pyarrow as pa
from llm_texts import prose

from stackloom.llm import tiling


def brute_tile(p, t, k):
    """Greedy string tiling, word by word."""
    mp, mt, tiles = [False] * len(p), [False] * len(t), 0
    while True:
        best, found = k - 1, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= k:
                    found.append((i, j))
        if best < k:
            return sum(mp), tiles
        for i, j in sorted(found):
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = [True] * best
                mt[j : j + best] = [True] * best
                tiles += 1


def test_tiles_equal_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        words = [str(x) for x in range(rng.choice([2, 3, 30]))]
        p = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        t = [rng.choice(words) for _ in range(rng.randint(0, 20))] + p[5:15] + [rng.choice(words)] + p[:6]
        k = rng.choice([2, 3, 5])
        block = tiling.make_block([1], [" ".join(p)], k)
        rows = list(tiling._found(block, pa.array([" ".join(t)]), k, 0.0001)) if len(block.seed) else []
        covered, tiles = brute_tile(p, t, k)
        assert rows == ([(0, 0, len(p), covered, tiles)] if covered else [])


def test_reordered_passages_and_word_forms(spark):
    rng = random.Random(4)
    item = prose(rng, 40).split()
    moved = [*prose(rng, 30).split(), *item[20:], *prose(rng, 9).split(), *item[:20]]
    rows = [
        (1, " ".join(item)),
        (2, " ".join(moved).upper().replace(" ", ", ")),
        (3, " ".join(item[:23])),
        (4, " ".join(item[:24])),
        (5, prose(rng, 300)),
        (6, None),
        (7, ""),
        (7, " ".join(item)),
        (None, " ".join(item)),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    items = [(10, " ".join(item)), (10, " ".join(item)), (11, "too short here"), (12, None), (None, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = tiling.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"] or -1, r["item_id"], r["covered_words"], r["tiles"]) for r in found) == [
        (-1, 10, 40, 1),
        (1, 10, 40, 1),
        (2, 10, 40, 2),
        (4, 10, 24, 1),
        (7, 10, 40, 1),
    ]
    kept = tiling.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted((d, t or "") for d, t in rows if d in (3, 5, 6) or (d == 7 and not t))


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(rng, 20)) for i in range(30)]
    docs = spark.createDataFrame([(i, prose(rng, 10) + " " + items[i][1]) for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, bench).collect()}
    monkeypatch.setattr(tiling, "BLOCK_BYTES", 900)
    assert whole == {(r["doc_id"], r["item_id"]) for r in tiling.contaminated(docs, bench).collect()} == {(i, i) for i in range(30)}


def test_empty_tables(spark, nothing, awkward):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert tiling.contaminated(nothing, bench).count() == 0
    assert tiling.contaminated(awkward, bench.limit(0)).count() == 0
    assert tiling.contaminated(awkward, bench).count() == 0
    assert tiling.drop_contaminated(awkward, bench.limit(0)).count() == awkward.count()
    assert np.array_equal(tiling.make_block([], [], 5).first, [0])


def test_unspaced_scripts_and_short_items(spark):
    item, thai = "中国的首都是哪里？北京是中国的首都。", "กรุงเทพมหานครเป็นเมืองหลวง"
    items = [(1, item), (2, "Quite short"), (3, "“seven words”—that end at dashes"), (4, thai), (5, "東京")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, f"问题：{item}完"), (2, "it is quite SHORT, yes"), (3, "seven words that end at dashes"), (4, f"ก่อน{thai}หลัง"), (5, "quite not short"), (6, "東の京"), (7, "在東京站")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in tiling.contaminated(docs, bench).collect()}
    assert found == {(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (7, 5): 1}
    assert sorted(r["doc_id"] for r in tiling.drop_contaminated(docs, bench).collect()) == [5, 6]
