import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stackloom.llm import merkle as m

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(row):
    return H("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [H("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((i & 1, level[i ^ 1] if (i ^ 1) < len(level) else None))
        i >>= 1
    return out


def plain(rows, changed):
    """id, leaf, subroot, root, siblings and folded root of every row."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, digest(r)))
        trees[name] = tree([digest(r) for r in groups[name]])
    top = tree([trees[n][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        for i, r in enumerate(groups[name]):
            path = proof(trees[name], i) + proof(top, k)
            node = digest(r | {"n_chars": r["n_chars"] + 1} if changed(r) and r["n_chars"] is not None else r)
            for right, sibling in path:
                node = H(node) if sibling is None else H(sibling + node) if right else H(node + sibling)
            out.append((r["doc_id"], digest(r), trees[name][-1][0], top[-1][0], "".join(s for _, s in path if s), node))
    return out


def ours(df, changed):
    cols = [F.col(c) for c in FIELDS]
    bad = [F.col(c) + F.when(changed, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in FIELDS]
    done = m.manifest(df, F.col("lang"), F.col("doc_id"), m.leaf_digest(*cols), m.leaf_digest(*bad))
    rows = done.select("id", "leaf", "subroot", "root", m.siblings(F.col("path")).alias("s"), "folded_root", "path", "presented").collect()
    for r in rows:
        assert m.fold(r["presented"], r["path"]) == r["folded_root"]
        assert m.fold(r["leaf"], r["path"]) == r["root"]
    return [tuple(r)[:6] for r in rows]


def key(row):
    return tuple(str(x) for x in row)


@pytest.mark.parametrize("height", [1, 2, 12])
def test_equals_a_plain_tree(spark, monkeypatch, height):
    monkeypatch.setattr(m, "HEIGHT", height)
    rng = random.Random(height)
    langs = [None, "", "en", "en", "en", "en", "é", "z", "漢", "\U00010000"]
    rows = []
    for i in range(150):
        lang = "lone" if i == 77 else rng.choice(langs)
        rows.append((i * 3 % 149, rng.choice(["", None, "täxt " * i]), lang, rng.choice(["a", None]), rng.choice([None, 5, i])))
    rows += [(None, None, None, None, None), (None, "x", "en", "a", 1), (3, "same", "en", "a", 1), (3, "same", "en", "a", 1)] + [(-8, "copy", "en", "a", 9)] * 60
    names = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, names).withColumns({c: F.lit(1) for c in ("tree", "pos", "node", "block", "left", "size")}).repartition(3)
    want = plain([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows], lambda r: r["doc_id"] is not None and r["doc_id"] % 7 == 0)
    got = ours(df, F.col("doc_id") % 7 == 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[5] != r[3] for r in got) and any(r[5] == r[3] for r in got)


def test_small_tables(spark, nothing, awkward):
    assert ours(nothing, F.lit(True)) == []
    one = spark.createDataFrame([(1, "t", "en", "s", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = ours(one, F.lit(False))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == ""
    got = ours(awkward, F.col("doc_id") % 2 == 0)
    want = plain([r.asDict() for r in awkward.select(*FIELDS).collect()], lambda r: r["doc_id"] is not None and r["doc_id"] % 2 == 0)
    assert sorted(got, key=key) == sorted(want, key=key)
