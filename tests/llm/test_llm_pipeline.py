import random

import numpy as np
import pytest
from llm_texts import prose, varied

import corpus_pipeline
from stackloom.llm import packing
from stackloom.llm.queries import ORACLES, QUERIES

pytest.importorskip("public_tokenizers")
STEMS = ["vermin", "grotz"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables in which it is known what every stage must do."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.randint(30, 80))
        if i % 4 == 0:
            text = " ".join(w if rng.random() > 0.1 else rng.choice(STEMS) + str(rng.randint(0, 99)) for w in text.split()) + " grotzing"
        rows.append((i, text))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = [r for r in rows if r[0] % 4]
    passage, items = prose(rng, 60), [(n, prose(rng, 25)) for n in range(4)]
    rows += [(1000, clean[0][1]), (1001, varied(rng, clean[1][1] + " " + prose(rng, 80), 0))]
    rows += [(1002, rows[-1][1].rsplit(" ", 1)[0] + " other")]
    rows += [(1003, prose(rng, 30) + " " + passage), (1004, passage + " " + prose(rng, 30)), (1005, passage)]
    half = items[0][1].split()
    rows += [(1006, prose(rng, 20) + " " + " ".join(half[13:]) + " " + prose(rng, 8) + " " + " ".join(half[:13]))]
    rows += [(1007, None), (1008, ""), (None, prose(rng, 20)), (1004, rows[-3][1])][:3]
    path = tmp_path_factory.mktemp("tables")
    frame = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), dict(rows), passage


def test_stages(spark, folder):
    path, texts, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").cache()
    before = {r["doc_id"] for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "substring_dedup", "decontamination", "packing"]

    kept = stages["toxicity"](spark, docs, path)
    assert kept.schema == docs.schema
    left = {r["doc_id"] for r in kept.collect()}
    toxic = {i for i in range(0, 300, 4)}
    assert len(toxic & left) <= 4 and len((before - toxic) - left) <= 4

    kept = stages["ngram_jaccard"](spark, docs, path)
    assert kept.columns == docs.columns
    left = {r["doc_id"] for r in kept.collect()}
    assert before - left == {1000, 1002, 1008}

    cut = stages["substring_dedup"](spark, docs, path)
    assert cut.columns == docs.columns
    now = {r["doc_id"]: r for r in cut.collect()}
    assert before - set(now) == {1000, 1005}
    assert passage in now[1003]["text"] and passage.split()[20] not in now[1004]["text"]
    assert all(r["n_chars"] == len(r["text"] or "") for r in now.values()) and now[1003]["text"] == texts[1003]

    kept = stages["decontamination"](spark, docs, path)
    assert before - {r["doc_id"] for r in kept.collect()} == {1006}


def test_run_packs_what_is_left(spark, folder):
    path, texts, _ = folder
    pieces = corpus_pipeline.run(spark, path).collect()
    ids = {r["doc_id"] for r in pieces}
    assert not ids & {1000, 1002, 1005, 1006, 1008} and {1003, 1004, None} <= ids
    tokens = len(packing.encoder(corpus_pipeline.byte_bpe()).encode(texts[1003])) + 1
    assert sum(r["length"] for r in pieces if r["doc_id"] == 1003) == tokens
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
