import zlib
from collections import defaultdict

import numpy as np
import pytest

from stackloom.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def check(rows, pieces, length):
    """Every id in exactly one piece, sequences without gaps, padding nowhere but in none."""
    enc = packing.encoder(PATH)
    wanted = sorted(np.append(np.array(enc._own(t or ""), np.uint32), np.uint32(1)).tobytes() + repr(d).encode() for d, t in rows)
    own = defaultdict(list)
    for p in pieces:
        own[p["doc_id"]].append(p)
        raw = np.frombuffer(p["ids"], "<u4")
        assert len(raw) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
    ids = []
    for doc, part in own.items():
        part.sort(key=lambda p: (p["doc_tokens"], p["start"]))
        starts = [i for i, p in enumerate(part) if p["start"] == 0]
        if len(starts) == 1:
            whole = b"".join(p["ids"] for p in part)
            assert [p["start"] for p in part] == np.cumsum([0, *(p["length"] for p in part[:-1])]).tolist()
            assert len(whole) == 4 * part[0]["doc_tokens"]
            ids.append(whole + repr(doc).encode())
    assert set(ids) <= set(wanted)
    total = sum(len(enc._own(t or "")) + 1 for _, t in rows)
    assert sum(p["length"] for p in pieces) == total
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist()
        size = sum(n for _, n in parts)
        assert size == length or size & (size - 1) == 0
    return sequences


@pytest.mark.parametrize(("fan_in", "parts", "open_windows"), [(64, 3, 16), (2, 9, 2), (3, 1, 1)])
def test_pieces_cover_all_ids(spark, monkeypatch, tmp_path, fan_in, parts, open_windows):
    monkeypatch.setattr(packing, "FAN_IN", fan_in)
    rows = [(i, f"text {i} " + "some words of it, " * (i * 7 % 50)) for i in range(60)] + [(99, "<|endoftext|> plain"), (100, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts).write.parquet(path)
    df = packing.pack_documents(spark.read.parquet(path), PATH, length=64, open_windows=open_windows, with_ids=True)
    sequences = check(rows, [r.asDict() for r in df.collect()], 64)
    full = sum(1 for p in sequences.values() if sum(n for _, n in p) == 64)
    assert len(sequences) - full <= 6


def test_awkward_rows(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    pieces = packing.pack_documents(awkward, PATH, with_ids=True).collect()
    check(rows, [r.asDict() for r in pieces], 2048)
    assert packing.pack_documents(nothing, PATH).count() == 0


def test_long_texts_are_cut_between_tokens(monkeypatch):
    enc = packing.encoder(PATH)
    assert enc.fast is not None
    text = ("Some words, 12 of  them: don't\n\n " * 40) + "ünïcödé 漢字 text " * 30
    whole = enc.encode(text).tolist()
    monkeypatch.setattr(packing, "PIECE_CHARS", 50)
    assert enc.encode(text).tolist() == whole == enc._own(text)
