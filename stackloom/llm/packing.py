"""Packing of token sequences: bounded-space online packing with best fit.

Each partition streams its documents into at most ``OPEN`` open windows.  Whole windows are cut off a long document at
once; what is left goes to the open window with the least space that holds it.  If none does and all windows are open,
the fullest is filled up by a cut, emitted, and the rest is placed again.  Windows that are still open at the end are
leftovers: they are merged in rounds, ``FAN_IN`` partitions to a group, until one group is left, whose last window is cut
into sequences of a power of two tokens, which need no padding.  A task holds the open windows and one slice of texts.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.llm.steps import written
from stackloom.llm.words import tidy

LENGTH = 2048
OPEN = 16
FAN_IN = 64
END_ID = 1
PIECE_CHARS = 1 << 20

# Fixed value: the pre-tokenisation pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, ids binary"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Token ids of a tokenizers file.

    The same merges run faster in another library, which is used for texts without special tokens once both agree on a
    probe; the file's own library does the rest, and is loaded again only if there is such a text.
    """

    PROBE = "Déjà vu:  it's 12\t<b>\n\n naïve — «ok» 日本語 \U0001f600 zzz'll  \n x" + " the of and" * 3

    def __init__(self, path: str):
        self.path, self.slow = path, None
        tokenizer = self._tokenizer()
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._same_merges(tokenizer.get_vocab())
        if self.fast is not None and self.fast.encode_ordinary(self.PROBE) != self._own(self.PROBE):
            self.fast = None
        self.slow = None if self.fast is not None else tokenizer

    def _tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
        return self.slow

    def _same_merges(self, vocabulary: dict[str, int]):
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        try:
            ranks = {bytes(letter[c] for c in t): i for t, i in vocabulary.items() if t not in self.special}
            return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None

    def _own(self, text: str) -> list[int]:
        return self._tokenizer().encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self._own(text), dtype=np.uint32)
        if len(text) <= PIECE_CHARS:
            return np.array(self.fast.encode_ordinary(text), dtype=np.uint32)
        parts, low = [], 0
        # a token never reaches over the boundary before a lone space between letters
        while low < len(text):
            m = re.compile(r"[^\W\d_] [^\W\d_]").search(text, low + PIECE_CHARS)
            high = m.start() + 1 if m else len(text)
            parts.append(np.array(self.fast.encode_ordinary(text[low:high]), dtype=np.uint32))
            low = high
        return np.concatenate(parts)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Packer:
    """Open windows of one partition or group.  A piece is (doc_id, start, doc_tokens, ids)."""

    def __init__(self, length: int, open_windows: int, first_id: int, emit: Callable):
        self.length, self.most, self.next_id, self.emit = length, open_windows, first_id, emit
        self.open: list[list] = []  # [space, pieces]

    def _finish(self, pieces: list) -> None:
        self.emit(self.next_id, pieces)
        self.next_id += 1

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.length:
            self._finish([(doc, start, total, ids[: self.length])])
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = [w for w in self.open if w[0] >= len(ids)]
            if fits:
                window = min(fits, key=lambda w: w[0])
                take = len(ids)
            elif len(self.open) < self.most:
                window, take = [self.length, []], len(ids)
                self.open.append(window)
            else:
                window = min(self.open, key=lambda w: w[0])
                take = window[0]
            window[0] -= take
            window[1].append((doc, start, total, ids[:take]))
            start, ids = start + take, ids[take:]
            if not window[0]:
                self.open = [w for w in self.open if w is not window]
                self._finish(window[1])


def _rows(sequence, pieces, part, keep: bool) -> list[tuple]:
    out, offset = [], 0
    for doc, start, total, ids in pieces:
        raw = ids.astype("<u4").tobytes()
        out.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, part, raw if keep else None))
        offset += len(ids)
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _first_pass(path: str, length: int, open_windows: int, end_id: int, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, done = encoder(path), []
        packer = Packer(length, open_windows, part << 33, lambda s, pieces: done.extend(_rows(s, pieces, None, keep)))
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(enc.encode(text.as_py() or ""), np.uint32(end_id))
                packer.add(doc.as_py(), 0, len(ids), ids)
                if len(done) >= 4096:
                    yield _batch(done)
                    done.clear()
        for i, (_, pieces) in enumerate(packer.open):
            done.extend(_rows(i, pieces, part, True))
        if done:
            yield _batch(done)

    return run


def _merge_pass(length: int, level: int, last: bool, keep: bool):
    """Merges the leftovers of each group of ``FAN_IN``; the last group's rest is cut into powers of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        group, packer = None, None

        def finish() -> None:
            if packer is None:
                return
            for _, pieces in packer.open:
                if not last:
                    done.extend(_rows(0, pieces, group, True))
                    continue
                rest = sum(len(p[3]) for p in pieces)
                while rest:
                    room, taken = 1 << (rest.bit_length() - 1), []
                    rest -= room
                    while room:
                        doc, start, total, ids = pieces.pop(0)
                        taken.append((doc, start, total, ids[:room]))
                        if len(ids) > room:
                            pieces.insert(0, (doc, start + room, total, ids[room:]))
                        room -= len(taken[-1][3])
                    packer._finish(taken)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("grp", "doc_id", "start", "doc_tokens", "ids"))
            for g, doc, start, total, raw in zip(*columns, strict=True):
                if g != group:
                    finish()
                    group = g
                    first = (level << 56) | (g << 33)
                    packer = Packer(length, 1, first, lambda s, pieces: done.extend(_rows(s, pieces, None, keep)))
                packer.add(doc, start, total, np.frombuffer(raw, dtype="<u4"))
            if done:
                yield _batch(done)
                done.clear()
        finish()
        if done:
            yield _batch(done)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    open_windows: int = OPEN,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ``ids``: uint32, little-endian).

    A document's tokens are those of ``tokenizer`` (a file of the tokenizers library) and then ``end_id``; each lies in
    exactly one piece.  Sequences hold ``length`` tokens but for a few of the last ones, which hold a power of two.
    Defined results: a null text is an empty one and has ``end_id`` alone; rows without an id or with a repeated one are
    packed as rows of their own; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(base.mapInArrow(tidy(_first_pass(tokenizer, length, open_windows, end_id, with_ids)), _SCHEMA))
    done, left = [pieces.filter("part IS NULL")], pieces.filter("part IS NOT NULL")
    groups = pieces.agg(F.max("part")).first()[0]
    level = 0
    while groups is not None:
        level, last, groups = level + 1, groups < FAN_IN, groups // FAN_IN
        dealt = left.withColumn("grp", F.floor(F.col("part") / FAN_IN)).repartition("grp")
        dealt = dealt.sortWithinPartitions("grp", "part", "sequence_id", "offset").drop("part")
        merged = written(dealt.mapInArrow(tidy(_merge_pass(length, level, last, with_ids)), _SCHEMA))
        done.append(merged.filter("part IS NULL"))
        left = merged.filter("part IS NOT NULL")
        if last:
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("part") if with_ids else out.drop("part", "ids")
