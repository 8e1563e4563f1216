"""Words of Arrow text columns as numpy arrays: positions, documents and 64-bit hashes, without a Python object a word.

A word is a run of bytes that are not white space (``[^\\x20\\x09-\\x0D]+``).  Hashes are polynomials over the bytes
modulo 2**64 that are mixed at the end; they depend on nothing but the bytes, so they agree between machines and runs.
"""

from __future__ import annotations

import ctypes
import functools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_PIECE = 1 << 20
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: Letters and digits.  Given this table, ``find_words`` tells characters beyond ASCII by their Unicode class.
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Scripts without spaces between words, of which each character is a word.
UNSPACED = (
    *((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x1B00, 0x1B7F), (0x2E80, 0x2FDF), (0x3005, 0x3007)),
    *((0x3021, 0x3029), (0x3040, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0xA4CF), (0xA980, 0xA9FF), (0xAA60, 0xAA7F)),
    *((0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x16FE0, 0x18DFF), (0x1AFF0, 0x1B2FF), (0x20000, 0x3FFFF)),
)
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """Words of a slice of rows: byte range in ``data``, row (from 0 in the slice) and hash of each."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each row and one more: index of its first word


def tidy(run):
    """``run`` for mapInArrow, after which freed memory goes back to the system: workers are kept for later stages."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(29))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(32))


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of texts; nulls are empty texts."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column: pa.Array, limit: int = 1 << 21, rows: int = 1024) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of slices of about ``limit`` bytes; nulls are empty texts.

    A longer text is a slice of its own.  Only ``rows`` rows are copied at a time.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for base in range(0, len(column), rows):
        data, offsets = _buffers(column.slice(base, rows))
        low, n = 0, len(offsets) - 1
        while low < n:
            high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1))
            yield base + low, base + high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of lower-cased texts; nulls are empty texts."""
    return _buffers(pc.utf8_lower(column.fill_null(""))) if len(column) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))


def _power_tables(size: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < size:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.ones(max(size, _PIECE + 1), dtype=U)
            table[1:] = U(base & (1 << 64) - 1)
            tables.append(np.cumprod(table, dtype=U))
        _powers[:] = tables
    return _powers


def _hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for ranges that lie in order and don't overlap."""
    out = np.empty(len(start), dtype=U)
    low = 0
    while low < len(start):
        base = int(start[low])
        high = max(low + 1, int(np.searchsorted(end, base + _PIECE, side="right")))
        piece = data[base : int(end[high - 1])]
        power, inverse = _power_tables(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum((piece.astype(U) + U(1)) * power[: len(piece)], dtype=U, out=sums[1:])
        a, b = start[low:high] - base, end[low:high] - base
        out[low:high] = (sums[b] - sums[a]) * inverse[a]
        low = high
    return mix(out + (end - start).astype(U))


@functools.cache
def _characters() -> np.ndarray:
    """Kind of each character: 0 none of a word, 1 letter or digit, 2 of a script without spaces, 3 mark."""
    of = {"L": 1, "N": 1, "M": 3}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    for low, high in UNSPACED:
        part = out[low : high + 1]
        part[part == 1] = 2
    return out


def letter_kinds(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Kind of each byte: 0 between words, 1 letters and digits, and 2 and 3 in turn for characters that are words alone.

    Marks belong to the character before them; at the start of a text or after what is no letter they are no part of a word.
    """
    kind = ALNUM_BYTES[data].astype(np.uint8)
    lead = np.flatnonzero(data >= 0xC0)
    kind[data >= 0x80] = 0
    if not len(lead):
        return kind
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    code = (data[lead] & np.array([0x1F, 0x0F, 0x07])[size - 2]).astype(np.int64)
    for j in (1, 2, 3):
        code = np.where(j < size, code << 6 | data[np.minimum(lead + j, len(data) - 1)] & 0x3F, code)
    own = _characters()[np.minimum(code, 0x10FFFF)]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[offsets] = True
    mark, begin = own == 3, begins[lead]
    follows = np.zeros(len(lead), dtype=bool)
    follows[1:] = (lead[:-1] + size[:-1] == lead[1:]) & ~begin[1:]
    # a mark takes the kind of the character that heads its run
    head = ~(mark & follows)
    before = np.where(begin, 0, kind[np.maximum(lead - 1, 0)])
    of_head = np.where(mark, before, np.where(own == 2, 2 + np.cumsum(head) % 2, own))
    of = of_head[np.maximum.accumulate(np.where(head, np.arange(len(lead)), 0))].astype(np.uint8)
    for j in range(4):
        kind[lead[j < size] + j] = of[j < size]
    return kind


def find_words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = WORD_BYTES) -> Words:
    """Runs of bytes of one kind: ``is_word`` gives the kind of each byte, 0 (or False) between words."""
    kind = letter_kinds(data, offsets) if is_word is ALNUM_BYTES else is_word[data]
    inside = kind > 0
    rows = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, none, none.astype(U), np.zeros(rows + 1, np.int64))
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin = inside.copy()
    new = kind[1:] != kind[:-1]
    begin[1:] &= new
    begin[edges] = inside[edges]
    stop = inside.copy()
    stop[:-1] &= new
    stop[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, row, _hash_ranges(data, start, end), np.searchsorted(row, np.arange(rows + 1)))


def gram_hashes(words: Words, k: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position at which k words of one row start, and those positions."""
    n = len(words.hash) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    h = words.hash[:n].copy()
    for j in range(1, k):
        h *= U(base)
        h += words.hash[j : j + n]
    at = np.flatnonzero(words.row[:n] == words.row[k - 1 :])
    return mix(h[at]), at


def sequence_hashes(words: Words, base: int) -> np.ndarray:
    """One hash of each row's whole word sequence."""
    n = len(words.hash)
    index = np.arange(n) - words.first[words.row]
    power = np.ones(int(index.max(initial=0)) + 2, dtype=U)
    power[1:] = U(base)
    power = np.cumprod(power, dtype=U)
    sums = np.zeros(n + 1, dtype=U)
    np.cumsum(mix(words.hash ^ U(base)) * power[index + 1], dtype=U, out=sums[1:])
    count = np.diff(words.first)
    return mix(sums[words.first[1:]] - sums[words.first[:-1]] + count.astype(U))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], size: int = 1 << 24) -> Iterator[pa.Table]:
    """Joins and cuts batches that are sorted by ``keys`` into tables of about ``size`` bytes that hold whole groups."""
    kept: list[pa.Table] = []
    held = 0

    def cut(table: pa.Table) -> int:
        """Row at which the last group begins."""
        n = table.num_rows
        low = 0
        for key in keys:
            column = table.column(key).combine_chunks()
            values = column.slice(low)
            same = np.asarray(pc.equal(values, values[len(values) - 1]).fill_null(False))
            differ = np.flatnonzero(~same)
            low += int(differ[-1]) + 1 if len(differ) else 0
        return low if n else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(pa.Table.from_batches([batch]))
        held += batch.nbytes
        if held >= size:
            table = pa.concat_tables(kept).combine_chunks()
            at = cut(table)
            if at:
                yield table.slice(0, at)
                # a copy, so that the part that was given away can be freed
                rest = table.slice(at)
                kept = [rest.take(pa.array(np.arange(rest.num_rows)))]
            else:
                kept = [table]
            held = kept[0].nbytes if at else 0  # a group of over the size is joined again only after as much more
    if kept:
        yield pa.concat_tables(kept).combine_chunks()


def group_bounds(*columns: np.ndarray) -> np.ndarray:
    """First row of each group of sorted key columns, and the number of rows at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
