"""Counting quotient filters of packed n-grams: exact counters in little more than the bits that tell keys apart.

A key is ``SLOTS`` word ids of ``bits`` bits each (0 where there is no word), laid out over ``lanes`` numbers of ``width`` bits.
A Feistel network permutes the keys, which spreads them evenly and can be undone.  The leading bits of a permuted key are its
shard, the next ones its quotient; a filter holds, in order of the keys of one shard, how many keys each quotient has (in
unary, one bit a key and one a quotient), the full remainders and the counts.  So nothing is lost: equal keys are equal
n-grams, and the ids can be read back from a filter.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

from stackloom.llm.words import U, mix

SLOTS = 5
_ROUNDS = 4
_LEAST_WIDTH = 32


class Layout(NamedTuple):
    """How ids of ``bits`` bits become keys of ``lanes`` numbers of ``width`` bits, and how many bits name the shard."""

    bits: int
    lanes: int
    width: int
    shard_bits: int


def layout(largest_id: int, shard_bits: int) -> Layout:
    bits = max(1, int(largest_id).bit_length())
    lanes = 2 if SLOTS * bits <= 128 else 3
    if SLOTS * bits > 192 or shard_bits >= _LEAST_WIDTH:
        raise ValueError(f"{largest_id} ids or {shard_bits} bits of shards are too many")
    return Layout(bits, lanes, max(_LEAST_WIDTH, -(-SLOTS * bits // lanes)), shard_bits)


def _mask(width: int) -> np.uint64:
    return U((1 << width) - 1)


def pack(ids: np.ndarray, form: Layout) -> list[np.ndarray]:
    """Lanes of the rows of ``ids``, which has up to ``SLOTS`` columns."""
    lanes = [np.zeros(len(ids), U) for _ in range(form.lanes)]
    for j in range(ids.shape[1]):
        lane, shift = divmod(j * form.bits, form.width)
        own = ids[:, j].astype(U)
        lanes[lane] |= own << U(shift) & _mask(form.width)
        if shift + form.bits > form.width:
            lanes[lane + 1] |= own >> U(form.width - shift)
    return lanes


def unpack(lanes: list[np.ndarray], form: Layout) -> np.ndarray:
    ids = np.zeros((len(lanes[0]), SLOTS), np.int64)
    for j in range(SLOTS):
        lane, shift = divmod(j * form.bits, form.width)
        own = lanes[lane] >> U(shift)
        if shift + form.bits > form.width:
            own = own | lanes[lane + 1] << U(form.width - shift)
        ids[:, j] = (own & _mask(form.bits)).astype(np.int64)
    return ids


def _steps(form: Layout) -> Iterator[tuple[int, int, np.uint64]]:
    for r in range(_ROUNDS):
        for i in range(form.lanes):
            yield i, (i + 1) % form.lanes, mix(np.array([r * 8 + i + 1], U))[0]


def permute(lanes: list[np.ndarray], form: Layout) -> list[np.ndarray]:
    lanes = list(lanes)
    for a, b, key in _steps(form):
        lanes[b] = lanes[b] ^ mix(lanes[a] ^ key) & _mask(form.width)
    return lanes


def restore(lanes: list[np.ndarray], form: Layout) -> list[np.ndarray]:
    """The inverse of ``permute``."""
    lanes = list(lanes)
    for a, b, key in reversed(list(_steps(form))):
        lanes[b] = lanes[b] ^ mix(lanes[a] ^ key) & _mask(form.width)
    return lanes


def combine(lanes: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys in ascending order, equal ones as one with the sum of their counts."""
    n = len(counts)
    if not n:
        return lanes, counts
    order = np.lexsort(lanes[::-1])
    lanes = [lane[order] for lane in lanes]
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([lane[1:] != lane[:-1] for lane in lanes])
    first = np.flatnonzero(new)
    return [lane[first] for lane in lanes], np.add.reduceat(counts[order], first)


def _plane_bytes(bits: int) -> int:
    return -(-bits // 8)


def encode(lanes: list[np.ndarray], counts: np.ndarray, form: Layout) -> bytes:
    """The filter of combined keys of one shard."""
    n = len(counts)
    rest = form.width - form.shard_bits
    quotient_bits = min(rest, max(0, n.bit_length() - 1))
    low = rest - quotient_bits
    local = lanes[0] & _mask(rest)
    runs = np.bincount((local >> U(low)).astype(np.int64) if low < 64 else np.zeros(n, np.int64), minlength=1 << quotient_bits)
    unary = np.ones(n + len(runs), np.uint8)
    unary[np.cumsum(runs) + np.arange(len(runs))] = 0
    planes = [(local & _mask(low), low), *((lane, form.width) for lane in lanes[1:])]
    parts = [struct.pack("<IB", n, quotient_bits), np.packbits(unary).tobytes()]
    parts += [np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(n, 8)[:, : _plane_bytes(k)]).tobytes() for v, k in planes]
    parts += [np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype("<i8").tobytes()]
    return b"".join(parts)


def decode(data: bytes, shard: int, form: Layout) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys and counts of a filter."""
    n, quotient_bits = struct.unpack_from("<IB", data)
    at, slots, rest = 5, 1 << quotient_bits, form.width - form.shard_bits
    raw = np.frombuffer(data, np.uint8)
    size = _plane_bytes(n + slots)
    ends = np.flatnonzero(np.unpackbits(raw[at : at + size], count=n + slots) == 0)
    runs = np.diff(np.append(-1, ends)) - 1
    at += size
    low = rest - quotient_bits
    lanes = []
    for k in (low, *[form.width] * (form.lanes - 1)):
        wide = np.zeros((n, 8), np.uint8)
        wide[:, : _plane_bytes(k)] = raw[at : at + n * _plane_bytes(k)].reshape(n, _plane_bytes(k))
        lanes.append(wide.reshape(-1).view("<u8").astype(U))
        at += n * _plane_bytes(k)
    quotient = np.repeat(np.arange(slots, dtype=U), runs)
    lanes[0] |= (quotient << U(low)) | U(shard) << U(rest)
    counts = raw[at : at + n].astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=at + n)
    return lanes, counts


class Counter:
    """Counts n-grams in bounded memory; gives filters whenever ``limit`` keys are held, and at the end."""

    def __init__(self, form: Layout, limit: int = 1 << 21):
        self.form, self.limit = form, limit
        self._held: list[tuple[list[np.ndarray], np.ndarray]] = []
        self._size = 0

    def add(self, ids: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Counts each row of ``ids`` once."""
        if len(ids):
            yield from self._keep(*combine(permute(pack(ids, self.form), self.form), np.ones(len(ids), np.int64)))

    def _keep(self, lanes: list[np.ndarray], counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
        self._held.append((lanes, counts))
        self._size += len(counts)
        if self._size > self.limit:
            self._join()
            if self._size > self.limit // 2:
                yield from self.filters()

    def _join(self) -> None:
        held = self._held
        lanes = [np.concatenate([x[0][k] for x in held]) for k in range(self.form.lanes)]
        self._held = [combine(lanes, np.concatenate([x[1] for x in held]))]
        self._size = len(self._held[0][1])

    def filters(self) -> Iterator[tuple[int, bytes]]:
        """(shard, filter) of all that is held, which is then given up."""
        if not self._held:
            return
        self._join()
        lanes, counts = self._held[0]
        self._held, self._size = [], 0
        shard = (lanes[0] >> U(self.form.width - self.form.shard_bits)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        for low, high in zip(begin, np.append(begin[1:], len(shard)), strict=True):
            yield int(shard[low]), encode([lane[low:high] for lane in lanes], counts[low:high], self.form)


class Merger:
    """Merges the filters of one shard; joins them whenever as much is waiting as is merged."""

    def __init__(self, shard: int, form: Layout):
        self.shard, self.form = shard, form
        self._merged = ([np.zeros(0, U) for _ in range(form.lanes)], np.zeros(0, np.int64))
        self._waiting: list[tuple[list[np.ndarray], np.ndarray]] = []
        self._size = 0

    def add(self, data: bytes) -> None:
        self._waiting.append(decode(data, self.shard, self.form))
        self._size += len(self._waiting[-1][1])
        if self._size > max(1 << 18, len(self._merged[1])):
            self._join()

    def _join(self) -> None:
        parts = [self._merged, *self._waiting]
        lanes = [np.concatenate([p[0][k] for p in parts]) for k in range(self.form.lanes)]
        self._merged = combine(lanes, np.concatenate([p[1] for p in parts]))
        self._waiting, self._size = [], 0

    def counts(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of the n-grams that occur ``least`` times or more."""
        self._join()
        lanes, counts = self._merged
        keep = counts >= least
        return unpack(restore([lane[keep] for lane in lanes], self.form), self.form), counts[keep]
