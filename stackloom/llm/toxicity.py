"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Words are lower-cased runs of letters and digits.  The input of a step joins a word's own vector (by hash) and the sum of
the vectors of its character grams, word boundaries included, so that unseen forms of a known stem are recognised.  The
network reads windows of ``WINDOW`` words, ``STRIDE`` apart, over the whole text; a document's score is that of its
worst window.  It learns the same way: of each document, the windows that score highest are corrected.

Input vectors and their projections are computed once for each distinct word of a slice, so a step costs one gather and one
small product for each window.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.sampling import training_texts
from stackloom.llm.words import ALNUM_BYTES, U, Words, find_words, lowered, mix, text_slices, tidy

WINDOW, STRIDE = 24, 12
HIDDEN, ATTENTION = 8, 8
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM = 1 << 13, 1 << 14, 8, 16
GRAM = 4
BATCH = 4096
# labelled documents of label 0 and 1, and words of each, that training takes at most
PER_CLASS, TRAIN_WORDS = (3000, 1500), 3000
EPOCHS, RANDOM_EPOCHS = 18, 3

Params = dict[str, np.ndarray]


class Inputs(NamedTuple):
    """Distinct words: word bucket of each; buckets of all grams and the first gram of each word."""

    word: np.ndarray
    gram: np.ndarray
    first: np.ndarray


def distinct_inputs(words: Words) -> tuple[Inputs, np.ndarray]:
    """Inputs of the distinct words, and for each word which of them it is."""
    _, at, which = np.unique(words.hash, return_index=True, return_inverse=True)
    grams = np.maximum(1, words.end[at] - words.start[at] + 3 - GRAM)
    first = np.concatenate([[0], np.cumsum(grams)]).astype(np.int64)
    parts = [_gram_buckets(words, at[low : low + (1 << 14)]) for low in range(0, len(at), 1 << 14)]
    gram = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return Inputs((words.hash[at] % U(WORD_BUCKETS)).astype(np.int32), gram, first), which.astype(np.int32)


def _gram_buckets(words: Words, at: np.ndarray) -> np.ndarray:
    """Buckets of the grams of words, marks at both ends included, word after word."""
    start, size = words.start[at], words.end[at] - words.start[at]
    padded = size + 2
    first = np.concatenate([[0], np.cumsum(padded)]).astype(np.int64)
    chars = np.full(int(first[-1]), 0x5E, dtype=np.uint8)
    place = np.arange(int(size.sum())) + np.repeat(2 * np.arange(len(size)) + 1, size)
    chars[place] = words.data[np.repeat(start - first[:-1] - 1, size) + place]
    grams = np.maximum(1, padded - GRAM + 1)
    gram_first = np.concatenate([[0], np.cumsum(grams)]).astype(np.int64)
    position = np.arange(int(gram_first[-1])) - np.repeat(gram_first[:-1] - first[:-1], grams)
    limit = np.repeat(first[1:], grams)
    h = np.zeros(len(position), dtype=U)
    for j in range(GRAM):
        char = np.where(position + j < limit, chars[np.minimum(position + j, len(chars) - 1)], 0)
        h = h * U(0x100000001B3) + char.astype(U) + U(1)
    return (mix(h) % U(GRAM_BUCKETS)).astype(np.int32)


def make_windows(words: Words, which: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) indexes of distinct words, ``none`` where there is no word, and the row of each window.

    A text has a window for each ``STRIDE`` words until one reaches its end; a text without words has one empty window.
    """
    size = np.diff(words.first)
    count = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(size)), count)
    begin = (np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = begin[:, None] + np.arange(WINDOW)
    inside = at < size[row][:, None]
    index = np.minimum(words.first[row][:, None] + at, max(0, len(which) - 1))
    return np.where(inside, which[index] if len(which) else none, none).astype(np.int32), row


def start_params(seed: int = 7) -> Params:
    rng = np.random.default_rng(seed)
    d, h, k = WORD_DIM + GRAM_DIM, HIDDEN, ATTENTION

    def weights(*shape: int, scale: float | None = None) -> np.ndarray:
        return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)

    p = {"word": weights(WORD_BUCKETS, WORD_DIM, scale=0.05), "gram": weights(GRAM_BUCKETS, GRAM_DIM, scale=0.05)}
    for side in ("f", "b"):
        p |= {f"W{side}": weights(d, 3 * h), f"U{side}": weights(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
    p |= {"A": weights(2 * h, k), "ca": np.zeros(k, np.float32), "v": weights(k), "w": weights(2 * h), "bias": np.zeros(1, np.float32)}
    return p


def word_inputs(p: Params, x: Inputs) -> np.ndarray:
    """Input vectors of distinct words."""
    if not len(x.word):
        return np.zeros((0, WORD_DIM + GRAM_DIM), np.float32)
    out = np.empty((len(x.word), WORD_DIM + GRAM_DIM), dtype=p["gram"].dtype)
    out[:, :WORD_DIM] = p["word"][x.word]
    for low in range(0, len(x.word), 1 << 14):  # in parts, as all grams at once would be large
        first = x.first[low : low + (1 << 14) + 1]
        grams = p["gram"][x.gram[first[0] : first[-1]]]
        out[low : low + (1 << 14), WORD_DIM:] = np.add.reduceat(grams, first[:-1] - first[0], axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _forward(p: Params, projected: dict[str, np.ndarray], windows: np.ndarray, none: int, keep: dict | None = None) -> np.ndarray:
    """Logits of windows.  ``projected`` has a row for each distinct word and one more for "no word"."""
    n, h = len(windows), HIDDEN
    mask = (windows != none).astype(np.float32)
    steps = np.ascontiguousarray(windows.T)
    states = np.empty((WINDOW, n, 2 * h), dtype=np.float32)
    for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
        state = np.zeros((n, h), dtype=np.float32)
        recurrent = p[f"U{side}"]
        part = slice(0, h) if side == "f" else slice(h, 2 * h)
        for t in order:
            a = projected[side].take(steps[t], axis=0)
            g = state @ recurrent
            zr = _sigmoid(a[:, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(a[:, 2 * h :] + r * g[:, 2 * h :])
            m = mask[:, t : t + 1] * (1 - z)
            after = state + m * (new - state)
            if keep is not None:
                keep[side, t] = (state, z, r, new, g[:, 2 * h :])
            state = after
            states[t, :, part] = state
    u = np.tanh(states @ p["A"] + p["ca"])
    e = np.where(mask.T > 0, u @ p["v"], np.float32(-1e9))
    e -= e.max(axis=0)
    alpha = np.exp(e) * mask.T
    alpha /= np.maximum(alpha.sum(axis=0), np.float32(1e-9))
    context = (alpha[:, :, None] * states).sum(axis=0)
    if keep is not None:
        keep["top"] = (mask, states, u, alpha, context)
    return context @ p["w"] + p["bias"][0]


def project(p: Params, vectors: np.ndarray) -> dict[str, np.ndarray]:
    out = {}
    for side in ("f", "b"):
        rows = vectors @ p[f"W{side}"] + p[f"c{side}"]
        out[side] = np.concatenate([rows, np.zeros((1, rows.shape[1]), np.float32)])
    return out


def _gradients(p: Params, x: Inputs, windows: np.ndarray, none: int, target: np.ndarray, drop: np.ndarray) -> Params:
    """Gradients of the mean logistic loss of windows; ``drop`` marks distinct words that are read by their characters only."""
    h = HIDDEN
    vectors = word_inputs(p, x)
    vectors[drop, :WORD_DIM] = 0
    keep: dict = {}
    logit = _forward(p, project(p, vectors), windows, none, keep)
    mask, states, u, alpha, context = keep["top"]
    d = ((_sigmoid(logit) - target) / len(target)).astype(np.float32)
    g = {"bias": np.array([d.sum()]), "w": context.T @ d}
    d_context = d[:, None] * p["w"]
    d_states = alpha[:, :, None] * d_context
    d_alpha = (states * d_context).sum(axis=2)
    d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
    g["v"] = (u * d_e[:, :, None]).sum(axis=(0, 1))
    d_u = d_e[:, :, None] * p["v"] * (1 - u * u)
    g["A"], g["ca"] = np.einsum("tni,tnj->ij", states, d_u), d_u.sum(axis=(0, 1))
    d_states = d_states + d_u @ p["A"].T
    d_vectors = np.zeros((len(vectors) + 1, vectors.shape[1]), dtype=np.float32)
    padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
    for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
        part = slice(0, h) if side == "f" else slice(h, 2 * h)
        recurrent = p[f"U{side}"]
        d_state = np.zeros((len(windows), h), dtype=np.float32)
        g[f"W{side}"], g[f"U{side}"], g[f"c{side}"] = (np.zeros_like(p[f"{c}{side}"]) for c in "WUc")
        for t in order:
            state, z, r, new, gn = keep[side, t]
            m = mask[:, t : t + 1]
            d_after = d_state + d_states[t, :, part]
            d_new = d_after * m * (1 - z)
            d_z = d_after * m * (state - new) * z * (1 - z)
            d_n = d_new * (1 - new * new)
            d_r = d_n * gn * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n], axis=1)
            d_g = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_state = d_after * (1 - m * (1 - z)) + d_g @ recurrent.T
            g[f"U{side}"] += state.T @ d_g
            g[f"W{side}"] += padded[windows[:, t]].T @ d_a
            g[f"c{side}"] += (d_a * m).sum(axis=0)
            np.add.at(d_vectors, windows[:, t], d_a @ p[f"W{side}"].T)
    d_vectors = d_vectors[:-1]
    d_word = d_vectors[:, :WORD_DIM].copy()
    d_word[drop] = 0
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], x.word, d_word)
    np.add.at(g["gram"], x.gram, np.repeat(d_vectors[:, WORD_DIM:], np.diff(x.first), axis=0))
    return g


class _Adam:
    def __init__(self, p: Params, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, p: Params, g: Params) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            p[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(np.float32)


def _part(x: Inputs, windows: np.ndarray, none: int) -> tuple[Inputs, np.ndarray, int]:
    """The same windows over their own distinct words alone."""
    used = np.unique(windows)
    used = used[used != none]
    size = np.diff(x.first)[used]
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    gram = x.gram[np.repeat(x.first[used] - first[:-1], size) + np.arange(int(size.sum()))]
    local = np.where(windows == none, len(used), np.searchsorted(used, windows))
    return Inputs(x.word[used], gram, first), local, len(used)


def _logits(p: Params, x: Inputs, windows: np.ndarray, none: int) -> np.ndarray:
    projected = project(p, word_inputs(p, x))
    return np.concatenate([_forward(p, projected, windows[i : i + BATCH], none) for i in range(0, len(windows), BATCH)])


def train(texts: list[tuple[list[str], int]], epochs: int = EPOCHS, seed: int = 11, rate: float = 0.01) -> Params:
    """Learns from (texts of a document, label).  Without both labels the network stays at its start."""
    p = start_params(seed)
    label = np.array([y for _, y in texts], dtype=np.float32)
    if len(set(label.tolist())) < 2:
        return p
    data, offsets = lowered(pa.array([t for own, _ in texts for t in own], pa.string()))
    words = find_words(data, offsets, ALNUM_BYTES)
    x, which = distinct_inputs(words)
    none = len(x.word)
    windows, row = make_windows(words, which, none)
    doc = np.repeat(np.arange(len(texts)), [len(own) for own, _ in texts])[row]
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    rng = np.random.default_rng(seed)
    adam = _Adam(p, rate)
    weight = np.where(label == 1, (label == 0).sum() / max(1, (label == 1).sum()), 1.0)
    for epoch in range(epochs):
        if epoch < RANDOM_EPOCHS:
            picked = np.concatenate([rng.integers(first[:-1], first[1:]) for _ in range(3)])
        else:
            score = _logits(p, x, windows, none)
            order = np.lexsort((-score, doc))
            rank = np.arange(len(order)) - first[doc[order]]
            top = order[rank < 2]
            second = order[(rank >= 2) & (rank < 4)]
            # the worst windows decide; of clean documents the next ones count as well
            picked = np.concatenate([order[rank == 0], top[(label[doc[top]] == 0)], second[label[doc[second]] == 0][::2]])
        picked = rng.permutation(picked)
        adam.rate = rate * (1 if epoch < epochs * 2 // 3 else 0.3)
        for i in range(0, len(picked), 256):
            own = picked[i : i + 256]
            y, w = label[doc[own]], weight[doc[own]]
            part, local, none_here = _part(x, windows[own], none)
            drop = rng.random(none_here) < 0.5
            # classes weigh the same: the more frequent one is thinned out by its weight
            use = rng.random(len(own)) < w / w.max()
            if use.any():
                adam.step(p, _gradients(p, part, local[use], none_here, y[use], drop))
    return p


def score_slices(p: Params, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, scores) of slices of texts."""
    for low, high, _, _ in text_slices(column):
        words = find_words(*lowered(column.slice(low, high - low)), ALNUM_BYTES)
        x, which = distinct_inputs(words)
        none = len(x.word)
        projected = project(p, word_inputs(p, x))
        best = np.full(high - low, -np.inf)
        # documents, and so their windows, come in order; windows are built for some rows at a time
        size = np.maximum(1, np.diff(words.first))
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), BATCH * STRIDE * 8), side="left")
        cuts = np.unique(np.append(cuts, high - low))
        for a, b in zip(np.append(0, cuts), cuts, strict=False):
            if a == b:
                continue
            base = words.first[a]
            part = Words(words.data, words.start, words.end, words.row, words.hash, words.first[a : b + 1] - base)
            windows, row = make_windows(part, which[base : words.first[b]], none)
            for i in range(0, len(windows), BATCH):
                np.maximum.at(best, a + row[i : i + BATCH], _forward(p, projected, windows[i : i + BATCH], none))
        yield low, high, _sigmoid(best)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Params:
    """The network, learnt from at most ``per_class`` documents of label 0 and 1 and ``TRAIN_WORDS`` words of each.

    That bounded sample goes to one task, which trains and gives the parameters back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        if rows:
            raw = io.BytesIO()
            np.savez(raw, **train([(texts, label) for _, texts, label in rows]))
            yield pa.RecordBatch.from_arrays([pa.array([raw.getvalue()], pa.binary())], names=["params"])

    sample = training_texts(docs, labels, label_col, keep, per_class, TRAIN_WORDS, 5 * WINDOW)
    found = sample.coalesce(1).mapInArrow(tidy(run), "params binary").collect()
    if not found:
        return train([])
    with np.load(io.BytesIO(found[0]["params"])) as params:
        return {k: params[k] for k in params.files}


def score(docs: DataFrame, params: Params, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability that its worst window is toxic.

    Every window of the whole text is read.  A null or empty text is one empty window, so it has the score of "nothing
    said".  Rows without an id, repeated rows and other columns are of no account.
    """
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, scores in score_slices(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(scores)], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double")


def drop_toxic(docs: DataFrame, params: Params, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``limit`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col)).cast(pa.string())
            keep = [s < limit for _, _, s in score_slices(shared.value, column)]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(tidy(run), docs.schema)
