"""Quality: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Random indexing: every token (by hash, ``BUCKETS`` of them) has a fixed sparse vector of plus and minus ones, and a token's
vector is the sum of the fixed vectors of its neighbours at up to ``REACH`` places, over all occurrences in all documents.
Tasks sum up their own share, so at most ``BUCKETS`` rows of a task are shuffled and ``BUCKETS`` rows reach the driver.
Tokens are runs of letters and digits, as written, and runs of other signs.

A document is the mean and the spread of its tokens' vectors, its size and how often it repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.llm.words import ALNUM_BYTES, U, WORD_BYTES, Words, find_words, group_bounds, text_slices, tidy

BUCKETS, DIM, SIGNS, REACH = 1 << 13, 24, 4, 2
HIDDEN = 32
SAMPLE = 8000
EPOCHS = 60
TOKEN_KINDS = np.where(WORD_BYTES, np.where(ALNUM_BYTES, 1, 2), 0).astype(np.uint8)
FEATURES = 2 * DIM + 4


class Model(NamedTuple):
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float


def index_vectors(seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :SIGNS]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.float32), (BUCKETS, SIGNS)), axis=1)
    return out


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    words = find_words(data, offsets, TOKEN_KINDS)
    return words, (words.hash % U(BUCKETS)).astype(np.int64)


def _context_sums(index: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIM))
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(0), 1 << 20):
                words, bucket = _tokens(data, offsets)
                context = np.zeros((len(bucket), DIM), dtype=np.float32)
                for d in range(1, REACH + 1):
                    if len(bucket) <= d:
                        break
                    same = (words.row[d:] == words.row[:-d]).astype(np.float32)[:, None]
                    context[d:] += index[bucket[:-d]] * same
                    context[:-d] += index[bucket[d:]] * same
                for k in range(DIM):
                    sums[:, k] += np.bincount(bucket, weights=context[:, k], minlength=BUCKETS)
        used = np.flatnonzero(sums.any(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, k]) for k in range(DIM))], names=["bucket", *_columns()])

    return run


def _columns() -> list[str]:
    return [f"v{k}" for k in range(DIM)]


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all buckets, from every document; zero for buckets without a token."""
    schema = "bucket long, " + ", ".join(f"{c} double" for c in _columns())
    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(tidy(_context_sums(index_vectors())), schema)
    rows = sums.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in _columns())).collect()
    out = np.zeros((BUCKETS, DIM), dtype=np.float32)
    for r in rows:
        out[r[0]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-9))


def features(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text; zeros but for its size if it has no tokens."""
    words, bucket = _tokens(data, offsets)
    rows = len(offsets) - 1
    out = np.zeros((rows, FEATURES), dtype=np.float32)
    size = np.diff(words.first)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    at, n = words.first[full], size[full, None]
    v = vectors[bucket]
    mean = np.add.reduceat(v, at, axis=0) / n
    out[full, :DIM] = mean
    out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(0, np.add.reduceat(v * v, at, axis=0) / n - mean * mean))
    order = np.lexsort((words.hash, words.row))
    bounds = group_bounds(words.row[order], words.hash[order])
    count, row = np.diff(bounds), words.row[order][bounds[:-1]]
    first = np.searchsorted(row, full)
    out[full, 2 * DIM] = np.log1p(size[full])
    out[full, 2 * DIM + 1] = np.diff(np.append(first, len(row))) / size[full]
    out[full, 2 * DIM + 2] = np.maximum.reduceat(count, first) / size[full]
    signs = TOKEN_KINDS[words.data[words.start]] == 2
    out[full, 2 * DIM + 3] = np.add.reduceat(signs.astype(np.float32), at) / size[full]
    return out


def _activations(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.tanh(x @ a + b)
    return hidden, hidden @ c + d[0]


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Four fifths of the rows train the network; the temperature makes the others' probabilities likeliest."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    layers = [
        rng.standard_normal((FEATURES, HIDDEN)) / np.sqrt(FEATURES),
        np.zeros(HIDDEN),
        rng.standard_normal(HIDDEN) / np.sqrt(HIDDEN),
        np.zeros(1),
    ]
    model = Model(vectors, mean, scale, layers, 1.0)
    if len(set(y.tolist())) < 2:
        # with one label only, or none, every text is as good as any other
        layers[2][:] = 0
        layers[3][:] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return model
    x = (x - mean) / scale
    order = rng.permutation(len(x))
    held, own = order[: len(x) // 5], order[len(x) // 5 :]
    m, v = ([np.zeros_like(p) for p in layers] for _ in range(2))
    t = 0
    for epoch in range(epochs):
        rate = 0.005 * (1 - epoch / epochs) + 1e-4
        for batch in np.array_split(rng.permutation(own), max(1, len(own) // 128)):
            hidden, logit = _activations(layers, x[batch])
            d = (1 / (1 + np.exp(-logit)) - y[batch]) / len(batch)
            d_hidden = d[:, None] * layers[2] * (1 - hidden * hidden)
            grads = [x[batch].T @ d_hidden + 1e-4 * layers[0], d_hidden.sum(axis=0), hidden.T @ d + 1e-4 * layers[2], np.array([d.sum()])]
            t += 1
            for p, g, mi, vi in zip(layers, grads, m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.001 * (g * g - vi)
                p -= rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * mi / (np.sqrt(vi) + 1e-8)
    temperature = 1.0
    if len(held):
        _, logit = _activations(layers, x[held])
        sign = np.where(y[held] == 1, 1.0, -1.0)
        candidates = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, -sign * logit / c).mean() for c in candidates]
        temperature = float(candidates[int(np.argmin(loss))])
    return model._replace(temperature=temperature)


def probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    _, logit = _activations(model.layers, (x - model.mean) / model.scale)
    return 1 / (1 + np.exp(-np.clip(logit / model.temperature, -50, 50)))


def _featured(vectors, batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for low, high, data, offsets in text_slices(batch.column(1), 1 << 20):
            yield batch.slice(low, high - low), features(vectors, data, offsets)


def fit(docs: DataFrame, labels: DataFrame, keep: Column, label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Vectors from all documents; the network from at most ``sample`` labelled ones for which ``keep`` holds.

    The sample is picked by a hash of the id, so its classes are as frequent as in the labels.
    """
    vectors = word_vectors(docs)
    known = labels.filter(keep & F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _featured(shared.value, batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(2), pa.array(list(x), pa.list_(pa.float32()))], names=["doc_id", "label", "x"]
            )

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = texts.mapInArrow(tidy(run), "doc_id long, label int, x array<float>").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), FEATURES)
    return train(x, np.array([r["label"] for r in rows], dtype=np.float64), vectors)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the calibrated probability of label 1, over the whole text.

    A null text is an empty one and has the score of a document without tokens.  Rows without an id, repeated rows and
    other columns are of no account.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, x in _featured(shared.value.vectors, batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(probabilities(shared.value, x.astype(np.float64)))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double")
