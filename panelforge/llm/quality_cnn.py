"""Quality classifier: a convolutional network over bytes, in numpy.

Network. Bytes are embedded; learned filters of `WIDTH` bytes slide over the whole text, byte by byte (`STEP`). The text is
cut into chunks of `CHUNK` bytes that overlap by the width of a filter, so that no window is lost; each filter is
max-pooled inside each chunk. The chunk maxima are combined over the document by their mean and their maximum, and one
logistic unit turns these into a probability. The whole text is read, whatever its length.

Training. Labelled rows are ordered by a hash of their id; the first `sample_rows`, up to `sample_bytes` of text, are the
training sample (a documented bound). One task fits the network by Adam; only the gradient of each maximum's own window
is followed. Rows with crc32(doc_id) mod 5 = 0 are never learned from. Only the bytes of the text are input.

Scoring runs in every task over blocks of rows with the weights (a few kilobytes) broadcast. Memory: one block.

Defined cases: NULL and empty texts have one empty chunk and get the score of that; repeated rows get a row each; several
labels of one id count by their mean; of an id that repeats in the documents as many rows as fit the sample are learned from; a NULL id is never held out and never learned from; without labels every score is
0.5, with labels of one kind their smoothed share; an empty table gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.core.scale import written
from panelforge.llm.words import text_blocks

WIDTH, STEP, CHUNK, EMBED, FILTERS = 8, 1, 512, 8, 24
SAMPLE_ROWS = 6000
SAMPLE_BYTES = 48 << 20
#: Passes over the sample: as many as make STEPS updates, within these bounds.
EPOCHS = (6, 30)
STEPS = 1500
THRESHOLD = 0.3
_AT_ONCE = 128

Weights = dict[str, np.ndarray]


def chunk_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of all rows as byte codes (0 beyond the end of the text, otherwise byte + 1), and the first chunk of each row."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // CHUNK))
    first = np.concatenate([[0], np.cumsum(counts)])
    row = np.repeat(np.arange(len(lengths)), counts)
    start = offsets[:-1][row] + (np.arange(first[-1]) - first[:-1][row]) * CHUNK
    at = start[:, None] + np.arange(CHUNK + WIDTH - STEP)
    inside = at < offsets[1:][row][:, None]
    if not len(data):
        return np.zeros(at.shape, np.int64), first
    return np.where(inside, data[np.minimum(at, len(data) - 1)].astype(np.int64) + 1, 0), first


def _windows(codes: np.ndarray, w: Weights) -> np.ndarray:
    x = w["embed"][codes]
    view = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1)[:, ::STEP]  # chunk, place, embed, width
    return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(codes), view.shape[1], WIDTH * EMBED)


def chunk_maxima(codes: np.ndarray, w: Weights) -> np.ndarray:
    out = np.empty((len(codes), FILTERS), np.float32)
    for a in range(0, len(codes), _AT_ONCE):
        x = _windows(codes[a : a + _AT_ONCE], w)
        found = x.reshape(-1, x.shape[2]) @ w["filters"]
        out[a : a + _AT_ONCE] = found.reshape(x.shape[0], x.shape[1], FILTERS).max(axis=1)
    return np.maximum(out + w["shift"], 0)


def _pooled(maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
    mean = np.add.reduceat(maxima, first[:-1]) / np.diff(first)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(maxima, first[:-1])], axis=1)


def scores(data: np.ndarray, offsets: np.ndarray, w: Weights) -> np.ndarray:
    codes, first = chunk_codes(data, offsets)
    logit = _pooled(chunk_maxima(codes, w), first) @ w["out"] + w["bias"]
    return 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -60, 60)))


def _initial(rng: np.random.Generator, share: float) -> Weights:
    return {
        "embed": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32),
        "filters": rng.normal(0, 0.25, (WIDTH * EMBED, FILTERS)).astype(np.float32),
        "shift": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        "bias": np.array(np.log(share / (1 - share)), np.float32),
    }


def _gradient(codes: np.ndarray, first: np.ndarray, target: np.ndarray, w: Weights) -> Weights:
    """Gradient of the mean log loss of one batch of documents."""
    n, n_docs = len(codes), len(target)
    maxima, best = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
    for a in range(0, n, _AT_ONCE):
        x = _windows(codes[a : a + _AT_ONCE], w)
        found = (x.reshape(-1, x.shape[2]) @ w["filters"]).reshape(x.shape[0], x.shape[1], FILTERS)
        best[a : a + _AT_ONCE] = found.argmax(axis=1)
        maxima[a : a + _AT_ONCE] = np.take_along_axis(found, best[a : a + _AT_ONCE][:, None, :], 1)[:, 0]
    active = np.maximum(maxima + w["shift"], 0)
    pooled = _pooled(active, first)
    error = ((1 / (1 + np.exp(-np.clip(pooled @ w["out"] + w["bias"], -30, 30)))) - target).astype(np.float32) / n_docs
    row = np.repeat(np.arange(n_docs), np.diff(first))
    g_pool = error[:, None] * w["out"][None, :]
    top = active == pooled[:, FILTERS:][row]
    g = g_pool[:, :FILTERS][row] / np.diff(first)[row][:, None] + g_pool[:, FILTERS:][row] * top
    g = (g * (active > 0)).astype(np.float32)
    at = best[:, :, None] * STEP + np.arange(WIDTH)  # chunk, filter, width
    seen = codes[np.arange(n)[:, None, None], at]
    window = w["embed"][seen]  # chunk, filter, width, embed
    g_filters = np.einsum("cf,cfwe->wef", g, window, optimize=True).reshape(WIDTH * EMBED, FILTERS)
    spread = g[:, :, None, None] * w["filters"].T.reshape(FILTERS, WIDTH, EMBED)[None]
    flat, add = seen.ravel(), spread.reshape(-1, EMBED)
    g_embed = np.stack([np.bincount(flat, weights=add[:, e], minlength=257) for e in range(EMBED)], axis=1).astype(np.float32)
    return {
        "embed": g_embed, "filters": g_filters, "shift": g.sum(0), "out": pooled.T @ error, "bias": np.array(error.sum(), np.float32)
    }


def train(texts: list[bytes], target: np.ndarray, batch: int = 32, rate: float = 0.01, seed: int = 5) -> Weights:
    """Fits the network to whole texts."""
    rng = np.random.default_rng(seed)
    w = _initial(rng, float(np.clip(target.mean(), 0.01, 0.99)))
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    updates = -(-len(texts) // batch)
    epochs = min(max(EPOCHS[0], -(-STEPS // updates)), EPOCHS[1])
    step, total = 0, epochs * updates
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for a in range(0, len(order), batch):
            some = order[a : a + batch]
            parts = [texts[i] for i in some]
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            codes, first = chunk_codes(np.frombuffer(b"".join(parts), np.uint8), offsets)
            g = _gradient(codes, first, target[some], w)
            step += 1
            slow = rate * (1 - step / (total + 1))
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                w[k] = (w[k] - slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, size: int) -> DataFrame:
    """At most `rows` labelled documents and `size` bytes, in the order of a hash of the id."""
    order = F.xxhash64(F.lit("sample"), "id")
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.avg("y").alias("y"))
        .withColumn("order", order)
        .orderBy("order", "id")
        .limit(rows)
    )
    known = written(known, "sample")  # at most `rows` small rows
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(known), "id")
    # an id may repeat without bound in the documents: no more rows than that either, whatever the copies
    found = found.orderBy("order", "id", F.xxhash64("text")).limit(rows)
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("upto", upto).filter((F.col("upto") <= size) | (F.col("upto") == F.octet_length("text"))).select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, rows: int, size: int) -> Weights:
    """Weights learned by one task from the sample."""
    sample = training_sample(docs, labels, label, id_col, text_col, rows, size).coalesce(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        target: list[float] = []
        for b in batches:
            texts += [t.encode() for t in b.column(0).to_pylist()]
            target += b.column(1).to_pylist()
        y = np.array(target, np.float32)
        if len(set(target)) > 1:
            w = train(texts, y)
        else:  # nothing to tell apart
            share = (float(y.sum()) + 1) / (len(y) + 2)
            w = {k: np.zeros_like(x) for k, x in _initial(np.random.default_rng(0), 0.5).items()}
            w["bias"] = np.array(np.log(share / (1 - share)), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(w)], pa.binary())], ["weights"])

    learned = sample.mapInArrow(learn, "weights binary").first()  # None if the sample has no partition
    return pickle.loads(bytes(learned[0])) if learned else {k: np.zeros_like(x) for k, x in _initial(np.random.default_rng(0), 0.5).items()}


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    sample_rows: int = SAMPLE_ROWS,
    sample_bytes: int = SAMPLE_BYTES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Probability that the label is 1, for every document."""
    w = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, sample_rows, sample_bytes))
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    schema = f"doc_id {slim.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end, data, offsets in text_blocks(batch.column(2), 1 << 20):
                p = scores(data, offsets, w.value)
                kept = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays(
                    [kept.column(0), kept.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return slim.mapInArrow(score, schema)
