"""Quality classifier: a convolutional network over bytes, in numpy.

A text's UTF-8 bytes are embedded; learned filters run over overlapping windows of ``WINDOW`` bytes, one every
``STRIDE``, so that they cover the whole text.  Each filter's largest response in each block of windows and in the
whole text are kept, and a logistic layer combines the text's largest responses and the mean of its blocks'.

Fitting takes at most ``TRAIN_ROWS`` labelled rows, half of each label where there are enough, chosen by hash of
doc_id; weights bring the labels back to their shares among all labelled rows.  Only text is an input.

Cases: a null text is an empty one, which scores as one window of padding; labels other than 0 and 1 and nulls teach
nothing; without labels of both kinds every score is the share of label 1 (0.5 if there are none); several labels of
one document count as the lowest, and of several texts of one doc_id the least teaches; a text of more than
``TRAIN_BYTES`` is scored whole and does not teach; a null doc_id is scored, has no label, and neither is nor is not held
out (null); rows repeat as they are; an empty table gives an empty table; all columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens

TRAIN_ROWS, THRESHOLD, FOLDS, HELD_OUT = 1600, 0.7, 4, 2
#: Bytes of a text that may teach: with TRAIN_ROWS the bound of what comes to the driver.
TRAIN_BYTES = 1 << 18
WINDOW, STRIDE, BLOCK, DEPTH, FILTERS = 12, 4, 256, 8, 24


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    weights: np.ndarray
    base: float


def _layout(body: np.ndarray, at: np.ndarray):
    """Bytes with each text at a multiple of the stride and a window of zeros behind it; its windows and blocks."""
    length = np.diff(at)
    room = -(-(length + WINDOW) // STRIDE) * STRIDE
    start = np.cumsum(room) - room
    padded = np.zeros(int(room.sum()) + WINDOW, np.uint8)
    padded[np.arange(len(body)) + np.repeat(start - at[:-1], length)] = body
    count = np.maximum(1, -(-length // STRIDE))
    blocks = -(-count // BLOCK)
    block_row = np.repeat(np.arange(len(length)), blocks)
    nth = np.arange(len(block_row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = start[block_row] // STRIDE + nth * BLOCK
    return padded, begin, np.minimum(BLOCK, count[block_row] - nth * BLOCK), blocks


def _windows(net: Network, padded: np.ndarray, begin: int, count: int) -> np.ndarray:
    part = net.embed[padded[begin * STRIDE : (begin + count - 1) * STRIDE + WINDOW]]
    step = STRIDE * DEPTH * part.itemsize
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(part, (count, WINDOW * DEPTH), (step, part.itemsize)))


def _pooled(net: Network, body: np.ndarray, at: np.ndarray, traced: bool = False):
    padded, begin, count, blocks = _layout(body, at)
    best = np.empty((len(begin), FILTERS), np.float32)
    where = np.empty((len(begin), FILTERS), np.int64) if traced else None
    for k, (a, n) in enumerate(zip(begin.tolist(), count.tolist(), strict=True)):
        response = _windows(net, padded, a, n) @ net.filters
        if traced:
            i = response.argmax(0)
            best[k], where[k] = response[i, np.arange(FILTERS)], i + a
        else:
            best[k] = response.max(0)
    best = np.maximum(best + net.bias, 0)
    first = np.cumsum(blocks) - blocks
    features = np.hstack([np.maximum.reduceat(best, first), np.add.reduceat(best, first) / blocks[:, None]])
    return features, best, where, padded, blocks, first


def score(net: Network, body: np.ndarray, at: np.ndarray) -> np.ndarray:
    features = _pooled(net, body, at)[0]
    return 1 / (1 + np.exp(-np.clip(features @ net.weights + net.base, -30, 30)))


def fit(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, seed: int = 7) -> Network:
    """Adam on the weighted log loss; gradients flow through the windows that gave the largest responses."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        rng.normal(0, 1 / np.sqrt(WINDOW * DEPTH), (WINDOW * DEPTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        0.0,
    )
    names = ["embed", "filters", "bias", "weights", "base"]
    moment = {k: [np.zeros_like(np.asarray(getattr(net, k), np.float32)) for _ in range(2)] for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), 32):
            rows = order[k : k + 32]
            body = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
            at = np.concatenate([[0], np.cumsum([len(texts[i]) for i in rows])]).astype(np.int64)
            features, best, where, padded, blocks, first = _pooled(net, body, at, traced=True)
            p = 1 / (1 + np.exp(-np.clip(features @ net.weights + net.base, -30, 30)))
            d = ((p - labels[rows]) * weights[rows] / len(rows)).astype(np.float32)
            grad = {"weights": features.T @ d + 1e-4 * net.weights, "base": d.sum()}
            d_features = d[:, None] * net.weights
            row = np.repeat(np.arange(len(rows)), blocks)
            d_best = (d_features[:, FILTERS:] / blocks[:, None])[row]
            top = best >= np.maximum.reduceat(best, first)[row]
            d_best = (d_best + np.where(top, d_features[:, :FILTERS][row], 0)) * (best > 0)
            grad["bias"] = d_best.sum(0)
            bytes_ = padded[(where * STRIDE)[:, :, None] + np.arange(WINDOW)]
            inputs = net.embed[bytes_].reshape(len(best), FILTERS, -1)
            grad["filters"] = np.einsum("bf,bfk->kf", d_best, inputs)
            d_embed = d_best[:, :, None] * net.filters.T
            grad["embed"] = np.stack([np.bincount(bytes_.ravel(), d_embed.reshape(-1, DEPTH)[:, c], 256) for c in range(DEPTH)], 1)
            step += 1
            for name in names:
                g, (m, v) = np.asarray(grad[name], np.float32), moment[name]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                change = 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, name, getattr(net, name) - (change if name != "base" else float(change)))
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network | float:
    """The network; or the share of label 1 if the labels are not of both kinds."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(~held_out(F.col("doc_id")))
    share = dict(known.groupBy("quality").count().collect())
    if len(share) < 2:
        return float(max(share)) if share else 0.5
    key = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") == q).orderBy(key, "doc_id").limit(rows // 2) for q in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))  # at most ``rows`` ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(picked, "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one of each id, however often it repeats
    texts = texts.where(F.octet_length("text") <= TRAIN_BYTES)
    sample = sorted((r.doc_id, r.quality, r.text) for r in texts.toLocalIterator())
    y = np.array([q for _, q, _ in sample], np.float32)
    if len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.5
    total = sum(share.values())
    weight = {q: share[q] / total / float((y == q).mean()) for q in (0, 1)}
    return fit([t.encode() for _, _, t in sample], y, np.array([weight[int(q)] for q in y], np.float32))


def _scores(net: Network | float, name: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.full(batch.num_rows, net if isinstance(net, float) else 0.0)
            if not isinstance(net, float):
                for i, j, body, at in tokens.runs(batch.column("text")):
                    out[i:j] = score(net, body, at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return rows


def score_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, name: str = "quality_score") -> DataFrame:
    """docs with a column ``name``, the score; docs that have one already are refused."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs have a column {name} already")
    net = train(docs, labels, rows)
    docs = docs.withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_scores(net, name), schema)
