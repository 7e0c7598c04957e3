"""Quality classifier: a byte-level convolutional network, trained and run in numpy.

A filter is a learned response to each byte value at each of WIDTH places; its
responses are computed at every byte of the text. They are max-pooled within
chunks of two blocks of BLOCK bytes that overlap by one block and cover the
whole document, a hidden layer looks at each chunk, its outputs are max-pooled
over the chunks, and one logistic unit combines them to the probability that the
document is good.

The network is fitted on at most TRAIN_DOCS labelled documents; it scores all
bytes of all documents.

Defined results: a NULL or empty text has probability 0 and is not kept; without
labels of both classes every other document gets the share of good ones (1 if
there are none); repeated rows are scored alike; an empty table gives an empty
result. Input columns named quality_prob or keep are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carry, labelled, prepare, table
from .textkit import raw, slices

TRAIN_DOCS = 2000
FILTERS, WIDTH, BLOCK, HIDDEN = 16, 8, 64, 16
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.5


@dataclass
class Net:
    taps: np.ndarray  # (WIDTH, 256, FILTERS)
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    constant: float | None = None

    def params(self) -> list[np.ndarray]:
        return [self.taps, self.w1, self.b1, self.w2]


def _layout(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(padded bytes, which of them begin a window, first block of each text).

    Each text is followed by at least WIDTH - 1 zeros, so no window crosses texts.
    """
    size = np.diff(at)
    blocks = -(-(size + WIDTH - 1) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(first[-1] * BLOCK + WIDTH, np.uint8)
    live = np.zeros(first[-1] * BLOCK, bool)
    to = np.repeat(first[:-1] * BLOCK - at[:-1], size) + np.arange(len(data))
    out[to] = data
    live[to] = True
    return out, live, first


def _pairs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left block, right block, first chunk of each text) of all chunks."""
    blocks = np.diff(first)
    chunks = np.where(blocks > 1, blocks - 1, blocks)
    begin = np.concatenate([[0], np.cumsum(chunks)])
    row = np.repeat(np.arange(len(chunks)), chunks)
    left = first[:-1][row] + np.arange(begin[-1]) - begin[:-1][row]
    return left, left + (blocks[row] > 1), begin


def _respond(taps: np.ndarray, out: np.ndarray, lo: int, hi: int) -> np.ndarray:
    span = out[lo : hi + WIDTH]
    r = taps[0][span[: hi - lo]]
    for k in range(1, WIDTH):
        r += taps[k][span[k : k + hi - lo]]
    return r


def _paired(taps: np.ndarray) -> list[np.ndarray]:
    """Responses to two adjacent bytes, so that a window takes WIDTH / 2 look-ups."""
    return [(taps[k][:, None, :] + taps[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]


def _block_max(pairs: list[np.ndarray], out: np.ndarray, live: np.ndarray) -> np.ndarray:
    n = len(live) // BLOCK
    best = np.empty((n, FILTERS), np.float32)
    step = 2048
    for b in range(0, n, step):
        lo, hi = b * BLOCK, min(n, b + step) * BLOCK
        two = out[lo : hi + WIDTH - 1].astype(np.uint16) << 8 | out[lo + 1 : hi + WIDTH]
        r = pairs[0][two[: hi - lo]]
        for k in range(1, WIDTH // 2):
            r += pairs[k][two[2 * k : 2 * k + hi - lo]]
        r[~live[lo:hi]] = -np.inf
        best[b : b + step] = r.reshape(-1, BLOCK, FILTERS).max(axis=1)
    return best


def _head(net: Net, pooled: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    chunk = np.maximum(pooled, 0)
    hidden = np.maximum(chunk @ net.w1 + net.b1, 0)
    doc = np.maximum.reduceat(hidden, begin[:-1], axis=0)
    return chunk, hidden, doc


def probabilities(net: Net, texts: pa.Array) -> np.ndarray:
    """Probability of each text; 0 for empty ones."""
    data, at = raw(texts)
    p = np.zeros(len(at) - 1)
    some = np.flatnonzero(np.diff(at))
    if not len(some):
        return p
    if net.constant is not None:
        p[some] = net.constant
        return p
    out, live, first = _layout(data, np.concatenate([at[some], at[-1:]]))
    best = _block_max(_paired(net.taps) if not hasattr(net, "pairs") else net.pairs, out, live)
    left, right, begin = _pairs(first)
    _, _, doc = _head(net, np.maximum(best[left], best[right]), begin)
    p[some] = 1 / (1 + np.exp(-np.clip(doc @ net.w2 + net.b2, -30, 30)))
    return p


def train(texts: list[str], labels: list[int], seed: int = 7) -> Net:
    """Fits the network by Adam on the logistic loss, both classes weighing the same."""
    rng = np.random.default_rng(seed)
    net = Net(
        rng.normal(0, 0.2, (WIDTH, 256, FILTERS)).astype(np.float32),
        rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
        np.zeros(HIDDEN, np.float32),
        rng.normal(0, 0.3, HIDDEN).astype(np.float32),
        0.0,
    )
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        net.constant = float(y.mean()) if len(y) else 1.0
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    bodies = [t.encode() for t in texts]
    bias = np.zeros(1, np.float32)
    params = [*net.params(), bias]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    by_size = np.argsort([len(b) for b in bodies], kind="stable")
    batches = [by_size[i : i + BATCH] for i in range(0, len(y), BATCH)]
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            rows = batches[k]
            size = np.array([len(bodies[r]) for r in rows])
            data = np.frombuffer(b"".join(bodies[r] for r in rows), np.uint8)
            out, live, first = _layout(data, np.concatenate([[0], np.cumsum(size)]))
            n = len(live) // BLOCK
            best, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
            for b in range(0, n, 2048):
                lo, hi = b * BLOCK, min(n, b + 2048) * BLOCK
                r = _respond(net.taps, out, lo, hi)
                r[~live[lo:hi]] = -np.inf
                r = r.reshape(-1, BLOCK, FILTERS)
                i = r.argmax(axis=1)
                best[b : b + 2048] = np.take_along_axis(r, i[:, None, :], 1)[:, 0, :]
                where[b : b + 2048] = i + (np.arange(b, b + len(i)) * BLOCK)[:, None]
            left, right, begin = _pairs(first)
            over = best[right] > best[left]
            pooled, place = np.where(over, best[right], best[left]), np.where(over, where[right], where[left])
            chunk, hidden, doc = _head(net, pooled, begin)
            p = 1 / (1 + np.exp(-np.clip(doc @ net.w2 + bias[0], -30, 30)))
            d = ((p - y[rows]) * weight[rows] / len(rows)).astype(np.float32)
            row = np.repeat(np.arange(len(rows)), np.diff(begin))
            top = hidden == doc[row]
            share = top / np.add.reduceat(top, begin[:-1], axis=0)[row]
            dh = (d[:, None] * net.w2)[row] * share * (hidden > 0)
            dh = dh.astype(np.float32)
            dc = (dh @ net.w1.T) * (pooled > 0)
            dt = np.zeros_like(net.taps)
            c, f = np.nonzero(dc)
            for j in range(WIDTH):
                np.add.at(dt[j], (out[place[c, f] + j], f), dc[c, f])
            grads = [dt, chunk.T @ dh, dh.sum(0), doc.T @ d, np.array([d.sum()])]
            t += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for q, g, a, s in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                s += 0.001 * (g * g - s)
                q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(bias[0])
    return net


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Net:
    """The network of a documents and a labels table."""
    return train(*labelled(docs, labels, "quality", bound))


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, quality_prob, keep) of every row."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.pairs = _paired(own.taps)
        for b in batches:
            texts = b.column(1)
            p = np.concatenate([np.zeros(0), *(probabilities(own, texts.slice(lo, hi - lo)) for lo, hi in slices(texts))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= THRESHOLD)], names=["doc_id", "quality_prob", "keep"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, quality_prob double, keep boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier accepts, scored in place without a join."""
    net = fit(docs, table(spark, sf_dir, "labels"))
    shared = prepare(spark).sparkContext.broadcast(net)

    def each():
        own = shared.value
        own.pairs = _paired(own.taps)

        def work(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            texts = b.column(0)
            p = np.concatenate([np.zeros(0), *(probabilities(own, texts.slice(lo, hi - lo)) for lo, hi in slices(texts))])
            yield b.filter(pa.array(p >= THRESHOLD)), []

        return work

    return carry(docs, [F.col("text").cast("string")], docs.columns, None, [], each)


QUERIES = {"op9_quality": op9_quality}
ORACLE_SQL: dict[str, str] = {}
