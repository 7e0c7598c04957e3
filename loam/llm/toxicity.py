"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the bag of the 3-, 5- and 7-byte n-grams of its folded words, each word
between boundary marks, hashed into BUCKETS. The embeddings of all its n-grams
(and of a few blank ones) are averaged over the whole text and a linear softmax turns the mean into two
class probabilities; embeddings and softmax are trained jointly in numpy. A
misspelt word that training never saw still shares most n-grams with the word it
stands for. As mean and softmax input are linear, scoring folds embeddings and
weights into one number per bucket.

The model is fitted on at most TRAIN_DOCS labelled documents; it scores all
n-grams of all documents.

Defined results: a NULL, empty or wordless text has probability 0; without labels
of both classes every other text gets the share of toxic ones (0 if there are
none); repeated rows are scored alike; an empty table gives an empty result.
Texts are scored whole. Other input columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import labelled, prepare, table
from .textkit import _FOLDED, raw, slices

TRAIN_DOCS = 5000
BITS, DIM = 17, 6
BUCKETS = 1 << BITS
SIZES = (3, 5, 7)
EPOCHS, BATCH, RATE, DECAY = 24, 32, 3.0, 6e-4
THRESHOLD = 0.5
#: Blank n-grams added to each bag, so that a few n-grams alone decide nothing.
BLANKS = 80
_I = np.uint32


@dataclass
class Model:
    logit: np.ndarray  # toxic minus clean, per bucket
    bias: float
    constant: float | None = None


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, first n-gram of each text); n-grams of all words and sizes."""
    data, at = raw(pc.utf8_lower(texts))
    n, rows = len(data), len(at) - 1
    # One boundary mark before each text and one at the end keep words of neighbours apart.
    body = np.zeros(n + rows + 1, np.uint8)
    to = np.arange(n) + np.repeat(np.arange(rows) + 1, np.diff(at))
    body[to] = np.where(_FOLDED[data], data, 0)
    inside = body != 0
    begin = at + np.arange(rows + 1)
    found, place = [], []
    h = np.zeros(len(body), _I)
    for k in range(max(SIZES)):
        m = len(body) - k
        if m <= 0:
            break
        h = h[:m] * _I(0x01000193) + (body[k : k + m].astype(_I) + _I(1))
        size = k + 1
        if size not in SIZES:
            continue
        ok = inside[1:m + 1].copy() if m < len(body) else np.append(inside[1:], False)
        for j in range(2, size - 1):
            ok &= inside[j : j + m]
        i = np.flatnonzero(ok)
        x = h[i] ^ (h[i] >> _I(15))
        x = x * _I(0x2C1B3C6D) + _I(size)
        x ^= x >> _I(12)
        x *= _I(0x297A2D39)
        found.append(x >> _I(32 - BITS))
        place.append(i)
    if not found:
        return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
    counts = sum(np.diff(np.searchsorted(i, begin)) for i in place)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(found) == 1:
        return found[0].astype(np.int64), first
    out = np.empty(first[-1], np.int64)
    fill = first[:-1].copy()
    for x, i in zip(found, place):
        cut = np.searchsorted(i, begin)
        size = np.diff(cut)
        out[np.repeat(fill - cut[:-1], size) + np.arange(len(x))] = x
        fill += size
    return out, first


def probabilities(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability that each text is toxic; 0 for wordless ones."""
    g, first = grams(texts)
    size = np.diff(first)
    p = np.zeros(len(size))
    some = np.flatnonzero(size)
    if not len(some):
        return p
    if model.constant is not None:
        p[some] = model.constant
        return p
    total = np.concatenate([[0.0], np.cumsum(model.logit[g], dtype=np.float64)])
    mean = (total[first[1:]] - total[first[:-1]])[some] / (size[some] + BLANKS)
    p[some] = 1 / (1 + np.exp(-np.clip(mean + model.bias, -30, 30)))
    return p


#: Averages of many n-grams are small; the scale lets the softmax see them.
_SCALE = np.float32(50)


def bag(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets of a text's n-grams, weight of each in its mean)."""
    u, c = np.unique(g, return_counts=True)
    return u, (c / (len(g) + BLANKS)).astype(np.float32) * _SCALE


def gradients(emb: np.ndarray, soft: np.ndarray, bias: np.ndarray, ids: np.ndarray, part: np.ndarray, begin: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the weighted mean cross entropy: (by text for each of its buckets, before its part; softmax; bias)."""
    mean = np.add.reduceat(emb[ids] * part[:, None], begin, axis=0)
    z = mean @ soft + bias
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=1, keepdims=True)
    d = (p - target) * weight[:, None] / len(target)
    return d @ soft.T, mean.T @ d, d.sum(0)


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    """Joint training by gradient steps over mini-batches; both classes weigh the same."""
    y = np.asarray(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    bags = []
    for lo in range(0, len(texts), 256):
        g, first = grams(pa.array(texts[lo : lo + 256], pa.string()))
        bags += [bag(g[a:b]) if b > a else (np.zeros(1, np.int64), np.zeros(1, np.float32)) for a, b in zip(first[:-1], first[1:])]
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    soft = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    target = np.eye(2, dtype=np.float32)[y]
    # Embeddings are shrunk times emb, so that decay is one product; a step changes only buckets that its texts have.
    shrunk, place = 1.0, np.zeros(BUCKETS, np.int64)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - 0.9 * epoch / EPOCHS)
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            ids = np.concatenate([bags[r][0] for r in rows])
            part = np.concatenate([bags[r][1] for r in rows])
            size = np.array([len(bags[r][0]) for r in rows])
            back, gs, gb = gradients(emb, soft, bias, ids, part * np.float32(shrunk), np.cumsum(size) - size, target[rows], weight[rows])
            seen = np.zeros(BUCKETS, bool)
            seen[ids] = True
            own = np.flatnonzero(seen)
            place[own] = np.arange(len(own))
            at, each = place[ids], np.repeat(back, size, axis=0) * part[:, None]
            emb[own] -= np.float32(rate / shrunk) * np.stack([np.bincount(at, each[:, k], len(own)) for k in range(DIM)], axis=1).astype(np.float32)
            shrunk *= 1 - rate * DECAY
            soft -= 0.1 * rate * gs
            bias -= 0.1 * rate * gb
    side = soft[:, 1] - soft[:, 0]
    return Model((emb @ side * _SCALE * np.float32(shrunk)).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """The model of a documents and a labels table."""
    return train(*labelled(docs, labels, "toxic", bound))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxic_prob, toxic) of every row."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            p = np.concatenate([np.zeros(0), *(probabilities(shared.value, texts.slice(lo, hi - lo)) for lo, hi in slices(texts, 1 << 20))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(p >= THRESHOLD)], names=["doc_id", "toxic_prob", "toxic"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, toxic_prob double, toxic boolean")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLE_SQL: dict[str, str] = {}
