"""LM scoring: a log-bilinear model trained by noise-contrastive estimation.

All folded words of the corpus are counted. The WORDS most frequent ones (all of them, in a
corpus of fewer) are outcomes of the model, as are classes of the others by length and hash;
a mark stands before each text. The model predicts a representation of the next word as the sum
of those of the two words before it, each weighted by place, and scores an outcome by the
inner product with its target vector plus a bias. Outcomes in order of frequency are
cut into GROUPS runs, which have target vectors and biases too: the probability of
an outcome is that of its group among all groups, times its own within the group, by
batched matrix products over the contexts seen. The probability of a word of a class is
that of its class times its share of the class's tokens in the corpus, so that the
probabilities of all words of the corpus add up to 1, however many there are.

Model and frequent words are of bounded size (132 bytes an outcome) and broadcast. The counts of the others
grow with the corpus and are never brought together: each document's such words go to
where their hash is counted, and what comes back is one number a document.

Training is by shards of about SHARD tokens, to which distinct texts are dealt by hash, each
trained in numpy over all its tokens from the same start, telling words from noise drawn by
corpus frequency, and groups likewise. The shards' models are averaged row by row, weighted by the
steps that changed a row. So results don't depend on how the table is partitioned.

Defined results: a NULL, empty or wordless text has 0 tokens and NULL scores; a corpus
without words has no model, and all scores are NULL; repeated rows count as often
as they stand, but the model is trained on each distinct text once; words of equal counts
are ranked by hash; an empty table gives an empty result. Other input columns, whatever their
names, are ignored. Word hashes have 48 bits in the counts of classes, without a check of collisions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, prepare, row_id, table
from .packed import by_part, joined, part_of, parts_for, split
from .textkit import U, mix, raw, slices, words

WORDS, GROUPS, DIM = 1 << 15, 255, 16
#: Classes of other words: by length in bytes up to LENGTHS, and by hash.
LENGTHS, BANDS = 24, 8
CLASSES = LENGTHS * BANDS
#: Tokens of a training shard.
SHARD = 2_000_000
NOISE, BATCH, RATE = 32, 4096, 0.1
_MARK = GROUPS
_WIDE = 2 * DIM + 1  # floats of a row: context vector, target vector, bias
_RATES = np.array([RATE] * DIM + [RATE / 2], np.float32)


@dataclass
class Vocabulary:
    """Outcomes are words and classes of others, numbered by falling frequency; the mark comes after them."""

    hashes: np.ndarray  # sorted
    ids: np.ndarray
    other: np.ndarray  # outcome of each class
    tokens: np.ndarray  # of each class in the corpus
    share: np.ndarray  # of each outcome among all tokens, smoothed
    starts: np.ndarray  # group g has the outcomes starts[g]..starts[g + 1] - 1
    total: int  # tokens of the corpus

    @property
    def mark(self) -> int:
        return len(self.share)

    def of(self, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(outcomes of words by hash and length in bytes, which of them are classes)."""
        other = self.other[(np.minimum(size, LENGTHS) - 1) * BANDS + (h & U(BANDS - 1)).astype(np.int64)]
        if not len(self.hashes):
            return other, np.ones(len(h), bool)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = self.hashes[at] == h
        return np.where(known, self.ids[at], other), ~known

    def group(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, "right") - 1

    def group_share(self) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(self.share)])[self.starts])

    def split(self) -> np.ndarray:
        """log of the tokens of each outcome that is a class, 0 for words."""
        out = np.zeros(self.mark)
        out[self.other] = np.log(np.maximum(self.tokens, 1))
        return out


@dataclass
class Model:
    context: np.ndarray  # (outcomes and the mark, DIM)
    place: np.ndarray  # (2, DIM)
    target: np.ndarray  # (outcomes, DIM + 1), the bias last
    group: np.ndarray  # (GROUPS, DIM + 1), the bias last; -inf for a group without outcomes


def _texts(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text != ''")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, length, n) of the words of a partition."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    waiting = 0

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, c, n = (np.concatenate(x) for x in zip(*held))
        u, first, at = np.unique(h, return_index=True, return_inverse=True)
        return u, c[first], np.bincount(at, n).astype(np.int64)

    for b in batches:
        for lo, hi in slices(b.column(0)):
            w = words(b.column(0).slice(lo, hi - lo), True)
            u, first, n = np.unique(w.hash, return_index=True, return_counts=True)
            held.append((u, np.minimum((w.end - w.start)[first], LENGTHS), n))
            waiting += len(u)
            if waiting > 1 << 20:
                held = [merged()]
                waiting = 0
    if held:
        u, c, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(n)], names=["h", "c", "n"])


def vocabulary(docs: DataFrame) -> Vocabulary | None:
    """The vocabulary of all documents; None without words."""
    counts = durable(_texts(docs).mapInArrow(_count, "h long, c int, n long").groupBy("h", "c").agg(F.sum("n").alias("n")))
    chosen = counts.orderBy(F.desc("n"), "h").limit(WORDS).toArrow()
    if not len(chosen):
        return None
    h, c, n = (chosen.column(k).to_numpy() for k in range(3))
    band = (h.view(U) & U(BANDS - 1)).astype(np.int64)
    tokens = np.zeros(CLASSES, np.int64)
    for r in counts.groupBy("c", F.expr(f"h & {BANDS - 1}").alias("b")).agg(F.sum("n").alias("n")).collect():
        tokens[(r.c - 1) * BANDS + r.b] = r.n
    total = int(tokens.sum())
    np.subtract.at(tokens, (c - 1) * BANDS + band, n)
    h, n = h.view(U), np.concatenate([n, tokens]) + 1
    order = np.lexsort((np.concatenate([h, np.arange(CLASSES, dtype=U)]), -n))
    rank = np.empty(len(n), np.int32)
    rank[order] = np.arange(len(n), dtype=np.int32)
    by_hash = np.argsort(h)
    return Vocabulary(h[by_hash], rank[: len(h)][by_hash], rank[len(h) :], tokens, (n[order] / n.sum()).astype(np.float32), _starts(len(n)), total)


def _starts(n: int) -> np.ndarray:
    """Begins of the groups of n outcomes and their end: longer runs for rarer words, and one outcome at least while there are any."""
    k = np.arange(GROUPS + 1)
    return np.minimum(np.maximum(k, n * k**2 // GROUPS**2), n)


def windows(vocab: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(second last, last, next id, first token of each text) over all tokens of the texts."""
    w = words(texts, True)
    ids, _ = vocab.of(w.hash, w.end - w.start)
    n = len(ids)
    at = np.arange(n) - w.first[w.row]
    last = np.where(at >= 1, ids[np.maximum(np.arange(n) - 1, 0)], vocab.mark) if n else ids
    second = np.where(at >= 2, ids[np.maximum(np.arange(n) - 2, 0)], vocab.mark) if n else ids
    return second, last, ids, w.first


class Rows:
    """Rows of outcomes, the mark and groups, numbered in this order, as every partition starts from them."""

    def __init__(self, vocab: Vocabulary):
        self.groups = vocab.mark + 1
        self.place = self.groups + GROUPS
        self.size = self.place + 1
        self.log = np.log(np.maximum(np.concatenate([vocab.share, [1], vocab.group_share(), [1]]), 1e-12)).astype(np.float32)

    def start(self, ids: np.ndarray) -> np.ndarray:
        """Rows drawn by their number alone, with standard deviation 0.1, and the log share as bias."""
        out = np.empty((len(ids), _WIDE), np.float32)
        for k in range(0, len(ids), 1 << 16):
            own = ids[k : k + (1 << 16)]
            x = mix(own.astype(U)[:, None] * U(2 * DIM) + np.arange(1, 2 * DIM + 1, dtype=U))
            out[k : k + (1 << 16), : 2 * DIM] = ((x >> U(40)).astype(np.float32) / (1 << 24) - 0.5) * np.float32(0.1 * 12**0.5)
            out[k : k + (1 << 16), -1] = self.log[own]
        out[ids == self.place] = 1
        return out


class Trainer:
    """Noise-contrastive steps with Adagrad over words and groups; a batch shares its noise."""

    def __init__(self, vocab: Vocabulary, seed: int):
        self.vocab, self.rows, self.rng = vocab, Rows(vocab), np.random.default_rng(seed)
        self.cuts = [np.cumsum(x, dtype=np.float64) for x in (vocab.share, vocab.group_share())]
        self.at = np.full(self.rows.size, -1, np.int32)  # of rows in the arrays below
        self.own = np.zeros(0, np.int64)
        self.noise_log = np.zeros(0, np.float32)
        self.context, self.target = np.zeros((0, DIM), np.float32), np.zeros((0, DIM + 1), np.float32)
        self.seen = [np.zeros_like(self.context), np.zeros_like(self.target)]
        self.steps = np.zeros((2, 0), np.float32)
        self.place, self.place_seen, self.done = np.ones((2, DIM), np.float32), np.full((2, DIM), 1e-4, np.float32), 0

    def _hold(self, ids: np.ndarray) -> None:
        new = np.unique(ids[self.at[ids] < 0])
        if not len(new):
            return
        have = len(self.own)
        self.at[new] = np.arange(have, have + len(new))
        rows = self.rows.start(new)
        self.own = np.concatenate([self.own, new])
        self.noise_log = np.concatenate([self.noise_log, self.rows.log[new]])
        self.context, self.target = np.concatenate([self.context, rows[:, :DIM]]), np.concatenate([self.target, rows[:, DIM:]])
        self.seen = [np.concatenate([s, np.full((len(new), s.shape[1]), 1e-4, np.float32)]) for s in self.seen]
        self.steps = np.concatenate([self.steps, np.zeros((2, len(new)), np.float32)], axis=1)

    def learn(self, second: np.ndarray, last: np.ndarray, to: np.ndarray) -> None:
        """One pass over tokens in random order."""
        order = self.rng.permutation(len(to))
        to = to[order]
        steps = -(-len(to) // BATCH)
        noise = [np.minimum(np.searchsorted(c, self.rng.random((steps, NOISE)) * c[-1]), len(c) - 1) for c in self.cuts]
        found = [second[order], last[order], to, self.vocab.group(to) + self.rows.groups, noise[0], noise[1] + self.rows.groups]
        for ids in found:
            self._hold(ids.reshape(-1))
        s, t, w, g, nw, ng = (self.at[ids] for ids in found)
        for k in range(steps):
            own = slice(k * BATCH, (k + 1) * BATCH)
            self.step(s[own], t[own], [(w[own], nw[k]), (g[own], ng[k])])

    def gradients(self, second: np.ndarray, last: np.ndarray, outcomes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Of the log-likelihood of telling true outcomes from noise: by place, and (row, gradient) pairs to be added up, of contexts and of targets."""
        shift = np.float32(np.log(NOISE))
        a, b = self.context[second], self.context[last]
        q = np.ones((len(second), DIM + 1), np.float32)
        q[:, :DIM] = a * self.place[0] + b * self.place[1]
        dq, ids, grads = np.zeros_like(a), [], []
        for to, noise in outcomes:
            r, rn = self.target[to], self.target[noise]
            true = np.einsum("ij,ij->i", q, r) - self.noise_log[to] - shift
            false = q @ rn.T - (self.noise_log[noise] + shift)
            dt = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - p
            df = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
            dq += dt[:, None] * r[:, :DIM] + df @ rn[:, :DIM]
            ids += [to, noise]
            grads += [dt[:, None] * q, df.T @ q]
        contexts = np.concatenate([second, last]), np.concatenate([dq * self.place[0], dq * self.place[1]])
        return np.stack([(dq * a).sum(0), (dq * b).sum(0)]), [contexts, (np.concatenate(ids), np.concatenate(grads))]

    def step(self, second: np.ndarray, last: np.ndarray, outcomes: list[tuple[np.ndarray, np.ndarray]]) -> None:
        n = np.float32(len(second))
        place, both = self.gradients(second, last, outcomes)
        place /= n
        for k, (p, rate) in enumerate(((self.context, np.float32(RATE)), (self.target, _RATES))):
            own, g = _scatter(*both[k])
            g /= n
            self.seen[k][own] += g * g
            p[own] += rate * g / np.sqrt(self.seen[k][own])
            self.steps[k][own] += 1
        self.place_seen += place * place
        self.place += np.float32(RATE / 10) * place / np.sqrt(self.place_seen)
        self.done += 1

    def changed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers, steps that changed context and target, values) of all rows held, and of the places."""
        place = np.ones((1, _WIDE), np.float32)
        place[0, : 2 * DIM] = self.place.reshape(-1)
        values = np.concatenate([np.concatenate([self.context, self.target], axis=1), place])
        return np.append(self.own, self.rows.place), np.concatenate([self.steps, np.full((2, 1), self.done, np.float32)], axis=1), values


def _scatter(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and the sums of their rows, by sorting once."""
    order = np.argsort(ids)
    own = ids[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    return own[first], np.add.reduceat(rows[order], first, axis=0)


def _packed(values: np.ndarray) -> pa.Array:
    offs = np.arange(len(values) + 1, dtype=np.int32) * np.int32(4 * _WIDE)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values, np.float32))])


def _unpacked(column: pa.Array) -> np.ndarray:
    return raw(column)[0].view(np.float32).reshape(-1, _WIDE)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition whose text hash comes first, so that no hash gets more rows than there are partitions."""
    seen: set[int] = set()
    for b in batches:
        keep = []
        for h in b.column(0).to_pylist():
            keep.append(h not in seen)
            seen.add(h)
        yield b.filter(pa.array(keep, pa.bool_()))


def train(docs: DataFrame, vocab: Vocabulary) -> Model:
    """One pass over the tokens of distinct texts in every shard, then the weighted mean of each row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        trainer, held, waiting, last_hash = Trainer(shared.value, shard), [], 0, None

        def learn() -> None:
            second, last, to, _ = windows(shared.value, pa.concat_arrays(held))
            if len(to):
                trainer.learn(second, last, to)

        for b in batches:
            h = np.asarray(b.column(0))
            new = np.ones(len(h), bool)
            if len(h):
                new[1:] = h[1:] != h[:-1]
                new[0] = h[0] != last_hash
                last_hash = h[-1]
            # One text at a time, so that what is learnt at once doesn't depend on the batches.
            texts = b.column(1).filter(pa.array(new))
            ends = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
            lo = before = 0
            while lo < len(texts):
                hi = min(len(texts), int(np.searchsorted(ends, before + (1 << 20) - waiting)) + 1)
                held.append(texts.slice(lo, hi - lo))
                waiting, before, lo = waiting + int(ends[hi - 1]) - before, int(ends[hi - 1]), hi
                if waiting >= 1 << 20:
                    learn()
                    held, waiting = [], 0
        if held:
            learn()
        if trainer.done:
            ids, steps, values = trainer.changed()
            for k in range(0, len(ids), 1 << 14):
                own = slice(k, k + (1 << 14))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own].astype(np.int32)), pa.array(np.full(len(ids[own]), shard, np.int32)), pa.array(steps[0, own]), pa.array(steps[1, own]), _packed(values[own])], names=["i", "s", "c", "t", "v"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total, weights = np.zeros(0, np.int64), np.zeros((0, _WIDE), np.float32), np.zeros((0, _WIDE), np.float32)

        def out(k: int) -> Iterator[pa.RecordBatch]:
            for lo in range(0, k, 1 << 14):
                at = slice(lo, min(k, lo + (1 << 14)))
                yield pa.RecordBatch.from_arrays([pa.array(own[at].astype(np.int32)), _packed(total[at] / weights[at])], names=["i", "v"])

        for b in batches:  # sorted, so that sums come out the same every time
            if not b.num_rows:
                continue
            c, t = np.asarray(b.column(2))[:, None], np.asarray(b.column(3))[:, None]
            weight = np.concatenate([np.repeat(c, DIM, 1), np.repeat(t, DIM + 1, 1)], axis=1) + np.float32(1e-6)  # all the same in rows never changed
            ids = np.concatenate([own, np.asarray(b.column(0))])
            first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            total = np.add.reduceat(np.concatenate([total, _unpacked(b.column(4)) * weight]), first, axis=0)
            weights = np.add.reduceat(np.concatenate([weights, weight]), first, axis=0)
            own = ids[first]
            yield from out(len(own) - 1)  # rows of the last one may follow
            own, total, weights = own[-1:], total[-1:], weights[-1:]
        yield from out(len(own))

    texts = _texts(docs).select(F.xxhash64("text").alias("h"), "text").mapInArrow(_distinct, "h long, text string")
    shards = max(1, -(-vocab.total // SHARD))
    parts = texts.repartition(shards, "h").sortWithinPartitions("h").mapInArrow(run, "i int, s int, c float, t float, v binary")
    found = parts.repartition("i").sortWithinPartitions("i", "s").mapInArrow(mean, "i int, v binary").toArrow()
    rows = Rows(vocab)
    values, missing = np.empty((rows.size, _WIDE), np.float32), np.ones(rows.size, bool)
    for b in found.to_batches():
        if b.num_rows:
            values[np.asarray(b.column(0))] = _unpacked(b.column(1))
            missing[np.asarray(b.column(0))] = False
    missing = np.flatnonzero(missing)
    values[missing] = rows.start(missing)
    group = values[rows.groups : rows.place, DIM:].copy()
    group[np.diff(vocab.starts) == 0, DIM] = -np.inf
    return Model(values[: rows.groups, :DIM].copy(), values[rows.place, : 2 * DIM].reshape(2, DIM).copy(), values[: vocab.mark, DIM:].copy(), group)


def _query(model: Model, second: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The predicted representations, with a 1 for the bias."""
    q = np.ones((len(second), DIM + 1), np.float32)
    q[:, :DIM] = model.context[second] * model.place[0] + model.context[last] * model.place[1]
    return q


def _log_sum(q: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log of the sum of exponential scores over all targets, for every representation."""
    out = np.empty(len(q), np.float32)
    step = max(1, (1 << 20) // len(target))
    for k in range(0, len(q), step):
        z = q[k : k + step] @ target.T
        top = z.max(axis=1)
        z -= top[:, None]
        out[k : k + step] = top + np.log(np.exp(z, out=z).sum(axis=1))
    return out


def log_partition(model: Model) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of context words: log of the sum over all groups, worked out once for every pair."""

    def of(second: np.ndarray, last: np.ndarray) -> np.ndarray:
        n = len(model.context)
        pairs, at = np.unique(second.astype(np.int64) * n + last, return_inverse=True)
        return _log_sum(_query(model, pairs // n, pairs % n), model.group)[at]

    return of


def log_probs(model: Model, partition: Callable, second: np.ndarray, last: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Normalised log-probability of the group of each token."""
    return np.einsum("ij,ij->i", _query(model, second, last), model.group[to]) - partition(second, last)


def outcome_log_probs(model: Model, vocab: Vocabulary, partition: Callable, second: np.ndarray, last: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Log-probability of the outcome of each token, normalised over all outcomes: its group, and itself in the group.

    Tokens of one context and group share their sums, which are worked out once.
    """
    group = vocab.group(to)
    n = len(model.context)
    key = (second.astype(np.int64) * n + last) * len(model.group) + group
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    head = order[new]
    # The distinct contexts with their groups, by group.
    by = np.argsort(group[head].astype(np.uint16), kind="stable")
    q, g = _query(model, second[head], last[head]), group[head]
    shared = np.einsum("ij,ij->i", q, model.group[g]) - partition(second[head], last[head])
    norm = np.zeros(len(head))
    cuts = np.flatnonzero(np.diff(g[by].astype(np.int64), prepend=-1, append=-1))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = by[lo:hi]
        begin, end = vocab.starts[g[own[0]]], vocab.starts[g[own[0]] + 1]
        if end - begin > 1:
            norm[own] = _log_sum(q[own], model.target[begin:end])
    single = (np.diff(vocab.starts) <= 1)[group]
    inside = np.where(single, 0.0, np.einsum("ij,ij->i", q[at], model.target[to]))
    return shared[at] + inside - norm[at]


_HELD = 1_000_000
_POSTED = ("high", "low", "place", "times", "uid", "rows")


def class_words(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(uid, own): for each row with words of classes, the sum of the logarithms of their counts in the corpus.

    docs has uid, which only repeated rows share, and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    parts = parts_for(14 * int(vocab.tokens.sum()))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            before = np.cumsum([0] + [len(x[3]) for x in held])
            h, times, uid = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3))
            row = np.concatenate([x[1] + d for x, d in zip(held, before)])
            one, at, copies = np.unique(uid, return_index=True, return_inverse=True, return_counts=True)[1:]
            first = (one[at] == np.arange(len(uid)))[row]  # repeated rows need one entry and their number
            h, row, times = h[first], row[first], times[first]
            for p, own in split(part_of(h, parts), parts):
                who, place = np.unique(row[own], return_inverse=True)
                packed = [(h[own] >> U(32)).astype(np.uint16), h[own].astype(np.uint32), place.astype(np.uint16), times[own].astype(np.uint32), uid[who], copies[at[who]].astype(np.uint32)]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["part", *_POSTED])

        for b in batches:
            for lo, hi in slices(b.column(1)):
                w = words(b.column(1).slice(lo, hi - lo), True)
                rare = np.flatnonzero(shared.value.of(w.hash, w.end - w.start)[1])
                h, row = w.hash[rare] >> U(16), w.row[rare]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
                if held and (waiting > _HELD or rows + hi - lo > 65535):
                    yield from flush()
                    held, waiting, rows = [], 0, 0
                held.append((h[first], row[first], np.diff(np.r_[first, len(h)]), np.asarray(b.column(0))[lo:hi]))
                waiting, rows = waiting + len(first), rows + hi - lo
        if held:
            yield from flush()

    def count(own: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0] + [len(x) // 8 for x in own["uid"]])
        place = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + d for x, d in zip(own["place"], before)])
        h = joined(own["high"], np.uint16).astype(U) << U(32) | joined(own["low"], np.uint32)
        times, uid, rows = joined(own["times"], np.uint32).astype(np.float64), joined(own["uid"], np.int64), joined(own["rows"], np.uint32)
        at = np.unique(h, return_inverse=True)[1]
        total = np.bincount(at, times * rows[place])
        ids, one, where = np.unique(uid, return_index=True, return_inverse=True)
        first = one[where][place] == place
        sums = np.bincount(where[place[first]], times[first] * np.log(total[at[first]]), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sums)], names=["uid", "own"])

    posted = docs.mapInArrow(post, ", ".join(["part int", *(f"{c} binary" for c in _POSTED)]))
    return by_part(posted, parts, count, "uid long, own double").groupBy("uid").agg(F.sum("own").alias("own"))


def score(docs: DataFrame, vocab: Vocabulary | None, model: Model | None) -> DataFrame:
    """(doc_id, n_tokens, mean_log_prob, perplexity) of every row; docs are those that the vocabulary was counted on."""
    spark = prepare(docs.sparkSession)
    own = docs.select(row_id().alias("uid"), F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    if vocab is None:
        none = F.lit(None).cast("double")
        return own.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), none.alias("mean_log_prob"), none.alias("perplexity"))
    shared = spark.sparkContext.broadcast((vocab, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = shared.value
        z, split_ = log_partition(m), v.split()
        for b in batches:
            for lo, hi in slices(b.column(1)):
                second, last, to, first = windows(v, b.column(1).slice(lo, hi - lo))
                total = np.concatenate([[0.0], np.cumsum(outcome_log_probs(m, v, z, second, last, to) - split_[to])])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), pa.array(total[first[1:]] - total[first[:-1]])], names=["uid", "doc_id", "n_tokens", "total"])

    scored = own.mapInArrow(run, "uid long, doc_id long, n_tokens long, total double").join(class_words(own.select("uid", "text"), vocab), "uid", "left")
    mean = (F.col("total") + F.coalesce("own", F.lit(0.0))) / F.nullif(F.col("n_tokens"), F.lit(0))
    return scored.select("doc_id", "n_tokens", mean.alias("mean_log_prob"), F.exp(-mean).alias("perplexity"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocab = vocabulary(docs)
    return score(docs, vocab, train(docs, vocab) if vocab is not None else None)


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
