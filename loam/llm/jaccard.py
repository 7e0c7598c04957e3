"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its folded word n-grams (all its words as one n-gram if
it has fewer). A sketch of counts over all documents orders the n-grams from rare
to frequent and parts them into rare and frequent ones; frequent ones are parted
further into classes by hash, more of them for larger sets. A set with n n-grams
can miss at most n - ceil(t * n) of them in a similar set, so a prefix of its
ordered n-grams is extended until more than that many would have to be missing
for the prefixes to share neither a rare n-gram nor two n-grams of one frequent
class: then similar sets share a single rare n-gram or a pair of frequent ones of
one class, and these are indexed. Every pair that shares one is verified on its
whole sets, so the result is exact but for collisions of 58-bit hashes.

A set carries its few least signatures along. Sets that share two of these make a
cluster, which is told by links to one of them, not by its pairs; all other pairs
that share a signature come out one by one, unless the rank of a shared rare n-gram
leaves too few n-grams to share. Parity bits of both sets give a lower bound of
their difference, which drops most pairs that met by chance. The sets of a cluster
are moved once and compared by products of 0/1 matrices, tile by tile; a large
cluster is parted into blocks of bounded size. So what is moved grows with the sets,
not with the pairs, and equal sets count as one set with a number of documents.

Defined results: rows with a NULL doc_id or without words (NULL and empty texts
too) are in no pair and no class; equal sets have similarity 1; rows that share a
doc_id are one document each for the search, a pair keeps their highest similarity, and
in pairs no document is paired with itself; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, durable, fresh, prepare, row_id, table
from .packed import bounded_set, by_part, joined, member, part_of, parts_for, split
from .textkit import _BASE, U, mix, ngrams, order_by, slices, words

N, THRESHOLD = 3, 0.6
SKETCH_BITS, SKETCH_PARTS = 26, 16
#: An n-gram whose bucket counts more is frequent in any corpus.
RARE = 256
_FREQUENT = 128
#: N-gram hashes that a task holds before it passes them on to the sketch.
_SKETCHED = 4_000_000
#: N-grams of one block of sets in verification.
BLOCK = 1_000_000
#: Signatures that a task holds before it passes them on.
HELD = 2_000_000
_LEAST, _NONE = 4, 0xFFFFFFFF
_PACKED = ("high", "low", "place", "rest", "id", "size", "least")
#: Sets and n-grams of a tile of a cluster's comparison.
_TILE, _COLUMNS = 512, 8192


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(58-bit n-gram hashes, sorted and distinct in each row; first of each row)."""
    w = words(texts, True)
    h, at, _ = ngrams(w, n)
    row = w.row[at]
    count = np.diff(w.first)
    for c in range(1, n):
        short = np.flatnonzero(count == c)
        own = np.zeros(len(short), U)
        for k in range(c):
            own = own * U(_BASE) + w.hash[w.first[short] + k]
        h, row = np.concatenate([h, mix(own + U(c))]), np.concatenate([row, short])
    h = h >> U(6)
    order = order_by(row, h)
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(count) + 1))


def set_ids(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, the same for equal sets."""
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h + U(1)), out=sums[1:])
    return mix((sums[first[1:]] - sums[first[:-1]]) ^ mix(np.diff(first).astype(U)))


def parity_bits(h: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each set, the parities of its n-grams by their last bits, in two to four bits an n-gram.

    Two such strings, the longer one folded, differ in at most as many bits as the sets differ in n-grams.
    """
    n = np.diff(first)
    size = np.int64(1) << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(begin[:-1], n) + (h & np.repeat(size - 1, n).astype(U)).astype(np.int64)
    bits = np.packbits((np.bincount(at, minlength=begin[-1]) & 1).astype(np.uint8), bitorder="little")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((begin // 8).tobytes()), pa.py_buffer(bits.tobytes())]).cast(pa.binary())


def may_be_similar(a: bytes, b: bytes, na: int, nb: int, threshold: float) -> bool:
    """Whether parity bits leave it open that sets of these sizes are similar."""
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    v, k, least = int.from_bytes(y, "little"), 8 * len(y), 8 * len(x)
    while k > least:
        k >>= 1
        v = (v >> k) ^ (v & ((1 << k) - 1))
    return (v ^ int.from_bytes(x, "little")).bit_count() <= na + nb - 2 * math.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)


def _own(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL AND text != ''")


def _gaps(values: np.ndarray) -> bytes:
    """Sorted numbers as the gaps between them: a byte each, 255 adding up, or four bytes each (told by the first byte)."""
    gap = np.diff(values, prepend=0)
    if len(gap) and gap.mean() > 64:
        return b"\x01" + gap.astype(np.uint32).tobytes()
    more = gap // 255
    out = np.full(int(more.sum()) + len(gap), 255, np.uint8)
    out[np.cumsum(more + 1) - 1] = gap % 255
    return b"\x00" + out.tobytes()


def _ungap(packed: bytes) -> np.ndarray:
    if packed[:1] == b"\x01":
        return np.cumsum(np.frombuffer(packed, np.uint32, offset=1), dtype=np.int64)
    gap = np.frombuffer(packed, np.uint8, offset=1)
    return np.cumsum(gap, dtype=np.int64)[gap < 255]


def survey(docs: DataFrame, n: int) -> DataFrame:
    """One pass over all documents, kept: rows with part hold the sorted n-gram hashes of a task, cut to
    SKETCH_BITS, that fall into a sixteenth of the sketch, and their number; rows without hold the
    set of each document, its size and its parity bits.
    """
    names = ["part", "n", "grams", "id", "doc_id", "size", "bits"]
    step = (1 << SKETCH_BITS) // SKETCH_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.sort(np.concatenate(held))
            cuts = np.searchsorted(found, np.arange(SKETCH_PARTS + 1) * step)
            packed = [_gaps(found[cuts[p] : cuts[p + 1]].astype(np.int64) - p * step) for p in range(SKETCH_PARTS)]
            none = pa.nulls(SKETCH_PARTS, pa.int64())
            rest = [pa.nulls(SKETCH_PARTS, k) for k in (pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_PARTS), pa.int32()), pa.array(packed, pa.binary()), pa.array(np.diff(cuts)), none, none, *rest], names=names)

        for b in batches:
            for lo, hi in slices(b.column(1)):
                h, first = gram_sets(b.column(1).slice(lo, hi - lo), n)
                held.append((h >> U(58 - SKETCH_BITS)).astype(np.uint32))
                some = np.diff(first) > 0
                k = int(some.sum())
                ids = pa.array(set_ids(h, first)[some].view(np.int64))
                own = b.column(0).slice(lo, hi - lo).filter(pa.array(some))
                first = np.r_[first[:-1][some], first[-1:]]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64()), ids, own, pa.array(np.diff(first).astype(np.int32)), parity_bits(h, first)], names=names)
            if sum(map(len, held)) > _SKETCHED:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    return durable(docs.mapInArrow(run, "part int, n binary, grams long, id long, doc_id long, size int, bits binary"))


def grades(counts: np.ndarray, mean: float) -> np.ndarray:
    """A byte for each bucket: its count's power of two, and _FREQUENT if n-grams of it are frequent."""
    often = counts > min(mean + 6 * np.sqrt(mean) + 16, RARE)
    return np.log2(np.maximum(counts, 1)).astype(np.uint8) | np.where(often, _FREQUENT, 0).astype(np.uint8)


def sketch(surveyed: DataFrame) -> tuple[np.ndarray, int]:
    """(grades of all hash buckets by the n-grams of all documents, number of these).

    There is a bucket for every eight n-grams or so, 2**SKETCH_BITS (64 MB) at most.
    """
    packed = surveyed.where("part IS NOT NULL").select("part", "n", "grams")
    total = packed.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    bits = min(SKETCH_BITS, max(16, (total // 8).bit_length()))
    size = (1 << bits) // SKETCH_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for p, x in zip(b.column(0).to_pylist(), b.column(1)):
                own = held.setdefault(p, np.zeros(size, np.int64))
                own += np.bincount(_ungap(x.as_py()) >> (SKETCH_BITS - bits), minlength=size)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([grades(x, total / (1 << bits)).tobytes() for x in held.values()], pa.binary())], names=["part", "n"])

    out = np.zeros((SKETCH_PARTS, size), np.uint8)
    for r in packed.select("part", "n").repartition(SKETCH_PARTS, "part").mapInArrow(run, "part int, n binary").collect():
        out[r.part] = np.frombuffer(r.n, np.uint8)
    return out.reshape(-1), total


def members(surveyed: DataFrame) -> DataFrame:
    """(id, doc_id) of all documents with words: which set each of them has."""
    return surveyed.where("part IS NULL").select("id", "doc_id").distinct()


class Prefixes:
    """Signatures of sets under one order of n-grams."""

    def __init__(self, grades: np.ndarray, threshold: float):
        self.t, self.grades, self.bits = threshold, grades, len(grades).bit_length() - 1

    def regime(self, n: np.ndarray) -> np.ndarray:
        """Size class: sets that can be similar are of the same or of neighbouring ones."""
        return np.floor(np.log(np.maximum(n, 1)) / -np.log(self.t) + 1e-9).astype(np.int64) if self.t < 1 else np.asarray(n, np.int64)

    def classes(self, regime: np.ndarray) -> np.ndarray:
        """Classes of frequent n-grams for sets of a size class; 0: index them singly."""
        least = np.power(1 / self.t, np.maximum(regime, 0)) if self.t < 1 else np.maximum(regime, 1)
        return np.minimum(least * (1 - self.t) / 3, np.maximum(np.ceil(self.t * least) - 1, 0)).astype(np.int64)

    def signatures(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(signature of 48 bits, row, rest) of every set of a batch.

        rest bounds, in 255ths of the set, how much of it the first common n-gram leaves to be
        shared, itself included, if that is the rare n-gram of this signature.
        """
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        grade = self.grades[(h >> U(58 - self.bits)).astype(np.int64)]
        often = grade >= _FREQUENT
        key = grade.astype(U) << U(56) | mix(h) >> U(8)
        order = order_by(row, key)
        h, often = h[order], often[order]
        need = (n - np.ceil(self.t * n - 1e-9).astype(np.int64) + 1)[row]
        at = np.arange(len(h)) - first[:-1][row] if len(h) else row
        rare = np.flatnonzero(~often & (at < need))
        size = n[row[rare]]
        sigs, rows, rests = [mix(h[rare])], [row[rare]], [-(-255 * (size - at[rare]) // size)]
        own = self.regime(n)
        f = np.flatnonzero(often)
        for back in (0, 1):
            m = self.classes(own - back)[row[f]]
            if back:
                fresh = own[row[f]] > 0
                f, m = f[fresh], m[fresh]
            single = m == 0
            cls = np.where(single, 0, (mix(h[f] ^ U(0x51ED270B)) % np.maximum(m, 1).astype(U)).astype(np.int64))
            by = np.lexsort((at[f], cls, row[f]))
            fresh = np.ones(len(f), bool)
            a, b = f[by][1:], f[by][:-1]
            fresh[by[1:]] = (row[a] != row[b]) | (cls[by][1:] != cls[by][:-1])
            gain = np.where(single, 1, ~fresh)
            rares = at[f] - (np.arange(len(f)) - np.searchsorted(row[f], row[f]))
            sums = np.concatenate([[0], np.cumsum(gain)])
            before = sums[:-1] - sums[np.searchsorted(row[f], row[f])]
            keep = rares + before < need[f]
            one = keep & single
            sigs.append(mix(h[f[one]]))
            rows.append(row[f[one]])
            two = by[keep[by] & ~single[by]]
            g, r, c = h[f[two]], row[f[two]], cls[two]
            salt = U(0xA24BAED4963EE407) + (own - back).astype(U)
            for d in range(1, len(g)):
                same = np.flatnonzero((r[:-d] == r[d:]) & (c[:-d] == c[d:]))
                if not len(same):
                    break
                sigs.append(mix(g[same] * U(_BASE) + mix(g[same + d] + salt[r[same]])))
                rows.append(r[same])
        sig, row, rest = np.concatenate(sigs) >> U(16), np.concatenate(rows), np.full(sum(map(len, sigs)), 255, np.uint8)
        rest[: len(rare)] = rests[0]
        return sig, row, rest


def _least(sig: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """32 bits of the least signatures of each row, sorted by signature; _NONE for missing ones."""
    order = order_by(row, sig)
    sig, row = sig[order], row[order]
    at = np.arange(len(sig)) - np.searchsorted(row, np.arange(rows))[row]
    out = np.full((rows, _LEAST), _NONE, np.uint32)
    few = at < _LEAST
    out[row[few], at[few]] = np.minimum(sig[few] & U(0xFFFFFFFF), U(_NONE - 1))
    return out


def _twos(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of every two least signatures of a row."""
    keys, rows = [], []
    for i, j in combinations(range(_LEAST), 2):
        own = np.flatnonzero(least[:, j] != _NONE)
        keys.append(least[own, i].astype(U) << U(32) | least[own, j])
        rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


def _linked(key: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The least row of each row's component, where rows of one key are linked."""
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[starts, len(key)])
    keep = np.repeat(size > 1, size)
    row, size = row[keep], size[size > 1]
    label = np.arange(rows)
    if not len(row):
        return label
    starts = np.cumsum(size) - size
    while True:
        least = np.repeat(np.minimum.reduceat(label[row], starts), size)
        after = label.copy()
        np.minimum.at(after, row, least)
        np.minimum.at(after, label[row], least)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def candidates(docs: DataFrame, surveyed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(x, y, nx, ny): ids and sizes of distinct sets that share a signature, x < y.

    Sets that share two of their few least signatures are near copies in all likelihood;
    they make clusters, of which only the links to the least set come out, with NULL sizes.
    Sets of one cluster are all compared with each other later, so pairs within one are left out.
    """
    spark = docs.sparkSession
    graded, total = sketch(surveyed)
    parts = parts_for(int(total * (1 - threshold)) * 10)
    shared = spark.sparkContext.broadcast(Prefixes(graded, threshold))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = rows = 0

        def flush() -> Iterator[pa.RecordBatch]:
            docs_before = np.cumsum([0] + [len(x[3]) for x in held])
            sig, rest, ids, size, least = (np.concatenate([x[k] for x in held]) for k in (0, 2, 3, 4, 5))
            row = np.concatenate([x[1] + d for x, d in zip(held, docs_before)])
            one, at = np.unique(ids, return_index=True, return_inverse=True)[1:]
            first = (one[at] == np.arange(len(ids)))[row]  # equal sets need one entry
            sig, row, rest = sig[first], row[first], rest[first]
            for p, at in split(part_of(sig, parts), parts):
                who, place = np.unique(row[at], return_inverse=True)
                packed = [(sig[at] >> U(32)).astype(np.uint16), sig[at].astype(np.uint32), place.astype(np.uint16), rest[at], ids[who], size[who].astype(np.int32), least[who]]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["part", *_PACKED])

        for b in batches:
            for lo, hi in slices(b.column(1)):
                h, first = gram_sets(b.column(1).slice(lo, hi - lo), n)
                if not len(h):
                    continue
                if held and (waiting > HELD or rows + hi - lo > 65535):
                    yield from flush()
                    held, waiting, rows = [], 0, 0
                ids = set_ids(h, first)
                sig, row, rest = shared.value.signatures(h, first)
                held.append((sig, row, rest, ids, np.diff(first), _least(sig, row, len(ids))))
                waiting, rows = waiting + len(sig), rows + len(ids)
        if held:
            yield from flush()

    def meet(own: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        before = np.cumsum([0] + [len(x) // 8 for x in own["id"]])
        who = np.concatenate([np.frombuffer(x, np.uint16).astype(np.int64) + d for x, d in zip(own["place"], before)])
        sig = joined(own["high"], np.uint16).astype(U) << U(32) | joined(own["low"], np.uint32)
        ids, size, rest = joined(own["id"], U), joined(own["size"], np.int32), joined(own["rest"], np.uint8)
        least = joined(own["least"], np.uint32).reshape(-1, _LEAST)
        ids, one, at = np.unique(ids, return_index=True, return_inverse=True)
        size, least, who = size[one], least[one], at[who]
        order = np.argsort(sig, kind="stable")
        again = sig[order][1:] == sig[order][:-1]
        order = order[np.r_[False, again] | np.r_[again, False]] if len(order) else order
        cluster = _linked(*_twos(least), len(ids))
        order = order[np.lexsort((who[order], cluster[who[order]], sig[order]))]
        sig, who, rest = sig[order], who[order], rest[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])] if len(sig) else np.zeros(0, bool)
        sig, who, rest = sig[new], who[new], rest[new]

        # Links of clusters: sets that have this signature and another one among their least, in the list of the first.
        home, a = np.nonzero(least[who] == np.minimum(sig & U(0xFFFFFFFF), U(_NONE - 1)).astype(np.uint32)[:, None])
        t = np.concatenate([home[a < b] for b in range(1, _LEAST)])
        other = np.concatenate([least[who[home[a < b]], b] for b in range(1, _LEAST)])
        t, other = t[other != _NONE], other[other != _NONE]
        by = np.lexsort((who[t], other, sig[t]))
        t, other = t[by], other[by]
        first = np.r_[True, (sig[t][1:] != sig[t][:-1]) | (other[1:] != other[:-1])] if len(t) else np.zeros(0, bool)
        root = who[t][np.maximum.accumulate(np.where(first, np.arange(len(t)), 0))] if len(t) else t
        links = [np.minimum(root, who[t]) << 32 | np.maximum(root, who[t])]

        # Pairs of different clusters: each entry with those that follow its cluster's in the same list.
        fresh = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
        end = np.repeat(np.r_[fresh[1:], len(sig)], np.diff(np.r_[fresh, len(sig)])) if len(sig) else fresh
        cuts = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (cluster[who][1:] != cluster[who][:-1])]) if len(sig) else fresh
        begin = np.repeat(np.r_[cuts[1:], len(sig)], np.diff(np.r_[cuts, len(sig)])) if len(sig) else fresh
        count = np.maximum(end - begin, 0)
        sums = np.concatenate([[0], np.cumsum(count)])
        found, waiting, lo = [], 0, 0
        while lo < len(sig):
            hi = max(lo + 1, int(np.searchsorted(sums, sums[lo] + (1 << 20), "right")) - 1)
            i = np.repeat(np.arange(lo, hi), count[lo:hi])
            j = np.arange(len(i)) - np.repeat(sums[lo:hi] - sums[lo], count[lo:hi]) + begin[i]
            lo = hi
            a, b = who[i], who[j]
            na, nb = size[a].astype(np.int64), size[b].astype(np.int64)
            near = np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9
            common = np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9)
            near &= (rest[i] * na // 255 >= common) & (rest[j] * nb // 255 >= common)
            pairs = np.minimum(a, b)[near] << 32 | np.maximum(a, b)[near]
            found.append(pairs)
            waiting += len(pairs)
            if waiting > 1 << 22:
                found = [np.unique(np.concatenate(found))]
                waiting = 0
        for kind, pairs in enumerate((found, links)):
            pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
            pairs = pairs[pairs >> 32 != pairs & 0xFFFFFFFF]
            for k in range(0, len(pairs), 50_000):
                a, b = pairs[k : k + 50_000] >> 32, pairs[k : k + 50_000] & 0xFFFFFFFF
                swap = ids[a].view(np.int64) > ids[b].view(np.int64)
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                none = np.full(len(a), bool(kind))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a].view(np.int64)), pa.array(ids[b].view(np.int64)), pa.array(size[a], mask=none), pa.array(size[b], mask=none)], names=["x", "y", "nx", "ny"])

    packed = docs.mapInArrow(index, ", ".join(["part int", *(f"{c} binary" for c in _PACKED)]))
    return by_part(packed, parts, meet, "x long, y long, nx int, ny int").distinct()


def _sets(docs: DataFrame, n: int, wanted: np.ndarray | None) -> DataFrame:
    """(id, grams) of the sets in `wanted`, once each."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for lo, hi in slices(b.column(1)):
                h, first = gram_sets(b.column(1).slice(lo, hi - lo), n)
                ids = set_ids(h, first)
                rows = np.flatnonzero(member(shared.value, ids) & (np.diff(first) > 0))
                own = {i: r for r, i in zip(rows.tolist(), ids[rows].view(np.int64).tolist()) if i not in seen}
                seen.update(own)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([h[first[r] : first[r + 1]].tobytes() for r in own.values()], pa.binary())], names=["id", "grams"])

    return docs.mapInArrow(run, "id long, grams binary").dropDuplicates(["id"])


def _checked(pairs: DataFrame, payload: DataFrame, check: Callable[[bytes, bytes], float], kind: str) -> DataFrame:
    """(x, y, nx, ny, value) of the pairs whose payloads pass: check gives a value, or a negative one.

    pairs has a column lead, by which both sides of a pair meet; a group whose sets have
    more than BLOCK n-grams is parted into blocks of pairs.
    """
    spark = pairs.sparkSession
    in_group = pairs.select("lead", F.col("x").alias("id"), F.col("nx").alias("n")).union(pairs.select("lead", F.col("y").alias("id"), F.col("ny").alias("n"))).distinct()
    blocks = in_group.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("b"))
    led = pairs.join(blocks, "lead").withColumns({"p": F.pmod(F.xxhash64("x"), "b"), "q": F.pmod(F.xxhash64("y"), "b")})
    led = durable(led.select("lead", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "x", "y", "nx", "ny"))
    places = led.select("lead", "p", "q", F.col("x").alias("id")).union(led.select("lead", "p", "q", F.col("y").alias("id"))).distinct()
    none = F.lit(None)
    empty = [none.cast("long").alias("y"), none.cast("int").alias("nx"), none.cast("int").alias("ny")]
    shipped = places.join(payload, "id").select("lead", "p", "q", F.lit(0).alias("kind"), F.col("id").alias("x"), *empty, F.col(kind).alias("body"))
    rows = shipped.union(led.select("lead", "p", "q", F.lit(1), "x", "y", "nx", "ny", none.cast("binary")))
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lead", "p", "q").sortWithinPartitions("lead", "p", "q", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, {}
        for b in batches:
            lead, p, q, which, x, y, nx, ny, body = (c.to_pylist() for c in b.columns)
            out = []
            for k in range(b.num_rows):
                now = (lead[k], p[k], q[k])
                if now != key:
                    key, own = now, {}
                if which[k] == 0:
                    own[x[k]] = body[k]
                    continue
                value = check(own[x[k]], own[y[k]], nx[k], ny[k])
                if value >= 0:
                    out.append((x[k], y[k], nx[k], ny[k], value))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["x", "y", "nx", "ny", "value"])

    return rows.mapInArrow(run, "x long, y long, nx int, ny int, value double")


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, similarity) of the pairs of a set in left and one in right that are similar enough, tile by tile.

    Common n-grams are counted by products of 0/1 matrices. If left is right, a < b in its order.
    """
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[token] > 1
    row, token = row[keep], token[keep]
    first = np.searchsorted(row, np.arange(len(sets) + 1))

    def dense(rows: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(tokens)), np.float32)
        for k, r in enumerate(rows.tolist()):
            own = token[first[r] : first[r + 1]]
            at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
            out[k, at[tokens[at] == own]] = 1
        return out

    same = left is right
    if not len(left) or not len(right):
        return
    for i in range(0, len(left), _TILE):
        for j in range(i if same else 0, len(right), _TILE):
            a, b = left[i : i + _TILE], right[j : j + _TILE]
            tokens = np.intersect1d(*(np.concatenate([token[first[r] : first[r + 1]] for r in x.tolist()]) for x in (a, b)))
            common = np.zeros((len(a), len(b)), np.float32)
            for k in range(0, len(tokens), _COLUMNS):
                own = tokens[k : k + _COLUMNS]
                x = dense(a, own)
                common += x @ (x if same and i == j else dense(b, own)).T
            value = common.astype(np.float64) / (size[a][:, None] + size[b][None, :] - common)
            hit = value >= threshold
            if same and i == j:
                hit = np.triu(hit, 1)
            x, y = np.nonzero(hit)
            yield a[x], b[y], value[x, y]


def _within(labels: DataFrame, counts: DataFrame, payload: DataFrame, threshold: float, pairs: bool) -> DataFrame:
    """(x, y, value) of the sets of each cluster that are similar enough: all pairs of them and their
    similarity, or links that connect the same sets (value NULL) and, for each set x with y NULL,
    how many documents have sets similar to it.

    A cluster of more than BLOCK n-grams is parted into blocks by hash, which meet two by two.
    """
    spark = labels.sparkSession
    own = labels.join(counts, "id")
    blocks = own.groupBy("label").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("b"))
    own = own.join(blocks, "label").withColumn("p", F.pmod(F.xxhash64("id"), "b")).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - F.lit(1).cast("long"))))
    rows = own.join(payload, "id").select("label", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), "p", "id", "times", "grams")
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "lo", "hi").sortWithinPartitions("label", "lo", "hi")

    def compare(lo: int, hi: int, group: list[tuple]) -> tuple[list, list, list]:
        ids, times, side = (np.array([g[k] for g in group], np.int64) for k in (1, 2, 0))
        sets = [np.frombuffer(g[3], U) for g in group]
        left = right = np.arange(len(ids))
        if lo != hi:
            left, right = np.flatnonzero(side == lo), np.flatnonzero(side == hi)
        x, y, value = [], [], []
        links = np.zeros(len(ids))
        for a, b, v in similar(sets, left, right, threshold):
            if not pairs:
                links += np.bincount(a, times[b], len(ids)) + np.bincount(b, times[a], len(ids))
                root = _linked(np.repeat(np.arange(len(a)), 2), np.stack([a, b], 1).reshape(-1), len(ids))
                a = np.flatnonzero(root != np.arange(len(ids)))
                b, v = root[a], np.full(len(a), np.nan)
            x += ids[a].tolist()
            y += ids[b].tolist()
            value += v.tolist()
        some = np.flatnonzero(links)
        return x + ids[some].tolist(), y + [None] * len(some), [None if v != v else v for v in value] + links[some].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            found = compare(key[1], key[2], group) if len(group) > 1 else ([], [], [])
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.float64()))], names=["x", "y", "value"])

        key, group = None, []
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for k in range(b.num_rows):
                now = (cols[0][k], cols[1][k], cols[2][k])
                if now != key:
                    yield from out()
                    key, group = now, []
                group.append((cols[3][k], cols[4][k], cols[5][k], cols[6][k]))
        yield from out()

    return rows.mapInArrow(run, "x long, y long, value double")


def similar_sets(docs: DataFrame, surveyed: DataFrame, n: int = N, threshold: float = THRESHOLD, pairs: bool = False) -> DataFrame:
    """(x, y, value), kept: ids of distinct sets that are similar enough, with their similarity if `pairs`.

    Without `pairs`, clusters give links that connect the same sets instead of all of their pairs, and rows
    with y NULL tell in value how many documents of other sets are similar to set x, in parts to be added up.

    Parity bits first drop most pairs of different clusters that share a signature by chance.
    """
    found = durable(candidates(docs, surveyed, n, threshold))
    labels = components(found.where("nx IS NULL").select("x", "y"))
    one, two = labels.select(F.col("id").alias("x"), F.col("label").alias("lx")), labels.select(F.col("id").alias("y"), F.col("label").alias("ly"))
    apart = found.where("nx IS NOT NULL").join(one, "x", "left").join(two, "y", "left").where("lx IS NULL OR ly IS NULL OR lx != ly").select("x", "y", "nx", "ny")

    def led(chosen: DataFrame) -> DataFrame:
        sides = chosen.select(F.col("x").alias("id"), F.col("y").alias("other")).union(chosen.select("y", "x"))
        least = sides.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("lead"))
        return chosen.join(least.withColumnRenamed("id", "x"), "x")

    def by_bits(a: bytes, b: bytes, na: int, nb: int) -> float:
        return 0.0 if may_be_similar(a, b, na, nb, threshold) else -1.0

    bits = surveyed.where("part IS NULL").select("id", "bits").dropDuplicates(["id"])
    likely = durable(_checked(led(durable(apart)), bits, by_bits, "bits").select("x", "y", "nx", "ny"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(b.column(0)).tobytes()], pa.binary())], names=["v"])

    ids = durable(labels.select("id").union(likely.select("x")).union(likely.select("y")).distinct())
    grams = _sets(docs, n, bounded_set(ids.mapInArrow(pack, "v binary"), ids.count()))

    def by_sets(a: bytes, b: bytes, na: int, nb: int) -> float:
        both = np.concatenate([np.frombuffer(a, U), np.frombuffer(b, U)])
        both.sort(kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        value = common / (len(both) - common)
        return value if value >= threshold else -1.0

    counts = surveyed.where("part IS NULL").groupBy("id").agg(F.max("size").alias("n"), F.countDistinct("doc_id").alias("times"))
    within = _within(labels, counts, grams, threshold, pairs)
    across = _checked(led(likely), grams, by_sets, "grams").select("x", "y", "value")
    if pairs:
        return durable(within.union(across))
    across = durable(across)
    times = counts.select("id", "times")
    sides = across.select("x", F.col("y").alias("id")).union(across.select("y", "x")).join(times, "id").select("x", F.lit(None).cast("long"), F.col("times").cast("double"))
    return durable(within.union(across.select("x", "y", F.lit(None).cast("double"))).union(sides))


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard) of all pairs of documents, doc_a < doc_b, that are similar enough.

    Its rows grow with the square of a group of copies: for tables of few copies. `classes` tells
    the same groups in a row a document.
    """
    docs = _own(docs)
    surveyed = survey(docs, n)
    who, sets = members(surveyed), similar_sets(docs, surveyed, n, threshold, True)
    a, b = who.select(F.col("id").alias("x"), F.col("doc_id").alias("a")), who.select(F.col("id").alias("y"), F.col("doc_id").alias("b"))
    across = sets.join(a, "x").join(b, "y").select("a", "b", F.col("value").alias("jaccard"))
    equal = a.join(b, F.col("x") == F.col("y")).where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    pairs = across.union(equal).where("a != b").select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), "jaccard")
    return pairs.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of the nodes x, y of edges: the least id of its connected component.

    Labels spread to neighbours and then jump to the label of their label, so
    rounds grow with the logarithm of the longest path.
    """
    both = durable(edges.select(F.col("x").alias("id"), F.col("y").alias("other")).union(edges.select("y", "x")).distinct())
    labels = durable(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        spread = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        after = durable(spread.join(jump, "new", "left").select("id", "label", F.least("new", F.coalesce("far", "new")).alias("new")))
        changed = after.where("label != new").limit(1).count()
        labels = after.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def _grouped(who: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, kept) of all documents: the least doc_id that edges of sets connect it with."""
    named = who.join(components(edges), "id", "left").select("doc_id", F.coalesce("label", "id").alias("label"))
    # A doc_id of several rows belongs to several sets; their groups are one.
    twice = named.groupBy("doc_id").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y")
    if twice.limit(1).count():
        more = components(named.groupBy("doc_id").agg(F.min("label").alias("x")).join(named, "doc_id").select("x", F.col("label").alias("y")).where("x != y"))
        named = named.join(more.withColumnRenamed("label", "top"), named.label == more.id, "left").select("doc_id", F.coalesce("top", named.label).alias("label"))
    named = named.distinct()
    return named.join(named.groupBy("label").agg(F.min("doc_id").alias("kept")), "label").select("doc_id", "kept")


def groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, kept): each document that resembles another, and the least doc_id of its group."""
    return classes(docs, n, threshold).select("doc_id", F.col("class_id").alias("kept"))


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): each document that resembles another, the least doc_id of those that
    it is connected with by resemblance, and the number of documents that it resembles itself.

    Of rows that share a doc_id, those of equal sets count once and others one by one: their links add up,
    and links between them aren't to another document but count.
    """
    docs = _own(docs)
    surveyed = survey(docs, n)
    who, sets = durable(members(surveyed)), similar_sets(docs, surveyed, n, threshold)
    kept = _grouped(who, sets.where("y IS NOT NULL").select("x", "y"))
    links = sets.where("y IS NULL").groupBy("x").agg(F.sum("value").cast("long").alias("own"))
    equal = who.groupBy("id").agg(F.count("*").alias("times"))
    named = who.join(equal, "id").join(links, F.col("id") == F.col("x"), "left")
    named = named.groupBy("doc_id").agg(F.sum(F.col("times") - 1 + F.coalesce("own", F.lit(0))).alias("links")).where("links > 0")
    return named.join(kept, "doc_id").select("doc_id", F.col("kept").alias("class_id"), "links")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row, that with the least doc_id, of each group of near copies; rows
    without doc_id come last, and of rows that repeat a doc_id and text one stays.
    """
    row = fresh(docs, "_row")
    marked = docs.withColumn(row, row_id())
    named = groups(docs.select(row_id().alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("kept").alias("group"))
    rows = docs.select(row_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL AND text != ''")
    rows = rows.groupBy("row").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    judged = rows.join(named, "row", "left").where("group IS NOT NULL OR n > 1").withColumn("group", F.coalesce("group", "row"))
    first = judged.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
    judged = durable(judged.join(first, "group").select("row", "n", (F.col("first.row") == F.col("row")).alias("kept"))).withColumnRenamed("row", row)
    once = marked.join(judged.where("NOT kept OR n > 1").select(row), row, "left_anti")
    more = marked.join(judged.where("kept AND n > 1").select(row), row, "left_semi").dropDuplicates([row])
    return once.unionByName(more).select(*[col(c) for c in docs.columns])


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLE_SQL = {
    "op2_ngram_jaccard": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10ffff}}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - {N - 1}), lambda i: array_to_string(w[i : i + {N - 1}], ' ')) END) AS g
  FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), pairs AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c)::DOUBLE >= {THRESHOLD}
), reach AS (
  SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b
)
SELECT doc_id, class_id, links FROM (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a) JOIN (SELECT a AS doc_id, count(*) AS links FROM pairs GROUP BY a) USING (doc_id)"""
}
