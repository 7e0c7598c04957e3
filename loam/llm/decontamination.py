"""Benchmark decontamination by greedy string tiling.

A document and a benchmark item that share a seed (a run of `seed` folded words)
become a candidate. Their words are tiled greedily: the longest common run of
unmarked words, found by running Karp-Rabin hashes at bisected lengths, is
marked in both, again and again, down to the seed length. The share of the
item's words under tiles is its coverage; tiles may come in any order, so
reordered passages count. Items shorter than a seed use their own length.

Defined results: rows with a NULL or wordless text never match; rows that share
a doc_id or item_id are tiled one by one, and the best coverage of a pair is
kept; of equally long runs the first in the document, then in the item, is tiled first; rows
without doc_id or item_id have no pairs, but the pipeline stage judges and drops documents
without doc_id like others; texts are matched whole; an empty table gives an empty result. Other
columns, whatever their names, are ignored. A benchmark beyond BROADCAST_BYTES takes another way to the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, prepare, row_id, table
from .textkit import _BASE, U, Words, mix, ngrams, prefix_sums, slices, span_hash, words

SEED_WORDS = 5
COVERAGE = 0.5
#: A benchmark of more bytes is joined by shuffles, not broadcast.
BROADCAST_BYTES = 16 << 20
_OUT = "doc_id long, item_id long, tiles int, matched int, item_words int, coverage double"
_BITS = 20


def _runs(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows of `size` positions that are all free."""
    if len(free) < size:
        return np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(taken[size:] == taken[:-size])


def _starts_of(hashes: np.ndarray) -> dict[int, list[int]]:
    where: dict[int, list[int]] = {}
    for p, h in enumerate(hashes.tolist()):
        where.setdefault(h, []).append(p)
    return where


class _Pair:
    """Two sequences of words with prefix sums, so that Karp-Rabin hashes of any length take one step a window."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = a, b
        self.sums = prefix_sums(a), prefix_sums(b)
        self.free = np.ones(len(a), bool), np.ones(len(b), bool)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts and hashes of the free windows of a that b has too, and of those of b)."""
        i, j = (_runs(f, size) for f in self.free)
        ha, hb = (span_hash(s, x, x + size) for s, x in zip(self.sums, (i, j)))
        inside = np.isin(ha, hb)
        return i[inside], ha[inside], j, hb

    def equal(self, i: int, j: int, size: int) -> bool:
        return np.array_equal(self.a[i : i + size], self.b[j : j + size])

    def any(self, size: int) -> bool:
        """Whether some free windows match, word by word."""
        i, ha, j, hb = self.windows(size)
        if not len(i):
            return False
        where = _starts_of(hb)
        return any(self.equal(p, int(j[q]), size) for p, h in zip(i.tolist(), ha.tolist()) for q in where[h][:1]) or any(self.equal(p, int(j[q]), size) for p, h in zip(i.tolist(), ha.tolist()) for q in where[h][1:])

    def mark(self, size: int) -> list[tuple[int, int, int]]:
        """Tiles of this length: each free window of a with the first free one of b that it matches."""
        i, ha, j, hb = self.windows(size)
        where, (free_a, free_b), tiles = _starts_of(hb), self.free, []
        for p, h in zip(i.tolist(), ha.tolist()):
            if not free_a[p : p + size].all():
                continue
            left = where[h]
            at = 0
            while at < len(left):
                q = int(j[left[at]])
                if not free_b[q : q + size].all():
                    left.pop(at)  # never free again
                elif self.equal(p, q, size):
                    free_a[p : p + size] = free_b[q : q + size] = False
                    tiles.append((p, q, size))
                    break
                else:
                    at += 1
        return tiles


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in a, start in b, length) of at least `least` tokens, longest first."""
    pair, tiles, top = _Pair(a, b), [], min(len(a), len(b))
    while top >= least and pair.any(least):
        lo, hi = least, top
        while lo < hi:  # a match of some length has matches of all smaller ones within
            mid = (lo + hi + 1) // 2
            if pair.any(mid):
                lo = mid
            else:
                hi = mid - 1
        tiles += pair.mark(lo)
        top = lo
    return tiles


def _roll(tokens: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all windows of `size` words, those of `ngrams`."""
    h = np.zeros(len(tokens) - size + 1, U)
    for k in range(size):
        h = h * U(_BASE) + tokens[k : k + len(h)]
    return mix(h)


class Bench:
    """Seeds of a benchmark, sorted by hash, with a bit table in front."""

    def __init__(self, ids: list[int], texts: list[str], seed: int):
        w = words(pa.array(texts, pa.string()), True)
        self.seed, self.items, hashes, rows, sizes = seed, [], [], [], []
        for r, item in enumerate(ids):
            own = w.hash[w.first[r] : w.first[r + 1]]
            self.items.append((item, own))
            if len(own):
                n = min(seed, len(own))
                h = _roll(own, n)
                hashes.append(h)
                rows.append(np.full(len(h), r))
                sizes.append(n)
        self.sizes = sorted(set(sizes))
        h = np.concatenate(hashes) if hashes else np.zeros(0, U)
        r = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        order = np.lexsort((r, h))
        self.hash, self.row = h[order], r[order]
        # A table of a few bits for a few seeds, of 2**_BITS for many.
        self.shift = U(64 - min(_BITS, max(4, (16 * len(h)).bit_length())))
        self.bits = np.zeros(1 << int(U(64) - self.shift), bool)
        self.bits[(self.hash >> self.shift).astype(np.int64)] = True

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word index, seed length, benchmark row) of every seed in a batch of documents."""
        out = []
        for n in self.sizes:
            h, at, _ = ngrams(w, n)
            maybe = np.flatnonzero(self.bits[(h >> self.shift).astype(np.int64)])
            lo = np.searchsorted(self.hash, h[maybe], "left")
            times = np.searchsorted(self.hash, h[maybe], "right") - lo
            place = np.repeat(lo, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
            out.append((np.repeat(at[maybe], times), np.full(times.sum(), n), self.row[place]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out))

    def tiled(self, w: Words) -> list[tuple[int, int, int, int, int]]:
        """(row of the document, benchmark row, tiles, matched, words of the item) of all candidates."""
        at, size, item = self.hits(w)
        order = np.lexsort((at, item, w.row[at]))
        at, size, item = at[order], size[order], item[order]
        row = w.row[at]
        cuts = np.flatnonzero((np.diff(row) != 0) | (np.diff(item) != 0)) + 1
        out = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(at)]):
            if lo == hi:
                continue
            target = self.items[item[lo]][1]
            # Tiles lie within unions of seeds; a zero word, which no text has, parts them.
            pieces, end = [], -1
            for p, n in zip(at[lo:hi].tolist(), size[lo:hi].tolist()):
                if p > end:
                    pieces.append(np.zeros(1, U))
                pieces.append(w.hash[max(p, end) : p + n])
                end = max(end, p + n)
            tiles = tile(np.concatenate(pieces), target, min(self.seed, len(target)))
            out.append((int(row[lo]), int(item[lo]), len(tiles), sum(t[2] for t in tiles), len(target)))
        return out


def _found(bench: Bench, ids: list, w: Words, coverage: float) -> Iterator[tuple]:
    for row, item, tiles, matched, n in bench.tiled(w):
        if matched >= coverage * n:
            yield ids[row], bench.items[item][0], tiles, matched, n, matched / n


def _schema() -> pa.Schema:
    return pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("tiles", pa.int32()), ("matched", pa.int32()), ("item_words", pa.int32()), ("coverage", pa.float64())])


def find(docs: DataFrame, benchmark: DataFrame, seed: int = SEED_WORDS, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, tiles, matched, item_words, coverage) of all pairs with at least that coverage."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    benchmark = benchmark.where("text IS NOT NULL AND item_id IS NOT NULL")
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    found = _broadcast(docs, benchmark, seed, coverage) if size <= broadcast_bytes else _joined(docs, benchmark, seed, coverage)
    best = F.max_by(F.struct("tiles", "matched", "item_words", "coverage"), F.struct("coverage", "matched", "tiles"))
    return found.where("doc_id IS NOT NULL").groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def _broadcast(docs: DataFrame, benchmark: DataFrame, seed: int, coverage: float) -> DataFrame:
    rows = benchmark.collect()  # its size was checked
    shared = docs.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Bench(*shared.value, seed)
        for b in batches:
            texts, ids = b.column(1), b.column(0).to_pylist()
            for lo, hi in slices(texts):
                found = list(_found(bench, ids[lo:hi], words(texts.slice(lo, hi - lo), True), coverage))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), _schema())], schema=_schema())

    return docs.mapInArrow(scan, _OUT)


def _joined(docs: DataFrame, benchmark: DataFrame, seed: int, coverage: float) -> DataFrame:
    """The same for a benchmark of any size: seeds of both sides meet by a shuffle, then
    the texts of the pairs do. Each text sends a seed once; equal texts are one on either side until the end.
    """

    def own_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[int] = set()
        for b in batches:
            for lo, hi in slices(b.column(1)):
                found.update(np.minimum(np.diff(words(b.column(1).slice(lo, hi - lo), True).first), seed).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found - {0}), pa.int32())], names=["n"])

    lengths = sorted(r.n for r in benchmark.mapInArrow(own_lengths, "n int").distinct().collect())  # at most `seed` of them

    def seeds(name: str, own: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = np.asarray(b.column(0)), b.column(1)
                for lo, hi in slices(texts):
                    w = words(texts.slice(lo, hi - lo), True)
                    count = np.diff(w.first)
                    for n in lengths:
                        h, at, _ = ngrams(w, n)
                        row = w.row[at]
                        if own:
                            keep = np.minimum(count, seed)[row] == n
                            h, row = h[keep], row[keep]
                        order = np.lexsort((h, row))
                        h, row = h[order], row[order]
                        new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.zeros(0, bool)
                        h, row = h[new], row[new]
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array(ids[lo:hi][row])], names=["h", "n", name])

        return run

    def texts_of(rows: DataFrame, uid: str) -> DataFrame:
        """(uid, text) of distinct texts."""
        return rows.where("text IS NOT NULL AND text != ''").select(F.xxhash64("text").alias(uid), "text").dropDuplicates([uid])

    a, b = texts_of(docs, "x"), texts_of(benchmark, "y")
    right = b.mapInArrow(seeds("y", True), "h long, n int, y long").distinct()
    left = a.mapInArrow(seeds("x", False), "h long, n int, x long")
    pairs = left.join(right, ["h", "n"]).select("x", "y").distinct()
    both = pairs.join(a.withColumnRenamed("text", "doc_text"), "x").join(b.withColumnRenamed("text", "item_text"), "y")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y, text, item in zip(*(batch.column(k).to_pylist() for k in range(4))):
                found += _found(Bench([y], [item], seed), [x], words(pa.array([text], pa.string()), True), coverage)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*found), _schema())], schema=_schema())

    hit = both.select("x", "y", "doc_text", "item_text").mapInArrow(check, _OUT).withColumnsRenamed({"doc_id": "x", "item_id": "y"})
    named = docs.select("doc_id", F.xxhash64("text").alias("x")).join(hit, "x").join(benchmark.select("item_id", F.xxhash64("text").alias("y")), "y")
    return named.select(*_schema().names)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without those that cover a benchmark item, each row judged by its own text."""
    own, row = docs.select(row_id().alias("doc_id"), "text"), fresh(docs, "_row")
    hit = find(own, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(row)).distinct()
    return docs.withColumn(row, row_id()).join(hit, row, "left_anti").select(*[col(c) for c in docs.columns])


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL: dict[str, str] = {}
