"""Suffix-array dedup: passages of WORDS words or more that occur before are found and cut.

A window is WORDS consecutive plain words. Each is assigned to one anchor, the
least hash among the runs of ANCHOR words in it, so equal windows have equal
anchors at equal places. Anchors that occur once in the whole corpus are left
out; the words around the others meet by the anchor's hash. There the suffixes
that start at window starts are sorted by a mergesort whose comparisons take the
common extension from prefix polynomial hashes by binary search, up to WORDS
words, and then the next word. Suffixes that are neighbours and agree in WORDS
words are the same window if the words themselves agree, which is checked word by
word, as is that words of one hash are the same bytes; where they aren't, words get numbers
of their own, and runs are hashed anew.

Windows that have no other of their hash around an anchor are left out before the sort. Of
pieces of text that are the same bytes, a task sends one and only the places of the others, which go
elsewhere and take over what was found for the piece; so a passage of very many
copies makes no large group.

The first of equal windows (by doc_id, then text hash, then place) is kept;
every other window is a repeat. Repeats of consecutive places with the same
source make one span.

Defined results: NULL, empty and shorter texts have no windows; rows with a NULL
doc_id come last in order; rows that agree in doc_id and text count as one, so a
text is not cut because of its own copy under the same doc_id, while copies under
other doc_ids are; an empty table gives an empty result; other columns are
ignored. A window that is repeated within one text is cut there as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .common import carry, col, durable, fresh, prepare, table
from .packed import bounded_set, by_part, joined, member, part_of, parts_for, split
from .textkit import U, Words, mix, ngrams, prefix_sums, raw, slices, span_hash, words

WORDS, ANCHOR = 50, 26
_LAST = (1 << 63) - 1
_HELD = 16 << 20


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of `width` values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word, first window start, windows) of every anchor of a batch; windows are by word."""
    none = np.zeros(0, np.int64)
    total, width = len(w.hash), WORDS - ANCHOR + 1
    if total < WORDS:
        return np.zeros(0, U), none, none, none
    h = np.full(total - ANCHOR + 1, ~U(0))
    own, at, _ = ngrams(w, ANCHOR)
    h[at] = own
    place = U((1 << 20) - 1)
    low = _sliding_least((h & ~place) | (np.arange(len(h), dtype=U) & place), width)
    start = np.flatnonzero(w.row[: total - WORDS + 1] == w.row[WORDS - 1 :])
    low = low[start]
    anchor = start + ((low - start.astype(U)) & place).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    count = np.diff(np.r_[new, len(start)])
    return h[anchor[new]], anchor[new], start[new], count


def _own(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.octet_length("text") >= 2 * WORDS - 1).withColumn("uid", F.xxhash64("text"))


def repeated_anchors(docs: DataFrame) -> np.ndarray | None:
    """Hashes of anchors that occur more than once, or None if they are too many to broadcast."""
    scale = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = parts_for(scale // 8)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            u = np.concatenate([u, u[n > 1]])
            for p, at in split(part_of(u, parts), parts):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([u[at].tobytes()], pa.binary())], names=["part", "h"])

        for b in batches:
            for lo, hi in slices(b.column(1)):
                held.append(anchors(words(b.column(1).slice(lo, hi - lo), False))[0])
            if sum(map(len, held)) > 1 << 20:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    def count(own: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        u, n = np.unique(joined(own["h"], U), return_counts=True)
        twice = u[n > 1]
        yield pa.RecordBatch.from_arrays([pa.array([twice.tobytes()], pa.binary())], names=["v"])

    found = durable(by_part(docs.mapInArrow(emit, "part int, h binary"), parts, count, "v binary"))
    return bounded_set(found, found.agg(F.coalesce(F.sum(F.octet_length("v")), F.lit(0))).first()[0] // 8)


def _gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    to = np.cumsum(size) - size
    return data[np.arange(size.sum()) + np.repeat(start - to, size)]


def _words(texts: pa.Array) -> Words:
    """The words of a large array, found slice by slice."""
    data, _ = raw(texts)
    found, bytes_before, words_before, rows_before = [], 0, 0, 0
    for lo, hi in slices(texts):
        w = words(texts.slice(lo, hi - lo), False)
        found.append((w.start + bytes_before, w.end + bytes_before, w.hash, w.row + rows_before, w.first[:-1] + words_before))
        bytes_before, words_before, rows_before = bytes_before + len(w.data), words_before + len(w.hash), hi
    start, end, hashes, row, first = (np.concatenate(x) for x in zip(*found))
    return Words(data, start, end, hashes, row, np.r_[first, words_before])


def tokens_of(data: np.ndarray, w: Words) -> np.ndarray:
    """Numbers of words: their hashes, but different ones for different bytes even if hashes collide."""
    size = w.end - w.start
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(body, 8)
    order = np.argsort(w.hash, kind="stable")
    a, b = order[:-1], order[1:]
    same = w.hash[a] == w.hash[b]
    a, b = a[same], b[same]
    apart = size[a] != size[b]

    def load(at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eight[at]).view(np.uint64)[:, 0]

    for k in range(0, len(a), 1 << 20):
        x, y = a[k : k + (1 << 20)], b[k : k + (1 << 20)]
        cut = U(8) * (U(8) - np.minimum(size[x], 8).astype(U))
        apart[k : k + (1 << 20)] |= (load(w.start[x]) ^ load(w.start[y])) << cut != 0
        more = size[x] > 8
        apart[k : k + (1 << 20)][more] |= load(w.end[x][more] - 8) != load(w.end[y][more] - 8)
    for k in np.flatnonzero((size[a] > 16) & ~apart).tolist():
        i, j = a[k], b[k]
        apart[k] = not np.array_equal(data[w.start[i] : w.end[i]], data[w.start[j] : w.end[j]])
    out = w.hash
    for h in np.unique(w.hash[a[apart]]):
        out, names = (out.copy() if out is w.hash else out), {}
        for i in np.flatnonzero(w.hash == h).tolist():
            n = names.setdefault(data[w.start[i] : w.end[i]].tobytes(), len(names))
            out[i] = mix(np.array([h]) + U(n) * U(0x9E3779B97F4A7C15))[0] if n else h
    return out


class Suffixes:
    """Suffixes of a sequence of word hashes, compared by hashed common extensions of at most WORDS words."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.sums = tokens, prefix_sums(tokens)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search over hashes of prefixes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WORDS)
        for _ in range(WORDS.bit_length()):
            mid = (low + high + 1) >> 1
            same = span_hash(self.sums, a, a + mid) == span_hash(self.sums, b, b + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: bool) -> np.ndarray:
        """Whether suffix a comes before b; equal ones: `ties`."""
        n = self.common(a, b)
        at = np.minimum(n, WORDS - 1)
        return np.where(n >= WORDS, ties, self.tokens[a + at] < self.tokens[b + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Positions of start sorted by group, then suffix; groups are sorted already. A stable
        mergesort: the runs of all groups merge at once, each item finding its rank in the other run."""
        n = len(start)
        order = np.arange(n)
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        width, most = 1, int((end - begin).max()) if n else 0
        while width < most:
            at = np.flatnonzero(end - begin > width)
            inside = at - begin[at]
            run = inside // width
            left = begin[at] + (run // 2) * 2 * width
            mid = np.minimum(left + width, end[at])
            right = np.minimum(mid + width, end[at])
            is_left = run % 2 == 0
            low, high = np.where(is_left, mid, left), np.where(is_left, right, mid)
            base = low.copy()
            me = start[order[at]]
            while len(open_ := np.flatnonzero(low < high)):
                half = (low[open_] + high[open_]) >> 1
                other = start[order[half]]
                mine = me[open_]
                # The other run's item goes first if it is less, or equal and from the left.
                first = np.where(is_left[open_], self.before(other, mine, False), ~self.before(mine, other, False))
                low[open_[first]] = half[first] + 1
                high[open_[~first]] = half[~first]
            to = np.where(is_left, at, left + (at - mid)) + (low - base)
            after = order.copy()
            after[to] = order[at]
            order = after
            width *= 2
        return order


def repeats(texts: pa.Array, anchor: np.ndarray, offset: np.ndarray, count: np.ndarray, doc: np.ndarray, uid: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, window, row of the first, its window) of every window that isn't the first of its kind.

    Row r has a text of count[r] + WORDS - 1 words; its windows start at words 0 .. count[r] - 1,
    window k stands at place at[r] + k of the document, offset[r] - k words before the anchor.
    """
    w = _words(texts)
    tokens = tokens_of(w.data, w)
    rows = np.repeat(np.arange(len(count)), count)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    starts = w.first[rows] + places
    kinds = mix(anchor[rows] ^ mix((offset[rows] - places).astype(U)))
    salt = 0
    while True:
        suffixes = Suffixes(mix(tokens ^ U(salt)) if salt else tokens)
        # Only windows that share a hash can be the same.
        hashed = kinds ^ span_hash(suffixes.sums, starts, starts + WORDS)
        by = np.argsort(hashed)
        twice = np.zeros(len(by), bool)
        same = hashed[by][1:] == hashed[by][:-1]
        twice[by[1:][same]] = twice[by[:-1][same]] = True
        keep = np.flatnonzero(twice)
        keep = keep[np.lexsort((at[rows[keep]] + places[keep], uid[rows[keep]], doc[rows[keep]], kinds[keep]))]
        row, k, start, kind = rows[keep], places[keep], starts[keep], kinds[keep]
        groups = np.cumsum(np.r_[False, kind[1:] != kind[:-1]]) if len(kind) else np.zeros(0, np.int64)
        order = suffixes.sort(start, groups)
        row, k, start, groups = row[order], k[order], start[order], groups[order]
        near = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        near = near[suffixes.common(start[near - 1], start[near]) >= WORDS]
        alike = np.ones(len(near), bool)
        for j in range(WORDS):  # collision check
            alike &= tokens[start[near - 1] + j] == tokens[start[near] + j]
        if alike.all():
            break
        salt += 1
    equal = np.zeros(len(row), bool)
    equal[near] = True
    head = np.maximum.accumulate(np.where(equal, 0, np.arange(len(row))))
    # The sort is stable, so the first of a class comes first. Copies of one row are that row.
    own = (doc[row] == doc[row[head]]) & (uid[row] == uid[row[head]]) & (at[row] + k == at[row[head]] + k[head])
    out = np.flatnonzero(equal & ~own)
    return row[out], k[out], row[head[out]], k[head[out]]


def _islands(row: np.ndarray, k: np.ndarray, doc: np.ndarray, uid: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of the runs of windows k of a row whose sources are consecutive places of one text."""
    cut = (row[1:] != row[:-1]) | (k[1:] != k[:-1] + 1) | (doc[1:] != doc[:-1]) | (uid[1:] != uid[:-1]) | (place[1:] != place[:-1] + 1)
    new = np.flatnonzero(np.r_[True, cut]) if len(row) else np.zeros(0, np.int64)
    return new, np.r_[new[1:], len(row)] - 1 if len(row) else new


def _copies(key: np.ndarray, doc: np.ndarray, uid: np.ndarray, at: np.ndarray, begin: np.ndarray, size: np.ndarray, body: np.ndarray) -> np.ndarray:
    """For each piece, the first (by document and place) that has its key and the same bytes; itself if there is none."""
    order = np.lexsort((at, uid, doc, key))
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.zeros(0, bool)
    first = np.empty(len(key), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))] if len(key) else order
    maybe = np.flatnonzero(first != np.arange(len(key)))
    for k in maybe.tolist():
        i = first[k]
        if size[i] != size[k] or not np.array_equal(body[begin[i] : begin[i] + size[i]], body[begin[k] : begin[k] + size[k]]):
            first[k] = k
    return first


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, start_word, end_word, first_doc, first_uid, first_word): repeated spans of words and their source."""
    docs = _own(docs)
    spark = docs.sparkSession
    wanted = repeated_anchors(docs)
    shared = spark.sparkContext.broadcast(wanted)
    scale = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = parts_for(3 * scale)
    names = ["part", "anchor", "offset", "count", "doc", "uid", "at", "size", "key", "text"]
    kinds = (U, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64)

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, offset, count, doc, uid, at, size, key, body = (np.concatenate(x) for x in zip(*held))
            ends = np.cumsum(size)
            first = _copies(key, doc, uid, at, ends - size, size, body)
            copy = first != np.arange(len(h))
            key = np.where(np.isin(np.arange(len(h)), first[copy]) | copy, key, 0)
            sent = np.flatnonzero(~copy)
            for p, own in split(part_of(mix(h[sent]), parts), parts):
                own = sent[own]
                packed = [*(c[own].tobytes() for c in (h, offset, count, doc, uid, at, size, key)), _gather(body, ends[own] - size[own], ends[own]).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=names)
            if copy.any():  # places only, wherever there is room
                packed = [None, None, None, *(c[copy].tobytes() for c in (doc, uid, at)), None, key[copy].tobytes(), None]
                yield pa.RecordBatch.from_arrays([pa.array([parts + turn % parts], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=names)

        for b in batches:
            ids = np.asarray(b.column(0).fill_null(_LAST))
            uids = np.asarray(b.column(2))
            for lo, hi in slices(b.column(1)):
                w = words(b.column(1).slice(lo, hi - lo), False)
                h, anchor, start, count = anchors(w)
                own = member(shared.value, h)
                h, anchor, start, count = h[own], anchor[own], start[own], count[own]
                row = w.row[start] if len(start) else start
                begin, end = w.start[start], w.end[start + count + WORDS - 2]
                said = span_hash(prefix_sums(w.hash), start, start + count + WORDS - 1)
                key = mix(said ^ mix(h + (anchor - start).astype(U) * U(1 << 20) + count.astype(U))).view(np.int64) | 1
                held.append((h, anchor - start, count, ids[lo:hi][row], uids[lo:hi][row], start - w.first[row], end - begin, key, _gather(w.data, begin, end)))
                waiting += len(held[-1][8]) + 72 * len(h)
                if waiting > _HELD:
                    yield from flush()
                    held.clear()
                    waiting, turn = 0, turn + 1
        if held:
            yield from flush()

    columns = ["kind", "key", "doc_id", "uid", "lo", "hi", "first_doc", "first_uid", "first_lo"]

    def batch(kind: int, *cols: np.ndarray | None) -> pa.RecordBatch:
        n = next(len(c) for c in cols if c is not None)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in cols)], names=columns)

    def find(own: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        if own["anchor"][0] is None:
            doc, uid, at, key = (joined(own[n], np.int64) for n in ("doc", "uid", "at", "key"))
            yield batch(1, key, doc, uid, at, None, None, None, None)
            return
        anchor, offset, count, doc, uid, at, size, key = (joined(own[n], k) for n, k in zip(names[1:], kinds))
        body = b"".join(own["text"])
        ends = np.concatenate([[0], np.cumsum(size)])
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(body)])
        row, k, source, j = repeats(texts, anchor, offset, count, doc, uid, at)
        order = np.lexsort((k, row))
        row, k, source, j = row[order], k[order], source[order], j[order]
        new, last = _islands(row, k, doc[source], uid[source], at[source] + j)
        if len(new):
            yield batch(0, None, doc[row[new]], uid[row[new]], at[row[new]] + k[new], at[row[last]] + k[last] + WORDS, doc[source[new]], uid[source[new]], (at[source] + j)[new])
        # What the copies of a piece take over: the source of each of its windows, itself where it is the first.
        many = np.flatnonzero(key)
        if len(many):
            begin = np.cumsum(count[many]) - count[many]
            r = np.repeat(many, count[many])
            w = np.arange(len(r)) - np.repeat(begin, count[many])
            d, u, f = doc[r], uid[r], at[r] + w
            where = np.full(len(count), -1)
            where[many] = begin
            hit = np.flatnonzero(where[row] >= 0)
            to = where[row[hit]] + k[hit]
            d[to], u[to], f[to] = doc[source[hit]], uid[source[hit]], (at[source] + j)[hit]
            new, last = _islands(r, w, d, u, f)
            yield batch(2, key[r[new]], None, None, w[new], w[last] + WORDS, d[new], u[new], f[new])

    packed = docs.mapInArrow(ship, ", ".join(["part int", *(f"{n} binary" for n in names[1:])]))
    made = durable(by_part(packed, parts, find, "kind int, " + ", ".join(f"{c} long" for c in columns[1:])))
    single = made.where("kind = 0").select(*columns[2:])
    pieces = made.where("kind = 2").select("key", F.col("lo").alias("k_lo"), F.col("hi").alias("k_hi"), *columns[6:]).distinct()
    places = made.where("kind = 1").select("key", "doc_id", "uid", F.col("lo").alias("place")).distinct()
    taken = places.join(pieces, "key").select("doc_id", "uid", (F.col("place") + F.col("k_lo")).alias("lo"), (F.col("place") + F.col("k_hi")).alias("hi"), *columns[6:])
    found = single.union(taken.where("doc_id != first_doc OR uid != first_uid OR lo != first_lo")).distinct()
    pair = ["doc_id", "uid", "first_doc", "first_uid", "shift"]
    found = found.withColumn("shift", F.col("first_lo") - F.col("lo"))
    order = Window.partitionBy(*pair).orderBy("lo", "hi")
    # Spans of consecutive window starts belong together: the next starts where the last window of this one has its second word, or before.
    far = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("new", F.when(far - (WORDS - 1) >= F.col("lo"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    merged = parted.groupBy(*pair, "island").agg(F.min("lo").alias("start_word"), F.max("hi").alias("end_word"))
    null = lambda c: F.nullif(F.col(c), F.lit(_LAST)).alias(c)
    return merged.select(null("doc_id"), "uid", "start_word", "end_word", null("first_doc"), "first_uid", (F.col("start_word") + F.col("shift")).alias("first_word"))


def dedup_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, first_doc, first_word) of all repeated spans."""
    return spans(docs).select("doc_id", "start_word", "end_word", "first_doc", "first_word")


def cut(docs: DataFrame) -> DataFrame:
    """docs without the repeated spans; a text of which nothing is left goes. n_chars, if there, is counted anew."""
    names = docs.columns
    doc, uid, found = (fresh(docs, x) for x in ("_doc", "_uid", "_spans"))
    gone = spans(docs).groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start_word", "end_word")).alias(found))
    gone = gone.select(F.col("doc_id").alias(doc), F.col("uid").alias(uid), found)
    both = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(uid)), "left")
    rest = [c for c in names if c not in ("text", "n_chars")]
    sized = "n_chars" in names

    def work(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        marked, text, size = b.columns[:3]
        hit = np.flatnonzero(~np.asarray(marked.is_null()))
        if not len(hit):
            yield b, [text, size]
            return
        texts, sizes, keep = text.to_pylist(), size.to_pylist(), np.ones(b.num_rows, bool)
        for r in hit.tolist():
            w = words(pa.array([texts[r]], pa.string()), False)
            body, left = texts[r].encode(), np.ones(len(w.hash), bool)
            for span in marked[r].as_py():
                left[span["start_word"] : span["end_word"]] = False
            if not left.any():
                keep[r] = False
                continue
            ends = np.r_[w.start[1:], len(body)]
            texts[r] = b"".join([body[: w.start[0]]] + [body[w.start[i] : ends[j]] for i, j in _runs(left)]).decode()
            sizes[r] = len(texts[r])
        mask = pa.array(keep)
        yield b.filter(mask), [pa.array(texts, pa.string()).filter(mask), pa.array(sizes, pa.int64()).filter(mask)]

    size = F.col("n_chars").cast("long") if sized else F.lit(None).cast("long")
    cut_ = carry(both, [F.col(found), F.col("text").cast("string"), size], rest, work, [("text", StringType()), ("n_chars", LongType())])
    return cut_.select(*[col(c).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else col(c) for c in names])


def _runs(left: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of True."""
    edge = np.diff(np.r_[0, left.astype(np.int8), 0])
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_spans(table(spark, sf_dir, "documents"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without passages that an earlier one has."""
    return cut(docs)


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
