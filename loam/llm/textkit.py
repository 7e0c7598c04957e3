"""Vectorised text helpers over Arrow string columns, shared by the llm operators.

Everything here works on whole Arrow batches at once: the UTF-8 buffer of a
column is scanned with numpy, words are found by byte class, and words and
n-grams get 64-bit hashes from prefix polynomial sums, so no Python loop runs
over words or characters.

A folded word is a maximal run of ASCII letters, digits and non-ASCII bytes of
the lower-cased text; a plain word is a maximal run of bytes other than ASCII
white space. NULL texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_PLAIN = np.ones(256, bool)
_PLAIN[[9, 10, 11, 12, 13, 32]] = False
_FOLDED = np.zeros(256, bool)
_FOLDED[48:58] = _FOLDED[97:123] = _FOLDED[128:] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The powers 0..n-1 of base modulo 2**64; grows by doubling and is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 1) - 1).bit_length())
        have = np.full(size, base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> U(31))
    x = x * U(0x7FB5D329728EA185)
    x ^= x >> U(27)
    x *= U(0x81DADEF4BC2DD44D)
    x ^= x >> U(33)
    return x


def order_by(row: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Positions sorted by row, then by the keys, the first one foremost; like lexsort, but by
    one quick sort and one radix sort where there is one key and rows are few.
    """
    if len(keys) > 1 or not len(row) or row.max() > 0xFFFF:
        return np.lexsort((*reversed(keys), row))
    first = np.argsort(keys[0])
    return first[np.argsort(row[first].astype(np.uint16), kind="stable")]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """S with S[j] = sum of values[i] * base**i over i < j, for `span_hash`."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes of the spans start..end, the same wherever a span stands."""
    return (sums[end] - sums[start]) * powers(_INV, len(sums))[start]


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array, offsets from 0; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text gets a range of its own."""
    if not len(texts):
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    lo = 0
    while lo < len(size):
        done = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, done + most, "right")))
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """Words of a batch: byte spans, 64-bit hashes, row of each; first[r]:first[r+1] are row r's words."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(texts: pa.Array, folded: bool) -> Words:
    """All words of a batch of texts."""
    if folded:
        texts = pc.utf8_lower(texts)
    data, at = raw(texts)
    n = len(data)
    is_word = (_FOLDED if folded else _PLAIN)[data]
    before = np.zeros(n + 1, bool)
    before[1:] = is_word
    cuts = at[(at > 0) & (at < n)]
    begins = is_word & ~before[:n]
    begins[cuts] = is_word[cuts]
    after = np.zeros(n, bool)
    if n:
        after[:-1] = is_word[1:]
        after[cuts - 1] = False
    start, end = np.flatnonzero(begins), np.flatnonzero(is_word & ~after) + 1
    sums = prefix_sums(data.astype(U) + U(1))
    h = mix(span_hash(sums, start, end) + (end - start).astype(U))
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(data, start, end, h, row, first)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word index, first) of all n-grams; first[r]:first[r+1] are row r's."""
    m = len(w.hash) - n + 1
    counts = np.maximum(np.diff(w.first) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), first
    ok = np.flatnonzero(w.row[: len(w.row) - n + 1] == w.row[n - 1 :])
    h = np.zeros(m, U)
    for k in range(n):
        h = h * U(_BASE) + w.hash[k : k + m]
    return mix(h[ok]), ok, first
