"""BPE encoding and decoding with a public byte-level vocabulary.

Encoding backtracks: an Aho-Corasick automaton over all tokens gives the longest
token at each place of a piece; a token is appended if it is compatible with the
one before it, that is, if merging the bytes of both alone yields just these two
(found from the table of how each token was merged); else the next shorter token
is tried, and where none is left, the last token is taken back. Places that
failed are remembered, so the work is linear, and the result is exactly that of
merging by rank. Decoding copies byte ranges out of one buffer by a table of
offsets.

Defined results: a NULL text has NULL tokens, an empty text none; special tokens
are ordinary text; texts of any length are encoded whole; repeated rows are
encoded alike; an empty table gives an empty result. Input columns named tokens,
n_tokens or exact are replaced by `encode`.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType

from .common import carry, others, prepare, table
from .textkit import slices

VOCABULARY = os.environ.get("LOAM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces kept per worker; the store starts anew when it is full.
KEPT = 600_000
#: Token pairs whose compatibility a worker keeps.
KEPT_PAIRS = 1_000_000


def read_ranks(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a rank file in order of rank, which is their id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(word) for word, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"ranks of {path} are not 0..n-1")
    return [tokens[i] for i in range(len(tokens))]


class Encoder:
    """Tables of one vocabulary. All 256 single bytes have to be tokens."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.tokens, self.pattern = tokens, pattern
        self.size = [len(t) for t in tokens]
        self.lookup = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.lookup for b in range(256)):
            raise ValueError("the vocabulary lacks some single bytes")
        self.shorter = [self._prefix(t) for t in tokens]
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.pairs: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            a = self.shorter[i]
            while a >= 0:
                b = self.lookup.get(t[self.size[a] :], -1)
                if 0 <= b < i and a < i and self.compatible(a, b):
                    self.left[i], self.right[i] = a, b
                    self.pairs[a, b] = i
                    break
                a = self.shorter[a]
        self._ready()

    def _ready(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(self.tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.split = regex.compile(self.pattern).findall
        self.buffer = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(self.size)])
        self.kept = _Kept(self)
        self.fits = _Fits(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "split", "buffer", "offsets", "kept", "fits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.lookup.get(token[:n], -1)) >= 0:
                return i
        return -1

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b together are encoded as [a, b].

        Walks down the merges on both sides of the seam, latest first; a merge
        across the seam that comes before them would have been made instead.
        """
        limit = 1 << 62
        left, right, pairs = self.left, self.right, self.pairs
        while True:
            over = pairs.get((a, b))
            if over is not None and over < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def piece(self, body: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.lookup.get(body)
        if whole is not None:
            return [whole]
        size, shorter, fits = self.size, self.shorter, self.fits
        longest = {}
        for end, i in self.automaton.iter(body.decode("latin-1")):
            longest[end - size[i]] = i  # keyed by the place before; ends only grow, so the longest stays
        n, at, last, out, failed = len(body), 0, -1, [], set()
        token = longest[-1]
        while at < n:
            while True:
                end = at + size[token]
                if end not in failed and (last < 0 or fits[last << 20 | token]):
                    out.append(token)
                    last, at = token, end
                    if at < n:
                        token = longest[at - 1]
                    break
                token = shorter[token]
                if token < 0:
                    failed.add(at)
                    token = out.pop()
                    at -= size[token]
                    last = out[-1] if out else -1
                    break
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        return np.frombuffer(b"".join(map(self.kept.__getitem__, self.split(text))), np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids."""
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        total = int(size.sum())
        step = np.ones(total, np.int32)
        if not total:
            return np.zeros(0, np.uint8)
        begin = np.cumsum(size) - size
        step[0] = start[0]
        step[begin[1:]] = start[1:] - (start[:-1] + size[:-1]) + 1
        return self.buffer[np.cumsum(step)]


class _Fits(dict):
    """The pair table: compatibility of left << 20 | right, filled as pairs turn up."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, pair: int) -> bool:
        if len(self) >= KEPT_PAIRS:
            self.clear()
        found = self[pair] = self.encoder.compatible(pair >> 20, pair & 0xFFFFF)
        return found


class _Kept(dict):
    """Packed ids of pieces seen before."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = np.array(self.encoder.piece(piece.encode()), np.int32).tobytes()
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = found
        return found


def encode_batch(encoder: Encoder, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(list of ids, whether decoding gives the text back) of each text; NULL for NULL."""
    ids, exact = [], []
    for text in texts.to_pylist():
        own = encoder.encode(text or "")
        ids.append(own)
        exact.append(encoder.decode(own).tobytes() == (text or "").encode())
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
    flags = pa.array(exact, pa.bool_())
    if texts.null_count:
        null = pc.is_null(texts)
        lists = pc.if_else(null, pa.scalar(None, lists.type), lists)
        flags = pc.if_else(null, pa.scalar(None, pa.bool_()), flags)
    return lists, flags


def encode(docs: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """docs without text, with tokens, n_tokens and exact (decoding gives the text back)."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(encoder or Encoder(read_ranks()))
    rest = others(docs, "text", "tokens", "n_tokens", "exact")

    def work(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        for lo, hi in slices(b.column(0), 4 << 20):
            part = b.slice(lo, hi - lo)
            ids, exact = encode_batch(shared.value, part.column(0))
            yield part, [ids, pc.list_value_length(ids), exact]

    return carry(docs, [F.col("text").cast("string")], rest, work, [("tokens", ArrayType(IntegerType())), ("n_tokens", IntegerType()), ("exact", BooleanType())])


def decode(rows: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """rows (with a column tokens) with the decoded text, in which bytes that aren't UTF-8 are replaced.

    NULL tokens, and a list with a NULL or an id outside the vocabulary, give NULL.
    """
    spark = prepare(rows.sparkSession)
    shared = spark.sparkContext.broadcast(encoder or Encoder(read_ranks()))

    def work(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        own, out = shared.value, []
        for ids in b.column(0):
            ids = ids.values if ids.is_valid else None
            if ids is None or ids.null_count:
                out.append(None)
                continue
            ids = np.asarray(ids, np.int64)
            good = not len(ids) or (ids.min() >= 0 and ids.max() < len(own.tokens))
            out.append(own.decode(ids).tobytes().decode("utf-8", "replace") if good else None)
        yield b, [pa.array(out, pa.string())]

    return carry(rows, [F.col("tokens").cast("array<int>")], others(rows, "text"), work, [("text", StringType())])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents as token ids."""
    return encode(docs)


QUERIES = {"op5_bpe": op5_bpe}
ORACLE_SQL: dict[str, str] = {}
