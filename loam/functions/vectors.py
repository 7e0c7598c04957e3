"""Vector columns: constructors, arithmetic, quantisation and distances.

Vectors are array columns (float or tinyint); bit vectors are binary columns.
Elementwise functions but vec_to_json are built-in expressions; distances to a
query vector run in Arrow batches with numpy, in double precision. A NULL vector
gives NULL; a distance of vectors of different sizes or a cosine distance of a
zero vector is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.column import Column

METRICS = ("cosine", "l2", "l1", "hamming", "cosine_eps")


def vec_f32(col: Column | str) -> Column:
    """A float vector from JSON text."""
    return F.from_json(col, "array<float>")


def vec_int8(col: Column | str) -> Column:
    """A tinyint vector; a value out of range raises an error."""
    return F.transform(col, lambda x: F.when(x.between(-128, 127), x.cast("tinyint")).otherwise(F.raise_error(F.lit("int8 value out of range"))))


def vec_bit(col: Column | str) -> Column:
    return F.col(col).cast("binary") if isinstance(col, str) else col.cast("binary")


def vec_length(col: Column | str, kind: str = "float32") -> Column:
    return F.octet_length(col) * 8 if kind == "bit" else F.size(col)


def vec_type(kind: str) -> Column:
    """float32, int8 or bit, by the simple type string of the column."""
    return F.lit({"array<float>": "float32", "array<tinyint>": "int8", "binary": "bit"}[kind])


def _same_size(a: Column | str, b: Column | str, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimensions")))


def _wrapped(x: Column) -> Column:
    """An int8 sum as it comes out in 8 bits."""
    return (F.pmod(x + 128, F.lit(256)) - 128).cast("tinyint")


def vec_add(a: Column | str, b: Column | str, kind: str = "float32") -> Column:
    """Sums by element; int8 ones wrap around."""
    if kind == "int8":
        return _same_size(a, b, F.zip_with(a, b, lambda x, y: _wrapped(x.cast("int") + y.cast("int"))))
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vec_sub(a: Column | str, b: Column | str, kind: str = "float32") -> Column:
    if kind == "int8":
        return _same_size(a, b, F.zip_with(a, b, lambda x, y: _wrapped(x.cast("int") - y.cast("int"))))
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def _sum(col: Column, kind: str = "double") -> Column:
    return F.aggregate(col, F.lit(0).cast(kind), lambda s, x: s + x)


def vec_distance_l2(a: Column | str, b: Column | str) -> Column:
    """Root of the summed squares of differences of two columns; different dimensions are an error."""
    return _same_size(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))))


def vec_distance_l1(a: Column | str, b: Column | str, kind: str = "float32") -> Column:
    """Summed differences of two columns, a whole number for int8."""
    wide = "long" if kind == "int8" else "double"
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast(wide) - y.cast(wide))), wide))


def vec_distance_cosine(a: Column | str, b: Column | str) -> Column:
    """One minus the cosine of two columns; NULL for a zero vector."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return _same_size(a, b, F.when(norms > 0, 1 - dot(a, b) / norms))


def vec_slice(col: Column | str, start: int, end: int) -> Column:
    """Elements start..end-1, from 0; an empty or negative range is an error."""
    if start < 0 or end <= start:
        raise ValueError("vec_slice needs 0 <= start < end")
    inside = F.size(col) >= end
    return F.when(inside, F.slice(col, start + 1, end - start)).otherwise(F.raise_error(F.lit("vec_slice beyond the vector")))


def vec_norm(col: Column | str) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def vec_normalize(col: Column | str) -> Column:
    """The vector over its length, which is summed once a row; NaN for a zero vector, NULL for one with a NULL element."""

    def over(norm: Column) -> Column:
        one = lambda x: F.when(norm == 0, x.cast("double") * F.lit(float("inf"))).otherwise(x.cast("double") / norm)
        return F.when(norm.isNotNull(), F.transform(col, one))

    return F.transform(F.array(vec_norm(col)), over)[0]


def vec_quantize_int8(col: Column | str) -> Column:
    """Unit range -1..1 to -128..127, truncated and clamped; NaN gives 127."""

    def one(x: Column) -> Column:
        v = (x.cast("double") + 1) / F.lit(2.0 / 255.0) - 128
        return F.when(F.isnan(x), 127).otherwise(F.greatest(F.lit(-128.0), F.least(F.lit(127.0), v))).cast("int").cast("tinyint")

    return F.transform(col, one)


def vec_quantize_binary(col: Column | str) -> Column:
    """Bits, least significant first, as an array of bytes 0..255; bit i is set if element i is positive."""
    size = F.size(col)
    bytes_ = F.sequence(F.lit(0), F.floor(size / 8).cast("int") - 1)

    def byte(k: Column) -> Column:
        part = F.slice(col, k * 8 + 1, F.lit(8))
        return F.aggregate(F.transform(part, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1), i)).otherwise(0)), F.lit(0), lambda s, x: s + x)

    return F.when(size % 8 == 0, F.transform(bytes_, byte)).otherwise(F.raise_error(F.lit("dimensions must be a multiple of 8")))


def vec_distance_hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two arrays of bytes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def vec_to_json(col: Column | str) -> Column:
    """A list of numbers with six decimals as C's printf has them: of the exact value, halves to even; NaN and NULL are null."""

    @F.pandas_udf("string")
    def run(vectors: pd.Series) -> pd.Series:
        one = lambda v: "[" + ",".join("null" if x is None or x != x else f"{x:.6f}" for x in v.tolist()) + "]"
        return vectors.map(lambda v: None if v is None else one(v))

    return run(col)


def vec_each(col: Column | str, kind: str = "float32") -> Column:
    """A generator of (pos, value), one row an element; bits come most significant first."""
    return F.posexplode(bits_of(col) if kind == "bit" else col)


def bits_of(col: Column | str) -> Column:
    """The bits 0 and 1 of a binary column, most significant of each byte first."""
    own = F.hex(col)
    digits = F.transform(F.sequence(F.lit(1), F.octet_length(col) * 2), lambda k: F.conv(F.substring(own, k, F.lit(1)), 16, 10).cast("int"))
    four = F.transform(digits, lambda d: F.array(*[F.call_function("shiftright", d, F.lit(k)).bitwiseAND(F.lit(1)) for k in (3, 2, 1, 0)]))
    return F.when(F.octet_length(col) > 0, F.flatten(four)).when(F.octet_length(col) == 0, F.array().cast("array<int>"))


def vec_version() -> Column:
    return F.lit("loam-1")


def vec_debug() -> Column:
    """Build facts, one a line."""
    return F.lit(f"Version: loam-1\nNumPy: {np.__version__}")


def encode_vector(col: Column | str) -> Column:
    """Little-endian float32 bytes of a vector."""

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return run(col)


def decode_vector(col: Column | str) -> Column:
    """The vector of such bytes; NULL if their number isn't divisible by four."""

    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return run(col)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Similarity of two columns over the shorter length, with a denominator of at least 1e-3; 0 for empty ones."""
    n = F.least(F.size(a), F.size(b))
    short = lambda v: F.when(n > 0, F.slice(v, 1, F.greatest(n, F.lit(1))))
    dot = lambda x, y: F.aggregate(F.zip_with(short(x), short(y), lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / F.sqrt(F.greatest(dot(a, a) * dot(b, b), F.lit(1e-6))))


def _distances(rows: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((rows - q) ** 2).sum(1))
    if metric == "l1":
        return np.abs(rows - q).sum(1)
    if metric == "hamming":
        return ((rows > 0) != (q > 0)).sum(1).astype(float)
    dot, squares = rows @ q, (rows * rows).sum(1) * (q @ q)
    if metric == "cosine_eps":
        return 1 - dot / np.sqrt(np.maximum(squares, 1e-6))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(squares > 0, 1 - dot / np.sqrt(squares), np.nan)


def distance_to(col: Column | str, query: Sequence[float], metric: str = "cosine") -> Column:
    """Distance of each vector to a query vector; NULL where there is none."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    q = np.asarray(query, float)

    @F.pandas_udf("double")
    def run(vectors: pd.Series) -> pd.Series:
        out = np.full(len(vectors), np.nan)
        fits = np.array([v is not None and len(v) == len(q) for v in vectors], bool)
        if fits.any():
            out[fits] = _distances(np.stack(vectors[fits].to_numpy()).astype(float), q, metric)
        return pd.Series(out).astype("Float64")

    # Not deterministic to the optimizer, so that a filter on the distance doesn't work it out a second time.
    return F.nanvl(run.asNondeterministic()(F.col(col) if isinstance(col, str) else col), F.lit(None).cast("double"))
