"""Shuffles of packed numpy arrays: one row for each part of a task, not one for each value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U

#: Bytes of packed values that one part should hold.
PART_BYTES = 16 << 20
#: Most values of a set that is broadcast as a filter; a larger set isn't used as one.
FILTER_VALUES = 8 << 20


def parts_for(total_bytes: int) -> int:
    """Number of parts, in proportion to the data."""
    return max(12, -(-total_bytes // PART_BYTES))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % U(parts)).astype(np.int64)


def split(part: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions) of every part that occurs, positions in order."""
    order = np.argsort(part, kind="stable")
    ends = np.cumsum(np.bincount(part, minlength=parts))
    lo = 0
    for p in np.flatnonzero(np.diff(np.concatenate([[0], ends]))).tolist():
        lo, hi = (int(ends[p - 1]) if p else 0), int(ends[p])
        yield p, order[lo:hi]


def by_part(rows: DataFrame, parts: int, work: Callable[[dict[str, list[bytes]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies work to the packed columns of each part; rows has a column part."""
    names = [c for c in rows.columns if c != "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[str, list[bytes]]] = {}
        for b in batches:
            cols = {n: b.column(b.schema.get_field_index(n)).to_pylist() for n in names}
            for k, p in enumerate(b.column(b.schema.get_field_index("part")).to_pylist()):
                own = held.setdefault(p, {n: [] for n in names})
                for n in names:
                    own[n].append(cols[n][k])
        while held:
            yield from work(held.popitem()[1])

    return rows.repartition(parts, F.col("part")).mapInArrow(run, schema)


def joined(pieces: list[bytes], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(pieces), kind)


def bounded_set(values: DataFrame, count: int) -> np.ndarray | None:
    """Sorted values of a one-column table of packed 64-bit numbers if they are few enough to broadcast."""
    if count > FILTER_VALUES:
        return None
    return np.sort(joined([r[0] for r in values.collect()], U))


def member(values: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted values; all, if values is None."""
    if values is None:
        return np.ones(len(x), bool)
    if not len(values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    return values[at] == x
