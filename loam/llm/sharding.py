"""Sharding: a Feistel permutation with cycle walking over global row numbers.

`assign` numbers all rows by key order, permutes the numbers with a keyed
balanced Feistel network on the smallest even number of bits that holds them
(walking the cycle until the value is below the row count), and derives
shard = position % shards and slot = position div shards. Anyone who knows the
row number, row count and seed can compute shard and slot (`place`), and the
inverse network (`source_row`) finds the row that fills a slot.

Defined results: rows with a NULL key come first; rows that share a key are
ordered by the hash of all their columns (maps by their text), and identical rows are
interchangeable; an empty table gives an empty result; input columns named
row_no, shard or slot are replaced, all others, whatever their names, are kept; texts of any length pass.

Nothing gathers the rows of one key: rows are counted by key, hash and input partition, these counts
are put in order, and each row needs only its place among the equal rows of its own partition.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import col, durable, fresh, key_parts, prepare, table, without

SHARDS = 64
SEED = 20240229
ROUNDS = 4
_M = 1 << 32


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """Round keys from a seed, by a 32-bit linear congruential step."""
    keys, x = [], seed % _M
    for _ in range(rounds):
        x = (x * 1664525 + 1013904223) % _M
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced network over n values."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _f(half: np.ndarray, key: int, mask: int) -> np.ndarray:
    v = (half * 1597334677 + key) % _M
    v = ((v ^ (v >> 15)) * 739982445) % _M
    return (v ^ (v >> 13)) & mask


def _network(x: np.ndarray, bits: int, keys: list[int], back: bool) -> np.ndarray:
    mask = (1 << bits) - 1
    left, right = x >> bits, x & mask
    if back:
        for k in reversed(keys):
            left, right = right ^ _f(left, k, mask), left
    else:
        for k in keys:
            left, right = right, left ^ _f(right, k, mask)
    return (left << bits) | right


def permute(x: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (its inverse, if `back`) at x."""
    if n > 1 << 60:
        raise ValueError("more than 2**60 rows")
    bits, keys = half_bits(n), round_keys(seed)
    out = _network(np.asarray(x, np.int64), bits, keys, back)
    while (far := out >= n).any():
        out[far] = _network(out[far], bits, keys, back)
    return out


def place(row_no: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute(np.array([row_no]), n, seed)[0])
    return p % shards, p // shards


def source_row(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that stands at a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def assign(docs: DataFrame, key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """docs with row_no, shard and slot.

    The row number comes from the narrow key column alone: distinct keys are
    range-partitioned, counted per partition, and offset. Texts move once, to meet
    the number where their key starts.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    prepare(docs.sparkSession)
    docs = without(docs, *[c for c in ("row_no", "shard", "slot") if c != key])
    names = [fresh(docs, f"_{c}") for c in "nkhpcirs"]
    none, value, h, p, count, inside, rank, start = names
    hashed = [col(f.name).cast("string") if "map<" in f.dataType.simpleString() else col(f.name) for f in docs.schema.fields]
    is_null, plain = key_parts(docs, key)
    keyed = docs.withColumns({none: is_null, value: plain, h: F.xxhash64(*hashed), p: F.spark_partition_id()})
    keys = [none, value, h, p]
    counts = keyed.groupBy(*keys).agg(F.count("*").alias(count))
    order = [F.col(none).desc(), F.col(value), F.col(h), F.col(p)]
    by_range = durable(counts.repartitionByRange(*order).withColumn(rank, F.spark_partition_id()))
    parts = by_range.groupBy(rank).agg(F.sum(count).alias("t"))
    before = Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range partition, so this window is small whatever the table's size.
    offsets = durable(parts.select(rank, F.coalesce(F.sum("t").over(before), F.lit(0)).alias("o"), "t"))
    n = offsets.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    earlier = Window.partitionBy(rank).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_range.withColumn(inside, F.coalesce(F.sum(count).over(earlier), F.lit(0))).join(offsets, rank)
    starts = starts.select(*keys, (F.col("o") + F.col(inside)).alias(start))

    @F.pandas_udf("long")
    def position(row_no: pd.Series) -> pd.Series:
        return pd.Series(permute(row_no.to_numpy(), n, seed))

    numbered = keyed.withColumn(inside, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))).join(starts, keys)
    numbered = numbered.withColumn(rank, F.col(start) + F.col(inside) - 1)
    placed = numbered.withColumn(count, position(rank))
    kept = [col(c) for c in docs.columns]
    return placed.select(*kept, F.col(rank).alias("row_no"), (F.col(count) % shards).cast("int").alias("shard"), F.expr(f"`{count}` div {shards}").alias("slot"))


def write_shards(assigned: DataFrame, path: str) -> None:
    """Writes one folder per shard, each in slot order."""
    n = assigned.select("shard").distinct().count()
    assigned.repartition(max(1, n), "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))


def _sql() -> str:
    def half(r: str, k: int) -> str:
        return f"(xor(xor((({r}*1597334677+{k})%{_M}), (({r}*1597334677+{k})%{_M})>>15)*739982445%{_M}, (xor((({r}*1597334677+{k})%{_M}), (({r}*1597334677+{k})%{_M})>>15)*739982445%{_M})>>13) % m)"

    def chain(source: str, where: str) -> str:
        q = f"SELECT r, n, b, m, x // m AS l, x % m AS h FROM {source} {where}"
        for k in round_keys(SEED):
            q = f"SELECT r, n, b, m, h AS l, xor(l, {half('h', k)}) AS h FROM ({q})"
        return f"SELECT r, n, b, m, l * m + h AS x FROM ({q})"

    return f"""
WITH RECURSIVE numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS row_no FROM documents
), size AS (
  SELECT n, 1::BIGINT << b AS m, b FROM (SELECT n, greatest(1, (ceil(log2(n)) + 1)::BIGINT // 2) AS b FROM (SELECT count(*) AS n FROM documents))
), start AS (SELECT row_no AS r, n, b, m, row_no AS x FROM numbered, size),
walk AS (
  {chain('start', '')}
  UNION ALL
  {chain('walk', 'WHERE x >= n')}
)
SELECT d.*, (w.x % {SHARDS})::INTEGER AS shard, w.x // {SHARDS} AS slot
FROM numbered d JOIN (SELECT r, x FROM walk WHERE x < n) w ON w.r = d.row_no"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLE_SQL = {"op1_sharding": _sql()}
