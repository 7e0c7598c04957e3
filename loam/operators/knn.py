"""Exact nearest-neighbour search over array columns.

Filters stand below the distance, the distance below the top-k, so partition and
column predicates reach the scan and only k rows a partition meet. Ties are
broken by the key. Filters on the distance apply before the top-k, the
similarity threshold applies after it (both keep the nearest first).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.vectors import distance_to

MOST = 4096


def search(
    vectors: DataFrame,
    query: Sequence[float],
    k: int = 10,
    metric: str = "cosine",
    key: str = "vec_id",
    vector: str = "embedding",
    where: Column | None = None,
    distance: tuple[str, float] | None = None,
    keys: DataFrame | None = None,
    threshold: float | None = None,
) -> DataFrame:
    """The k nearest rows with column distance (and similarity, with a threshold).

    where: filter on other columns; distance: (operator, bound); keys: rows to search only, by key.
    """
    if not 0 <= k <= MOST:
        raise ValueError(f"k must be 0..{MOST}")
    if where is not None:
        vectors = vectors.where(where)
    if keys is not None:
        vectors = vectors.join(keys.select(key).distinct(), key, "left_semi")
    found = vectors.withColumn("distance", distance_to(vector, query, metric)).where("distance IS NOT NULL")
    if distance is not None:
        op, bound = distance
        if op not in ("<", "<=", ">", ">="):
            raise ValueError("a distance filter is <, <=, > or >=")
        found = found.where(F.expr(f"distance {op} {float(bound)!r}"))
    found = found.orderBy("distance", key).limit(k)
    if threshold is None:
        return found
    return found.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance"))).where(F.col("similarity") >= threshold)


def brute_force(vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.3, key: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k most similar rows of those that reach the threshold, which applies before the limit; a zero vector has similarity 0."""
    if where is not None:
        vectors = vectors.where(where)
    found = vectors.withColumn("similarity", 1 - distance_to(vector, query, "cosine_eps"))
    return found.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), key).limit(k)


def scalar_search(vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.3, where: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The first k of those of the 2k nearest filtered rows that reach the threshold."""
    return search(vectors, query, 2 * k, "cosine", key, vector, where, threshold=threshold).orderBy("distance", key).limit(k)


def similar(vectors: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.6, exclude: Column | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows like a query: by the plain search, or by the filtered one if rows are to be left out."""
    if exclude is None:
        return search(vectors, query, k, "cosine", key, vector, threshold=threshold)
    return scalar_search(vectors, query, k, threshold, ~exclude, key, vector)


def with_sources(found: DataFrame, chunks: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """Hits (by chunk_id) with their chunk, file and repository; path is the whole one."""
    # The hits are few, so the tables are read through them.
    star = chunks.join(F.broadcast(found), "chunk_id").join(files, "file_id").join(F.broadcast(repos), "repo_id")
    return star.withColumn("path", F.concat_ws("/", "root_path", "path"))


def vector_of(vectors: DataFrame, value: int, key: str = "vec_id", vector: str = "embedding") -> list[float]:
    """One vector, by key, to search with."""
    row = vectors.where(F.col(key) == value).select(F.col(vector).cast("array<double>").alias("v")).first()
    if row is None or row.v is None:
        raise ValueError(f"no vector for {key} {value}")
    return list(row.v)


def check_dimensions(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Rows whose vectors have the dimensions of the index; others are left out."""
    return vectors.where(F.size(vector) == dims)


def sync(index: DataFrame, vectors: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index with vectors of its dimensions that it lacks."""
    return index.unionByName(check_dimensions(vectors, dims, vector).join(index.select(key), key, "left_anti").select(*index.columns))
