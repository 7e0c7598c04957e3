"""Embedding and analysis of chunks by pluggable providers, with caches, batches and failures as sentinels.

A provider turns a text column into a column; `HashEmbedding` and `RuleAnalyzer` are
deterministic built-in expressions, `FunctionEmbedding` and `FunctionAnalyzer` wrap Python
functions in Arrow batches. A model is called once for each distinct text that a cache
doesn't hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .analytics import FAILED
from .chunking import batches
from .store import FAILED_SUMMARY


class EmbeddingProvider(Protocol):
    dimensions: int
    model_name: str

    def embed(self, text: Column) -> Column:
        """array<float> of each text, NULL where the model fails."""


class ChunkAnalyzer(Protocol):
    model_name: str

    def analyze(self, text: Column) -> Column:
        """struct<summary string, tags array<string>> of each text, NULL where the model fails."""


@dataclass(frozen=True)
class HashEmbedding:
    """Vectors from the SHA-256 of a text: equal texts, equal vectors. For tests and dry runs."""

    dimensions: int = 8
    model_name: str = "hash"

    def embed(self, text: Column) -> Column:
        if not 0 < self.dimensions <= 16:
            raise ValueError("1 to 16 dimensions")
        digest = F.sha2(text, 256)
        value = lambda k: F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("double") / 32767.5 - 1
        return F.when(text.isNotNull(), F.array(*[value(k).cast("float") for k in range(self.dimensions)]))


@dataclass(frozen=True)
class FunctionEmbedding:
    """A Python function from texts to vectors, called with batches bounded by bytes and number; a batch that fails is tried one by one."""

    function: Callable[[list[str]], list[list[float]]]
    dimensions: int
    model_name: str
    most_bytes: int = 16_000
    most_items: int = 4

    def embed(self, text: Column) -> Column:
        call, most_bytes, most_items, dims = self.function, self.most_bytes, self.most_items, self.dimensions

        @F.pandas_udf("array<float>")
        def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in series:
                out: list[list[float] | None] = [None] * len(texts)
                own = [k for k, t in enumerate(texts) if t is not None]
                for part in batches([len(texts.iloc[k].encode()) for k in own], most_bytes, most_items):
                    ids = [own[k] for k in part]
                    for group in _tried(call, [texts.iloc[k] for k in ids]):
                        for k, v in zip(ids, group):
                            out[k] = list(v) if v is not None and len(v) == dims else None
                yield pd.Series(out)

        return run.asNondeterministic()(text)


def _tried(call: Callable, texts: list[str]) -> Iterator[list]:
    """The results of a batch; if it fails, of its texts one by one, None for those that fail."""
    try:
        yield call(texts)
        return
    except Exception:  # noqa: BLE001 - any failure of a model is a missing result
        if len(texts) == 1:
            yield [None]
            return
    out = []
    for t in texts:
        try:
            out += call([t])
        except Exception:  # noqa: BLE001
            out.append(None)
    yield out


@dataclass(frozen=True)
class RuleAnalyzer:
    """The first characters as summary and the first words as tags; texts that match `fails` fail."""

    model_name: str = "rules"
    fails: str = "(?!)"

    def analyze(self, text: Column) -> Column:
        tags = F.slice(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 6))), 1, 3)
        good = F.struct(F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 60).alias("summary"), tags.alias("tags"))
        return F.when(text.isNotNull() & ~text.rlike(self.fails), good)


@dataclass(frozen=True)
class FunctionAnalyzer:
    """A Python function from a text to (summary, tags)."""

    function: Callable[[str], tuple[str, Sequence[str]]]
    model_name: str

    def analyze(self, text: Column) -> Column:
        call = self.function

        @F.pandas_udf("summary string, tags array<string>")
        def run(texts: pd.Series) -> pd.DataFrame:
            out = []
            for t in texts:
                try:
                    summary, tags = call(t)
                    out.append((summary, list(tags)))
                except Exception:  # noqa: BLE001
                    out.append((None, None))
            return pd.DataFrame(out, columns=["summary", "tags"])

        found = run.asNondeterministic()(text)
        return F.when(found["summary"].isNotNull(), found)


def embed_missing(chunks: DataFrame, cache: DataFrame, provider: EmbeddingProvider, text: str = "text") -> DataFrame:
    """(text_hash, embedding) of the distinct texts that the cache lacks; failed ones have NULL."""
    own = chunks.where(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("text_hash"), F.col(text).alias("text"))
    new = own.join(cache.select("text_hash"), "text_hash", "left_anti").dropDuplicates(["text_hash"])
    return new.select("text_hash", provider.embed(F.col("text")).alias("embedding"))


def embed_chunks(chunks: DataFrame, cache: DataFrame, provider: EmbeddingProvider, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """((key, embedding) of all chunks whose text has one, the cache with new entries)."""
    fresh = embed_missing(chunks, cache, provider).where("embedding IS NOT NULL")
    full = cache.select("text_hash", "embedding").unionByName(fresh)
    return chunks.select(key, F.sha2("text", 256).alias("text_hash")).join(full, "text_hash").select(key, "embedding"), full


def analyze_chunks(chunks: DataFrame, analyzer: ChunkAnalyzer, limit: int = 100, order: str = "chunk_id") -> DataFrame:
    """(chunk_id, summary, tags, analyzer_model) of the first `limit` chunks that have no analysis or a failed one; failures are marked."""
    open_ = chunks.where(F.col("analyzer_model").isNull() | (F.col("analyzer_model") == FAILED)).orderBy(order).limit(limit)
    found = open_.select("chunk_id", analyzer.analyze(F.col("text")).alias("r"))
    bad = F.col("r").isNull()
    return found.select("chunk_id", F.when(bad, FAILED_SUMMARY).otherwise(F.col("r.summary")).alias("summary"), F.when(~bad, F.col("r.tags")).alias("tags"), F.when(bad, FAILED).otherwise(F.lit(analyzer.model_name)).alias("analyzer_model"))


def enriched_text(text: Column, summary: Column) -> Column:
    return F.concat(text, F.lit("\n\n// AI Summary: "), summary)


def enrich_embeddings(chunks: DataFrame, provider: EmbeddingProvider, limit: int = 500, order: str = "chunk_id") -> DataFrame:
    """(chunk_id, embedding) of the first `limit` analysed chunks that aren't enriched, from text and summary together."""
    good = (F.col("analyzer_model") != FAILED) & F.col("summary").isNotNull() & F.col("enriched_at").isNull()
    own = chunks.where(good).orderBy(order).limit(limit)
    return own.select("chunk_id", provider.embed(enriched_text(F.col("text"), F.col("summary"))).alias("embedding")).where("embedding IS NOT NULL")


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """New chunks with the analyses that old ones of the same text have (the last one of each text); failed ones don't count."""
    good = old.where(F.col("analyzer_model").isNotNull() & (F.col("analyzer_model") != FAILED))
    held = good.groupBy(F.sha2("text", 256).alias("__hash")).agg(F.max_by(F.struct("summary", "tags", "analyzer_model"), F.struct("analyzed_at", "chunk_id")).alias("__a"))
    both = new.withColumn("__hash", F.sha2("text", 256)).join(held, "__hash", "left")
    return both.withColumns({c: F.coalesce(F.col(c), F.col(f"__a.{c}")) if c in new.columns else F.col(f"__a.{c}") for c in ("summary", "tags", "analyzer_model")}).drop("__hash", "__a")


def search_text(vectors: DataFrame, query: str, provider: EmbeddingProvider, search: Callable, **options) -> DataFrame:
    """A vector search (`knn.search` or one of its kind) for a text; nothing if the provider gives no vector."""
    row = vectors.sparkSession.range(1).select(provider.embed(F.lit(query)).alias("v")).first()
    return vectors.limit(0) if row.v is None else search(vectors, [float(x) for x in row.v], **options)
