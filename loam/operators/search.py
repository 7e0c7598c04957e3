"""Text and tag search over chunk-shaped tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts)


def text_search(rows: DataFrame, query: str, columns: list[str], match_all: bool = True, limit: int = 10, order: list[str] | None = None, module: tuple[str, str] | None = None) -> DataFrame:
    """Rows in which every (or any) word of the query is part of one of the columns, in any case.

    % and _ in a word are wildcards. An empty query finds nothing. module: (column, part of it).
    """
    found = query.split()
    if not found:
        return rows.limit(0)
    hits = [_any([F.coalesce(F.col(c), F.lit("")).ilike(f"%{w}%") for c in columns]) for w in found]
    cond = reduce(lambda a, b: a & b, hits) if match_all else _any(hits)
    if module:
        cond = cond & F.contains(F.lower(F.col(module[0])), F.lit(module[1].lower()))
    return rows.where(cond).orderBy(*(order or columns)).limit(max(1, limit))


def tag_search(rows: DataFrame, tags: list[str], column: str = "tags", match_all: bool = False, limit: int = 30, order: list[Column | str] | None = None) -> DataFrame:
    """Rows that have any (or all) of the tags."""
    if not tags:
        return rows.limit(0)
    hits = [F.array_contains(column, t) for t in tags]
    cond = reduce(lambda a, b: a & b, hits) if match_all else _any(hits)
    return rows.where(cond).orderBy(*(order or [column])).limit(limit)


def tag_counts(rows: DataFrame, column: str = "tags") -> DataFrame:
    return rows.select(F.explode(column).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def recent_hints(hints: DataFrame, at: str, key: str, limit: int = 20) -> DataFrame:
    return hints.orderBy(F.desc(at), key).limit(limit)


def match_lessons(lessons: DataFrame, signature: str | None = None, pattern: str | None = None, limit: int = 10) -> DataFrame:
    """Active lessons by parts of error_signature and file_pattern (a lesson without a pattern fits every file), surest first.

    Case doesn't matter; % and _ are wildcards.
    """
    found = lessons.where("is_active")
    if signature:
        found = found.where(F.col("error_signature").ilike(f"%{signature}%"))
    if pattern:
        found = found.where(F.col("file_pattern").isNull() | F.col("file_pattern").ilike(f"%{pattern}%"))
    return found.orderBy(F.desc("confidence"), F.desc("success_count"), "id").limit(limit)


def use_lesson(lessons: DataFrame, id_: Column, success: Column) -> DataFrame:
    """Lessons after one use of those that id_ picks: a success is counted, a failure lowers the confidence by 0.1, to 0.1 at least."""
    ok, bad = id_ & success, id_ & ~success
    return lessons.withColumns(
        {
            "apply_count": F.col("apply_count") + id_.cast("int"),
            "success_count": F.col("success_count") + ok.cast("int"),
            "confidence": F.when(bad, F.greatest(F.lit(0.1), F.col("confidence") - 0.1)).otherwise(F.col("confidence")),
        }
    )


def list_lessons(lessons: DataFrame, inactive: bool = False, limit: int = 50) -> DataFrame:
    """Lessons, active ones unless asked for all, latest change first."""
    return (lessons if inactive else lessons.where("is_active")).orderBy(F.desc("updated_at"), "id").limit(limit)


def get_lesson(lessons: DataFrame, id_) -> DataFrame:
    return lessons.where(F.col("id") == id_)


def search_chunks(chunks: DataFrame, files: DataFrame, repos: DataFrame, query: str, match_all: bool = True, limit: int = 10, repo: str | None = None, module: str | None = None) -> DataFrame:
    """Chunks with words of the query in text, construct name or summary, with their file and repository, by path and line."""
    files = files.where(F.col("repo_id") == repo) if repo is not None else files
    star = chunks.join(files, "file_id").join(F.broadcast(repos), "repo_id")
    order = ["path", "start_line", "chunk_id"]
    found = text_search(star, query, ["text", "construct_name", "summary"], match_all, limit, order, ("module_path", module) if module else None)
    return found.withColumn("path", F.concat_ws("/", "root_path", "path"))
