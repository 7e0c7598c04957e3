"""Changes of store tables (repos, files, chunks, embeddings, analyses, lessons, caches), as the state after them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import SECRETS_PATTERN
from .analytics import FAILED, dangling
from .merge import cascade, replace

FAILED_SUMMARY = "[analysis-failed]"
_ANALYSIS = ("summary", "tags", "analyzed_at", "analyzer_model", "enriched_at")


def _merged(old: DataFrame, new: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """old and new by key; columns by their rule over a.x (old) and b.x (new) where the row is new, else as they were."""
    a, b = old.withColumn("__old", F.lit(True)).alias("a"), new.withColumn("__new", F.lit(True)).alias("b")
    both = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]), "full")
    cols = [F.when(F.col("b.__new"), rules.get(c, F.col(f"b.{c}"))).otherwise(F.col(f"a.{c}")).alias(c) for c in old.columns]
    return both.select(*cols)


def upsert_repos(old: DataFrame, new: DataFrame) -> DataFrame:
    """Repositories by repo_id: identifier and model stay where the new one is NULL, dimensions unless the new ones are positive; the parent is always the new one."""
    keep = {c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) for c in ("repo_identifier", "embedding_model")}
    dims = F.when(F.col("b.embedding_dimensions") > 0, F.col("b.embedding_dimensions")).otherwise(F.col("a.embedding_dimensions"))
    return _merged(old, new, ["repo_id"], keep | {"embedding_dimensions": dims})


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks by chunk_id; a chunk that is written again isn't enriched."""
    return replace(old, new.withColumn("enriched_at", F.lit(None).cast(old.schema["enriched_at"].dataType)), ["chunk_id"])


def upsert_embeddings(old: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """Embeddings by chunk_id; an empty one, or one of other dimensions than dims (0: any), is an error."""
    size = F.size("embedding")
    bad = (F.coalesce(size, F.lit(0)) <= 0) | F.lit(dims > 0) & (size != dims)
    checked = F.when(bad, F.raise_error(F.lit("embedding of wrong dimensions"))).otherwise(F.col("embedding"))
    return replace(old, new.withColumn("embedding", checked), ["chunk_id"])


def last_wins(new: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The last row of each key."""
    ordered = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return new.withColumn("__at", F.row_number().over(ordered)).where("__at = 1").drop("__at")


def upsert_cache(cache: DataFrame, new: DataFrame, order: str = "at", key: str = "text_hash") -> DataFrame:
    """A cache by text hash with new entries, of which the last of a hash counts; order is a column of both."""
    best = F.max_by(F.struct(*new.columns), F.struct(order, *[c for c in new.columns if c not in (key, order)]))
    return replace(cache, new.groupBy(key).agg(best.alias("r")).select("r.*"), [key])


def insert_rows(old: DataFrame, new: DataFrame, required: Sequence[str], key: str = "id") -> DataFrame:
    """Rows with new ones by id, once each; new rows that lack a required value are skipped."""
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in (key, *required)])
    return replace(old, new.where(good).dropDuplicates([key]), [key])


def update_analysis(chunks: DataFrame, analyses: DataFrame, cache: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """chunks, chunk_analysis and cache after results (chunk_id, summary, tags, analyzer_model, analyzed_at).

    A chunk is enriched no longer. Failed results don't go to the cache.
    """
    own = results.select("chunk_id", *[F.col(c).alias(f"__{c}") for c in _ANALYSIS[:4]], F.lit(True).alias("__hit"))
    both = chunks.join(own, "chunk_id", "left")
    after = both.withColumns({c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) for c in _ANALYSIS[:4]})
    after = after.withColumn("enriched_at", F.when(F.col("__hit"), F.lit(None)).otherwise(F.col("enriched_at"))).select(*chunks.columns)
    good = results.where(F.coalesce(F.col("analyzer_model"), F.lit("")) != FAILED).join(chunks.select("chunk_id", F.sha2("text", 256).alias("text_hash")), "chunk_id")
    entries = good.select("text_hash", "summary", "tags", "analyzer_model", F.col("analyzed_at").alias("at"))
    return {"chunks": after, "chunk_analysis": replace(analyses, results.select(*analyses.columns), ["chunk_id", "analyzer_model"]), "cache": upsert_cache(cache, entries.select(*cache.columns))}


def clear_analysis(chunks: DataFrame, where: Column | None = None) -> DataFrame:
    """Chunks without their analysis, those that `where` picks or all."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    return chunks.withColumns({c: F.when(~hit, F.col(c)) for c in _ANALYSIS if c in chunks.columns})


def import_overlay(analyses: DataFrame, overlay: DataFrame, source: str) -> DataFrame:
    """Analyses by chunk and model with those of an overlay, marked with its source."""
    return replace(analyses, overlay.withColumn("source", F.lit(source)).select(*analyses.columns), ["chunk_id", "analyzer_model"])


def delete_repo(tables: Mapping[str, DataFrame], repo_id: Column) -> dict[str, DataFrame]:
    """repos, files, chunks, embeddings, dependencies and symbol_refs without a repository (chosen by a condition on repo_id). Analyses, symbols and lessons stay."""
    files = tables["files"].where(repo_id).select("file_id")
    chunks = tables["chunks"].join(files, "file_id", "left_semi").select("chunk_id")
    gone = cascade({n: (tables[n], "file_id") for n in ("files", "chunks", "dependencies", "symbol_refs") if n in tables}, files, "file_id")
    if "embeddings" in tables:
        gone |= cascade({"embeddings": (tables["embeddings"], "chunk_id")}, chunks, "chunk_id")
    return dict(tables) | gone | {"repos": tables["repos"].where(~repo_id)}


def delete_files(tables: Mapping[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without the files in gone (file_id) and all that hangs on them, number of files that went)."""
    own = gone.select("file_id").distinct()
    chunks = tables["chunks"].join(own, "file_id", "left_semi").select("chunk_id")
    left = cascade({n: (t, "file_id") for n, t in tables.items() if "file_id" in t.columns}, own, "file_id")
    left |= cascade({n: (t, "chunk_id") for n, t in tables.items() if "chunk_id" in t.columns and "file_id" not in t.columns}, chunks, "chunk_id")
    return dict(tables) | left, tables["files"].join(own, "file_id", "left_semi").agg(F.count("*").alias("files"))


def delete_dangling(files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks whose file is there, embeddings whose chunk is then there, (chunks, embeddings) counts of dangling rows before)."""
    counts = dangling(chunks, files, "file_id").agg(F.count("*").alias("chunks")).join(F.broadcast(dangling(embeddings, chunks, "chunk_id").agg(F.count("*").alias("embeddings"))))
    kept = chunks.join(files.select("file_id"), "file_id", "left_semi")
    return kept, embeddings.join(kept.select("chunk_id"), "chunk_id", "left_semi"), counts


def refused(files: DataFrame, pattern: str = SECRETS_PATTERN) -> DataFrame:
    """Files whose path the policy would refuse, in order."""
    return files.where(F.col("path").rlike(pattern)).orderBy("path")


def purge(tables: Mapping[str, DataFrame], pattern: str = SECRETS_PATTERN) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without refused files and all that hangs on them, (path, chunks) of what went)."""
    gone = tables["files"].where(F.col("path").rlike(pattern))
    counts = tables["chunks"].groupBy("file_id").agg(F.count("*").alias("chunks"))
    report = gone.join(counts, "file_id", "left").select("path", F.coalesce("chunks", F.lit(0)).alias("chunks")).orderBy("path")
    return delete_files(tables, gone)[0], report


def clear(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(an empty cache, number of entries before)."""
    return cache.where(F.lit(False)), cache.agg(F.count("*").alias("n"))


def add_lesson(lessons: DataFrame, new: DataFrame) -> DataFrame:
    """Lessons with new ones by id: active, sure, never used, as far as new doesn't say otherwise."""
    fill = {"is_active": F.lit(True), "confidence": F.lit(1.0), "apply_count": F.lit(0), "success_count": F.lit(0)}
    cols = []
    for f in lessons.schema.fields:
        own, rest = (F.col(f.name) if f.name in new.columns else F.lit(None)), fill.get(f.name, F.lit(None))
        cols.append(F.coalesce(own.cast(f.dataType), rest.cast(f.dataType)).alias(f.name))
    return replace(lessons, new.select(*cols), ["id"])


def update_lesson(lessons: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Lessons with some columns set where `where` holds; a NULL value leaves the column as it is."""
    hit = F.coalesce(where, F.lit(False))
    return lessons.withColumns({c: F.when(hit, F.coalesce(v, F.col(c))).otherwise(F.col(c)) for c, v in values.items()})


def delete_lessons(lessons: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """(lessons without those that `where` picks, how many went)."""
    hit = F.coalesce(where, F.lit(False))
    return lessons.where(~hit), lessons.where(hit).agg(F.count("*").alias("n"))


def add_hint(hints: DataFrame, new: DataFrame) -> DataFrame:
    """The log of query hints with new rows at its end; nothing is replaced."""
    return hints.unionByName(new.select(*hints.columns))


def set_pin(repos: DataFrame, where: Column, pin: str | None) -> DataFrame:
    """Repositories with the analyzer pin, trimmed, set where `where` holds; a blank one unpins."""
    return repos.withColumn("analyzer_pin", F.when(where, F.nullif(F.trim(F.lit(pin).cast("string")), F.lit(""))).otherwise(F.col("analyzer_pin")))


def read_pin(repos: DataFrame, where: Column) -> DataFrame:
    """(repo_id, pin): blank pins read as NULL."""
    return repos.where(where).select("repo_id", F.nullif(F.trim("analyzer_pin"), F.lit("")).alias("pin"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def reconcile_names(repos: DataFrame, existing: DataFrame) -> DataFrame:
    """Top-level repositories whose root (root_path in existing) is there take its last name; others stay."""
    there = existing.select("root_path", F.lit(True).alias("__there")).distinct()
    both = repos.join(there, "root_path", "left")
    new = F.when(F.col("__there") & F.col("parent_repo_id").isNull(), basename(F.col("root_path"))).otherwise(F.col("name"))
    return both.withColumn("name", new).select(*repos.columns)


def remap_root(repos: DataFrame, repo_id, root: str, allowed: bool = False) -> DataFrame:
    """Repositories with the root of one of them moved, if that is asked for; else unchanged."""
    return repos.withColumn("root_path", F.when(F.col("repo_id") == repo_id, root).otherwise(F.col("root_path"))) if allowed else repos


def resolve_repo(repos: DataFrame, path: str, identifier: str | None = None) -> DataFrame:
    """The repository at a path; failing that, the one of that remote identifier; of several, the only one with the path's last name, else none."""
    name = path.rstrip("/").rpartition("/")[2]
    exact = repos.where(F.col("root_path") == path).withColumn("rank", F.lit(0))
    same = repos.where(F.col("repo_identifier") == identifier)
    sizes = same.agg(F.count("*").alias("n"), F.count_if(basename(F.col("root_path")) == name).alias("named"))
    remote = same.join(F.broadcast(sizes)).where((F.col("n") == 1) | (F.col("named") == 1) & (basename(F.col("root_path")) == name)).drop("n", "named").withColumn("rank", F.lit(1))
    return exact.unionByName(remote).orderBy("rank", "repo_id").limit(1).drop("rank")


#: Columns that an open store has to have, by table.
TABLES: Mapping[str, Sequence[str]] = {
    "repos": ("repo_id", "name", "root_path"), "files": ("file_id", "repo_id", "path", "hash", "language"),
    "chunks": ("chunk_id", "file_id", "start_line", "end_line", "text"), "embeddings": ("chunk_id", "embedding"),
}


def status(tables: Mapping[str, DataFrame], version: int, expected: int) -> dict[str, object]:
    """What opening a store would find: missing tables and columns, its version, and whether it can be used."""
    missing = sorted(set(TABLES) - set(tables))
    lacking = {n: sorted(set(c) - set(tables[n].schema.fieldNames())) for n, c in TABLES.items() if n in tables}
    lacking = {n: c for n, c in lacking.items() if c}
    return {"missing": missing, "lacking": lacking, "version": version, "usable": not missing and not lacking and version == expected}


def has_column(table: DataFrame, name: str) -> bool:
    return name in table.schema.fieldNames()


def scalar(df: DataFrame, default=0):
    """The first value of the first row; default without one."""
    row = df.first()
    return default if row is None or row[0] is None else row[0]
