"""Aggregates over chunk-, file- and analysis-shaped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import directory_bucket

FAILED = "chunk-analyzer-failed"
SUFFIXES = ("ViewModel", "DataSource", "UseCase", "Controller", "Coordinator", "Configurator", "Repository", "Interactor", "Serializer", "Presenter", "Validator", "Formatter", "Delegate", "Provider", "Manager", "Handler", "Factory", "Service", "Adapter", "Builder", "Router", "Parser", "Helper", "Store", "View")


def least_values(column: str, n: int) -> Column:
    """An aggregate: the n least distinct values in order; for groups as small as the names of a file."""
    return F.slice(F.array_sort(F.collect_set(column)), 1, n)


def duplicates(chunks: DataFrame, least: int = 50, limit: int = 20) -> DataFrame:
    """Constructs of one name and type (or none) in several files, with the tokens that copies waste.

    Chunks of fewer tokens don't count. files lists (tokens, path), most tokens first, any_summary is the greatest summary.
    """
    own = chunks.where(F.col("construct_name").isNotNull() & (F.col("construct_name") != "") & (F.col("tokens") >= least))
    summary = F.max("summary") if "summary" in chunks.columns else F.max(F.lit(None).cast("string"))
    per_file = own.groupBy("construct_name", "construct_type", "path").agg(F.sum("tokens").alias("tokens"), summary.alias("any_summary"))
    found = per_file.groupBy("construct_name", "construct_type").agg(F.count("*").alias("files"), F.sum("tokens").alias("total"), F.max("any_summary").alias("any_summary"))
    found = found.where("files > 1").withColumn("wasted", F.expr("total - total div files")).orderBy(F.desc("total"), "construct_name", "construct_type").limit(limit)
    # Only the files of the constructs that are listed are gathered.
    few = found.select(F.col("construct_name").alias("name"), F.col("construct_type").alias("kind"), "files", "total", "wasted", "any_summary")
    mine = per_file.select(F.col("construct_name").alias("n"), F.col("construct_type").alias("k"), "path", "tokens")
    both = mine.join(F.broadcast(few), (F.col("n") == F.col("name")) & F.col("k").eqNullSafe(F.col("kind")))
    keys = [F.col("name").alias("construct_name"), F.col("kind").alias("construct_type"), "files", "total", "wasted", "any_summary"]
    paths = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("tokens")).alias("order"), "path"))), lambda x: x["path"])
    return both.groupBy(*keys).agg(paths.alias("paths")).orderBy(F.desc("total"), "construct_name", "construct_type")


def patterns(chunks: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, limit: int = 20) -> DataFrame:
    """Groups of names by the first suffix that they end with and are longer than; constructs without a type are left out.

    samples are the five first names: each group's are ranked among its distinct names, so none is gathered whole.
    """
    ends = F.filter(F.array(*[F.lit(s) for s in suffixes]), lambda s: F.endswith(F.col("construct_name"), s) & (F.length("construct_name") > F.length(s)))
    found = chunks.where("construct_type IS NOT NULL").withColumn("suffix", F.get(ends, F.lit(0))).where("suffix IS NOT NULL")
    names = found.groupBy("suffix", "construct_name").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
    # The five least names of each hash bucket first, then of the group: no task sorts all names of a suffix.
    salted = names.withColumn("salt", F.pmod(F.xxhash64("construct_name"), F.lit(64)))
    few = lambda df, keys: df.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("construct_name"))).where("at <= 5")
    samples = few(few(salted.select("suffix", "salt", "construct_name"), ["suffix", "salt"]), ["suffix"])
    samples = samples.groupBy("suffix").agg(F.array_join(F.array_sort(F.collect_list("construct_name")), "|").alias("samples"))
    sums = names.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n >= 2")
    return sums.join(samples, "suffix").orderBy(F.desc("n"), "suffix").limit(limit)


def hotspots(chunks: DataFrame, key: str, threshold: int = 200, limit: int = 20) -> DataFrame:
    named = chunks.where(F.col("tokens") >= threshold)
    named = named.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in ("construct_name", "construct_type")})
    return named.orderBy(F.desc("tokens"), key).limit(limit)


def counts_by(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n"))


def facets(files: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of several columns in one pass."""
    sets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return files.select(sets.alias("s")).where("s.value IS NOT NULL").groupBy("s.facet", "s.value").agg(F.count("*").alias("n"))


def large_files(chunks: DataFrame, limit: int = 20) -> DataFrame:
    found = chunks.groupBy("path").agg(F.count("*").alias("chunks"), F.sum(F.col("end_line") - F.col("start_line")).alias("lines"))
    return found.orderBy(F.desc("lines"), "path").limit(limit)


def structural_stats(files: DataFrame) -> DataFrame:
    """Totals, averages (0 for none) and the largest file."""
    zero = F.lit(0)
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("lines"), zero).alias("lines"),
        F.coalesce(F.sum("bytes"), zero).alias("bytes"),
        F.coalesce(F.round(F.avg("lines"), 6), F.lit(0.0)).alias("avg_lines"),
        F.max_by("path", F.struct("lines", "path")).alias("largest"),
    )


def analysis_counts(chunks: DataFrame) -> DataFrame:
    """Analysed, failed, not analysed and enriched rows; a failed one isn't analysed."""
    model = F.col("analyzer_model")
    return chunks.agg(
        F.count_if(model.isNotNull() & (model != FAILED)).alias("analysed"),
        F.count_if(model == FAILED).alias("failed"),
        F.count_if(model.isNull()).alias("unanalysed"),
        F.count_if(model.isNotNull() & (model != FAILED) & F.col("enriched")).alias("enriched"),
    )


def model_counts(chunks: DataFrame) -> DataFrame:
    return chunks.where("analyzer_model IS NOT NULL").groupBy("analyzer_model").agg(F.count("*").alias("n"))


def analyzer_drift(chunks: DataFrame, pin: str | None = None) -> DataFrame:
    """Models in use, rows off the pinned model (0 if it is blank), failed and open rows, and whether models are mixed."""
    pin = (pin or "").strip()
    model = F.col("analyzer_model")
    good = model.isNotNull() & (model != FAILED)
    return chunks.agg(
        F.countDistinct(F.when(good, model)).alias("models"),
        F.count_if(good & (model != pin) & F.lit(bool(pin))).alias("off_pin"),
        F.count_if(model == FAILED).alias("failed"),
        F.count_if(model.isNull()).alias("unanalysed"),
    ).withColumn("drifted", F.col("models") > 1)


def dangling(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose key no parent has."""
    return child.join(parent.select(key), key, "left_anti")


def coverage(disk: DataFrame, indexed: DataFrame, column: str) -> DataFrame:
    """Files on disk and in the index by a column, and the gap."""
    a = disk.groupBy(column).agg(F.count("*").alias("disk"))
    b = indexed.groupBy(column).agg(F.count("*").alias("indexed"))
    both = a.join(b, column, "full").na.fill(0, ["disk", "indexed"])
    return both.withColumn("gap", F.greatest(F.lit(0), F.col("disk") - F.col("indexed")))


def stats(repos: DataFrame, **tables: DataFrame) -> DataFrame:
    """(name, n) of all tables, repos too, and (latest) the name of the repository that was indexed last in each row."""
    latest = repos.where("last_indexed_at IS NOT NULL").agg(F.max_by("name", F.struct("last_indexed_at", "name")).alias("latest"))
    return table_counts(repos=repos, **tables).join(F.broadcast(latest))


def list_repos(repos: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Repositories with their numbers of files and chunks, by name."""
    per_file = chunks.groupBy("file_id").agg(F.count("*").alias("chunks"))
    counts = files.join(per_file, "file_id", "left").groupBy("repo_id").agg(F.count("*").alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
    return repos.join(counts, "repo_id", "left").na.fill(0, ["files", "chunks"]).orderBy("name", "repo_id")


def index_stats(files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(files, chunks, embeddings, lines) of a store, lines 0 without any."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).cast("long").alias("lines"))
    rest = [t.agg(F.count("*").alias(n)) for n, t in (("chunks", chunks), ("embeddings", embeddings))]
    return f.join(F.broadcast(rest[0])).join(F.broadcast(rest[1])).select("files", "chunks", "embeddings", "lines")


def drift_coverage(chunks: DataFrame) -> DataFrame:
    """(analyzer_model, n) without failures, most first."""
    return model_counts(chunks).where(F.col("analyzer_model") != FAILED).orderBy(F.desc("n"), "analyzer_model")


def most_methods(files: DataFrame) -> DataFrame:
    """(path, methods) of the file with most methods, if any has one."""
    return files.where("methods > 0").orderBy(F.desc("methods"), "path").select("path", "methods").limit(1)


def file_metrics(chunks: DataFrame) -> DataFrame:
    """(file_id, lines, methods): the last line of a file's chunks, and how many of these are functions."""
    method = F.lower(F.coalesce("construct_type", F.lit(""))).isin("function", "method", "init", "deinit")
    return chunks.groupBy("file_id").agg(F.max("end_line").alias("lines"), F.count_if(method).alias("methods"))


def integrity_report(files: DataFrame, chunks: DataFrame, embeddings: DataFrame, repos: DataFrame | None = None, **children: DataFrame) -> DataFrame:
    """(kind, n): rows of each table whose parent is gone; children are further tables with file_id."""
    parts = {"chunks": dangling(chunks, files, "file_id"), "embeddings": dangling(embeddings, chunks, "chunk_id")}
    if repos is not None:
        parts["files"] = dangling(files, repos, "repo_id")
    parts |= {name: dangling(t, files, "file_id") for name, t in children.items()}
    return table_counts(**parts).withColumnRenamed("name", "kind")


def coverage_report(disk: DataFrame, indexed: DataFrame, sample: int = 50, folders: int = 20) -> dict[str, DataFrame]:
    """Of paths on disk and in the index: totals, by_language, missing (a sample in order) and the directories with most missing files."""
    both = disk.select("path", "language").withColumn("d", F.lit(1)).join(indexed.select("path", F.col("language").alias("l")).withColumn("i", F.lit(1)), "path", "full")
    both = both.select("path", F.coalesce("language", "l").alias("language"), F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("i", F.lit(0)).alias("i"))
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    missing = both.where("d = 1 AND i = 0")
    gaps = missing.groupBy(directory_bucket(F.col("path")).alias("directory")).agg(F.count("*").alias("gap")).orderBy(F.desc("gap"), "directory").limit(folders)
    return {
        "totals": both.agg(zero("d")("disk"), zero("i")("indexed"), F.count_if(F.expr("d = 1 AND i = 0")).alias("missing"), F.count_if(F.expr("d = 0")).alias("gone")),
        "by_language": both.groupBy("language").agg(F.sum("d").alias("disk"), F.sum("i").alias("indexed"), F.greatest(F.lit(0), F.sum(F.col("d") - F.col("i"))).alias("gap")),
        "missing": missing.select("path", "language").orderBy("path").limit(sample),
        "directories": gaps,
    }


def dimensions_by_repo(repos: DataFrame, files: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """repos with embedding_dimensions, where NULL, taken from one of their vectors (the longest)."""
    own = embeddings.join(chunks.select("chunk_id", "file_id"), "chunk_id").join(files.select("file_id", "repo_id"), "file_id")
    found = own.groupBy("repo_id").agg(F.max(F.size("embedding")).alias("__dims"))
    return repos.join(found, "repo_id", "left").withColumn("embedding_dimensions", F.coalesce("embedding_dimensions", "__dims")).drop("__dims")


MODELS_BY_DIMENSIONS = {384: "all-MiniLM-L6-v2", 768: "nomic-embed-text-v1.5", 1024: "Qwen3-Embedding-0.6B-4bit"}


def model_by_dimensions(repos: DataFrame) -> DataFrame:
    """repos with embedding_model, where NULL, told by the dimensions."""
    known = F.create_map(*[F.lit(x) for kv in MODELS_BY_DIMENSIONS.items() for x in kv])
    return repos.withColumn("embedding_model", F.coalesce("embedding_model", F.element_at(known, F.col("embedding_dimensions").cast("int"))))


def chunking_health(failures: DataFrame, recent: int = 20) -> dict[str, DataFrame]:
    """Failures of chunking: total, by language, and the last ones."""
    return {
        "total": failures.agg(F.count("*").alias("n")),
        "by_language": failures.groupBy("language").agg(F.count("*").alias("n")),
        "recent": failures.orderBy(F.desc("at"), "path").limit(recent),
    }


def table_counts(**tables: DataFrame) -> DataFrame:
    """(name, n) of several tables."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
