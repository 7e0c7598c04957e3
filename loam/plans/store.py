"""Queries over documents seen as a store of repositories, files, chunks, analyses, symbols and lessons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import analytics as A
from ..operators import chunking, graph, knn, merge, providers, search, store, structure
from .corpus import docs

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The store, and the same tables in SQL.


def repos(spark, sf_dir) -> DataFrame:
    d = docs(spark, sf_dir).groupBy(F.col("source").alias("repo_id")).agg(F.max("doc_id").alias("last_indexed_at"))
    even = F.substring("repo_id", 4, 9).cast("int") % 2 == 0
    return d.select(
        "repo_id", F.concat(F.lit("repo "), "repo_id").alias("name"), F.concat(F.lit("/repos/"), "repo_id").alias("root_path"), F.when(even, F.concat(F.lit("host/x/"), "repo_id")).alias("repo_identifier"), "last_indexed_at",
        F.when(even, "src0").alias("parent_repo_id"), F.when(even, "model-a").alias("embedding_model"), F.when(even, F.lit(8)).alias("embedding_dimensions"), F.when(even, " pin ").alias("analyzer_pin"),
    )


_EVEN = "substring(source, 4, 9)::INTEGER % 2 = 0"
_REPOS = f"""repos AS (SELECT source AS repo_id, 'repo ' || source AS name, '/repos/' || source AS root_path, CASE WHEN {_EVEN} THEN 'host/x/' || source END AS repo_identifier, max(doc_id) AS last_indexed_at,
CASE WHEN {_EVEN} THEN 'src0' END AS parent_repo_id, CASE WHEN {_EVEN} THEN 'model-a' END AS embedding_model, CASE WHEN {_EVEN} THEN 8 END AS embedding_dimensions, CASE WHEN {_EVEN} THEN ' pin ' END AS analyzer_pin FROM documents GROUP BY source)"""


def files(spark, sf_dir) -> DataFrame:
    path = F.concat("lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 0, "_test.ts").otherwise(".txt"))
    lines = F.size(F.split("text", "\n", -1)).alias("lines")
    return docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo_id"), path.alias("path"), F.col("lang").alias("language"), lines, F.sha2("text", 256).alias("hash"))


_FILES = "files AS (SELECT doc_id AS file_id, source AS repo_id, lang || '/doc_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_test.ts' ELSE '.txt' END AS path, lang AS language, len(string_split(text, chr(10)))::INTEGER AS lines, sha256(text) AS hash FROM documents)"


def chunks(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("classDecl", "Method", "comment", "structDecl", "function")]), (F.col("file_id") + F.col("chunk")).cast("int") % 5 + 1)
    own = chunking.fixed_windows(docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text"), most=20, overlap=5)
    return own.select(
        (F.col("file_id") * 10000 + F.col("chunk")).alias("chunk_id"), "file_id", "start_line", "end_line", F.col("body").alias("text"), T.token_count(F.col("body")).alias("tokens"),
        kind.alias("construct_type"), F.concat(F.lit("Thing"), (F.col("file_id") % 50).cast("string")).alias("construct_name"),
    )


_CHUNKS = r"""windows AS (SELECT doc_id, l, unnest(generate_series(0, greatest(0, (ceil((len(l) - 20) / 15.0))::BIGINT))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
bodies AS (SELECT doc_id AS file_id, k, (k * 15 + 1)::INTEGER AS start_line, least(k * 15 + 20, len(l))::INTEGER AS end_line, array_to_string(l[k * 15 + 1 : k * 15 + 20], chr(10)) AS text FROM windows),
chunks AS (SELECT file_id * 10000 + k AS chunk_id, file_id, start_line, end_line, text, greatest(1, len(regexp_extract_all(text, '\S+')))::INTEGER AS tokens,
['classDecl', 'Method', 'comment', 'structDecl', 'function'][(file_id + k) % 5 + 1] AS construct_type, 'Thing' || (file_id % 50) AS construct_name FROM bodies)"""


def analysed(spark, sf_dir) -> DataFrame:
    k = F.col("chunk_id") % 4
    model = F.when(k == 0, F.lit(None)).when(k == 1, A.FAILED).otherwise(F.concat(F.lit("model-"), k.cast("string")))
    return chunks(spark, sf_dir).select("*", F.when(k > 1, F.substring("text", 1, 9)).alias("summary"), F.when(k > 1, F.array("construct_type")).alias("tags"), F.when(k > 0, k).alias("analyzed_at"), model.alias("analyzer_model"), F.when(k == 3, k).alias("enriched_at"))


_ANALYSED = f"""analysed AS (SELECT *, CASE WHEN chunk_id % 4 > 1 THEN substring(text, 1, 9) END AS summary, CASE WHEN chunk_id % 4 > 1 THEN [construct_type] END AS tags, CASE WHEN chunk_id % 4 > 0 THEN chunk_id % 4 END AS analyzed_at,
CASE chunk_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '{A.FAILED}' ELSE 'model-' || chunk_id % 4 END AS analyzer_model, CASE WHEN chunk_id % 4 = 3 THEN chunk_id % 4 END AS enriched_at FROM chunks)"""
_HASHED = providers.HashEmbedding()


def embedded(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).select("chunk_id", _HASHED.embed(F.col("text")).alias("embedding"))


def _vector_sql(text: str) -> str:
    return "[" + ", ".join(f"(('0x' || substring(sha256({text}), {4 * k + 1}, 4))::INTEGER / 32767.5::DOUBLE - 1)::FLOAT" for k in range(8)) + "]"


_EMBEDDED = f"embedded AS (SELECT chunk_id, {_vector_sql('text')} AS embedding FROM chunks)"


def symbols(spark, sf_dir) -> DataFrame:
    """Constructs of part, in files by key, and what lineitem refers to."""
    return _t(spark, sf_dir, "part").select((F.col("p_partkey") % 97).alias("file_id"), F.concat(F.lit(" "), "p_brand", F.lit(" ")).alias("construct_name"), F.element_at(F.array(*[F.lit(x) for x in ("classDecl", "Method", "comment", "STRUCT", "enum ")]), F.col("p_size") % 5 + 1).alias("construct_type"), F.col("p_partkey").alias("start_line"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"))


def definitions(spark, sf_dir) -> DataFrame:
    return graph.symbol_definitions(symbols(spark, sf_dir))


_SYMBOLS = "symbols AS (SELECT p_partkey % 97 AS file_id, trim(' ' || p_brand || ' ') AS name, ['class', 'method', NULL, 'struct', 'enum'][p_size % 5 + 1] AS kind, p_partkey AS start_line, p_partkey + p_size AS end_line FROM part)"
_DEFS = f"""{_SYMBOLS}, defs AS (SELECT sha256(file_id || ':def:' || kind || ':' || name) AS id, file_id, name, kind, start_line, end_line FROM (SELECT *, row_number() OVER (PARTITION BY file_id, name, kind ORDER BY start_line, end_line) AS r FROM symbols WHERE kind IS NOT NULL) WHERE r = 1)"""


def references(spark, sf_dir) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    own = _t(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return graph.symbol_refs(own.select((F.col("l_orderkey") % 97).alias("file_id"), F.when(F.col("l_returnflag") == "R", F.array("p_brand")).alias("typeReferences"), F.when(F.col("l_returnflag") == "N", F.array("p_brand")).alias("protocols"), F.when(F.col("l_returnflag") == "A", F.array("p_brand")).alias("mixins")))


_REFS = """refs AS (SELECT DISTINCT sha256(file_id || ':' || kind || ':' || name) AS id, file_id, kind, name FROM (SELECT l_orderkey % 97 AS file_id, CASE l_returnflag WHEN 'R' THEN 'type' WHEN 'N' THEN 'conform' WHEN 'A' THEN 'mixin' END AS kind, p_brand AS name FROM lineitem JOIN part ON p_partkey = l_partkey) WHERE kind IS NOT NULL)"""


def links(spark, sf_dir) -> DataFrame:
    """Dependency edges between files, from lineitem; every third leads outside."""
    li = _t(spark, sf_dir, "lineitem")
    target = F.col("l_suppkey") % 190
    return li.select((F.col("l_partkey") % 200).alias("source"), F.when(target % 3 != 0, target).alias("target_file"), F.concat(F.lit("mod/doc_"), target.cast("string")).alias("target"), F.col("l_returnflag").alias("kind")).distinct()


_LINKS = "links AS (SELECT DISTINCT l_partkey % 200 AS source, CASE WHEN l_suppkey % 190 % 3 <> 0 THEN l_suppkey % 190 END AS target_file, 'mod/doc_' || l_suppkey % 190 AS target, l_returnflag AS kind FROM lineitem)"


# Reports over the whole store.


@register("stats_latest", f"WITH {_REPOS}, {_FILES}, {_CHUNKS} SELECT c.*, (SELECT name FROM repos ORDER BY last_indexed_at DESC, name DESC LIMIT 1) AS latest FROM (SELECT 'repos' AS name, count(*) AS n FROM repos UNION ALL SELECT 'files', count(*) FROM files UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'embeddings', count(*) FROM chunks UNION ALL SELECT 'labels', count(*) FROM labels) c")
def stats_latest(spark, sf_dir):
    return A.stats(repos(spark, sf_dir), files=files(spark, sf_dir), chunks=chunks(spark, sf_dir), embeddings=embedded(spark, sf_dir), labels=_t(spark, sf_dir, "labels"))


@register("list_repos", f"WITH {_REPOS}, {_FILES}, {_CHUNKS} SELECT r.repo_id, r.name, count(DISTINCT f.file_id) AS files, count(c.chunk_id) AS chunks FROM repos r LEFT JOIN files f USING (repo_id) LEFT JOIN chunks c USING (file_id) GROUP BY 1, 2")
def list_repos(spark, sf_dir):
    return A.list_repos(repos(spark, sf_dir), files(spark, sf_dir), chunks(spark, sf_dir)).select("repo_id", "name", "files", "chunks")


@register("index_stats", f"WITH {_FILES}, {_CHUNKS} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM chunks) AS embeddings, (SELECT sum(lines)::BIGINT FROM files) AS lines")
def index_stats(spark, sf_dir):
    return A.index_stats(files(spark, sf_dir), chunks(spark, sf_dir), embedded(spark, sf_dir))


@register("drift_coverage", f"WITH {_CHUNKS}, {_ANALYSED} SELECT analyzer_model, count(*) AS n FROM analysed WHERE analyzer_model <> '{A.FAILED}' GROUP BY 1")
def drift_coverage(spark, sf_dir):
    return A.drift_coverage(analysed(spark, sf_dir))


_METRICS = f"{_CHUNKS}, metrics AS (SELECT file_id, max(end_line) AS lines, count(*) FILTER (lower(construct_type) IN ('function', 'method', 'init', 'deinit')) AS methods FROM chunks GROUP BY file_id)"


@register("file_metrics", f"WITH {_METRICS} SELECT * FROM metrics")
def file_metrics(spark, sf_dir):
    return A.file_metrics(chunks(spark, sf_dir))


@register("most_methods", f"WITH {_METRICS}, {_FILES} SELECT path, methods FROM metrics JOIN files USING (file_id) WHERE methods > 0 ORDER BY methods DESC, path LIMIT 1")
def most_methods(spark, sf_dir):
    return A.most_methods(file_metrics(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "path"), "file_id"))


@register("files_by_methods", f"WITH {_METRICS}, {_FILES} SELECT path, m.lines, methods FROM metrics m JOIN files USING (file_id) WHERE methods BETWEEN 1 AND 9 AND m.lines >= 3 AND language = 'en' ORDER BY methods DESC, path LIMIT 50")
def files_by_methods(spark, sf_dir):
    own = file_metrics(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "path", "language"), "file_id")
    return structure.files_by_structure(own, lines=(3, None), methods=(1, 9), language="en", sort="methods").select("path", "lines", "methods")


@register("large_files_chunks", f"WITH {_CHUNKS}, {_FILES} SELECT path, count(*) AS chunks, sum(end_line - start_line)::BIGINT AS lines FROM chunks JOIN files USING (file_id) GROUP BY path ORDER BY lines DESC, path LIMIT 20")
def large_files_chunks(spark, sf_dir):
    return A.large_files(chunks(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "path"), "file_id"))


@register("facets_four", f"""WITH {_FILES}, {_CHUNKS} SELECT 'module' AS facet, language AS value, count(*) AS n FROM files GROUP BY 2 UNION ALL SELECT 'language', language, count(*) FROM files GROUP BY 2
UNION ALL SELECT 'construct', construct_type, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest(list_distinct([language, CASE WHEN contains(path, 'test') THEN 'tested' ELSE language END])) AS tag FROM files) GROUP BY 2""")
def facets_four(spark, sf_dir):
    f = files(spark, sf_dir)
    own = A.facets(f.select(T.module_path(F.col("path")).alias("module"), "language"), ["module", "language"]).union(A.facets(chunks(spark, sf_dir).select(F.col("construct_type").alias("construct")), ["construct"]))
    tags = F.array_distinct(F.array("language", F.when(F.contains("path", F.lit("test")), "tested").otherwise(F.col("language"))))
    return own.union(search.tag_counts(f.select(tags.alias("tags"))).select(F.lit("tag"), "tag", "n"))


@register("integrity_report", f"WITH {_FILES}, {_CHUNKS}, kept AS (SELECT * FROM files WHERE language <> 'en') SELECT 'chunks' AS kind, count(*) AS n FROM chunks WHERE file_id NOT IN (SELECT file_id FROM kept) UNION ALL SELECT 'embeddings', count(*) FROM chunks WHERE chunk_id % 3 = 0 UNION ALL SELECT 'files', count(*) FROM kept WHERE repo_id = 'src1' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT file_id FROM kept)")
def integrity_report(spark, sf_dir):
    kept = files(spark, sf_dir).where("language != 'en'")
    # Embeddings of chunks that are gone, files of a repository that is gone.
    c, r = chunks(spark, sf_dir), repos(spark, sf_dir).where("repo_id != 'src1'")
    parts = A.integrity_report(kept, c, embedded(spark, sf_dir), r, labels=_t(spark, sf_dir, "labels").withColumnRenamed("doc_id", "file_id"))
    gone = A.integrity_report(kept, c.where("chunk_id % 3 != 0"), embedded(spark, sf_dir)).where("kind = 'embeddings'")
    return parts.where("kind != 'embeddings'").union(gone)


_COVER = f"WITH {_FILES}, indexed AS (SELECT * FROM files WHERE file_id % 3 <> 0), missing AS (SELECT * FROM files WHERE file_id % 3 = 0)"
for _name, _sql in {
    "totals": "SELECT (SELECT count(*) FROM files) AS disk, (SELECT count(*) FROM indexed) AS indexed, (SELECT count(*) FROM missing) AS missing, 0::BIGINT AS gone",
    "by_language": "SELECT language, count(*) AS disk, count(*) FILTER (file_id % 3 <> 0) AS indexed, count(*) FILTER (file_id % 3 = 0) AS gap FROM files GROUP BY language",
    "missing": "SELECT path, language FROM missing ORDER BY path LIMIT 50",
    "directories": "SELECT language AS directory, count(*) AS gap FROM missing GROUP BY 1 ORDER BY gap DESC, 1 LIMIT 20",
}.items():
    register(f"coverage_{_name}", f"{_COVER} {_sql}")(lambda spark, sf_dir, k=_name: A.coverage_report(files(spark, sf_dir), files(spark, sf_dir).where("file_id % 3 != 0"))[k])


def failures(spark, sf_dir) -> DataFrame:
    return files(spark, sf_dir).where("file_id % 7 = 0").select("path", "hash", F.lit("parse").alias("kind"), "language", F.col("file_id").alias("at"))


_FAILURES = f"""{_FILES}, failures AS (SELECT path, hash, 'parse' AS kind, language, file_id AS "at" FROM files WHERE file_id % 7 = 0)"""
for _name, _sql in {"total": "SELECT count(*) AS n FROM failures", "by_language": "SELECT language, count(*) AS n FROM failures GROUP BY 1", "recent": 'SELECT * FROM failures ORDER BY "at" DESC, path LIMIT 20'}.items():
    register(f"chunking_failures_{_name}", f"WITH {_FAILURES} {_sql}")(lambda spark, sf_dir, k=_name: A.chunking_health(failures(spark, sf_dir))[k])


@register("unmeasured_count", "SELECT count(*) AS unmeasured FROM documents")
def unmeasured_count(spark, sf_dir):
    return structure.unmeasured(structure.measure(docs(spark, sf_dir), "doc_id", "text", F.lit("Text")))


#: Line classes of text whose lines either begin with // or hold no mark at all.
_LINES = r"""ls AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, string_split(replace(replace(replace(regexp_replace(text, '(^|\n)([A-D])', '\1//~ \2', 'g'), '//~', chr(1)), '/', '|'), chr(1), '//'), chr(10)) AS l FROM documents)),
cs AS (SELECT *, starts_with(trim(line, ' ' || chr(9) || chr(160)), '//') AS c, trim(line, ' ' || chr(9) || chr(160)) = '' AS blank FROM ls),
runs AS (SELECT doc_id, count(*) AS n FROM (SELECT *, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS g FROM cs WHERE c) GROUP BY doc_id, g)"""


@register("line_comment_metrics", f"WITH {_LINES} SELECT doc_id, count(*) FILTER (c)::INTEGER AS comment_lines, count(*) FILTER (NOT c AND NOT blank)::INTEGER AS code_lines, coalesce((SELECT max(n) FROM runs r WHERE r.doc_id = cs.doc_id), 0)::INTEGER AS max_block FROM cs GROUP BY doc_id")
def line_comment_metrics(spark, sf_dir):
    """Texts in which lines that begin with A to D are made comments and other slashes taken out."""
    marked = F.regexp_replace("text", r"(^|\n)([A-D])", "$1\u0001 $2")
    text = F.replace(F.replace(marked, F.lit("/"), F.lit("|")), F.lit("\u0001"), F.lit("//"))
    return structure.measure(docs(spark, sf_dir).select("doc_id", text.alias("text")), "doc_id", "text", F.lit("Go")).select("doc_id", "comment_lines", "code_lines", "max_block")


@register("line_structural_chunks", f"""WITH {_LINES}, m AS (SELECT doc_id, count(*) FILTER (c)::INTEGER AS comment_lines, count(*) FILTER (NOT c AND NOT blank)::INTEGER AS code_lines, coalesce((SELECT max(n) FROM runs r WHERE r.doc_id = cs.doc_id), 0)::INTEGER AS max_block FROM cs GROUP BY doc_id)
SELECT doc_id, max_block, round(comment_lines / (comment_lines + code_lines), 6) AS ratio FROM m WHERE comment_lines + code_lines >= 4 AND comment_lines / (comment_lines + code_lines) >= 0.1 AND max_block >= 1 ORDER BY comment_lines / (comment_lines + code_lines) DESC, max_block DESC, doc_id LIMIT 50""")
def line_structural_chunks(spark, sf_dir):
    m = line_comment_metrics(spark, sf_dir).withColumn("comment_ratio", F.col("comment_lines") / F.nullif(F.col("comment_lines") + F.col("code_lines"), F.lit(0)))
    return structure.structural(m, "doc_id", 0.1, 1, lines=4).select("doc_id", "max_block", F.round("comment_ratio", 6).alias("ratio"))


@register("regex_audit_limit", "SELECT doc_id, pattern, n FROM (SELECT doc_id, 1 AS p, 'first' AS pattern, len(regexp_extract_all(text, '(?m)^[A-Z]'))::INTEGER AS n FROM documents UNION ALL SELECT doc_id, 2, 'last', len(regexp_extract_all(text, '(?m)e$'))::INTEGER FROM documents) WHERE n > 0 ORDER BY doc_id, p LIMIT 50")
def regex_audit_limit(spark, sf_dir):
    return structure.audit(docs(spark, sf_dir), "doc_id", "text", {"first": "^[A-Z]", "last": "e$"}, 50)


# Changes (W1-W25).


def _repo_news(spark, sf_dir) -> DataFrame:
    r = repos(spark, sf_dir).where("repo_id < 'src5'")
    n = F.substring("repo_id", 4, 9).cast("int")
    return r.withColumns({"repo_identifier": F.when(n % 3 == 0, "new/id"), "embedding_model": F.when(n % 3 == 1, "model-b"), "embedding_dimensions": F.when(n % 4 == 0, 16).when(n % 4 == 1, 0), "parent_repo_id": F.lit(None).cast("string"), "name": F.upper("name")})


@register("upsert_repos", f"""WITH {_REPOS}, n AS (SELECT repo_id, upper(name) AS name, substring(repo_id, 4, 9)::INTEGER AS k FROM repos WHERE repo_id < 'src5')
SELECT o.repo_id, coalesce(n.name, o.name) AS name, CASE WHEN n.k % 3 = 0 THEN 'new/id' ELSE o.repo_identifier END AS repo_identifier, CASE WHEN n.k % 3 = 1 THEN 'model-b' ELSE o.embedding_model END AS embedding_model,
CASE WHEN n.k % 4 = 0 THEN 16 ELSE o.embedding_dimensions END AS embedding_dimensions, CASE WHEN n.k IS NULL THEN o.parent_repo_id END AS parent_repo_id FROM repos o LEFT JOIN n USING (repo_id)""")
def upsert_repos(spark, sf_dir):
    return store.upsert_repos(repos(spark, sf_dir), _repo_news(spark, sf_dir)).select("repo_id", "name", "repo_identifier", "embedding_model", "embedding_dimensions", "parent_repo_id")


@register("upsert_chunks", f"WITH {_CHUNKS}, {_ANALYSED} SELECT chunk_id, tokens, CASE WHEN file_id % 2 = 0 THEN NULL ELSE enriched_at END AS enriched_at FROM analysed")
def upsert_chunks(spark, sf_dir):
    own = analysed(spark, sf_dir)
    return store.upsert_chunks(own, own.where("file_id % 2 = 0")).select("chunk_id", "tokens", "enriched_at")


@register("upsert_embeddings", f"WITH {_CHUNKS}, {_EMBEDDED} SELECT chunk_id, CASE WHEN chunk_id % 2 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embedded")
def upsert_embeddings(spark, sf_dir):
    own = embedded(spark, sf_dir)
    return store.upsert_embeddings(own, own.where("chunk_id % 2 = 0").select("chunk_id", F.reverse("embedding").alias("embedding")), 8)


@register("upsert_cache_last", 'SELECT text_hash, "at", lang FROM (SELECT sha256(text) AS text_hash, doc_id AS "at", lang, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE WHEN lang = \'en\' THEN 0 ELSE 1 END, doc_id DESC) AS r FROM documents) WHERE r = 1')
def upsert_cache_last(spark, sf_dir):
    own = docs(spark, sf_dir).select(F.sha2("text", 256).alias("text_hash"), F.col("doc_id").alias("at"), "lang")
    old = store.last_wins(own.where("lang != 'en'"), ["text_hash"], ["at"])
    return store.upsert_cache(old, own.where("lang = 'en'"))


@register("insert_refs", f"WITH {_REFS} SELECT * FROM refs")
def insert_refs(spark, sf_dir):
    r = references(spark, sf_dir)
    return store.insert_rows(r.where("kind = 'type'"), r.where("kind != 'conform'").union(r.where("kind = 'conform'")).union(r.withColumn("name", F.lit(""))), ["name"])


@register("delete_repo", f"WITH {_REPOS}, {_FILES}, {_CHUNKS} SELECT 'repos' AS name, count(*) AS n FROM repos WHERE repo_id <> 'src1' UNION ALL SELECT 'files', count(*) FROM files WHERE repo_id <> 'src1' UNION ALL SELECT 'chunks', count(*) FROM chunks JOIN files USING (file_id) WHERE repo_id <> 'src1' UNION ALL SELECT 'embeddings', count(*) FROM chunks JOIN files USING (file_id) WHERE repo_id <> 'src1'")
def delete_repo(spark, sf_dir):
    tables = {"repos": repos(spark, sf_dir), "files": files(spark, sf_dir), "chunks": chunks(spark, sf_dir), "embeddings": embedded(spark, sf_dir)}
    return A.table_counts(**store.delete_repo(tables, F.col("repo_id") == "src1"))


@register("delete_dangling", f"WITH {_FILES}, {_CHUNKS} SELECT 'before_chunks' AS name, count(*) AS n FROM chunks JOIN files USING (file_id) WHERE language = 'en' UNION ALL SELECT 'chunks', count(*) FROM chunks JOIN files USING (file_id) WHERE language <> 'en' UNION ALL SELECT 'embeddings', count(*) FROM chunks JOIN files USING (file_id) WHERE language <> 'en'")
def delete_dangling(spark, sf_dir):
    c, e, before = store.delete_dangling(files(spark, sf_dir).where("language != 'en'"), chunks(spark, sf_dir), embedded(spark, sf_dir))
    return A.table_counts(chunks=c, embeddings=e).union(before.select(F.lit("before_chunks"), "chunks"))


@register("policy_purge", f"WITH {_FILES}, {_CHUNKS} SELECT path, count(chunk_id) AS chunks FROM files LEFT JOIN chunks USING (file_id) WHERE regexp_matches(path, '7\\.txt$') GROUP BY path")
def policy_purge(spark, sf_dir):
    return store.purge({"files": files(spark, sf_dir), "chunks": chunks(spark, sf_dir), "embeddings": embedded(spark, sf_dir)}, r"7\.txt$")[1]


@register("policy_audit", f"WITH {_FILES} SELECT path FROM files WHERE regexp_matches(path, '7\\.txt$')")
def policy_audit(spark, sf_dir):
    return store.refused(files(spark, sf_dir), r"7\.txt$").select("path")


@register("clear_cache", "SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def clear_cache(spark, sf_dir):
    return store.clear(docs(spark, sf_dir).select(F.sha2("text", 256)).distinct())[1]


@register("update_analysis", f"""WITH {_CHUNKS}, {_ANALYSED} SELECT chunk_id, CASE WHEN chunk_id % 3 = 0 THEN 'new' ELSE summary END AS summary, CASE WHEN chunk_id % 3 = 0 THEN CASE WHEN chunk_id % 2 = 0 THEN '{A.FAILED}' ELSE 'model-n' END ELSE analyzer_model END AS analyzer_model, CASE WHEN chunk_id % 3 = 0 THEN NULL ELSE enriched_at END AS enriched_at FROM analysed""")
def update_analysis(spark, sf_dir):
    return _updated(spark, sf_dir)["chunks"].select("chunk_id", "summary", "analyzer_model", "enriched_at")


def _updated(spark, sf_dir):
    own = analysed(spark, sf_dir)
    new = own.where("chunk_id % 3 = 0").select("chunk_id", F.lit("new").alias("summary"), F.array(F.lit("t")).alias("tags"), F.when(F.col("chunk_id") % 2 == 0, A.FAILED).otherwise("model-n").alias("analyzer_model"), F.col("chunk_id").alias("analyzed_at"))
    analyses = own.where("analyzer_model IS NOT NULL").select("chunk_id", "analyzer_model", "summary")
    cache = own.where("analyzer_model LIKE 'model%'").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.max("summary").alias("summary"), F.lit("model-o").alias("analyzer_model"), F.lit(-1).cast("long").alias("at"))
    return store.update_analysis(own, analyses, cache, new)


@register("update_analysis_cache", f"""WITH {_CHUNKS}, {_ANALYSED}, o AS (SELECT DISTINCT sha256(text) AS text_hash FROM analysed WHERE analyzer_model LIKE 'model%'), n AS (SELECT sha256(text) AS text_hash, max(chunk_id) AS at FROM analysed WHERE chunk_id % 3 = 0 AND chunk_id % 2 = 1 GROUP BY 1)
SELECT coalesce(n.text_hash, o.text_hash) AS text_hash, coalesce(n.at, -1) AS at, CASE WHEN n.at IS NULL THEN 'model-o' ELSE 'model-n' END AS analyzer_model FROM o FULL JOIN n ON o.text_hash = n.text_hash""")
def update_analysis_cache(spark, sf_dir):
    return _updated(spark, sf_dir)["cache"].select("text_hash", "at", "analyzer_model")


@register("clear_analysis", f"WITH {_CHUNKS}, {_ANALYSED}, {_FILES} SELECT chunk_id, CASE WHEN repo_id <> 'src1' THEN summary END AS summary, CASE WHEN repo_id <> 'src1' THEN analyzer_model END AS analyzer_model FROM analysed JOIN files USING (file_id)")
def clear_analysis(spark, sf_dir):
    own = analysed(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "repo_id"), "file_id")
    return store.clear_analysis(own, F.col("repo_id") == "src1").select("chunk_id", "summary", "analyzer_model")


@register("import_overlay", f"WITH {_CHUNKS}, {_ANALYSED} SELECT chunk_id, analyzer_model, CASE WHEN chunk_id % 4 = 2 THEN 'theirs' ELSE summary END AS summary, CASE WHEN chunk_id % 4 = 2 THEN 'overlay' ELSE 'own' END AS source FROM analysed WHERE analyzer_model IS NOT NULL UNION ALL SELECT chunk_id, 'model-2', 'theirs', 'overlay' FROM analysed WHERE chunk_id % 4 = 3")
def import_overlay(spark, sf_dir):
    own = analysed(spark, sf_dir).where("analyzer_model IS NOT NULL").select("chunk_id", "analyzer_model", "summary", F.lit("own").alias("source"))
    return store.import_overlay(own, own.where("chunk_id % 4 > 1").select("chunk_id", F.lit("model-2").alias("analyzer_model"), F.lit("theirs").alias("summary")), "overlay")


def lessons(spark, sf_dir) -> DataFrame:
    t = _t(spark, sf_dir, "conversations")
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    return t.select(id_.alias("id"), F.col("text").alias("error_signature"), F.when(F.col("turn") % 3 != 0, F.col("role")).alias("file_pattern"), (F.col("turn") % 5 != 0).alias("is_active"), (1 - F.col("turn") % 4 / 10).alias("confidence"), F.lit(0).alias("apply_count"), F.col("turn").cast("int").alias("success_count"), F.col("conv_id").alias("updated_at"), F.concat(F.lit("o"), (F.col("conv_id") % 9).cast("string")).alias("source_learning_id"))


_LESSONS = "lessons AS (SELECT conv_id * 1000 + turn AS id, text AS error_signature, CASE WHEN turn % 3 <> 0 THEN role END AS file_pattern, turn % 5 <> 0 AS is_active, 1 - (turn % 4)::DOUBLE / 10 AS confidence, 0 AS apply_count, turn::INTEGER AS success_count, conv_id AS updated_at, 'o' || conv_id % 9 AS source_learning_id FROM conversations)"


@register("lessons_query", f"WITH {_LESSONS} SELECT id, file_pattern FROM lessons WHERE is_active AND error_signature ILIKE '%LA%' AND (file_pattern IS NULL OR file_pattern ILIKE '%USER%') ORDER BY confidence DESC, success_count DESC, id LIMIT 10")
def lessons_query(spark, sf_dir):
    return search.match_lessons(lessons(spark, sf_dir), "LA", "USER").select("id", "file_pattern")


@register("lessons_list", f"WITH {_LESSONS} SELECT id, is_active FROM lessons WHERE is_active ORDER BY updated_at DESC, id LIMIT 50")
def lessons_list(spark, sf_dir):
    return search.list_lessons(lessons(spark, sf_dir)).select("id", "is_active")


@register("lessons_get", f"WITH {_LESSONS} SELECT * FROM lessons WHERE id = 1000")
def lessons_get(spark, sf_dir):
    return search.get_lesson(lessons(spark, sf_dir), 1000)


@register("lessons_changed", f"""WITH {_LESSONS}, base AS (SELECT id, is_active, confidence FROM lessons WHERE source_learning_id <> 'o3' UNION ALL SELECT -1 - id, true, 1.0::DOUBLE FROM lessons WHERE id % 1000 = 1)
SELECT id, is_active AND id % 1000 <> 2 AS is_active, CASE WHEN id % 1000 = 2 THEN 0.5 ELSE confidence END AS confidence FROM base""")
def lessons_changed(spark, sf_dir):
    own = lessons(spark, sf_dir)
    left, _ = store.delete_lessons(own, F.col("source_learning_id") == "o3")
    added = store.add_lesson(left, own.where("id % 1000 = 1").select((-1 - F.col("id")).alias("id"), "error_signature"))
    return store.update_lesson(added, F.col("id") % 1000 == 2, is_active=F.lit(False), confidence=F.lit(0.5), file_pattern=F.lit(None).cast("string")).select("id", "is_active", "confidence")


@register("lessons_deleted", f"WITH {_LESSONS} SELECT count(*) AS n FROM lessons WHERE source_learning_id = 'o3'")
def lessons_deleted(spark, sf_dir):
    return store.delete_lessons(lessons(spark, sf_dir), F.col("source_learning_id") == "o3")[1]


@register("hints_appended", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT event_type FROM events WHERE value > 50) GROUP BY event_type")
def hints_appended(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return store.add_hint(e, e.where("value > 50")).groupBy("event_type").agg(F.count("*").alias("n"))


@register("analyzer_pins", f"WITH {_REPOS} SELECT repo_id, CASE WHEN repo_id = 'src1' THEN 'model-x' WHEN repo_id = 'src2' THEN NULL ELSE nullif(trim(analyzer_pin), '') END AS pin FROM repos")
def analyzer_pins(spark, sf_dir):
    own = store.set_pin(store.set_pin(repos(spark, sf_dir), F.col("repo_id") == "src1", "  model-x "), F.col("repo_id") == "src2", "   ")
    return store.read_pin(own, F.lit(True))


@register("reconcile_names", f"WITH {_REPOS} SELECT repo_id, CASE WHEN parent_repo_id IS NULL AND repo_id <> 'src1' THEN repo_id ELSE name END AS name FROM repos")
def reconcile_names(spark, sf_dir):
    r = repos(spark, sf_dir)
    return store.reconcile_names(r, r.where("repo_id != 'src1'").select("root_path")).select("repo_id", "name")


@register("remap_root", f"WITH {_REPOS} SELECT repo_id, CASE WHEN repo_id = 'src1' THEN '/moved/src1' ELSE root_path END AS root_path FROM repos")
def remap_root(spark, sf_dir):
    return store.remap_root(repos(spark, sf_dir), "src1", "/moved/src1", True).select("repo_id", "root_path")


@register("resolve_repo", f"WITH {_REPOS} SELECT repo_id FROM repos WHERE repo_identifier = 'host/x/src2'")
def resolve_repo(spark, sf_dir):
    return store.resolve_repo(repos(spark, sf_dir), "/other/place", "host/x/src2").select("repo_id")


@register("dims_backfill", f"WITH {_REPOS} SELECT repo_id, 8 AS embedding_dimensions, embedding_model FROM repos")
def dims_backfill(spark, sf_dir):
    own = A.dimensions_by_repo(repos(spark, sf_dir), files(spark, sf_dir), chunks(spark, sf_dir), embedded(spark, sf_dir))
    return A.model_by_dimensions(own).select("repo_id", "embedding_dimensions", "embedding_model")


@register("vector_sync", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def vector_sync(spark, sf_dir):
    t = _t(spark, sf_dir, "embeddings")
    return knn.sync(t.where("vec_id % 2 = 0"), t.union(t.withColumn("vec_id", -1 - F.col("vec_id")).withColumn("embedding", F.slice("embedding", 1, 3))), 64).select("vec_id", "label")


@register("structure_backfill", "SELECT 0::BIGINT AS measured, least(count(*), 5000) AS unmeasurable, greatest(0, count(*) - 5000) AS remaining FROM documents")
def structure_backfill(spark, sf_dir):
    own = docs(spark, sf_dir).select("doc_id", "text", "lang", F.lit(None).cast("int").alias("comment_lines"))
    return structure.backfill(own, "doc_id", "text", "lang")[1]


# Joins and searches.


@register("star_join", f"WITH {_REPOS}, {_FILES}, {_CHUNKS}, {_EMBEDDED} SELECT r.name, language, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, sum(len(embedding))::BIGINT AS numbers FROM embedded JOIN chunks USING (chunk_id) JOIN files USING (file_id) JOIN repos r USING (repo_id) GROUP BY 1, 2")
def star_join(spark, sf_dir):
    own = embedded(spark, sf_dir).join(chunks(spark, sf_dir), "chunk_id").join(files(spark, sf_dir), "file_id").join(repos(spark, sf_dir), "repo_id")
    return own.groupBy("name", "language").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.sum(F.size("embedding")).cast("long").alias("numbers"))


@register("chunk_search", f"WITH {_REPOS}, {_FILES}, {_CHUNKS}, {_ANALYSED} SELECT chunk_id, root_path || '/' || path AS path FROM analysed JOIN files USING (file_id) JOIN repos USING (repo_id) WHERE (text ILIKE '%la%' OR construct_name ILIKE '%la%' OR summary ILIKE '%la%') AND (text ILIKE '%thing1%' OR construct_name ILIKE '%thing1%' OR summary ILIKE '%thing1%') AND contains(lower(language), 'fr') ORDER BY files.path, start_line, chunk_id LIMIT 10")
def chunk_search(spark, sf_dir):
    f = files(spark, sf_dir).withColumn("module_path", T.module_path(F.col("path")))
    return search.search_chunks(analysed(spark, sf_dir), f, repos(spark, sf_dir), "LA thing1", module="FR").select("chunk_id", "path")


_HIT_DIST = "1 - list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q))"
_QUERY = f"q AS (SELECT {_vector_sql(chr(39) + 'hello' + chr(39))}::DOUBLE[] AS q)"


@register("search_by_text", f"WITH {_REPOS}, {_FILES}, {_CHUNKS}, {_EMBEDDED}, {_QUERY}, h AS (SELECT chunk_id, {_HIT_DIST} AS d FROM embedded, q ORDER BY d, chunk_id LIMIT 10) SELECT chunk_id, root_path || '/' || path AS path, round(greatest(0, 1 - d), 6) AS similarity FROM h JOIN chunks USING (chunk_id) JOIN files USING (file_id) JOIN repos USING (repo_id) WHERE greatest(0, 1 - d) >= 0.3")
def search_by_text(spark, sf_dir):
    hits = providers.search_text(embedded(spark, sf_dir), "hello", _HASHED, knn.search, k=10, key="chunk_id", threshold=0.3)
    return knn.with_sources(hits, chunks(spark, sf_dir), files(spark, sf_dir), repos(spark, sf_dir)).select("chunk_id", "path", F.round("similarity", 6).alias("similarity"))


_E0 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


@register("search_scalar_filtered", f"WITH {_E0}, h AS (SELECT vec_id, {_HIT_DIST} AS d FROM embeddings, q WHERE label <> 1 ORDER BY d, vec_id LIMIT 10) SELECT vec_id, round(1 - d, 6) AS similarity FROM (SELECT * FROM h WHERE greatest(0, 1 - d) >= 0.1 ORDER BY d, vec_id LIMIT 5)")
def search_scalar_filtered(spark, sf_dir):
    t = _t(spark, sf_dir, "embeddings")
    return knn.scalar_search(t, knn.vector_of(t, 0), 5, 0.1, F.col("label") != 1).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("search_brute_force", f"WITH {_E0}, h AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], q) / sqrt(greatest(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q), 1e-6)) AS s FROM embeddings, q) SELECT vec_id, round(s, 6) AS similarity FROM h WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 10")
def search_brute_force(spark, sf_dir):
    t = _t(spark, sf_dir, "embeddings")
    return knn.brute_force(t, knn.vector_of(t, 0), 10, 0.2).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("similar_code", f"WITH {_E0}, h AS (SELECT vec_id, {_HIT_DIST} AS d FROM embeddings, q WHERE NOT vec_id < 5 ORDER BY d, vec_id LIMIT 20) SELECT vec_id, round(greatest(0, 1 - d), 6) AS similarity FROM (SELECT * FROM h WHERE greatest(0, 1 - d) >= 0.15 ORDER BY d, vec_id LIMIT 10)")
def similar_code(spark, sf_dir):
    t = _t(spark, sf_dir, "embeddings")
    return knn.similar(t, knn.vector_of(t, 0), 10, 0.15, F.col("vec_id") < 5).select("vec_id", F.round("similarity", 6).alias("similarity"))


@register("vec_distances", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS l2, round(list_sum(list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i]::DOUBLE - embedding[len(embedding) + 1 - i]::DOUBLE))), 6) AS l1, round(list_cosine_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS cosine FROM embeddings")
def vec_distances(spark, sf_dir):
    a, b = F.col("embedding"), F.reverse("embedding")
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.round(V.vec_distance_l2(a, b), 6).alias("l2"), F.round(V.vec_distance_l1(a, b), 6).alias("l1"), F.round(V.vec_distance_cosine(a, b), 6).alias("cosine"))


@register("vec_int8_sums", "WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: trunc(greatest(-128.0, least(127.0, (x::DOUBLE + 1) / (2.0::DOUBLE / 255.0::DOUBLE) - 128)))::INTEGER) AS v FROM embeddings) SELECT vec_id, list_transform(v, lambda x: ((2 * x + 384) % 256 - 128)::TINYINT) AS doubled, list_sum(list_transform(generate_series(1, len(v)), lambda i: abs(v[i] - v[len(v) + 1 - i])))::BIGINT AS l1 FROM t")
def vec_int8_sums(spark, sf_dir):
    own = _t(spark, sf_dir, "embeddings").select("vec_id", V.vec_quantize_int8("embedding").alias("v"))
    return own.select("vec_id", V.vec_add("v", "v", "int8").alias("doubled"), V.vec_distance_l1("v", F.reverse("v"), "int8").alias("l1"))


@register("vec_blob", "SELECT vec_id, 4 * len(embedding)::INTEGER AS bytes, embedding AS v FROM embeddings")
def vec_blob(spark, sf_dir):
    own = _t(spark, sf_dir, "embeddings").select("vec_id", V.encode_vector("embedding").alias("b"))
    return own.select("vec_id", F.octet_length("b").alias("bytes"), V.decode_vector("b").alias("v"))


# Symbols and dependencies.


@register("symbol_definitions", f"WITH {_DEFS} SELECT * FROM defs")
def symbol_definitions(spark, sf_dir):
    return definitions(spark, sf_dir)


@register("symbol_references", f"WITH {_REFS} SELECT * FROM refs")
def symbol_references(spark, sf_dir):
    return references(spark, sf_dir)


@register("find_definitions", f"WITH {_DEFS}, {_FILES} SELECT repo_id, path, kind, start_line FROM defs JOIN files USING (file_id) WHERE name = 'Brand#2' AND kind = 'class' ORDER BY repo_id, path, start_line, kind LIMIT 100")
def find_definitions(spark, sf_dir):
    return graph.find_symbols(definitions(spark, sf_dir), files(spark, sf_dir), "Brand#2", kind="class").select("repo_id", "path", "kind", "start_line")


@register("find_references", f"WITH {_REFS}, {_FILES} SELECT repo_id, path, kind FROM refs JOIN files USING (file_id) WHERE name = 'Brand#2' AND language = 'en' ORDER BY repo_id, path, kind LIMIT 100")
def find_references(spark, sf_dir):
    return graph.find_symbols(references(spark, sf_dir), files(spark, sf_dir), "Brand#2", language="EN").select("repo_id", "path", "kind")


@register("definition_counts", f"WITH {_DEFS}, {_FILES} SELECT name, count(*) AS n FROM defs JOIN files USING (file_id) WHERE kind = 'class' AND language = 'en' GROUP BY name")
def definition_counts(spark, sf_dir):
    return graph.symbol_counts(definitions(spark, sf_dir), files(spark, sf_dir), "class", "en")


@register("file_dependencies", f"WITH {_LINKS}, {_FILES} SELECT l.kind, l.target, t.path AS reached FROM links l JOIN files s ON s.file_id = l.source LEFT JOIN files t ON t.file_id = l.target_file WHERE s.path = 'doc_7.txt' OR suffix(s.path, '/doc_7.txt')")
def file_dependencies(spark, sf_dir):
    return graph.dependencies_of(links(spark, sf_dir), files(spark, sf_dir), "doc_7.txt").select("kind", "target", "reached")


@register("file_dependents", f"WITH {_LINKS}, {_FILES} SELECT s.path AS source_path, l.target, l.kind FROM links l JOIN files s ON s.file_id = l.source WHERE l.target_file IN (SELECT file_id FROM files WHERE path = 'doc_8' OR suffix(path, '/doc_8')) OR l.target = 'doc_8' OR suffix(l.target, '/doc_8')")
def file_dependents(spark, sf_dir):
    return graph.dependents_of(links(spark, sf_dir), files(spark, sf_dir), "doc_8").select("source_path", "target", "kind")


@register("dependency_edges", f"WITH {_LINKS}, {_FILES} SELECT s.path AS source_path, t.path AS target_path, l.kind FROM links l JOIN files s ON s.file_id = l.source LEFT JOIN files t ON t.file_id = l.target_file")
def dependency_edges(spark, sf_dir):
    return graph.edge_list(links(spark, sf_dir), files(spark, sf_dir)).select("source_path", "target_path", "kind")


@register("file_summaries", f'WITH {_LINKS}, {_FILES} SELECT file_id, path, (SELECT count(*) FROM links WHERE source = file_id) AS "out", (SELECT count(*) FROM links WHERE target_file = file_id) AS "into" FROM files')
def file_summaries(spark, sf_dir):
    return graph.file_summaries(files(spark, sf_dir), links(spark, sf_dir))


@register("find_orphans", f"""WITH {_LINKS}, {_FILES}, {_DEFS}, {_REFS} SELECT file_id, path, lines, (SELECT count(*) FROM defs d WHERE d.file_id = f.file_id) AS symbols, (SELECT coalesce(array_to_string(list_sort(list(DISTINCT name))[1:5], ', '), '') FROM defs d WHERE d.file_id = f.file_id) AS names FROM files f
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.target_file = f.file_id) AND NOT EXISTS (SELECT 1 FROM refs r JOIN defs d ON d.name = r.name WHERE d.file_id = f.file_id AND r.file_id <> f.file_id) AND NOT suffix(path, '_test.ts') ORDER BY lines DESC, file_id LIMIT 50""")
def find_orphans(spark, sf_dir):
    return graph.unreferenced(files(spark, sf_dir), links(spark, sf_dir), definitions(spark, sf_dir), references(spark, sf_dir))


@register("resolve_suffixes", f"""WITH {_FILES}, i AS (SELECT file_id, unnest(['doc_' || (file_id + 1), 'nowhere']) AS cand, generate_subscripts(['', ''], 1) AS pos FROM files),
m AS (SELECT i.file_id, pos, min(f.path) AS target FROM i JOIN files f ON f.path = cand OR suffix(f.path, '/' || cand) OR regexp_matches(f.path, '/' || cand || '\\.') GROUP BY 1, 2)
SELECT f.file_id, (SELECT min_by(target, pos) FROM m WHERE m.file_id = f.file_id) AS target FROM files f""")
def resolve_suffixes(spark, sf_dir):
    f = files(spark, sf_dir)
    wanted = F.array(F.concat(F.lit("doc_"), (F.col("file_id") + 1).cast("string")), F.lit("nowhere"))
    return graph.resolve_imports(f.select("file_id", wanted.alias("c")), f, "c", "file_id")


@register("import_kinds", f"WITH {_FILES} SELECT file_id, CASE language WHEN 'en' THEN 'framework' WHEN 'fr' THEN CASE WHEN file_id % 2 = 0 THEN 'inherit' ELSE 'require' END ELSE 'import' END AS kind FROM files")
def import_kinds(spark, sf_dir):
    lang = F.when(F.col("language") == "en", "Swift").when(F.col("language") == "fr", "Ruby").otherwise("TypeScript")
    return files(spark, sf_dir).select("file_id", T.import_kind(F.when(F.col("file_id") % 2 == 0, "A::B").otherwise("./a"), lang).alias("kind"))


# Providers (U5, U6, U8-U11, L11) and text rules.


@register("embed_missing", f"WITH {_CHUNKS} SELECT DISTINCT sha256(text) AS text_hash, {_vector_sql('text')} AS embedding FROM chunks WHERE sha256(text) NOT IN (SELECT sha256(text) FROM chunks WHERE file_id % 2 = 0)")
def embed_missing(spark, sf_dir):
    c = chunks(spark, sf_dir)
    cache = c.where("file_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"), F.lit(None).cast("array<float>").alias("embedding")).distinct()
    return providers.embed_missing(c, cache, _HASHED)


@register("embed_chunks", f"WITH {_CHUNKS}, {_EMBEDDED} SELECT chunk_id, embedding FROM embedded")
def embed_chunks(spark, sf_dir):
    c = chunks(spark, sf_dir)
    cache = c.where("file_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"), _HASHED.embed(F.col("text")).alias("embedding")).distinct()
    return providers.embed_chunks(c, cache, _HASHED)[0]


@register("analyze_chunks", f"""WITH {_CHUNKS}, {_ANALYSED}, o AS (SELECT * FROM analysed WHERE analyzer_model IS NULL OR analyzer_model = '{A.FAILED}' ORDER BY chunk_id LIMIT 100)
SELECT chunk_id, CASE WHEN contains(text, 'q') THEN '{store.FAILED_SUMMARY}' ELSE substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 60) END AS summary, CASE WHEN contains(text, 'q') THEN '{A.FAILED}' ELSE 'rules' END AS analyzer_model FROM o""")
def analyze_chunks(spark, sf_dir):
    return providers.analyze_chunks(analysed(spark, sf_dir), providers.RuleAnalyzer(fails="q")).select("chunk_id", "summary", "analyzer_model")


@register("enrich_embeddings", f"WITH {_CHUNKS}, {_ANALYSED}, o AS (SELECT * FROM analysed WHERE analyzer_model = 'model-2' ORDER BY chunk_id LIMIT 500) SELECT chunk_id, {_vector_sql('text || chr(10) || chr(10) || ' + chr(39) + '// AI Summary: ' + chr(39) + ' || summary')} AS embedding FROM o")
def enrich_embeddings(spark, sf_dir):
    return providers.enrich_embeddings(analysed(spark, sf_dir), _HASHED)


@register("analysis_carry_over", f"""WITH {_CHUNKS}, {_ANALYSED}, h AS (SELECT sha256(text) AS h, max_by(summary, analyzed_at * 100000000000 + chunk_id) AS summary, max_by(analyzer_model, analyzed_at * 100000000000 + chunk_id) AS analyzer_model FROM analysed WHERE analyzer_model LIKE 'model%' GROUP BY 1)
SELECT c.chunk_id, h.summary, h.analyzer_model FROM chunks c LEFT JOIN h ON h.h = sha256(c.text)""")
def analysis_carry_over(spark, sf_dir):
    return providers.carry_over(analysed(spark, sf_dir), chunks(spark, sf_dir)).select("chunk_id", "summary", "analyzer_model")


@register("file_tags", f"""WITH {_FILES} SELECT file_id, list_sort(list_distinct(list_concat(['rag', 'agent', language], CASE WHEN file_id % 2 = 0 THEN ['uikit', 'glimmer'] ELSE [] END))) AS tags FROM files""")
def file_tags(spark, sf_dir):
    meta = T.metadata(F.when(F.col("file_id") % 2 == 0, F.lit('{"frameworks": ["UIKit"], "hasTemplate": true}')).otherwise(F.lit("no json")))
    path = F.concat(F.lit("Rag/Agents/x"), F.col("file_id").cast("string"))
    return files(spark, sf_dir).select("file_id", T.file_tags(path, F.upper("language"), F.array(meta)).alias("tags"))


@register("metadata_fields", "SELECT event_id, ['k' || (event_id % 3)] AS imports, event_id % 2 = 0 AS has FROM events")
def metadata_fields(spark, sf_dir):
    text = F.concat(F.lit('{"imports": ["k'), (F.col("event_id") % 3).cast("string"), F.lit('"], "hasTemplate": '), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}"))
    return _t(spark, sf_dir, "events").select("event_id", T.metadata(text).alias("m")).select("event_id", "m.imports", F.col("m.hasTemplate").alias("has"))


@register("symbol_kinds", "SELECT p_partkey, ['class', 'method', NULL, 'struct', 'enum'][p_size % 5 + 1] AS kind FROM part")
def symbol_kinds(spark, sf_dir):
    own = F.element_at(F.array(*[F.lit(x) for x in (" ClassDecl", "method", "comment", "STRUCT", "enumDecl ")]), F.col("p_size") % 5 + 1)
    return _t(spark, sf_dir, "part").select("p_partkey", T.symbol_kind(own, True).alias("kind"))


@register("text_for_embedding", "SELECT doc_id, length(substring(text, 1, 8000))::INTEGER AS long, length(substring(text, 1, 2000))::INTEGER AS short FROM documents")
def text_for_embedding(spark, sf_dir):
    own = F.col("text")
    return docs(spark, sf_dir).select("doc_id", F.length(T.for_embedding(own, "qwen3-embedding:0.6b")).alias("long"), F.length(T.for_embedding(own, "nomic-embed-text")).alias("short"))


@register("clean_reply", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'sum ' || event_id ELSE 'plain ' || event_id END AS reply FROM events")
def clean_reply(spark, sf_dir):
    n = F.col("event_id").cast("string")
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('<think>a\nb</think>```json\n{"summary": "sum '), n, F.lit('"}\n```'))).otherwise(F.concat(F.lit("<think>x</think> plain "), n))
    return _t(spark, sf_dir, "events").select("event_id", T.clean_reply(reply).alias("reply"))


@register("packed_lists", "SELECT user_id, list(value ORDER BY event_id) AS vals FROM events GROUP BY user_id")
def packed_lists(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("user_id").agg(T.packed_list(F.col("event_id"), F.col("value")).alias("l")).select("user_id", F.col("l.value").alias("vals"))


@register("safe_division", "SELECT event_id, value / nullif(event_id % 3, 0) AS share FROM events")
def safe_division(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.try_divide("value", F.col("event_id") % 3).alias("share"))


@register("file_hashes", f"SELECT doc_id, sha256('{chunking.SIGNATURE}:' || text) AS hash FROM documents")
def file_hashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", chunking.file_hash(F.col("text")).alias("hash"))


@register("hybrid_chunks", f"WITH {_FILES} SELECT path, count(*) AS n FROM files WHERE lines <= 120 GROUP BY path")
def hybrid_chunks(spark, sf_dir):
    """Files of up to 120 lines, which no tree cuts, are a chunk each."""
    f = files(spark, sf_dir).join(docs(spark, sf_dir).select(F.col("doc_id").alias("file_id"), "text"), "file_id")
    return chunking.hybrid(f).groupBy("path").agg(F.count("*").alias("n")).join(f.where("lines <= 120").select("path"), "path")


@register("delete_prefix_count", f"WITH {_FILES}, {_CHUNKS} SELECT 'files' AS name, count(*) AS n FROM files WHERE NOT starts_with(path, 'en/') UNION ALL SELECT 'chunks', count(*) FROM chunks JOIN files USING (file_id) WHERE NOT starts_with(path, 'en/') UNION ALL SELECT 'gone', count(*) FROM files WHERE starts_with(path, 'en/')")
def delete_prefix_count(spark, sf_dir):
    f = files(spark, sf_dir)
    gone = f.join(merge.delete_under(f, "path", ["en/", " "]).select("file_id"), "file_id", "left_anti")
    left, n = store.delete_files({"files": f, "chunks": chunks(spark, sf_dir)}, gone)
    return A.table_counts(**left).union(n.select(F.lit("gone"), "files"))
