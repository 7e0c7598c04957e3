"""Queries over documents and pages seen as files and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, merge, search, structure
from ..operators import analytics as A

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return add


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs(spark, sf_dir).withColumn("path", path)


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when(F.col("n_chars") >= 2000, "long").otherwise("short")
    return docs(spark, sf_dir).withColumn("tags", F.array("lang", "source", size))


_PATH = "source || '/' || lang || '/doc_' || doc_id::VARCHAR || '.txt'"
_FILES = f"files AS (SELECT *, {_PATH} AS path FROM documents)"
_TAGGED = "tagged AS (SELECT *, [lang, source, CASE WHEN n_chars >= 2000 THEN 'long' ELSE 'short' END] AS tags FROM documents)"

for _all, _name in ((True, "text_search_and"), (False, "text_search_or")):
    register(_name, f"WITH {_FILES} SELECT doc_id, path FROM files WHERE text ILIKE '%license%' {'AND' if _all else 'OR'} text ILIKE '%the%' ORDER BY path LIMIT 10")(
        lambda spark, sf_dir, every=_all: search.text_search(files(spark, sf_dir), "license the", ["text"], every, 10, ["path"]).select("doc_id", "path")
    )


@register("text_search_module", f"WITH {_FILES} SELECT doc_id, path FROM files WHERE text ILIKE '%a%' AND contains(lower(path), 'src1/') ORDER BY path LIMIT 10")
def text_search_module(spark, sf_dir):
    return search.text_search(files(spark, sf_dir), "a", ["text"], True, 10, ["path"], ("path", "SRC1/")).select("doc_id", "path")


@register("tag_query_any", f"WITH {_TAGGED} SELECT doc_id, n_chars, substring(text, 1, 300) AS snippet FROM tagged WHERE list_contains(tags, 'src1') OR list_contains(tags, 'src2') ORDER BY n_chars DESC, doc_id LIMIT 30")
def tag_query_any(spark, sf_dir):
    return search.tag_search(tagged(spark, sf_dir), ["src1", "src2"], order=[F.desc("n_chars"), "doc_id"]).select("doc_id", "n_chars", T.snippet(F.col("text")).alias("snippet"))


@register("tag_query_all", f"WITH {_TAGGED} SELECT doc_id, n_chars FROM tagged WHERE list_contains(tags, 'src1') AND list_contains(tags, 'long') ORDER BY n_chars DESC, doc_id LIMIT 30")
def tag_query_all(spark, sf_dir):
    return search.tag_search(tagged(spark, sf_dir), ["src1", "long"], match_all=True, order=[F.desc("n_chars"), "doc_id"]).select("doc_id", "n_chars")


@register("tag_counts", f"WITH {_TAGGED} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM tagged) GROUP BY tag")
def tag_counts(spark, sf_dir):
    return search.tag_counts(tagged(spark, sf_dir))


_WINDOWS = """l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, l, unnest(generate_series(0, greatest(0, (ceil((len(l) - 20) / 15.0))::BIGINT))) AS k FROM l)"""


@register("chunk_fixed_windows", f"WITH {_WINDOWS} SELECT doc_id, k::INTEGER AS chunk, (k * 15 + 1)::INTEGER AS start_line, least(k * 15 + 20, len(l))::INTEGER AS end_line, sha256(array_to_string(l[k * 15 + 1 : k * 15 + 20], chr(10))) AS hash FROM w")
def chunk_fixed_windows(spark, sf_dir):
    found = chunking.fixed_windows(docs(spark, sf_dir), most=20, overlap=5)
    return found.select("doc_id", "chunk", "start_line", "end_line", F.sha2("body", 256).alias("hash"))


@register("chunk_token_counts", r"SELECT doc_id, greatest(1, len(regexp_extract_all(text, '\S+')))::INTEGER AS tokens FROM documents")
def chunk_token_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@register("chunk_semantic_boundaries")
def chunk_semantic_boundaries(spark, sf_dir):
    return chunking.semantic(docs(spark, sf_dir), "doc_id")


@register("stable_ids", "SELECT doc_id, sha256(source || ':' || lang || ':' || doc_id::VARCHAR) AS id FROM documents")
def stable_ids(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.stable_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("id"))


@register("dedup_text_hash", "SELECT sha256(text) AS text_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def dedup_text_hash(spark, sf_dir):
    return docs(spark, sf_dir).groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@register("cache_miss", "SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def cache_miss(spark, sf_dir):
    hashed = docs(spark, sf_dir).select("lang", F.sha2("text", 256).alias("text_hash"))
    return merge.changed(hashed.select("text_hash").distinct(), hashed.where("lang = 'en'"), ["text_hash"])


def _old(spark, sf_dir):
    """A snapshot with older contents and without some sources."""
    return files(spark, sf_dir).where("source != 'src3'").select("path", "lang", F.when(F.col("lang") == "en", F.lit("old")).otherwise(F.sha2("text", 256)).alias("hash"))


def _new(spark, sf_dir):
    return files(spark, sf_dir).where("source != 'src5'").select("path", F.when(F.col("lang") == "de", F.lit(None)).otherwise(F.col("lang")).alias("lang"), F.sha2("text", 256).alias("hash"))


_SNAPS = f"""{_FILES}, old AS (SELECT path, lang, CASE WHEN lang = 'en' THEN 'old' ELSE sha256(text) END AS hash FROM files WHERE source <> 'src3'),
new AS (SELECT path, CASE WHEN lang = 'de' THEN NULL ELSE lang END AS lang, sha256(text) AS hash FROM files WHERE source <> 'src5')"""


@register("incremental_changed_files", f"WITH {_SNAPS} SELECT path, lang, hash FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = new.path AND old.hash = new.hash)")
def incremental_changed_files(spark, sf_dir):
    return merge.changed(_new(spark, sf_dir), _old(spark, sf_dir), ["path", "hash"]).select("path", "lang", "hash")


@register("prune_deleted", f"WITH {_SNAPS} SELECT path, lang, hash FROM old WHERE path IN (SELECT path FROM new)")
def prune_deleted(spark, sf_dir):
    return merge.prune(_old(spark, sf_dir), _new(spark, sf_dir), "path")


@register("upsert_coalesce", f"WITH {_SNAPS} SELECT coalesce(n.path, o.path) AS path, coalesce(n.lang, o.lang) AS lang, CASE WHEN n.path IS NOT NULL THEN n.hash ELSE o.hash END AS hash FROM old o FULL JOIN new n ON o.path = n.path")
def upsert_coalesce(spark, sf_dir):
    return merge.upsert(_old(spark, sf_dir), _new(spark, sf_dir), ["path"], ["lang"])


@register("upsert_replace", f"WITH {_SNAPS} SELECT path, lang, hash FROM new UNION ALL SELECT path, lang, hash FROM old WHERE path NOT IN (SELECT path FROM new)")
def upsert_replace(spark, sf_dir):
    return merge.replace(_old(spark, sf_dir), _new(spark, sf_dir), ["path"])


@register("delete_prefix", f"WITH {_FILES} SELECT path FROM files WHERE NOT (starts_with(path, 'src1/') OR starts_with(path, 'src2/en/'))")
def delete_prefix(spark, sf_dir):
    return merge.delete_under(files(spark, sf_dir).select("path"), "path", ["src1/", "src2/en", "  "])


@register("deleted_cascade", "SELECT 'documents' AS tab, count(*) AS n FROM documents WHERE source <> 'src1' UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src1')")
def deleted_cascade(spark, sf_dir):
    d = docs(spark, sf_dir)
    gone = d.where("source = 'src1'").select("doc_id")
    left = merge.cascade({"documents": (d.select("doc_id"), "doc_id"), "labels": (spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")}, gone, "doc_id")
    return A.table_counts(**left).withColumnRenamed("name", "tab")


@register("module_path", f"WITH {_FILES} SELECT doc_id, source || '/' || lang AS module, source AS top FROM files")
def module_path(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", T.module_path(F.col("path")).alias("module"), T.directory_bucket(F.col("path"), 1).alias("top"))


@register("is_test_path", f"WITH {_FILES} SELECT doc_id, regexp_matches(lower(path || CASE WHEN doc_id % 3 = 0 THEN '_test.txt' ELSE '' END), '/tests?/|/spec/|[_-](test|spec)\\.|\\.(test|spec)\\.') AS is_test FROM files")
def is_test_path(spark, sf_dir):
    path = F.concat("path", F.when(F.col("doc_id") % 3 == 0, "_test.txt").otherwise(""))
    return files(spark, sf_dir).select("doc_id", T.is_test_path(path).alias("is_test"))


@register("sanitize_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(substring(text, 1, 10000), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t\n\r]+', ' ', 'g')) AS clean FROM documents")
def sanitize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.sanitize(F.col("text")).alias("clean"))


@register("url_normalise", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z+]+://', ''), '^[^@/]+@', ''), '^www\.', ''), '^([^/:]+):([^0-9])', '\1/\2'), '/+$', ''), '\.git$', '') AS url FROM pages")
def url_normalise(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.normalize_remote(F.col("url")).alias("url"))


_EXTENSIONS = sorted(T.LANGUAGES) + ["zzz", "bak"]
_WITH_EXTENSION = f"source || '/doc_' || doc_id || '.' || [{', '.join(repr(x) for x in _EXTENSIONS)}][doc_id % {len(_EXTENSIONS)} + 1]"


@register("language_detect", f"SELECT doc_id, CASE regexp_extract(path, '[^.]+$') {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in T.LANGUAGES.items())} ELSE upper(regexp_extract(path, '[^.]+$')) END AS language FROM (SELECT doc_id, {_WITH_EXTENSION} AS path FROM documents)")
def language_detect(spark, sf_dir):
    """Documents named in turn with every known extension and two unknown ones, in capitals now and then."""
    end = F.element_at(F.array(*[F.lit(x) for x in _EXTENSIONS]), F.pmod(F.col("doc_id"), F.lit(len(_EXTENSIONS))).cast("int") + 1)
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.when(F.col("doc_id") % 3 == 0, F.upper(end)).otherwise(end))
    return docs(spark, sf_dir).select("doc_id", T.language_of(path).alias("language"))


@register("html_comment_metrics")
def html_comment_metrics(spark, sf_dir):
    return structure.measure(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html", F.lit("HTML"))


@register("structural_chunks")
def structural_chunks(spark, sf_dir):
    return structure.structural(html_comment_metrics(spark, sf_dir), "page_id", limit=50)


@register("doc_comment_metrics", "SELECT doc_id, NULL::INTEGER AS comment_lines, NULL::INTEGER AS code_lines, NULL::INTEGER AS max_block, NULL::BOOLEAN AS has_code, NULL::DOUBLE AS comment_ratio FROM documents")
def doc_comment_metrics(spark, sf_dir):
    return structure.measure(docs(spark, sf_dir), "doc_id", "text", F.lit("Text"))


_AUDIT = {"numbers": r"[0-9]+", "capitals": r"[A-Z][a-z]+", "mail": r"[a-z0-9.]+@[a-z0-9.]+"}
_AUDIT_SQL = "SELECT doc_id, pattern, n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, len(regexp_extract_all(text, '{p}'))::INTEGER AS n FROM documents" for k, p in _AUDIT.items()) + ") WHERE n > 0"


@register("regex_audit", _AUDIT_SQL)
def regex_audit(spark, sf_dir):
    return structure.audit(docs(spark, sf_dir), "doc_id", "text", _AUDIT)


@register("regex_audit_counts", f"SELECT pattern, count(*) AS rows_hit, sum(n)::BIGINT AS hits FROM ({_AUDIT_SQL}) GROUP BY pattern")
def regex_audit_counts(spark, sf_dir):
    return regex_audit(spark, sf_dir).groupBy("pattern").agg(F.count("*").alias("rows_hit"), F.sum("n").alias("hits"))


_BUILT_IN_SQL = "SELECT doc_id, pattern, n FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS pattern, len(regexp_extract_all(text, '{p}'))::INTEGER AS n FROM documents" for k, p in structure.AUDITS.items()) + ") WHERE n > 0"


@register("regex_audit_built_in", _BUILT_IN_SQL)
def regex_audit_built_in(spark, sf_dir):
    return structure.audit(docs(spark, sf_dir), "doc_id", "text")


@register("pipeline_report", f"WITH {_WINDOWS} SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM w) AS chunks, (SELECT sum(strlen(text))::BIGINT FROM documents) AS bytes, (SELECT count(DISTINCT sha256(text)) FROM documents) AS distinct_texts")
def pipeline_report(spark, sf_dir):
    d = docs(spark, sf_dir)
    chunks = chunking.fixed_windows(d, most=20, overlap=5).agg(F.count("*").alias("chunks"))
    return d.agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts")).join(F.broadcast(chunks)).select("files", "chunks", "bytes", "distinct_texts")
