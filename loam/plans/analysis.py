"""Aggregate, graph and log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..operators import graph as G
from ..operators import search
from .corpus import _FILES, files

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


def constructs(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    return p.select("p_partkey", F.col("p_name").alias("construct_name"), F.col("p_type").alias("construct_type"), F.col("p_brand").alias("path"), F.col("p_size").cast("long").alias("tokens"))


_C = "c AS (SELECT p_partkey, p_name AS construct_name, p_type AS construct_type, p_brand AS path, p_size::BIGINT AS tokens FROM part)"


@register("duplicates", f"""WITH {_C}, f AS (SELECT construct_name, construct_type, path, sum(tokens)::BIGINT AS tokens FROM c WHERE tokens >= 5 GROUP BY ALL)
SELECT construct_name, construct_type, count(*) AS files, sum(tokens)::BIGINT AS total, (sum(tokens) - sum(tokens) // count(*))::BIGINT AS wasted, NULL::VARCHAR AS any_summary, list(path ORDER BY tokens DESC, path) AS paths FROM f GROUP BY ALL HAVING count(*) > 1 ORDER BY total DESC, construct_name, construct_type LIMIT 20""")
def duplicates(spark, sf_dir):
    return A.duplicates(constructs(spark, sf_dir), 5)


_SUFFIX = ("e", "n", "d")


@register("naming_patterns", f"""WITH {_C}, s AS (SELECT *, CASE WHEN ends_with(construct_name, 'e') AND length(construct_name) > 1 THEN 'e' WHEN ends_with(construct_name, 'n') AND length(construct_name) > 1 THEN 'n' WHEN ends_with(construct_name, 'd') AND length(construct_name) > 1 THEN 'd' END AS suffix FROM c WHERE construct_type IS NOT NULL)
SELECT suffix, count(*) AS n, sum(tokens)::BIGINT AS tokens, array_to_string(list_sort(list_distinct(list(construct_name)))[1:5], '|') AS samples FROM s WHERE suffix IS NOT NULL GROUP BY suffix HAVING count(*) >= 2""")
def naming_patterns(spark, sf_dir):
    return A.patterns(constructs(spark, sf_dir), _SUFFIX)


@register("hotspots", f"WITH {_C} SELECT * FROM c WHERE tokens >= 40 ORDER BY tokens DESC, p_partkey LIMIT 20")
def hotspots(spark, sf_dir):
    return A.hotspots(constructs(spark, sf_dir), "p_partkey", 40)


@register("type_stats", f"WITH {_C} SELECT coalesce(construct_type, 'unknown') AS construct_type, count(*) AS n FROM c GROUP BY 1")
def type_stats(spark, sf_dir):
    return A.counts_by(constructs(spark, sf_dir), "construct_type", "construct_type")


@register("facets", "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facets(spark, sf_dir):
    return A.facets(_t(spark, sf_dir, "documents"), ["lang", "source"])


def _measured(spark, sf_dir):
    return files(spark, sf_dir).select("path", "lang", F.size(F.split("text", "\n", -1)).alias("lines"), F.octet_length("text").cast("long").alias("bytes"))


_M = f"{_FILES}, m AS (SELECT path, lang, len(string_split(text, chr(10)))::INTEGER AS lines, strlen(text) AS bytes FROM files)"


@register("large_files", f"WITH {_M} SELECT path, 1::BIGINT AS chunks, (lines - 1)::BIGINT AS lines FROM m ORDER BY lines DESC, path LIMIT 20")
def large_files(spark, sf_dir):
    return A.large_files(_measured(spark, sf_dir).select("path", F.lit(1).alias("start_line"), F.col("lines").alias("end_line")))


@register("structural_stats", f"WITH {_M} SELECT count(*) AS files, sum(lines)::BIGINT AS lines, sum(bytes)::BIGINT AS bytes, round(avg(lines), 6) AS avg_lines, (SELECT path FROM m ORDER BY lines DESC, path DESC LIMIT 1) AS largest FROM m")
def structural_stats(spark, sf_dir):
    return A.structural_stats(_measured(spark, sf_dir))


@register("files_by_structure", f"WITH {_M} SELECT path, lang, lines, bytes FROM m WHERE lines >= 3 AND bytes <= 20000 AND lang = 'en' ORDER BY bytes DESC, path LIMIT 50")
def files_by_structure(spark, sf_dir):
    return _measured(spark, sf_dir).where("lines >= 3 AND bytes <= 20000 AND lang = 'en'").orderBy(F.desc("bytes"), "path").limit(50)


def analysed(spark, sf_dir):
    model = F.when(F.col("quality").isNull(), F.lit(None)).when(F.col("toxic") == 1, A.FAILED).when(F.col("quality") == 1, "model-a").otherwise("model-b")
    joined = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", model.alias("analyzer_model"), (F.col("quality") == 1).alias("enriched"))


_AN = f"a AS (SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL WHEN toxic = 1 THEN '{A.FAILED}' WHEN quality = 1 THEN 'model-a' ELSE 'model-b' END AS m, quality = 1 AS enriched FROM documents d LEFT JOIN labels USING (doc_id))"
_BAD = f"m = '{A.FAILED}'"
_GOOD = f"m <> '{A.FAILED}'"


@register("analysis_counts", f"WITH {_AN} SELECT count(*) FILTER ({_GOOD}) AS analysed, count(*) FILTER ({_BAD}) AS failed, count(*) FILTER (m IS NULL) AS unanalysed, count(*) FILTER ({_GOOD} AND enriched) AS enriched FROM a")
def analysis_counts(spark, sf_dir):
    return A.analysis_counts(analysed(spark, sf_dir))


@register("analyzer_models", f"WITH {_AN} SELECT m AS analyzer_model, count(*) AS n FROM a WHERE m IS NOT NULL GROUP BY m")
def analyzer_models(spark, sf_dir):
    return A.model_counts(analysed(spark, sf_dir))


@register("analyzer_drift", f"WITH {_AN} SELECT count(DISTINCT m) FILTER ({_GOOD}) AS models, count(*) FILTER ({_GOOD} AND m <> 'model-a') AS off_pin, count(*) FILTER ({_BAD}) AS failed, count(*) FILTER (m IS NULL) AS unanalysed, count(DISTINCT m) FILTER ({_GOOD}) > 1 AS drifted FROM a")
def analyzer_drift(spark, sf_dir):
    return A.analyzer_drift(analysed(spark, sf_dir), " model-a ")


@register("integrity_dangling", "SELECT doc_id, quality, toxic FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def integrity_dangling(spark, sf_dir):
    return A.dangling(_t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id")


for _name, _col in (("coverage_by_lang", "lang"), ("coverage_dirs", "source")):
    register(_name, f"SELECT {_col}, count(*) AS disk, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS indexed, count(*) - count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS gap FROM documents GROUP BY {_col}")(
        lambda spark, sf_dir, c=_col: A.coverage(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left_semi"), c)
    )


@register("store_stats", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'labels', count(*) FROM labels")
def store_stats(spark, sf_dir):
    return A.table_counts(**{n: _t(spark, sf_dir, n) for n in ("documents", "embeddings", "labels")})


def edges(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("kind"))


_E = "e AS (SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS kind FROM lineitem)"


@register("dep_edges", f"WITH {_E} SELECT source, target, kind, s_name FROM e JOIN supplier ON s_suppkey = target")
def dep_edges(spark, sf_dir):
    return edges(spark, sf_dir).join(_t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("target"), "s_name"), "target").select("source", "target", "kind", "s_name")


@register("dependencies_of", f"WITH {_E} SELECT DISTINCT target FROM e WHERE source = 10")
def dependencies_of(spark, sf_dir):
    return G.outgoing(edges(spark, sf_dir), 10)


@register("dependents_of", f"WITH {_E} SELECT DISTINCT source FROM e WHERE target = 3")
def dependents_of(spark, sf_dir):
    return G.incoming(edges(spark, sf_dir), 3)


@register("dep_stats", f"WITH {_E} SELECT kind, count(*) AS n FROM e GROUP BY kind")
def dep_stats(spark, sf_dir):
    return G.edge_counts(edges(spark, sf_dir))


@register("orphans", "SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 49) ORDER BY p_size DESC, p_partkey LIMIT 50")
def orphans(spark, sf_dir):
    """Parts without a large return: every part has some line, so edges are told apart by quantity."""
    nodes = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    large = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 49").select(F.col("l_partkey").alias("source"))
    return G.orphans(nodes, large, "p_partkey", "source").orderBy(F.desc("p_size"), "p_partkey").limit(50)


@register("symbol_refs", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name = (SELECT min(p_name) FROM part) ORDER BY l_orderkey, l_linenumber LIMIT 100")
def symbol_refs(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_name")
    first = names.agg(F.min("p_name")).first()[0]
    refs = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber")
    return G.references(refs, names, "p_name", first, 100, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "p_name")


@register("symbol_counts", f"WITH {_E} SELECT source, count(*) AS n FROM e GROUP BY source")
def symbol_counts(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"))


@register("import_resolution", f"""WITH {_FILES}, c AS (SELECT doc_id, unnest([source || '/xx/doc_' || doc_id, source || '/en/doc_' || doc_id || '.txt', source || '/de/doc_' || doc_id || '.txt']) AS path FROM documents)
SELECT d.doc_id, min(f.path) AS target FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN files f ON f.path = c.path GROUP BY d.doc_id""")
def import_resolution(spark, sf_dir):
    f = files(spark, sf_dir)
    tried = F.array(*[F.concat("source", F.lit(f"/{lang}/doc_"), F.col("doc_id").cast("string"), F.lit(end)) for lang, end in (("xx", ""), ("en", ".txt"), ("de", ".txt"))])
    return G.resolve(f.select("doc_id", tried.alias("tried")), f, "tried", "doc_id")


@register("query_hints_recent", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id LIMIT 20")
def query_hints_recent(spark, sf_dir):
    return search.recent_hints(_t(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type", "value")


def lessons(spark, sf_dir):
    t = _t(spark, sf_dir, "conversations")
    return t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("error_signature"), F.col("role").alias("file_pattern"), (F.col("turn") < 6).alias("is_active"), F.lit(1.0).alias("confidence"), F.lit(0).alias("apply_count"), F.col("turn").cast("int").alias("success_count"))


_L = "l AS (SELECT conv_id * 1000 + turn AS id, text AS error_signature, role AS file_pattern, turn < 6 AS is_active, turn::INTEGER AS success_count FROM conversations)"


@register("lessons_match", f"WITH {_L} SELECT id, file_pattern FROM l WHERE is_active AND error_signature ILIKE '%a%' AND (file_pattern IS NULL OR file_pattern ILIKE '%user%') ORDER BY success_count DESC, id LIMIT 10")
def lessons_match(spark, sf_dir):
    return search.match_lessons(lessons(spark, sf_dir), "a", "user").select("id", "file_pattern")


@register("lesson_decay", f"WITH {_L} SELECT id, 1 AS apply_count, success_count + (success_count % 2 = 0)::INTEGER AS success_count, CASE WHEN success_count % 2 = 0 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM l")
def lesson_decay(spark, sf_dir):
    used = search.use_lesson(lessons(spark, sf_dir), F.lit(True), F.col("success_count") % 2 == 0)
    return used.select("id", "apply_count", "success_count", F.round("confidence", 9).alias("confidence"))
