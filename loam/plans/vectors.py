"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import vectors as V
from ..operators import knn

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_Q = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_DIST = {
    "cosine": "list_cosine_distance(embedding::DOUBLE[], q)",
    "l2": "list_distance(embedding::DOUBLE[], q)",
    "l1": "list_sum(list_transform(generate_series(1, len(q)), lambda i: abs(embedding[i]::DOUBLE - q[i])))",
    "hamming": "list_sum(list_transform(generate_series(1, len(q)), lambda i: CASE WHEN (embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END))::DOUBLE",
    "cosine_eps": "1 - list_dot_product(embedding::DOUBLE[], q) / sqrt(greatest(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(q, q), 1e-6))",
}


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _knn(name: str, k: int = 10, metric: str = "cosine", sql_where: str = "true", sql_after: str = "true", **options) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir)
        own = {n: o(t) if callable(o) else o for n, o in options.items()}
        return _rounded(knn.search(t, knn.vector_of(t, 0), k, metric, **own))

    QUERIES[name] = query
    ORACLE_SQL[name] = f"""WITH {_Q}, d AS (SELECT vec_id, label, {_DIST[metric]} AS distance FROM embeddings, q WHERE {sql_where}),
t AS (SELECT * FROM d WHERE {sql_after.replace('AFTER:', '') if not sql_after.startswith('AFTER:') else 'true'} ORDER BY distance, vec_id LIMIT {k})
SELECT vec_id, label, round(distance, 6) AS distance FROM t WHERE {sql_after[6:] if sql_after.startswith('AFTER:') else 'true'}"""


_knn("knn_cosine")
_knn("knn_l2", metric="l2")
_knn("knn_l1", metric="l1")
_knn("knn_hamming", metric="hamming")
_knn("knn_brute_force_eps", metric="cosine_eps")
_knn("knn_partition_eq", where=lambda t: F.col("label") == 1, sql_where="label = 1")
_knn("knn_partition_range", where=lambda t: (F.col("label") >= 1) & (F.col("label") < 4), sql_where="label >= 1 AND label < 4")
_knn("knn_metadata_in", where=lambda t: F.col("label").isin(0, 2), sql_where="label IN (0, 2)")
_knn("knn_pk_in", k=5, keys=lambda t: t.where("vec_id % 7 = 0").select("vec_id"), sql_where="vec_id % 7 = 0")
_knn("knn_distance_range", distance=(">", 0.5), sql_after="distance > 0.5")
_knn("knn_threshold", k=50, threshold=0.3, sql_after="AFTER:greatest(0, 1 - distance) >= 0.3")
_knn("knn_filter_before_rank", where=lambda t: F.contains(F.col("label").cast("string"), F.lit("1")), sql_where="contains(label::VARCHAR, '1')")
_knn("similar_excluding", where=lambda t: F.col("vec_id") != 0, threshold=0.2, k=20, sql_where="vec_id <> 0", sql_after="AFTER:greatest(0, 1 - distance) >= 0.2")


def knn_join_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir)
    sizes = t.groupBy("label").agg(F.count("*").alias("label_size"))
    return _rounded(knn.search(t, knn.vector_of(t, 0), 10)).join(sizes, "label")


QUERIES["knn_join_dims"] = knn_join_dims
ORACLE_SQL["knn_join_dims"] = f"SELECT k.*, s.label_size FROM ({ORACLE_SQL['knn_cosine']}) k JOIN (SELECT label, count(*) AS label_size FROM embeddings GROUP BY label) s USING (label)"


def _scalar(name: str, columns: dict, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _table(spark, sf_dir).select("vec_id", *[c().alias(n) for n, c in columns.items()])
    ORACLE_SQL[name] = f"SELECT vec_id, {sql} FROM embeddings"


def _round(x: Column, n: int) -> Column:
    """As SQL rounds: the product by 10^n to a whole number, halves away from zero, and negative zero keeps its sign."""
    scaled = F.abs(x) * F.lit(10.0**n)
    whole = F.rint(scaled)
    return F.signum(x) * (whole + F.when(scaled - whole == 0.5, 1.0).otherwise(0.0)) / F.lit(10.0**n)


_e = "embedding"
_r = lambda c, n=5: F.transform(c, lambda x: _round(x.cast("double"), n))
_sum = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
_scalar("vec_length", {"n": lambda: V.vec_length(_e), "kind": lambda: V.vec_type("array<float>")}, "len(embedding)::INTEGER AS n, 'float32' AS kind")
_scalar("vec_add", {"v": lambda: _r(V.vec_add(_e, _e))}, "list_transform(embedding, lambda x: round((x + x)::DOUBLE, 5)) AS v")
_scalar("vec_sub", {"v": lambda: V.vec_sub(_e, F.reverse(_e))}, "list_transform(generate_series(1, len(embedding)), lambda i: embedding[i] - embedding[len(embedding) + 1 - i]) AS v")
_scalar("vec_slice", {"v": lambda: V.vec_slice(_e, 8, 24)}, "embedding[9:24] AS v")
_scalar("vec_normalize", {"v": lambda: _r(V.vec_normalize(_e))}, "list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5)) AS v")
_scalar("vec_quantize_int8", {"v": lambda: V.vec_quantize_int8(_e)}, "list_transform(embedding, lambda x: trunc(greatest(-128.0, least(127.0, (x::DOUBLE + 1) / (2.0::DOUBLE / 255.0::DOUBLE) - 128)))::TINYINT) AS v")
_scalar("vec_quantize_binary", {"v": lambda: V.vec_quantize_binary(_e)}, "list_transform(generate_series(0, len(embedding) // 8 - 1), lambda k: list_sum(list_transform(generate_series(0, 7), lambda j: CASE WHEN embedding[k * 8 + j + 1] > 0 THEN 1 << j ELSE 0 END))::INTEGER) AS v")
_scalar("vec_hamming", {"n": lambda: V.vec_distance_hamming(V.vec_quantize_binary(_e), V.vec_quantize_binary(F.reverse(_e)))}, "list_sum(list_transform(generate_series(1, len(embedding)), lambda i: CASE WHEN (embedding[i] > 0) <> (embedding[len(embedding) + 1 - i] > 0) THEN 1 ELSE 0 END))::INTEGER AS n")
_scalar("vec_to_json", {"v": lambda: V.vec_to_json(_e)}, "'[' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', x::DOUBLE)), ',') || ']' AS v")
_scalar("cosine_similarity", {"s": lambda: F.round(V.cosine_similarity(F.col(_e), F.reverse(_e)), 6)}, "round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]) / sqrt(greatest(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 1e-6)), 6) AS s")


def vec_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir).select("vec_id", V.vec_each("embedding").alias("pos", "value"))


QUERIES["vec_each"] = vec_each
ORACLE_SQL["vec_each"] = "SELECT vec_id, (i - 1)::INTEGER AS pos, embedding[i] AS value FROM embeddings, unnest(generate_series(1, len(embedding))) AS u(i)"
