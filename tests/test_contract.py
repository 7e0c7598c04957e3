import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loam import plans
from loam.functions import vectors as V
from loam.plans import vectors

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    if x is None or str(x) in ("<NA>", "nan", "NaT"):
        return None
    return round(x, 7) if isinstance(x, float) else x


def _rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted((tuple(map(_plain, r)) for r in frame[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    if name in plans.ORACLE_SQL:
        assert _rows(got.toPandas()) == _rows(duck.sql(plans.ORACLE_SQL[name]).df())
    else:
        assert got.count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _both(spark, folder, name, own):
    """Values of a vector query and of its SQL over own vectors, as text, which tells -0.0 from 0.0."""
    table = spark.createDataFrame([(k, v, 0) for k, v in enumerate(own)], "vec_id long, embedding array<float>, label int")
    table.write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    got = plans.QUERIES[name](spark, str(folder)).orderBy("vec_id").collect()
    return [repr(r[1]) for r in got], [repr(r[1]) for r in con.sql(f"SELECT * FROM ({plans.ORACLE_SQL[name]}) ORDER BY vec_id").fetchall()]


def test_vec_add_rounds_as_sql(spark, tmp_path):
    got, want = _both(spark, tmp_path, "vec_add", [[-1e-6, 1e-6, -0.0, 0.0], [1 / 128, -1 / 128, -0.25, 3e6], [float("nan"), float("inf"), -float("inf"), None], [], None])
    assert got == want and got[0] == "[-0.0, 0.0, -0.0, 0.0]"


def test_vec_normalize_is_sql(spark, tmp_path):
    own = [[0.0, -0.0], [-1e-6, 1.0], [3.0, -4.0], [float("nan"), 1.0], [float("inf"), -1.0], [1e-45, 0.0], [-3e38, 3e38], [], None]
    got, want = _both(spark, tmp_path, "vec_normalize", own)
    assert got == want and got[:3] == ["[nan, nan]", "[-0.0, 1.0]", "[0.6, -0.8]"]


def test_rounding_near_halves(spark, duck):
    values = [s * math.nextafter((k + 0.5) / 1e5, up) for k in range(0, 99_999, 37) for up in (0, 1) for s in (1, -1)]
    got = spark.createDataFrame([(values,)], "v array<double>").select(vectors._r("v")).first()[0]
    assert list(map(repr, got)) == [repr(r[0]) for r in duck.execute("SELECT round(x, 5) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]


def test_vec_to_json_is_sql(spark, tmp_path):
    own = [[1 / 128, 3 / 128, -1 / 128, -9 / 128], [1e20, 3e38, -1e-8, -0.0], [float("inf"), -float("inf"), 1e-45, 5e-7], [], None]
    got, want = _both(spark, tmp_path, "vec_to_json", own)
    assert got == want and got[0] == "'[0.007812,0.023438,-0.007812,-0.070312]'"


def test_vec_to_json_other_types(spark):
    rows = spark.createDataFrame([([1e11 + 1 / 3, None, float("nan")], [1, None, -2])], "d array<double>, i array<tinyint>")
    assert tuple(rows.select(V.vec_to_json("d"), V.vec_to_json(F.col("i"))).first()) == ("[100000000000.333328,null,null]", "[1.000000,null,-2.000000]")
