"""Session, scratch and naming helpers of the llm operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.types import DataType, StructField, StructType

from ..session import visible

ARROW_ROWS = 2000
_WORKER = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(64 << 20), "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, so that a batch of long texts fits a worker, and makes
    sure that checkpoints have a folder: the cluster's spark.checkpoint.dir, else
    (local runs only) a temporary one.
    """
    visible(spark)
    # Python workers give freed memory back, so that two fit beside an executor's heap.
    spark.sparkContext.environment.update(_WORKER)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loam-checkpoint-"))
    return spark


def durable(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the checkpoint folder, without lineage."""
    prepare(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its plain name, whatever is in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of df but those of these names."""
    lower = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in lower]


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns that an operator is about to add under these names."""
    return df.select(*[col(c) for c in others(df, *names)])


Work = Callable[[pa.RecordBatch], Iterable[tuple[pa.RecordBatch, list[pa.Array]]]]


def carry(df: DataFrame, inputs: list[Column], rest: list[str], work: Work, added: list[tuple[str, DataType]], each: Callable[[], Work] | None = None) -> DataFrame:
    """The columns `rest` of df with added ones, in Arrow batches; names of any kind pass.

    work is given a batch, in which the inputs come first and rest follows, and yields pieces of it, each
    with its added columns; `each` makes a work for every task instead.
    """
    prepare(df.sparkSession)
    n = len(inputs)
    own = df.select(*[c.alias(f"i{k}") for k, c in enumerate(inputs)], *[col(c).alias(f"r{k}") for k, c in enumerate(rest)])
    schema = StructType([StructField(f"r{k}", df.schema[c].dataType) for k, c in enumerate(rest)] + [StructField(f"a{k}", t) for k, (_, t) in enumerate(added)])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        do = each() if each else work
        for b in batches:
            for piece, columns in do(b):
                yield pa.RecordBatch.from_arrays([*piece.columns[n:], *columns], names=names)

    return own.mapInArrow(run, schema).toDF(*rest, *(name for name, _ in added))


def key_parts(df: DataFrame, key: str) -> tuple[Column, Column]:
    """(is null, value without nulls) of a key column, for joins in which nulls match."""
    kind = df.schema[key].dataType.simpleString()
    own = col(key)
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return own.isNull(), F.coalesce(own.cast("long"), F.lit(0).cast("long"))
    return own.isNull(), F.coalesce(own.cast("string"), F.lit(""))


def row_id() -> Column:
    """A 64-bit hash of doc_id, nulls kept apart, and text: the identity of a row, which only repeated rows share."""
    return F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.col("text").cast("string"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> tuple[list[str], list[int]]:
    """At most `bound` labelled texts, chosen by the hash of doc_id, with their 0/1 labels.

    Only narrow label rows are ordered; the bounded choice is small, whatever the
    table's size, so documents are scanned once and joined to it in place.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text != ''")
    rows = own.join(F.broadcast(known), "doc_id").select("doc_id", "text", "label").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))[:bound]
    return [r.text for r in rows], [r.label for r in rows]
