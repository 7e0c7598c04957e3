"""The corpus pipeline: documents in, encoded clean documents out.

Each stage judges every row that its predecessor kept, by doc_id and text together, so
rows that share a doc_id but not the text are judged apart.

Defined results: rows with a NULL or empty text are rejected by the first stage; rows
with a NULL doc_id are judged like others and stand after them where an order decides
who stays; of rows that agree in doc_id and text, and of each group of near copies, one stays;
a passage is cut from all texts but the first that has it, and texts are never shortened
otherwise; long texts are read whole; an empty table gives an empty result; other columns,
whatever their names and values, are carried along, but columns named like an output column of
the last stage (tokens, n_tokens, exact) are replaced there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm.bpe import encoded
from loam.llm.common import table
from loam.llm.decontamination import drop_contaminated
from loam.llm.jaccard import keep_one
from loam.llm.quality import keep_good
from loam.llm.repeats import cut_repeats

STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one),
    ("repeated_passages", cut_repeats),
    ("decontamination", drop_contaminated),
    ("encoding", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
