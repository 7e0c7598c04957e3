"""Session helpers shared by the whole library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def visible(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package when it is used from a source folder."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])
    return spark


def local(name: str = "loam", cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return visible(spark)
