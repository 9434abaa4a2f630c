"""Reading the input tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def workers_find_package(spark: SparkSession) -> None:
    """Let local Python workers import this package, wherever the driver was started; a cluster gets it by ``--py-files``."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if _ROOT not in paths:
        env["PYTHONPATH"] = ":".join([_ROOT, *filter(None, paths)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table. ``sf_dir`` may be any path or URL that Spark's readers open."""
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
