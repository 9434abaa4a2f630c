"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from stratavox.sources.shared import settle

__all__ = ["forget", "set_aside", "settle", "small_batches"]


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns of these names under others, so that helper columns may take the names; and how to name them back."""
    taken, back = set(df.columns), {}
    for name in names:
        if name in taken:
            other = name
            while other in taken:
                other += "_"
            taken.add(other)
            back[other] = name
    return df.withColumnsRenamed({v: k for k, v in back.items()}), back


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Let Arrow batches hold ``rows`` rows at most for the jobs within: rows here are whole texts or sets, and workers of several stages share an executor."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(*tables: DataFrame) -> None:
    """Delete what :func:`settle` wrote for tables that no later step reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/stratavox/" in path:
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(conf).delete(target, True)
