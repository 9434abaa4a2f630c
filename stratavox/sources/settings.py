"""Configurations, and snapshots of a training run as tables with a list of what was written."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole_file(spark: SparkSession, path: str) -> str:
    found = spark.read.text(path, wholetext=True).first()
    return found[0] if found else ""


def _parsed(text: str, path: str) -> dict:
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise RuntimeError(f"{path}: no YAML reader is installed; give the configuration as JSON") from missing
        found = yaml.safe_load(text)
    else:
        try:
            found = json.loads(text)
        except json.JSONDecodeError:  # written with the quotes and constants of Python
            for old, new in (("'", '"'), ("None", "null"), ("False", "false"), ("True", "true")):
                text = text.replace(old, new)
            found = json.loads(text)
    merged: dict = {}
    for part in found if isinstance(found, list) else [found or {}]:
        merged |= {k: v for k, v in part.items() if k != "_"}
    return merged


def read_settings(spark: SparkSession, path: str, given: dict | None = None, override: bool = True) -> dict:
    """The settings of a YAML or JSON file over those ``given`` (under them without ``override``).

    Objects of a list are merged in order, and the key ``_`` is a comment. A
    file named by ``include_configs``, relative to this one, is read first; what
    it includes itself is not followed.
    """
    own = _parsed(_whole_file(spark, path), path)
    base = own.pop("include_configs", None)
    if base is not None:
        other = f"{path.rsplit('/', 1)[0]}/{base}" if "/" in path else base
        own = _parsed(_whole_file(spark, other), other) | own
    return (given or {}) | own if override else own | (given or {})


def snapshot_epochs(last: int, every: int, more: Iterable[int] = ()) -> list[int]:
    """Epochs up to ``last`` with a snapshot: all multiples of ``every``, and ``more``."""
    return sorted({*range(every, last + 1, every), *(e for e in more if 0 < e <= last)})


def write_snapshot(path: str, epoch: int, tables: dict[str, DataFrame]) -> None:
    """Write an epoch's tables (weights, latents, optimiser state), then one row for each into the list: a snapshot is listed only once it is whole."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/epoch_{epoch}/{name}")
    spark = next(iter(tables.values())).sparkSession
    listed = spark.createDataFrame([(epoch, name) for name in tables], "epoch long, name string")
    listed.coalesce(1).write.mode("append").parquet(f"{path}/list")


def read_snapshot(spark: SparkSession, path: str, name: str, epoch: int | None = None) -> DataFrame:
    """A table of a snapshot, of the latest epoch that has it if none is named."""
    listed = spark.read.parquet(f"{path}/list").where(F.col("name") == name)
    found = (listed if epoch is None else listed.where(F.col("epoch") == epoch)).agg(F.max("epoch")).first()[0]
    if found is None:
        raise LookupError(f"no snapshot of {name!r}" + ("" if epoch is None else f" at epoch {epoch}"))
    return spark.read.parquet(f"{path}/epoch_{found}/{name}")
