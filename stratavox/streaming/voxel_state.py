"""The voxel map as a stream: each batch of frames updates the state of the cells it touches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratavox.operators.grid import Grid


def update(freeze_at: float | None):
    """The state update of one cell: running means of x, y, z; a frozen cell takes no more (checked before the batch)."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, count = (np.array(state.get[:3]), state.get[3]) if state.exists else (np.zeros(3), 0.0)
        open_ = freeze_at is None or count < freeze_at
        for part in parts:
            if open_ and len(part):
                total = part[["x", "y", "z"]].sum().to_numpy()
                mean = (mean * count + total) / (count + len(part))
                count += float(len(part))
        state.update((*map(float, mean), float(count)))
        yield pd.DataFrame([[key[0], *mean, count]], columns=["lin_id", "cx", "cy", "cz", "obs_count"])

    return run


def integrate(points: DataFrame, grid: Grid, freeze_at: float | None = None) -> DataFrame:
    """Streaming points to the updated cells (lin_id, cx, cy, cz, obs_count); what a batch emits is its dirty set."""
    cells = grid.cells(points).select("lin_id", "x", "y", "z")
    state = "cx double, cy double, cz double, obs_count double"
    return cells.groupBy("lin_id").applyInPandasWithState(update(freeze_at), f"lin_id long, {state}", state, "update", GroupStateTimeout.NoTimeout)


def run_to_end(spark: SparkSession, source: str, schema: str, grid: Grid, work: str, freeze_at: float | None = None, files_each: int = 1) -> DataFrame:
    """Play the files of ``source`` as a stream, ``files_each`` a batch, and return the map after the last one.

    Every batch's updates are appended with its number, under ``work``; a batch
    that is run again after a failure overwrites its own folder only. The map is
    each cell's row of the latest batch.
    """
    points = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{work}/updates/batch={number}")

    stream = integrate(points, grid, freeze_at).writeStream.outputMode("update").foreachBatch(keep)
    running = stream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.parquet(f"{work}/updates")
    latest = rows.groupBy("lin_id").agg(F.max_by(F.struct("cx", "cy", "cz", "obs_count"), "batch").alias("s"))
    return latest.select("lin_id", "s.*")
