"""The online map: key-frames arrive as a stream, voxels with latents are admitted, merged and optimised, and changed voxels are meshed anew.

State and meshes are tables of changes: batch n writes the rows that it changed to a
folder of its own and reads those of earlier batches only, so a batch that runs again
after a failure gives what it gave before. Rows lie in blocks of cells, and a batch
reads the blocks around the cells that its points touch. Every so many batches the
latest rows are written together, and readers start from there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratavox.operators import reduce, volume
from stratavox.operators.grid import Grid, dilate, prune, scatter8
from stratavox.sources.shared import settle

STATE = "lin_id long, latent array<double>, obs_count double, optimized boolean, dirty boolean, block long"
MADE = "lin_id long, block long"
TRIANGLES = "lin_id long, i long, j long, k long, tri_no int, v array<struct<x:double,y:double,z:double,std:double>>, block long"


@dataclass(frozen=True)
class Meshing:
    """How changed voxels are meshed: see :func:`volume.dirty_mesh`.

    ``exact`` makes anew all 26 neighbours of a changed voxel as well, whose meshes
    its lattice reaches into; without, only changed voxels are, as in the original.
    """

    r: int
    decode: volume.Decode
    more_than: float = 0
    gate: float | None = None
    most_std: float | None = None
    exact: bool = True


@dataclass(frozen=True)
class Fusion:
    """A map under the folder ``work``.

    ``encode`` adds ``latent`` (``dims`` numbers) to points that were scattered to
    a voxel, with their place ``rx``, ``ry``, ``rz`` in it. Voxels seen ``freeze_at``
    times take no more. Voxels seen ``optimise_at`` times get what ``optimise``
    makes of (lin_id, latent) and the batch's points, once each. Points in cells
    with at most ``prune`` points of the batch are dropped if that is positive.
    """

    grid: Grid
    work: str
    dims: int
    encode: Callable[[DataFrame], DataFrame]
    freeze_at: float
    optimise: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    optimise_at: float = float("inf")
    prune: int = 0
    meshing: Meshing | None = None
    edge: int = 8
    compact_every: int = 16

    # tables of changes

    def block(self, lin_id: Column) -> Column:
        """The block of a cell: a cube of ``edge`` cells."""
        x, y, z = (F.floor(g / self.edge) for g in self.grid.axes(lin_id))
        ny, nz = (-(-n // self.edge) for n in self.grid.shape[1:])
        return (z + nz * (y + ny * x)).cast("long")

    def _batches(self, spark: SparkSession, name: str) -> list[int]:
        """The numbers of the whole folders of a table."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.work}/{name}")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.listStatus(path) if files.exists(path) else []
        return sorted(int(f.getPath().getName().split("=")[1]) for f in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def _changes(self, spark: SparkSession, name: str, schema: str, before: int, after: int = -1) -> DataFrame:
        """The rows of batches after ``after`` and before ``before``, with ``batch``."""
        paths = [f"{self.work}/{name}/batch={n}" for n in self._batches(spark, name) if after < n < before]
        fields = T.StructType([*spark.createDataFrame([], schema).schema.fields, T.StructField("batch", T.LongType())])
        if not paths:
            return spark.createDataFrame([], fields)
        return spark.read.schema(fields).option("basePath", f"{self.work}/{name}").parquet(*paths)

    def _write(self, rows: DataFrame, name: str, number: int) -> None:
        laid = rows.withColumn("block", self.block(F.col("lin_id")))
        laid.repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{self.work}/{name}/batch={number}")

    def state(self, spark: SparkSession, before: int = 1 << 62, blocks: DataFrame | None = None) -> DataFrame:
        """(lin_id, latent, obs_count, optimized) of all voxels as they were before a batch; of certain blocks if given."""
        whole = [n for n in self._batches(spark, "whole") if n < before]
        rows = self._changes(spark, "state", STATE, before, whole[-1] if whole else -1)
        if whole:
            rows = rows.unionByName(self._changes(spark, "whole", STATE, whole[-1] + 1, whole[-1] - 1))
        if blocks is not None:
            rows = rows.join(blocks, "block", "left_semi")
        latest = rows.groupBy("lin_id").agg(F.max_by(F.struct("latent", "obs_count", "optimized"), "batch").alias("s"))
        return latest.select("lin_id", "s.*")

    def mesh(self, spark: SparkSession, before: int = 1 << 62) -> DataFrame:
        """The triangles of every voxel from the batch that last made it."""
        made = self._changes(spark, "made", MADE, before).groupBy("lin_id").agg(F.max("batch").alias("batch"))
        return self._changes(spark, "mesh", TRIANGLES, before).join(made, ["lin_id", "batch"]).drop("block", "batch")

    def _around(self, cells: DataFrame) -> DataFrame:
        """The blocks of cells and all their neighbours."""
        return dilate(cells, self.grid, corners=True).select(self.block(F.col("lin_id")).alias("block")).distinct()

    # one batch

    def step(self, points: DataFrame, number: int) -> None:
        """Take the points (x, y, z, ..) of batch ``number`` into the map, and mesh what they changed."""
        spark = points.sparkSession
        names = points.columns
        points = settle(prune(points, self.grid, self.prune).select(*names, "lin_id"), "points")
        touched = settle(points.select("lin_id").distinct(), "touched")
        before = settle(self.state(spark, number, self._around(touched)), "before")
        state = settle(volume.admit(before, touched, self.grid, self.dims), "admitted")
        seen = self.encode(scatter8(points.select(*names), self.grid, state.where(F.col("obs_count") < self.freeze_at)))
        delta = settle(reduce.group_vectors(seen, "lin_id", "latent", self.dims, "sum").withColumnRenamed("latent", "total"), "delta")
        new = volume.integrate(state, delta, self.freeze_at)
        marks = delta.select("lin_id", F.lit(True).alias("dirty")), before.select("lin_id", F.lit(True).alias("known"))
        new = new.join(marks[0], "lin_id", "left").join(marks[1], "lin_id", "left").withColumn("dirty", F.coalesce("dirty", F.lit(False)))
        new = settle(new.where(F.col("dirty") | F.col("known").isNull()).drop("known"), "merged")
        if self.optimise is not None:
            due = volume.due(new, self.optimise_at).select("lin_id", "latent")
            better = self.optimise(due, points).select("lin_id", F.col("latent").alias("better"))
            new = new.join(better, "lin_id", "left")
            done = F.col("better").isNotNull()
            new = new.withColumns({"latent": F.coalesce("better", "latent"), "optimized": F.col("optimized") | done, "dirty": F.col("dirty") | done}).drop("better")
        self._write(new.select("lin_id", "latent", "obs_count", "optimized", "dirty"), "state", number)
        if self.meshing is not None:
            self._remesh(spark, number)
        if (number + 1) % self.compact_every == 0:
            self._write(self.state(spark, number + 1).withColumn("dirty", F.lit(False)), "whole", number)

    def _remesh(self, spark: SparkSession, number: int) -> None:
        m = self.meshing
        dirty = self._changes(spark, "state", STATE, number + 1, number - 1).where("dirty").select("lin_id")
        again = settle(dilate(dirty, self.grid, corners=True) if m.exact else dirty, "again")
        voxels = settle(self.state(spark, number + 1, self._around(again)), "around")
        self._write(volume.dirty_mesh(voxels, again, self.grid, m.r, m.decode, m.more_than, m.gate, m.most_std, m.exact), "mesh", number)
        self._write(again, "made", number)

    def play(self, spark: SparkSession, source: str, schema: str, files_each: int = 1) -> None:
        """Take the Parquet files of ``source``, in the order in which they were written, as a stream of batches up to the last one there is."""
        points = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(source)
        stream = points.writeStream.foreachBatch(lambda batch, number: self.step(batch, number))
        stream.option("checkpointLocation", f"{self.work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
