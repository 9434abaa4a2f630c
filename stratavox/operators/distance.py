"""The tracker's distance term against the decoded map: points meet their voxel's latent, and the network's gradient becomes the pose's Jacobian."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.geometry import transform, vec
from stratavox.functions.heads import Decoder, stacked
from stratavox.operators import volume
from stratavox.operators.grid import Grid
from stratavox.operators.track import Result, Stability, Term, scheduled


@dataclass(frozen=True)
class Field:
    """A map of voxels (lin_id, latent, obs_count) with their decoder; voxels seen at most ``more_than`` times don't count."""

    grid: Grid
    voxels: DataFrame
    decoder: Decoder
    more_than: float = 0
    chunk: int = 65536

    def sample(self, points: DataFrame) -> DataFrame:
        """Points (.., x, y, z) in voxels that count, with ``sdf``, ``std`` and the gradient ``gx``, ``gy``, ``gz`` of the distance by the place in the world."""
        names = points.columns
        known = self.voxels.where(F.col("obs_count") > self.more_than).select("lin_id", F.col("latent").alias("_latent"))
        cells = self.grid.cells(points.withColumnsRenamed({n: f"_{n}" for n in ("gx", "gy", "gz", "lin_id") if n in names}))
        met = cells.join(known, "lin_id")
        places = [((F.col(c) - low) / self.grid.size - F.col(f"g{c}") - 0.5) for c, low in zip("xyz", self.grid.low, strict=True)]
        shared, chunk, size = points.sparkSession.sparkContext.broadcast(self.decoder), self.chunk, self.grid.size

        @F.pandas_udf("sdf double, std double, gx double, gy double, gz double")
        def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
            for code, *place in parts:
                made = []
                for a in range(0, len(code), chunk):
                    x = stacked(code[a : a + chunk], [c[a : a + chunk] for c in place])
                    g = shared.value.gradient(x, np.ones(len(x)), np.zeros(len(x)))[:, -3:] / size
                    made.append(np.column_stack([*shared.value.run(x), g]))
                yield pd.DataFrame(np.concatenate(made) if made else np.zeros((0, 5)), columns=["sdf", "std", "gx", "gy", "gz"])

        return met.withColumn("_d", run("_latent", *places)).select(*[F.col(n) for n in names if n not in ("gx", "gy", "gz", "lin_id")], "_d.*")

    def residuals(self, points: DataFrame, previous: np.ndarray, delta: np.ndarray, weight: Callable[[Column], Column] | None = None, as_original: bool = False) -> DataFrame:
        """(f, j0 .. j5) of the points (x, y, z) in the camera's frame, with f = sdf / std at previous . delta . point; std is held constant.

        The Jacobian is by a twist on the left of ``delta``. It turns the gradient by
        the inverse of ``previous``'s rotation; ``as_original`` by the rotation itself, as
        the original is written. ``weight`` of f weighs each point: f and J are
        multiplied by its root.
        """
        moved = transform(vec("x", "y", "z"), delta[:3, :3].tolist(), delta[:3, 3].tolist())
        near = points.select(*[m.alias(f"p{c}") for m, c in zip(moved, "xyz", strict=True)])
        world = transform(vec("px", "py", "pz"), previous[:3, :3].tolist(), previous[:3, 3].tolist())
        seen = self.sample(near.withColumns({c: w for c, w in zip("xyz", world, strict=True)}))
        turn = previous[:3, :3] if as_original else previous[:3, :3].T
        rows = volume.sdf_residuals(seen, turn.tolist())
        if weight is None:
            return rows
        root = F.sqrt(weight(F.col("f")))
        return rows.withColumn("_w", root).select(*[(F.col(c) * F.col("_w")).alias(c) for c in rows.columns])


def track(field: Field, points: DataFrame, previous: np.ndarray, start: np.ndarray, groups: list[tuple[int, list[str]]], weight: Callable[[Column], Column] | None = None, others: dict[str, Term] | None = None, stability: Stability | None = None) -> Result:
    """The pose of the camera that saw ``points``, from ``start``, by steps of the term ``sdf`` and of ``others`` (terms of the motion from ``previous``).

    A step is one join of the points with the map and one sum; the 6 x 6 system
    alone comes to the driver.
    """
    terms = {"sdf": Term(lambda delta: field.residuals(points, previous, delta, weight)), **(others or {})}
    found = scheduled(groups, terms, np.linalg.inv(previous) @ start, stability)
    return Result(previous @ found.pose, found.energies, found.tracked)
