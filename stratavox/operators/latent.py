"""Optimisation of the map's latents: samples off the surface, and Adam steps whose gradients are summed by voxel on Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratavox.functions.augment import gaussian
from stratavox.functions.heads import Decoder, stacked
from stratavox.operators.reduce import group_vectors
from stratavox.sources.shared import settle


def off_surface(points: DataFrame, key: str, deviation: float = 0.05) -> DataFrame:
    """Points (.., x, y, z, nx, ny, nz) moved along their normals by a normal number, which becomes ``sdf``."""
    far = points.withColumn("sdf", deviation * gaussian(F.col(key), "off"))
    return far.withColumns({c: F.col(c) + F.col("sdf") * F.col(f"n{c}") for c in "xyz"})


def likelihood_gradient(decoder: Decoder, x: np.ndarray, sdf: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Each row's negative log likelihood and its gradient by the input; both distances are clamped to ``most``."""
    mean, std = decoder.run(x)
    error = np.clip(mean, -most, most) - np.clip(sdf, -most, most)
    loss = error**2 / (2 * std**2) + np.log(std) + 0.5 * np.log(2 * np.pi)
    by_sdf = np.where(np.abs(mean) <= most, error / std**2, 0.0)
    return loss, decoder.gradient(x, by_sdf, 1 / std - error**2 / std**3)


def optimise(samples: DataFrame, latents: DataFrame, decoder: Decoder, dims: int, steps: int, rate: float = 0.01, most: float = 0.2, decay: float = 0.0) -> tuple[DataFrame, list[float]]:
    """Latents (lin_id, latent) after ``steps`` of Adam on the samples (lin_id, x, y, z, sdf) of their voxels, and each step's mean loss.

    A task sums its gradients by voxel before they are shuffled, so a voxel with
    many samples costs one row a batch; no group of samples meets in one task.
    ``decay`` weighs the sum of the latents' lengths over the number of samples.
    Latents without samples only feel that; samples without a latent don't count.
    """
    shared = samples.sparkSession.sparkContext.broadcast(decoder)
    zero = F.array_repeat(F.lit(0.0), dims)
    state = settle(latents.select("lin_id", "latent", zero.alias("first"), zero.alias("second")), "latents")
    rows = settle(samples.select("lin_id", "x", "y", "z", "sdf").join(state.select("lin_id"), "lin_id", "left_semi"), "samples")
    count, losses = rows.count(), []

    def gradients(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = stacked(frame["latent"], [frame[c] for c in "xyz"])
                loss, g = likelihood_gradient(shared.value, x, frame["sdf"].to_numpy(float), most)
                keys, place = np.unique(frame["lin_id"].to_numpy(), return_inverse=True)
                total = np.zeros((len(keys), dims + 1))
                np.add.at(total, place, np.column_stack([g[:, :dims], loss]))
                yield pd.DataFrame({"lin_id": keys, "g": list(total)})

    for step in range(1, steps + 1):
        if not count:
            break
        met = rows.join(state.select("lin_id", "latent"), "lin_id")
        summed = settle(group_vectors(met.mapInPandas(gradients, "lin_id long, g array<double>"), "lin_id", "g", dims + 1, "sum").withColumnRenamed("g", "_g"), "gradients")
        losses.append(summed.agg(F.sum(F.element_at("_g", dims + 1))).first()[0] / count)
        state = settle(_adam(state.join(summed, "lin_id", "left"), dims, count, step, rate, decay), "latents")
    return state.select("lin_id", "latent"), losses


def _adam(rows: DataFrame, dims: int, count: int, step: int, rate: float, decay: float) -> DataFrame:
    """One step for every latent from its summed gradient ``_g`` (null: none)."""
    size = F.sqrt(F.aggregate("latent", F.lit(0.0), lambda a, v: a + v * v))
    pull = F.when(size > 0, decay / size).otherwise(0.0)
    given = F.coalesce(F.slice("_g", 1, dims), F.array_repeat(F.lit(0.0), dims))
    rows = rows.withColumn("_g", F.zip_with(given, "latent", lambda g, v: (g + pull * v) / count))
    rows = rows.withColumns(
        {
            "first": F.zip_with("first", "_g", lambda m, g: 0.9 * m + 0.1 * g),
            "second": F.zip_with("second", "_g", lambda m, g: 0.999 * m + 0.001 * g * g),
        }
    )

    def change(m: Column, v: Column) -> Column:
        return rate * (m / (1 - 0.9**step)) / (F.sqrt(v / (1 - 0.999**step)) + 1e-8)

    rows = rows.withColumn("_change", F.zip_with("first", "second", change))
    return rows.select("lin_id", F.zip_with("latent", "_change", lambda a, b: a - b).alias("latent"), "first", "second")
