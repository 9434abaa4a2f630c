"""Data-parallel training of small networks: gradients by partition, summed on Spark, one Adam step on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions.mlp import Layer, forward


def flat(layers: list[Layer]) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in (layer.weight, layer.bias)])


def shaped(layers: list[Layer], values: np.ndarray) -> list[Layer]:
    out, at = [], 0
    for layer in layers:
        w, b = layer.weight.size, layer.bias.size
        out.append(Layer(values[at : at + w].reshape(layer.weight.shape), values[at + w : at + w + b], layer.again))
        at += w + b
    return out


def loss_gradient(layers: list[Layer], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """The summed squared error of the first output, halved, and its gradient over all weights."""
    out, inputs = forward(layers, x)
    error = out[:, 0] - y
    back = np.zeros_like(out)
    back[:, 0] = error
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts = [(back.T @ inputs[k]).ravel(), back.sum(0), *parts]
        back = back @ layers[k].weight
        if layers[k].again:
            back = back[:, : -x.shape[1]]
        if k:
            back = back * (inputs[k][:, : back.shape[1]] > 0)
    return float(error @ error / 2), np.concatenate(parts)


def fit(rows: DataFrame, inputs: list[str], target: str, layers: list[Layer], steps: int, rate: float) -> tuple[list[Layer], list[float]]:
    """``steps`` of Adam over all rows; what comes to the driver is one number for each weight. Returns the layers and each step's mean loss."""
    values, first, second, losses = flat(layers), 0.0, 0.0, []
    for step in range(1, steps + 1):
        shared = rows.sparkSession.sparkContext.broadcast(shaped(layers, values))

        def gradients(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            total, loss, n = None, 0.0, 0
            for frame in frames:
                part, g = loss_gradient(shared.value, frame[inputs].to_numpy(float), frame[target].to_numpy(float))
                total, loss, n = g if total is None else total + g, loss + part, n + len(frame)
            if total is not None:
                yield pd.DataFrame({"place": np.arange(len(total) + 2), "value": np.concatenate([total, [loss, n]])})

        summed = rows.select(*inputs, target).mapInPandas(gradients, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
        found = summed.orderBy("place").toPandas()["value"].to_numpy()
        shared.unpersist()
        if not len(found):
            return layers, losses
        g, loss, n = found[:-2] / found[-1], found[-2], found[-1]
        losses.append(float(loss / n))
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        values = values - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return shaped(layers, values), losses
