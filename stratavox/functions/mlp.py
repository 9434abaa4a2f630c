"""Small dense networks with NumPy, applied to columns batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Layer:
    """weight (out, in) and bias; ``again`` tells that the network's input is joined to this layer's."""

    weight: np.ndarray
    bias: np.ndarray
    again: bool = False


def synthetic(sizes: list[int], again: tuple[int, ...] = ()) -> list[Layer]:
    """Deterministic weights: ((7 i + 3 j) mod 11 - 5) / 10 at row i, column j of a layer, biases (i mod 5 - 2) / 10."""
    layers = []
    for k in range(len(sizes) - 1):
        n_in, n_out = sizes[k] + (sizes[0] if k in again else 0), sizes[k + 1]
        i, j = np.mgrid[:n_out, :n_in]
        layers.append(Layer(((7 * i + 3 * j) % 11 - 5) / 10, (np.arange(n_out) % 5 - 2) / 10, k in again))
    return layers


def forward(layers: list[Layer], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The last layer's output (linear) and each layer's input; ReLU between layers."""
    inputs, h = [], x
    for k, layer in enumerate(layers):
        h = np.concatenate([h, x], axis=1) if layer.again else h
        inputs.append(h)
        h = h @ layer.weight.T + layer.bias
        if k < len(layers) - 1:
            h = np.maximum(h, 0)
    return h, inputs


def gradient(layers: list[Layer], x: np.ndarray, output: int = 0) -> np.ndarray:
    """d output / d x for each row, by hand through the layers."""
    _, inputs = forward(layers, x)
    back = np.zeros((len(x), layers[-1].weight.shape[0]))
    back[:, output] = 1
    total = np.zeros_like(x)
    for k in range(len(layers) - 1, -1, -1):
        back = back @ layers[k].weight
        if layers[k].again:
            total += back[:, -x.shape[1] :]
            back = back[:, : -x.shape[1]]
        if k:
            back = back * (inputs[k][:, : back.shape[1]] > 0)
    return total + back


def encode(df: DataFrame, inputs: list[str], layers: list[Layer], out: str = "latent") -> DataFrame:
    """Add the network's output for the columns ``inputs`` as an array."""
    shared = df.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(forward(shared.value, np.stack([c.to_numpy(float) for c in part], axis=1))[0]))

    return df.withColumn(out, run(*inputs))


def decode(df: DataFrame, latent: str, xyz: list[str], layers: list[Layer]) -> DataFrame:
    """Add ``sdf`` = tanh of the first output and ``std`` = 0.05 + softplus(the second) / 2 of the network over latent and place."""
    shared = df.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("sdf double, std double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for code, *place in parts:
            x = np.concatenate([np.stack(code.to_list()), np.stack([c.to_numpy(float) for c in place], axis=1)], axis=1) if len(code) else np.zeros((0, layers_in))
            y = forward(shared.value, x)[0]
            yield pd.DataFrame({"sdf": np.tanh(y[:, 0]), "std": 0.05 + np.logaddexp(0, y[:, 1]) / 2})

    layers_in = layers[0].weight.shape[1]
    return df.withColumn("_d", run(latent, *xyz)).select("*", "_d.sdf", "_d.std").drop("_d")
