"""Networks as the voxel map uses them: norms folded into dense layers, and a decoder with two heads and its gradient."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.functions.mlp import Layer


def batch_normed(layer: Layer, gain: np.ndarray, shift: np.ndarray, mean: np.ndarray, variance: np.ndarray, eps: float = 1e-5) -> Layer:
    """A layer and the batch norm after it, with its running statistics, as one layer."""
    scale = gain / np.sqrt(variance + eps)
    return Layer(layer.weight * scale[:, None], (layer.bias - mean) * scale + shift, layer.again)


def weight_normed(layer: Layer, length: np.ndarray) -> Layer:
    """A layer whose weight rows have the directions of ``layer``'s and the given lengths."""
    return Layer(layer.weight * (length / np.linalg.norm(layer.weight, axis=1))[:, None], layer.bias, layer.again)


@dataclass(frozen=True)
class Decoder:
    """``body`` with ReLU after each layer; both heads (one row each) read its features."""

    body: list[Layer]
    distance: Layer
    deviation: Layer

    def features(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """What the heads read, and each body layer's output."""
        h, outputs = x, []
        for layer in self.body:
            h = np.concatenate([h, x], axis=1) if layer.again else h
            h = np.maximum(h @ layer.weight.T + layer.bias, 0)
            outputs.append(h)
        return h, outputs

    def run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signed distance and deviation of each row."""
        h, _ = self.features(x)
        spread = (h @ self.deviation.weight.T + self.deviation.bias)[:, 0]
        return np.tanh((h @ self.distance.weight.T + self.distance.bias)[:, 0]), 0.05 + np.logaddexp(0, spread) / 2

    def gradient(self, x: np.ndarray, by_sdf: np.ndarray, by_std: np.ndarray) -> np.ndarray:
        """d loss / d x of each row, from the loss's derivatives by both outputs."""
        h, outputs = self.features(x)
        sdf = np.tanh((h @ self.distance.weight.T + self.distance.bias)[:, 0])
        spread = (h @ self.deviation.weight.T + self.deviation.bias)[:, 0]
        rise = np.exp(-np.logaddexp(0, -spread)) / 2
        back = (by_sdf * (1 - sdf * sdf))[:, None] * self.distance.weight + (by_std * rise)[:, None] * self.deviation.weight
        total = np.zeros_like(x)
        for layer, out in zip(reversed(self.body), reversed(outputs), strict=True):
            back = (back * (out > 0)) @ layer.weight
            if layer.again:
                total += back[:, -x.shape[1] :]
                back = back[:, : -x.shape[1]]
        return total + back


def stacked(code: pd.Series, place: list[pd.Series]) -> np.ndarray:
    """Latents and places side by side, a row each."""
    return np.concatenate([np.stack(code.to_list()), np.stack([c.to_numpy(float) for c in place], axis=1)], axis=1)


def decode(df: DataFrame, latent: str, xyz: list[str], decoder: Decoder, chunk: int = 65536) -> DataFrame:
    """Add ``sdf`` and ``std`` of each row's latent and place. At most ``chunk`` rows go through the network at once, however large the Arrow batch."""
    shared = df.sparkSession.sparkContext.broadcast(decoder)

    @F.pandas_udf("sdf double, std double")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for code, *place in parts:
            made = [shared.value.run(stacked(code[a : a + chunk], [c[a : a + chunk] for c in place])) for a in range(0, len(code), chunk)]
            sdf, std = (np.concatenate(x) for x in zip(*made, strict=True)) if made else (np.zeros(0), np.zeros(0))
            yield pd.DataFrame({"sdf": sdf, "std": std})

    return df.withColumn("_d", run(latent, *xyz)).select("*", "_d.sdf", "_d.std").drop("_d")
