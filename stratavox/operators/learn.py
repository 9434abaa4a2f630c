"""Training of encoder and decoder together: latents pooled from surface points, gradients summed on Spark, each network's weights moved by a rate of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.functions import mlp
from stratavox.functions.heads import Decoder, stacked
from stratavox.functions.mlp import Layer
from stratavox.operators.reduce import group_vectors
from stratavox.operators.sample import batches
from stratavox.operators.train import flat, shaped
from stratavox.sources.settings import read_snapshot, write_snapshot
from stratavox.sources.shared import fresh_path, settle

SURFACE = ["x", "y", "z", "nx", "ny", "nz"]


@dataclass(frozen=True)
class Moments:
    """Weights of one network in a row, with Adam's moments after ``step`` steps."""

    values: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0

    @classmethod
    def of(cls, layers: list[Layer]) -> Moments:
        values = flat(layers)
        return cls(values, np.zeros_like(values), np.zeros_like(values))

    def moved(self, gradient: np.ndarray, rate: float) -> Moments:
        step = self.step + 1
        first, second = 0.9 * self.first + 0.1 * gradient, 0.999 * self.second + 0.001 * gradient**2
        change = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        return Moments(self.values - change, first, second, step)


@dataclass(frozen=True)
class Loss:
    """Negative log likelihood with distances clamped to ``most``, and the latents' lengths weighed by ``length``, which ramps up over ``ramp`` epochs."""

    most: float = 0.2
    length: float = 0.0
    ramp: int = 100

    def pull(self, epoch: int) -> float:
        return self.length * min(1.0, epoch / self.ramp)


@dataclass(frozen=True)
class Trainer:
    """Both networks' weights and moments.

    ``rates`` are functions of the epoch, for decoder and encoder. ``splits`` is
    the number of parts in which a batch's gradients are summed one after another.
    """

    decoder: Decoder
    encoder: list[Layer]
    rates: tuple[Callable[[int], float], Callable[[int], float]]
    loss: Loss = Loss()
    splits: int = 1
    epoch: int = 0
    state: tuple[Moments, Moments] | None = None
    losses: list[float] = field(default_factory=list)

    def networks(self) -> tuple[Decoder, list[Layer]]:
        """Decoder and encoder with the weights reached."""
        if self.state is None:
            return self.decoder, self.encoder
        *body, distance, deviation = shaped(_layers(self.decoder), self.state[0].values)
        return Decoder(body, distance, deviation), shaped(self.encoder, self.state[1].values)

    # one step

    def latents(self, surface: DataFrame) -> DataFrame:
        """(lin_id, n, latent): the mean of the encoder's output over each voxel's surface points."""
        _, encoder = self.networks()
        return group_vectors(mlp.encode(surface, SURFACE, encoder), "lin_id", "latent", encoder[-1].weight.shape[0], "avg")

    def gradients(self, samples: DataFrame, surface: DataFrame, epoch: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The mean loss's gradients by all weights of decoder and encoder, and the loss.

        Samples (lin_id, x, y, z, sdf) meet their voxel's latent; tasks sum what
        each voxel's latent and all weights get. Each voxel's part then goes back to
        its surface points. What comes to the driver is a number for each weight. Samples
        of voxels without surface points don't count.
        """
        decoder, encoder = self.networks()
        codes = settle(self.latents(surface), "codes")
        met = samples.select("lin_id", "x", "y", "z", "sdf").join(codes.select("lin_id", "latent"), "lin_id")
        total, by_code = None, None
        for part in range(self.splits):
            mine = met if self.splits == 1 else met.where(F.pmod(F.xxhash64("x", "y", "z", "sdf"), F.lit(self.splits)) == part)
            rows = settle(_decoder_gradients(mine, decoder, self.loss, self.loss.pull(epoch)), "gradients")
            found = _summed(rows.where("lin_id IS NULL"), len(flat(_layers(decoder))) + 2)
            total = found if total is None else total + found
            own = rows.where("lin_id IS NOT NULL")
            by_code = own if by_code is None else by_code.unionByName(own)
        if not total[-1]:
            return np.zeros(len(total) - 2), np.zeros(len(flat(encoder))), 0.0
        pulled = group_vectors(by_code, "lin_id", "g", encoder[-1].weight.shape[0], "sum").select("lin_id", "g")
        back = pulled.join(codes.select("lin_id", F.col("n").alias("_n")), "lin_id")
        back = back.select("lin_id", F.transform("g", lambda v: v / F.col("_n")).alias("g"))
        through = _summed(_encoder_gradients(surface.select("lin_id", *SURFACE).join(back, "lin_id"), encoder), len(flat(encoder)))
        return total[:-2] / total[-1], through / total[-1], float(total[-2] / total[-1])

    def stepped(self, samples: DataFrame, surface: DataFrame, epoch: int) -> Trainer:
        by_decoder, by_encoder, loss = self.gradients(samples, surface, epoch)
        state = self.state or (Moments.of(_layers(self.decoder)), Moments.of(self.encoder))
        moved = tuple(s.moved(g, rate(epoch)) for s, g, rate in zip(state, (by_decoder, by_encoder), self.rates, strict=True))
        return replace(self, state=moved, losses=[*self.losses, loss])

    # epochs

    def fit(self, samples: DataFrame, surface: DataFrame, epochs: int, batch: int | None = None, snapshots: tuple[int, ...] = (), path: str = "") -> Trainer:
        """Train up to epoch ``epochs``, ``batch`` voxels a step (all if None; the last, partial batch is dropped), in an order of its own each epoch.

        An epoch's batches are written by batch, so a step reads its own rows only.
        Epochs in ``snapshots`` are written to ``path``; :func:`resumed` goes on from there.
        """
        now = self
        for epoch in range(self.epoch + 1, epochs + 1):
            if batch is None:
                now = now.stepped(samples, surface, epoch)
            else:
                for part in _dealt(samples, surface, batch, epoch):
                    now = now.stepped(*part, epoch)
            now = replace(now, epoch=epoch)
            if epoch in snapshots:
                now.save(samples.sparkSession, path)
        return now

    def save(self, spark: SparkSession, path: str) -> None:
        tables = {}
        for name, s in zip(("decoder", "encoder"), self.state, strict=True):
            rows = [(k, *map(float, v), s.step) for k, v in enumerate(zip(s.values, s.first, s.second, strict=True))]
            tables[name] = spark.createDataFrame(rows, "place long, value double, first double, second double, step long")
        tables["losses"] = spark.createDataFrame([(k, float(x)) for k, x in enumerate(self.losses)], "place long, loss double")
        write_snapshot(path, self.epoch, tables)

    def resumed(self, spark: SparkSession, path: str, epoch: int) -> Trainer:
        """This trainer as it was saved after ``epoch``."""
        state = []
        for name in ("decoder", "encoder"):
            rows = read_snapshot(spark, path, name, epoch).orderBy("place").toPandas()
            state.append(Moments(*(rows[c].to_numpy() for c in ("value", "first", "second")), int(rows["step"][0])))
        losses = [r.loss for r in read_snapshot(spark, path, "losses", epoch).orderBy("place").collect()]
        return replace(self, state=tuple(state), epoch=epoch, losses=losses)


def _layers(decoder: Decoder) -> list[Layer]:
    return [*decoder.body, decoder.distance, decoder.deviation]


def _dealt(samples: DataFrame, surface: DataFrame, size: int, epoch: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The samples and surface points of each batch of voxels; the order of the voxels is another one each epoch."""
    voxels = surface.select("lin_id").distinct().withColumn("_key", F.concat_ws(":", F.col("lin_id").cast("string"), F.lit(str(epoch))))
    order = settle(batches(voxels, "_key", size).select("lin_id", F.col("batch").cast("long").alias("batch")), "order")
    count = (order.agg(F.max("batch")).first()[0] or 0) + 1 if not order.isEmpty() else 0
    laid = [settle_by(df.join(order, "lin_id"), "batch") for df in (samples, surface)]
    for k in range(count):
        yield laid[0].where(F.col("batch") == k), laid[1].where(F.col("batch") == k)


def settle_by(df: DataFrame, column: str) -> DataFrame:
    """:func:`settle` with a folder for each value of a column, so a filter on it reads its own rows only."""
    path = fresh_path(df.sparkSession, "by")
    df.repartition(column).write.partitionBy(column).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def decoder_gradient(decoder: Decoder, x: np.ndarray, by_sdf: np.ndarray, by_std: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient over all weights, summed over the rows, and over each row's input, from the derivatives by both outputs."""
    h, outputs = decoder.features(x)
    sdf = np.tanh((h @ decoder.distance.weight.T + decoder.distance.bias)[:, 0])
    spread = (h @ decoder.deviation.weight.T + decoder.deviation.bias)[:, 0]
    ends = [(by_sdf * (1 - sdf * sdf))[:, None], (by_std * np.exp(-np.logaddexp(0, -spread)) / 2)[:, None]]
    parts = [p for e in ends for p in ((e.T @ h).ravel(), e.sum(0))]
    back = ends[0] * decoder.distance.weight + ends[1] * decoder.deviation.weight
    by_input = np.zeros_like(x)
    for k in range(len(decoder.body) - 1, -1, -1):
        layer = decoder.body[k]
        given = outputs[k - 1] if k else x
        given = np.concatenate([given, x], axis=1) if layer.again else given
        back = back * (outputs[k] > 0)
        parts = [(back.T @ given).ravel(), back.sum(0), *parts]
        back = back @ layer.weight
        if layer.again:
            by_input += back[:, -x.shape[1] :]
            back = back[:, : -x.shape[1]]
    return np.concatenate(parts), by_input + back


def encoder_gradient(layers: list[Layer], x: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The gradient over all weights, summed over the rows, from the derivatives by the outputs."""
    _, inputs = mlp.forward(layers, x)
    parts: list[np.ndarray] = []
    for k in range(len(layers) - 1, -1, -1):
        parts = [(back.T @ inputs[k]).ravel(), back.sum(0), *parts]
        back = back @ layers[k].weight
        if layers[k].again:
            back = back[:, : -x.shape[1]]
        if k:
            back = back * (inputs[k][:, : back.shape[1]] > 0)
    return np.concatenate(parts)


def _decoder_gradients(met: DataFrame, decoder: Decoder, loss: Loss, pull: float) -> DataFrame:
    """(lin_id, g): for each voxel of a batch of rows its latent's summed gradient, and with a null id all weights', the loss and the number of samples, once for a task."""
    shared = met.sparkSession.sparkContext.broadcast(decoder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if not len(frame):
                continue
            x = stacked(frame["latent"], [frame[c] for c in "xyz"])
            dims = x.shape[1] - 3
            mean, std = shared.value.run(x)
            error = np.clip(mean, -loss.most, loss.most) - np.clip(frame["sdf"].to_numpy(float), -loss.most, loss.most)
            by_sdf = np.where(np.abs(mean) <= loss.most, error / std**2, 0.0)
            g, by_input = decoder_gradient(shared.value, x, by_sdf, 1 / std - error**2 / std**3)
            size = np.sqrt((x[:, :dims] ** 2).sum(1))
            by_code = by_input[:, :dims] + pull * x[:, :dims] / np.where(size > 0, size, 1)[:, None]
            value = (error**2 / (2 * std**2) + np.log(std) + 0.5 * np.log(2 * np.pi) + pull * size).sum()
            g = np.concatenate([g, [value, len(x)]])
            total = g if total is None else total + g
            keys, place = np.unique(frame["lin_id"].to_numpy(), return_inverse=True)
            sums = np.zeros((len(keys), dims))
            np.add.at(sums, place, by_code)
            yield pd.DataFrame({"lin_id": pd.array(keys, "Int64"), "g": list(sums)})
        if total is not None:
            yield pd.DataFrame({"lin_id": pd.array([None], "Int64"), "g": [total]})

    return met.mapInPandas(run, "lin_id long, g array<double>")


def _encoder_gradients(points: DataFrame, layers: list[Layer]) -> DataFrame:
    """(lin_id, g): all weights' gradient, once for a task, from what each point's output gets (column ``g``)."""
    shared = points.sparkSession.sparkContext.broadcast(layers)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                g = encoder_gradient(shared.value, frame[SURFACE].to_numpy(float), np.stack(frame["g"].to_list()))
                total = g if total is None else total + g
        if total is not None:
            yield pd.DataFrame({"lin_id": pd.array([None], "Int64"), "g": [total]})

    return points.mapInPandas(run, "lin_id long, g array<double>")


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """The sum of arrays of one length, place by place; zeros without rows."""
    places = rows.select(F.posexplode("g").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in places.collect():  # as many rows as weights
        out[row.place] = row.value
    return out
