"""Grouped vector aggregation and incrementally merged keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_vectors(df: DataFrame, key: str, vector: str, dims: int, op: str) -> DataFrame:
    """Element-wise ``sum``, ``avg`` or ``max`` of the first ``dims`` elements of an array for each key, with the count.

    One aggregate for each element stays in code generation and combines before the shuffle.
    """
    if op not in ("sum", "avg", "max"):
        raise ValueError(f"unknown reduction: {op}")
    made = [getattr(F, op)(F.element_at(vector, i + 1).cast("double")).alias(f"_{i}") for i in range(dims)]
    grouped = df.groupBy(key).agg(F.count("*").alias("n"), *made)
    return grouped.select(key, "n", F.array(*[f"_{i}" for i in range(dims)]).alias(vector))


def running_mean_merge(state: DataFrame, delta: DataFrame, key: str, freeze_at: float | None = None) -> DataFrame:
    """Merge sums and counts (``key``, ``total`` array, ``n``) into state rows (``key``, ``latent`` array, ``obs_count``).

    latent' = (latent * count + total) / (count + n). A row that has reached
    ``freeze_at`` before the merge stays as it is, so one merge may overshoot.
    """
    both = state.join(delta, key, "full_outer")
    known, came = F.coalesce("obs_count", F.lit(0.0)), F.coalesce("n", F.lit(0)).cast("double")
    if freeze_at is not None:
        came = F.when(known >= freeze_at, 0.0).otherwise(came)
    zero = F.transform(F.coalesce("latent", "total"), lambda x: F.lit(0.0))
    mean = F.zip_with(F.coalesce("latent", zero), F.coalesce("total", zero), lambda a, b: (a * F.col("_known") + F.when(F.col("_came") > 0, b).otherwise(0.0)) / (F.col("_known") + F.col("_came")))
    both = both.withColumns({"_known": known, "_came": came})
    merged = F.when(F.col("_came") > 0, mean).otherwise(F.coalesce("latent", zero))
    return both.select(key, merged.alias("latent"), (F.col("_known") + F.col("_came")).alias("obs_count"))


def deintegrate(state: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """Replace an old contribution (``old``, ``count_old``) by ``new``: (latent * count + (new - old) * count_old) / count."""
    both = state.join(change, key)
    corrected = F.zip_with("latent", F.zip_with("new", "old", lambda a, b: a - b), lambda x, d: (x * F.col("obs_count") + d * F.col("count_old")) / F.col("obs_count"))
    return both.select(key, corrected.alias("latent"), "obs_count")


def replace_by_key(cached: DataFrame, new: DataFrame, key: str, remade: DataFrame | None = None) -> DataFrame:
    """New rows in place of the cached ones of the same keys.

    With ``remade`` (all keys that were made again) a key that made nothing loses
    its rows too; without, it keeps the stale ones.
    """
    gone = (new if remade is None else remade).select(key).distinct()
    return cached.join(gone, key, "left_anti").unionByName(new)


def ordered_ema(df: DataFrame, key: str, order: str, value: str, alpha: float) -> DataFrame:
    """The exponential mean of each key's values in order: alpha weighs the old one; nulls and NaN are skipped.

    Written as a sum: the value at place i of n weighs (1 - alpha) * alpha^(n - i),
    the first alpha^(n - 1). A place's weight needs only counts, which blocks of
    the order give, so no key's values are collected.
    """
    from stratavox.operators.scan import numbered

    rows = numbered(df.where(F.col(value).isNotNull() & ~F.isnan(value)), [key], order)
    last = rows.groupBy(key).agg(F.max("place").alias("last"))
    weight = F.pow(F.lit(alpha), (F.col("last") - F.col("place")).cast("double")) * F.when(F.col("place") == 1, 1.0).otherwise(1 - alpha)
    return rows.join(last, key).groupBy(key).agg(F.sum(weight * F.col(value)).alias("ema"), F.count("*").alias("n"))


def overall(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row (names, mean, total): how many keys have values, and the mean and the sum of their means; null and NaN are no values."""
    means = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key).agg(F.avg(value).alias("_mean"))
    return means.agg(F.count("*").alias("names"), F.avg("_mean").alias("mean"), F.sum("_mean").alias("total"))
