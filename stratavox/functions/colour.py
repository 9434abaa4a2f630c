"""Colours as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The corners of the jet colour map, as (place, share) for each channel.
JET = {
    "r": [(0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)],
    "g": [(0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)],
    "b": [(0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)],
}


def jet(value: Column, steps: int = 256) -> dict[str, Column]:
    """Shares of red, green and blue for a value in [0, 1], in ``steps`` colours; values outside take the end's colour, NaN is black, null null."""
    inside = F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0))
    t = F.least(F.floor(inside * steps), F.lit(steps - 1)) / (steps - 1)
    found = {}
    for name, corners in JET.items():
        share = F.lit(corners[-1][1])
        for (p, a), (q, b) in reversed(list(zip(corners, corners[1:], strict=False))):
            share = F.when(t <= q, (t - p) / (q - p) * (b - a) + a).otherwise(share)
        found[name] = F.when(value.isNull(), None).when(F.isnan(value), 0.0).otherwise(share)
    return found
