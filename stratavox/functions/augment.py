"""Augmentations of training points. Random numbers are hashes of a key, so every run and retry makes the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratavox.functions.geometry import Vec, cross, normalised, uniform


def seeded(key: Column, name: str) -> Column:
    """A uniform number in [0, 1) for a key and a name."""
    return uniform(F.concat_ws(":", key.cast("string"), F.lit(name)))


def gaussian(key: Column, name: str) -> Column:
    """A standard normal number for a key and a name (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - seeded(key, f"{name}/r"))) * F.cos(2 * math.pi * seeded(key, f"{name}/t"))


def turned(p: Vec, key: Column, axis: str, jitter: float = math.pi / 6) -> Vec:
    """Turn about an axis by a quarter turn or several and up to ``jitter`` more."""
    angle = F.floor(seeded(key, "quarter") * 4) * (math.pi / 2) + seeded(key, "jitter") * jitter
    a, b = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    out = list(p)
    out[a] = p[a] * F.cos(angle) - p[b] * F.sin(angle)
    out[b] = p[a] * F.sin(angle) + p[b] * F.cos(angle)
    return tuple(out)  # type: ignore[return-value]


def moved(p: Vec, key: Column, deviation: float) -> Vec:
    """Gaussian noise on a place."""
    return tuple(x + deviation * gaussian(key, f"move{k}") for k, x in enumerate(p))  # type: ignore[return-value]


def tilted(n: Vec, key: Column, most: float) -> Vec:
    """A direction tilted by up to ``most`` towards a random side."""
    theta, phi = seeded(key, "theta") * most, seeded(key, "phi") * (2 * math.pi)
    flat = F.abs(n[2]) < 0.9
    helper: Vec = (F.when(flat, 0.0).otherwise(1.0), F.lit(0.0), F.when(flat, 1.0).otherwise(0.0))
    u = normalised(cross(helper, n))
    v = cross(n, u)
    return tuple(a * F.cos(theta) + F.sin(theta) * (b * F.cos(phi) + c * F.sin(phi)) for a, b, c in zip(n, u, v, strict=True))  # type: ignore[return-value]
