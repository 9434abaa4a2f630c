"""Losses, robust kernels and schedules by the names that configurations use. An unknown name is an error that lists the known ones."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratavox.functions import geometry as geo

_FOUND: dict[str, dict[str, Callable]] = {}


def register(kind: str, name: str, function: Callable) -> Callable:
    """Keep ``function`` under a kind and a name; a name is given once."""
    known = _FOUND.setdefault(kind, {})
    if name in known:
        raise ValueError(f"{kind} {name!r} is there already")
    known[name] = function
    return function


def get(kind: str, name: str) -> Callable:
    """The function of a kind by its name."""
    known = _FOUND.get(kind, {})
    if name not in known:
        raise KeyError(f"no {kind} is named {name!r}; known: {', '.join(sorted(known)) or 'none'}")
    return known[name]


def names(kind: str) -> list[str]:
    return sorted(_FOUND.get(kind, {}))


def neg_log_likelihood(prediction: Column, deviation: Column, target: Column, most: float) -> Column:
    """The negative log likelihood of clamped distances."""
    return -geo.normal_log_prob(geo.clamp(prediction, most), deviation, geo.clamp(target, most))


def l1(prediction: Column, deviation: Column, target: Column, most: float) -> Column:
    """The absolute difference of clamped distances; the deviation isn't read."""
    return F.abs(geo.clamp(prediction, most) - geo.clamp(target, most))


def no_weight(x: Column, k: float = math.inf) -> Column:
    return F.lit(1.0)


register("loss", "neg_log_likelihood", neg_log_likelihood)
register("loss", "l1", l1)
register("robust kernel", "huber", geo.huber_weight)
register("robust kernel", "tukey", geo.tukey_weight)
register("robust kernel", "none", no_weight)
register("schedule", "step", geo.step_rate)
register("schedule", "warmup", geo.warmup_rate)
register("schedule", "constant", lambda epoch, value: F.lit(float(value)))
