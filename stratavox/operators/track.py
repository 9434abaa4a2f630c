"""Iterative pose estimation: each step is one Spark aggregate to the normal equations, solved on the driver."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from stratavox.functions.pose import se3_exp
from stratavox.operators.image import normal_equations

Residuals = Callable[[np.ndarray], DataFrame]


@dataclass
class Result:
    pose: np.ndarray
    energies: list[float]
    tracked: bool


def solve(residuals: DataFrame) -> tuple[np.ndarray, np.ndarray, float, int]:
    """H, g, E and the number of rows of residuals (f, j0 .. j5)."""
    row = normal_equations(residuals).first()
    h = np.zeros((6, 6))
    for a in range(6):
        for b in range(a, 6):
            h[a, b] = h[b, a] = row[f"h{a}{b}"]
    return h, np.array([row[f"g{k}"] for k in range(6)]), row["e"], row["m"]


def gauss_newton(residuals: Residuals, start: np.ndarray, steps: int) -> Result:
    """Left-multiplied steps exp(xi) T; a step that raises the energy is taken back and ends the loop.

    Without any residual row, or with a singular system, the pose stays and is not tracked.
    """
    pose, before, energies = start, start, []
    for step in range(steps + 1):  # the last only checks
        h, g, e, m = solve(residuals(pose))
        if not m:
            return Result(before, energies, False)
        if energies and e > energies[-1]:
            return Result(before, energies, True)
        energies.append(e)
        if step == steps:
            break
        try:
            xi = np.linalg.solve(h, -g)
        except np.linalg.LinAlgError:
            return Result(pose, energies, False)
        before, pose = pose, se3_exp(xi) @ pose
    return Result(pose, energies, True)


def levenberg_marquardt(residuals: Residuals, start: np.ndarray, steps: int, damping: float = 1e-4) -> Result:
    """As :func:`gauss_newton`, with a damped diagonal that grows on a failed step and shrinks on a good one."""
    pose = start
    h, g, e, m = solve(residuals(pose))
    energies = [e]
    if not m:
        return Result(pose, energies, False)
    for _ in range(steps):
        xi = np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), -g)
        tried = se3_exp(xi) @ pose
        h2, g2, e2, m2 = solve(residuals(tried))
        if m2 and e2 < e:
            pose, h, g, e = tried, h2, g2, e2
            energies.append(e)
            damping = max(damping / 3, 1e-7)
            if np.linalg.norm(xi) < 1e-10:
                break
        else:
            damping = min(damping * 2, 1e7)
            if damping >= 1e7:
                break
    return Result(pose, energies, True)


@dataclass
class Term:
    """A term of the energy: its residuals at a pose, and the weight of all its sums."""

    residuals: Residuals
    weight: float = 1.0


@dataclass
class Stability:
    """Counts frames whose last group stopped late; from ``most`` on the weight of ``term`` is raised to ``weight`` at least."""

    term: str
    late: int = 10
    most: int = 3
    weight: float = 500.0
    events: int = 0

    def note(self, stopped_at: int, terms: dict[str, Term]) -> None:
        if stopped_at >= self.late:
            self.events += 1
            if self.events >= self.most:
                terms[self.term].weight = max(terms[self.term].weight, self.weight)


def scheduled(groups: list[tuple[int, list[str]]], terms: dict[str, Term], start: np.ndarray, stability: Stability | None = None) -> Result:
    """Gauss-Newton steps in groups of (number of steps, names of the terms that are summed), the pose handed on from group to group.

    Each group ends with a step that only checks; a step that raised the group's
    energy is taken back and ends the group. Every term is one Spark aggregate a
    step. The step at which the last group stopped early is noted in
    ``stability``. A group without residual rows, or a singular system, ends the
    whole schedule, not tracked.
    """
    pose, energies = start, []
    stopped_at = -1
    for steps, names in groups:
        before, last, stopped_at = pose, np.inf, -1
        for step in range(steps + 1):
            parts = [(terms[n].weight, *solve(terms[n].residuals(pose))) for n in names]
            if not sum(m for *_, m in parts):
                return Result(pose, energies, False)
            energy = sum(w * e for w, _, _, e, _ in parts)
            if energy > last:
                pose, stopped_at = before, step if step < steps else -1
                break
            before, last = pose, energy
            energies.append(energy)
            if step < steps:
                try:
                    xi = np.linalg.solve(sum(w * h for w, h, *_ in parts), -sum(w * g for w, _, g, *_ in parts))
                except np.linalg.LinAlgError:
                    return Result(pose, energies, False)
                pose = se3_exp(xi) @ pose
    if stability is not None:
        stability.note(stopped_at, terms)
    return Result(pose, energies, True)
