"""Rigid motions with NumPy: small driver-side helpers of the pose loops. Twists are (translation, rotation)."""

from __future__ import annotations

import numpy as np


def wedge(phi: np.ndarray) -> np.ndarray:
    """The skew matrix of a vector."""
    x, y, z = phi
    return np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]], float)


def vee(matrix: np.ndarray) -> np.ndarray:
    return np.array([matrix[2, 1], matrix[0, 2], matrix[1, 0]])


def so3_exp(phi: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(phi))
    k = wedge(phi)
    if angle < 1e-8:
        return np.eye(3) + k + k @ k / 2
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def so3_log(rotation: np.ndarray) -> np.ndarray:
    angle = float(np.arccos(np.clip((np.trace(rotation) - 1) / 2, -1, 1)))
    if angle < 1e-8:
        return vee(rotation - rotation.T) / 2
    if np.pi - angle < 1e-6:  # the skew part vanishes: the axis is a column of R + I
        columns = rotation + np.eye(3)
        axis = columns[:, np.argmax(np.linalg.norm(columns, axis=0))]
        axis = axis / np.linalg.norm(axis)
        sign = np.sign(vee(rotation - rotation.T) @ axis) or 1.0
        return angle * sign * axis
    return angle / (2 * np.sin(angle)) * vee(rotation - rotation.T)


def left_jacobian(phi: np.ndarray) -> np.ndarray:
    angle = float(np.linalg.norm(phi))
    k = wedge(phi)
    if angle < 1e-6:
        return np.eye(3) + k / 2 + k @ k / 6
    return np.eye(3) + (1 - np.cos(angle)) / angle**2 * k + (angle - np.sin(angle)) / angle**3 * k @ k


def se3_exp(xi: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = so3_exp(xi[3:])
    out[:3, 3] = left_jacobian(xi[3:]) @ xi[:3]
    return out


def se3_log(pose: np.ndarray) -> np.ndarray:
    phi = so3_log(pose[:3, :3])
    return np.concatenate([np.linalg.solve(left_jacobian(phi), pose[:3, 3]), phi])


def inverse(pose: np.ndarray) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3] = pose[:3, :3].T
    out[:3, 3] = -pose[:3, :3].T @ pose[:3, 3]
    return out


def adjoint(pose: np.ndarray) -> np.ndarray:
    r, t = pose[:3, :3], pose[:3, 3]
    return np.block([[r, wedge(t) @ r], [np.zeros((3, 3)), r]])


def nearest_rotation(matrix: np.ndarray) -> np.ndarray:
    """The closest rotation, by singular values, with determinant 1."""
    u, _, v = np.linalg.svd(matrix)
    return u @ np.diag([1, 1, np.sign(np.linalg.det(u @ v))]) @ v


def from_quaternion(x: float, y: float, z: float, w: float, t: np.ndarray) -> np.ndarray:
    q = np.array([x, y, z, w], float)
    x, y, z, w = q / np.linalg.norm(q)
    out = np.eye(4)
    out[:3, :3] = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
        [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
        [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
    ]
    out[:3, 3] = t
    return out


def interpolate(a: np.ndarray, b: np.ndarray, alpha: float) -> np.ndarray:
    """Rotation along the shortest turn, translation along the line."""
    out = np.eye(4)
    out[:3, :3] = a[:3, :3] @ so3_exp(alpha * so3_log(a[:3, :3].T @ b[:3, :3]))
    out[:3, 3] = (1 - alpha) * a[:3, 3] + alpha * b[:3, 3]
    return out


def look_at(source: np.ndarray, target: np.ndarray, up: np.ndarray) -> np.ndarray:
    """The pose at ``source`` whose z axis points at ``target``, its y axis away from ``up``."""
    z = target - source
    z = z / np.linalg.norm(z)
    x = np.cross(z, up)
    x = x / np.linalg.norm(x)
    out = np.eye(4)
    out[:3, :3] = np.stack([x, np.cross(z, x), z], axis=1)
    out[:3, 3] = source
    return out


def curly_wedge(xi: np.ndarray) -> np.ndarray:
    """The 6 x 6 matrix by which one twist acts on another."""
    turn = wedge(xi[3:])
    return np.block([[turn, wedge(xi[:3])], [np.zeros((3, 3)), turn]])


def se3_left_jacobian(xi: np.ndarray, terms: int = 40) -> np.ndarray:
    """The Jacobian J with exp(xi + d) = exp(J d) exp(xi) to first order, by its power series (``terms`` are enough for turns up to some full ones)."""
    act, term, total = curly_wedge(xi), np.eye(6), np.eye(6)
    for n in range(1, terms):
        term = term @ act / (n + 1)
        total = total + term
    return total


def se3_inverse_left_jacobian(xi: np.ndarray) -> np.ndarray:
    return np.linalg.inv(se3_left_jacobian(xi))


def continuous(pose: np.ndarray) -> np.ndarray:
    """Nine numbers: the rotation's first two columns and the translation."""
    return np.concatenate([pose[:3, 0], pose[:3, 1], pose[:3, 3]])


def from_continuous(numbers: np.ndarray, orthonormal: bool = True) -> np.ndarray:
    """The pose of nine numbers; the columns are made orthonormal unless they are known to be, and the third is their cross product."""
    a, b, t = np.asarray(numbers, float).reshape(3, 3)
    if orthonormal:
        a = a / np.linalg.norm(a)
        b = b - (a @ b) * a
        b = b / np.linalg.norm(b)
    out = np.eye(4)
    out[:3] = np.stack([a, b, np.cross(a, b), t], axis=1)
    return out


def full(pose: np.ndarray) -> np.ndarray:
    """Twelve numbers: the rotation's columns and the translation."""
    return pose[:3].T.ravel()


def from_full(numbers: np.ndarray, orthonormal: bool = False) -> np.ndarray:
    """The pose of twelve numbers, with the nearest rotation if asked for."""
    out = np.eye(4)
    out[:3] = np.asarray(numbers, float).reshape(4, 3).T
    if orthonormal:
        out[:3, :3] = nearest_rotation(out[:3, :3])
    return out


def random_pose(seed: int, spread: float = 1.0) -> np.ndarray:
    """A pose with an evenly distributed rotation and a normal translation, the same for one seed."""
    made = np.random.default_rng(seed)
    return from_quaternion(*made.normal(size=4), made.normal(scale=spread, size=3))


def to_gl_camera(pose: np.ndarray) -> np.ndarray:
    """The same camera with its y axis up and looking along negative z."""
    return pose @ np.diag([1.0, -1.0, -1.0, 1.0])


def tangent(pose: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A path's control pose at ``pose`` between its neighbours: half the way between them, and the turn that evens out theirs."""
    turns = so3_log(pose[:3, :3].T @ before[:3, :3]) + so3_log(pose[:3, :3].T @ after[:3, :3])
    out = np.eye(4)
    out[:3, :3] = pose[:3, :3] @ so3_exp(-turns / 4)
    out[:3, 3] = (after[:3, 3] - before[:3, 3]) / 2
    return out
