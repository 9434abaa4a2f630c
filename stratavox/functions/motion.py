"""Poses as Columns: a unit quaternion and a translation in each row, composed, turned round and interpolated by the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratavox.functions.geometry import Vec, add, cross, dot, length, normalised, sub

Matrix = list[list[Column]]


def _times(s: Column | float, a: Vec) -> Vec:
    return tuple(x * s for x in a)  # type: ignore[return-value]


def wedge(a: Vec) -> Matrix:
    """The skew matrix of a vector."""
    x, y, z = a
    o = F.lit(0.0)
    return [[o, -z, y], [z, o, -x], [-y, x, o]]


def product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum((x * b[k][j] for k, x in enumerate(row) if k), row[0] * b[0][j]) for j in range(len(b[0]))] for row in a]


@dataclass(frozen=True)
class Pose:
    """p -> rotation by ``v``, ``w`` (a unit quaternion's vector and scalar) + ``t``."""

    v: Vec
    w: Column
    t: Vec

    @staticmethod
    def read(pose: str | Column) -> Pose:
        """The pose of a struct column (qx, qy, qz, qw, tx, ty, tz); the quaternion is brought to length 1."""
        p = F.col(pose) if isinstance(pose, str) else pose
        q = [p[n] for n in ("qx", "qy", "qz", "qw")]
        n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
        return Pose((q[0] / n, q[1] / n, q[2] / n), q[3] / n, (p["tx"], p["ty"], p["tz"]))

    def struct(self) -> Column:
        return F.struct(*[c.alias(n) for c, n in zip((*self.v, self.w, *self.t), ("qx", "qy", "qz", "qw", "tx", "ty", "tz"), strict=True)])

    def turned(self, p: Vec) -> Vec:
        """A direction turned by the pose."""
        twice = _times(2.0, cross(self.v, p))
        return add(p, add(_times(self.w, twice), cross(self.v, twice)))

    def moved(self, p: Vec) -> Vec:
        return add(self.turned(p), self.t)

    def inverse(self) -> Pose:
        back = Pose(_times(-1.0, self.v), self.w, self.t)
        return Pose(back.v, back.w, _times(-1.0, back.turned(self.t)))

    def after(self, first: Pose) -> Pose:
        """The pose that moves by ``first`` and then by this one."""
        v = add(add(_times(self.w, first.v), _times(first.w, self.v)), cross(self.v, first.v))
        return Pose(v, self.w * first.w - dot(self.v, first.v), self.moved(first.t))

    def rotation(self) -> Matrix:
        one, o = F.lit(1.0), F.lit(0.0)
        columns = [self.turned(e) for e in ((one, o, o), (o, one, o), (o, o, one))]
        return [[c[r] for c in columns] for r in range(3)]

    def adjoint(self) -> Matrix:
        """The 6 x 6 matrix that carries twists (translation, rotation) through the pose."""
        r = self.rotation()
        zeros = [F.lit(0.0)] * 3
        return [a + b for a, b in zip(r, product(wedge(self.t), r), strict=True)] + [zeros + row for row in r]

    def log(self) -> Vec:
        """The rotation's vector, of length 0 to pi."""
        sign = F.when(self.w < 0, -1.0).otherwise(1.0)
        n = length(self.v)
        return _times(F.when(n > 1e-12, 2 * F.atan2(n, F.abs(self.w)) / n).otherwise(2.0) * sign, self.v)

    def interpolate(self, other: Pose, alpha: Column) -> Pose:
        """The rotation along the shortest turn, the translation along the line; alpha 0 is this pose."""
        cos = dot(self.v, other.v) + self.w * other.w
        sign = F.when(cos < 0, -1.0).otherwise(1.0)
        angle = F.acos(F.least(F.abs(cos), F.lit(1.0)))
        far = F.sin(angle) > 1e-9
        a = F.when(far, F.sin((1 - alpha) * angle) / F.sin(angle)).otherwise(1 - alpha)
        b = F.when(far, F.sin(alpha * angle) / F.sin(angle)).otherwise(alpha) * sign
        t = add(_times(1 - alpha, self.t), _times(alpha, other.t))
        return Pose(add(_times(a, self.v), _times(b, other.v)), self.w * a + other.w * b, t)


def from_rotation(m: Matrix, t: Vec) -> Pose:
    """The pose of a rotation matrix, by the largest of the quaternion's four numbers."""
    trace = m[0][0] + m[1][1] + m[2][2]
    squares = [1 + 2 * m[k][k] - trace for k in range(3)] + [1 + trace]  # 4 x the square of x, y, z, w
    skew = (m[2][1] - m[1][2], m[0][2] - m[2][0], m[1][0] - m[0][1])
    both = [m[0][1] + m[1][0], m[0][2] + m[2][0], m[1][2] + m[2][1]]
    forms = [
        (squares[0], both[0], both[1], skew[0]),
        (both[0], squares[1], both[2], skew[1]),
        (both[1], both[2], squares[2], skew[2]),
        (*skew, squares[3]),
    ]
    most = F.greatest(*squares)
    root = 2 * F.sqrt(most)
    pick = lambda k: F.when(squares[3] == most, forms[3][k]).when(squares[0] == most, forms[0][k]).when(squares[1] == most, forms[1][k]).otherwise(forms[2][k]) / root
    return Pose((pick(0), pick(1), pick(2)), pick(3), t)


def orthonormal(a: Vec, b: Vec) -> Matrix:
    """The rotation whose first two columns are ``a`` and ``b`` made orthonormal, the third their cross product; NaN where they have no direction."""
    x = normalised(a)
    y = normalised(sub(b, _times(dot(x, b), x)))
    columns = [x, y, cross(x, y)]
    return [[c[r] for c in columns] for r in range(3)]


def look_at(source: Vec, target: Vec, up: Vec) -> Pose:
    """The pose at ``source`` whose z axis points at ``target``, its y axis away from ``up``."""
    z = normalised(sub(target, source))
    x = normalised(cross(z, up))
    y = cross(z, x)
    return from_rotation([[x[r], y[r], z[r]] for r in range(3)], source)


def _jacobian(phi: Vec, linear: Column | float, square: Column) -> Matrix:
    k = wedge(phi)
    k2 = product(k, k)
    return [[(1.0 if r == c else 0.0) + k[r][c] * linear + k2[r][c] * square for c in range(3)] for r in range(3)]


def left_jacobian(phi: Vec) -> Matrix:
    """J with exp(phi + d) = exp(J d) exp(phi) to first order, for rotation vectors."""
    n = length(phi)
    small = n < 1e-4
    linear = F.when(small, 0.5 - n * n / 24).otherwise((1 - F.cos(n)) / (n * n))
    return _jacobian(phi, linear, F.when(small, 1 / 6 - n * n / 120).otherwise((n - F.sin(n)) / (n * n * n)))


def inverse_left_jacobian(phi: Vec) -> Matrix:
    """The inverse of :func:`left_jacobian`, for turns below a full one."""
    n = length(phi)
    square = F.when(n < 1e-4, 1 / 12 + n * n / 720).otherwise(1 / (n * n) - F.cos(n / 2) / F.sin(n / 2) / (2 * n))
    return _jacobian(phi, -0.5, square)
