"""Queries of poses as Columns: a trajectory at the times between its key-frames, and the Jacobians of rotations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox.functions import geometry as geo
from stratavox.functions import motion
from stratavox.operators import scan
from stratavox.plans import views
from stratavox.plans.registered import query

_NAMES = ["qx", "qy", "qz", "qw", "tx", "ty", "tz"]
#: A pose made of a frame's numbers; the factor keeps what is between two poses off the halves of a sixth decimal.
_MADE = dict(
    zip(_NAMES, ["user_id%7-3e0", "user_id%5-2e0", "frame_id%9-4e0", "frame_id%4+5e-1", "user_id*318309886e-9", "frame_id%100*318309886e-9", "coalesce(value,0e0)*318309886e-11"], strict=True)
)
_LENGTH = "sqrt(qx*qx+qy*qy+qz*qz+qw*qw)"
_SLERP = ", ".join(f"(CASE WHEN sin(w) > 1e-9 THEN sin((1-r)*w)/sin(w) ELSE 1-r END)*a.{q}+(CASE WHEN sin(w) > 1e-9 THEN sin(r*w)/sin(w) ELSE r END)*flip*b.{q} AS {q}" for q in _NAMES[:4])
_LINE = ", ".join(f"(1-r)*a.{t}+r*b.{t} AS {t}" for t in _NAMES[4:])
_PATH = f""", k0 AS (SELECT event_type, frame_id, {', '.join(f'{e} AS {n}' for n, e in _MADE.items())} FROM frames WHERE is_key),
k AS (SELECT event_type, frame_id, {', '.join(f'{q}/{_LENGTH} AS {q}' for q in _NAMES[:4])}, tx, ty, tz FROM k0),
f AS (SELECT event_type, frame_id, is_key, max(CASE WHEN is_key THEN frame_id END) OVER (PARTITION BY event_type ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low,
 min(CASE WHEN is_key THEN frame_id END) OVER (PARTITION BY event_type ORDER BY frame_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS high FROM frames),
g AS (SELECT event_type, frame_id, coalesce(low, high) AS low, coalesce(high, low) AS high, CASE WHEN high > low THEN (frame_id-low)/((high-low)*1e0) ELSE 0e0 END AS r FROM f WHERE NOT is_key AND coalesce(low, high) IS NOT NULL),
h AS (SELECT g.*, a, b, CASE WHEN a.qx*b.qx+a.qy*b.qy+a.qz*b.qz+a.qw*b.qw < 0 THEN -1e0 ELSE 1e0 END AS flip, acos(least(abs(a.qx*b.qx+a.qy*b.qy+a.qz*b.qz+a.qw*b.qw), 1e0)) AS w
 FROM g JOIN k a ON a.event_type=g.event_type AND a.frame_id=low JOIN k b ON b.event_type=g.event_type AND b.frame_id=high)
SELECT event_type, frame_id, {', '.join(f'round({n},6)+0e0 AS {n}' for n in _NAMES)} FROM (SELECT event_type, frame_id, {_SLERP}, {_LINE} FROM h)"""


@query(_PATH, "frames")
def trajectory_at_frames(spark, sf_dir):
    """Poses of the frames between key-frames, each between the last key-frame of its kind before it and the first one after; held where there is only one."""
    rows = views.frames(spark, sf_dir)
    made = F.struct(F.col("frame_id").alias("at"), *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in _MADE.items()])
    marks = rows.where("is_key").select("frame_id", "event_type", made.alias("pose"))
    met = scan.between(rows.where("NOT is_key").select("frame_id", "event_type"), marks, "frame_id", ["event_type"], "pose", block=1000)
    met = met.select("event_type", "frame_id", F.coalesce("before", "after").alias("a"), F.coalesce("after", "before").alias("b")).where("a IS NOT NULL")
    share = F.when(F.col("b.at") > F.col("a.at"), (F.col("frame_id") - F.col("a.at")) / (F.col("b.at") - F.col("a.at"))).otherwise(0.0)
    pose = motion.Pose.read("a").interpolate(motion.Pose.read("b"), share)
    found = met.select("event_type", "frame_id", pose.struct().alias("p"))
    return found.select("event_type", "frame_id", *[(F.round(f"p.{n}", 6) + 0.0).alias(n) for n in _NAMES])


_K = [["0e0", "-pz", "py"], ["pz", "0e0", "-px"], ["-py", "px", "0e0"]]
_K2 = [["-(py*py+pz*pz)", "px*py", "px*pz"], ["px*py", "-(px*px+pz*pz)", "py*pz"], ["px*pz", "py*pz", "-(px*px+py*py)"]]
_INVERSE = ", ".join(f"round({1 if r == c else 0}-({_K[r][c]})/2+({_K2[r][c]})*(1/(n*n)-(1+cos(n))/(2*n*sin(n))),6)+0e0 AS i{r}{c}" for r in range(3) for c in range(3))
_FORTH = ", ".join(f"round({1 if r == c else 0}+({_K[r][c]})*(1-cos(n))/(n*n)+({_K2[r][c]})*(n-sin(n))/(n*n*n),6)+0e0 AS j{r}{c}" for r in range(3) for c in range(3))


@query(f", a AS (SELECT vec_id, 4*x AS px, 4*y AS py, 4*z AS pz FROM epts), b AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS n FROM a) SELECT vec_id, {_FORTH}, {_INVERSE} FROM b", "epts")
def rotation_jacobians(spark, sf_dir):
    """The left Jacobian of each point as a rotation vector, and its inverse."""
    phi = tuple(4 * c for c in geo.vec("x", "y", "z"))
    both = {"j": motion.left_jacobian(phi), "i": motion.inverse_left_jacobian(phi)}
    return views.epts(spark, sf_dir).select("vec_id", *[(F.round(m[r][c], 6) + 0.0).alias(f"{n}{r}{c}") for n, m in both.items() for r in range(3) for c in range(3)])
