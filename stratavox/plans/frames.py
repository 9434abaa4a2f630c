"""Queries of colour and depth frames on their way to the tracker."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratavox.operators import frame
from stratavox.plans import views
from stratavox.plans.registered import query, r6

_SHARE = 0.318309886
_PX = ", q AS (SELECT frame_id, v, u, depth, intensity*318309886e-9 AS r, depth*318309886e-10 AS g, u*318309886e-10 AS b FROM px)"
_THIN = """, t AS (SELECT frame_id, v//2 AS v, u//2 AS u, max(CASE WHEN v%2=0 AND u%2=0 THEN depth END) AS depth, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM q GROUP BY ALL)"""
READY = frame.Preparation((20.0, 20.0, 7.5, 7.5), 16, 16, crowd=4, crowd_radius=0.5, neighbours=16, normal_radius=0.5, cell=0.4)


def _pixels(spark, sf_dir):
    shares = [("r", F.col("intensity") * _SHARE), ("g", F.col("depth") * _SHARE / 10), ("b", F.col("u") * _SHARE / 10)]
    return views.px(spark, sf_dir).select("frame_id", "v", "u", "depth", *[c.alias(n) for n, c in shares])


@query(f"{_PX}{_THIN} SELECT frame_id, v, u, round(depth,6) AS depth, round((r+g+b)/3,6) AS intensity FROM t", "px")
def thinned_frames(spark, sf_dir):
    """Frames of half the size: the nearest depth, and the brightness of the colours between pixels."""
    rows = frame.thinned(_pixels(spark, sf_dir), 2, 16, 16)
    return rows.select("frame_id", "v", "u", r6("depth"), F.round(frame.intensity(F.col("r"), F.col("g"), F.col("b")), 6).alias("intensity"))


_NEAR = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 25e-2"
_AXES = ", ".join(f"CAST(floor(({c}-(min({c}) OVER ()-2e-1))/4e-1) AS BIGINT) AS b{c}" for c in "xyz")


@query(
    f"""{_PX}{_THIN}, p AS (SELECT v*8+u AS pid, (u-375e-2)/10e0*depth AS x, (v-375e-2)/10e0*depth AS y, depth AS z FROM t WHERE frame_id = 0 AND depth IS NOT NULL),
k AS (SELECT a.* FROM p a JOIN p b ON {_NEAR} GROUP BY ALL HAVING count(*) >= 4), m AS (SELECT a.* FROM k a JOIN k b ON {_NEAR} GROUP BY ALL HAVING count(*)-1 >= 5),
c AS (SELECT *, {_AXES} FROM m)
SELECT bx, by_ AS "by", bz, count(*) AS n, round(avg(x),6)+0e0 AS mx, round(avg(y),6)+0e0 AS my, round(avg(z),6)+0e0 AS mz FROM (SELECT * RENAME ("by" AS by_) FROM c) GROUP BY ALL""",
    "px",
)
def prepared_frame(spark, sf_dir):
    """A frame's points without outliers and those that have no normal, averaged by cell."""
    found = READY.processed(READY.coloured(_pixels(spark, sf_dir).where("frame_id = 0")))
    return found.select("bx", "by", "bz", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mx", "my", "mz")])
