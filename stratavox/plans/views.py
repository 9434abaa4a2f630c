"""Geometry views over the driver's tables, as DataFrames and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratavox.sources.tables import read_table

#: DuckDB text of each view.
SQL = {
    "pts": "SELECT l_quantity/10e0 AS x, l_extendedprice/21000e0 AS y, l_discount*50e0+0e0 AS z, l_tax*50e0+0e0 AS w, l_returnflag AS tag FROM lineitem",
    "px": (
        "SELECT l_linenumber % 2 AS frame_id, l_suppkey % 16 AS v, l_partkey % 16 AS u, avg(l_quantity)/10e0 AS depth, "
        "CAST(sum(CAST(round(l_discount*100e0) AS BIGINT)) AS DOUBLE)/count(*)/10e0 AS intensity FROM lineitem GROUP BY 1,2,3"
    ),
    "frames": "SELECT event_id AS frame_id, ts, user_id, event_type, value, event_id % 20 = 0 AS is_key FROM events",
    "epts": (
        "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, "
        "CAST(embedding[4] AS DOUBLE) AS nx, CAST(embedding[5] AS DOUBLE) AS ny, CAST(embedding[6] AS DOUBLE) AS nz, label FROM embeddings"
    ),
    "tri": (
        "SELECT CAST(floor(a.vec_id/3e0) AS BIGINT) AS tri_id, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz, "
        "c.x AS cx, c.y AS cy, c.z AS cz FROM epts a JOIN epts b ON b.vec_id=a.vec_id+1 JOIN epts c ON c.vec_id=a.vec_id+2 WHERE a.vec_id % 3 = 0"
    ),
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` behind the views that it names."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + sql


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cloud in [0, 5]^3 without a key."""
    rows = read_table(spark, sf_dir, "lineitem")
    return rows.select(
        (F.col("l_quantity") / 10).alias("x"),
        (F.col("l_extendedprice") / 21000).alias("y"),
        (F.col("l_discount") * 50 + 0.0).alias("z"),
        (F.col("l_tax") * 50 + 0.0).alias("w"),
        F.col("l_returnflag").alias("tag"),
    )


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two 16 x 16 frames of depth and intensity."""
    rows = read_table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_linenumber") % 2).alias("frame_id"), (F.col("l_suppkey") % 16).alias("v"), (F.col("l_partkey") % 16).alias("u")]
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("long")).cast("double")
    return rows.groupBy(*keys).agg((F.avg("l_quantity") / 10).alias("depth"), (cents / F.count("*") / 10).alias("intensity"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in order, every twentieth a key-frame."""
    rows = read_table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("frame_id"), "ts", "user_id", "event_type", "value", (F.col("event_id") % 20 == 0).alias("is_key"))


def epts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with ids, directions and labels."""
    rows = read_table(spark, sf_dir, "embeddings")
    names = ["x", "y", "z", "nx", "ny", "nz"]
    return rows.select("vec_id", *[F.element_at("embedding", i + 1).cast("double").alias(n) for i, n in enumerate(names)], "label")


def tri(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of three consecutive points each."""
    rows = epts(spark, sf_dir).select(F.floor(F.col("vec_id") / 3).alias("tri_id"), (F.col("vec_id") % 3).alias("k"), "x", "y", "z")
    corner = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    names = [("ax", "ay", "az"), ("bx", "by_", "bz"), ("cx", "cy", "cz")]
    made = [corner(k, c).alias(n) for k, row in enumerate(names) for c, n in zip("xyz", row, strict=True)]
    return rows.groupBy("tri_id").agg(*made, F.count("*").alias("n")).where("n = 3").drop("n")
