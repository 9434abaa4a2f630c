"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratavox.llm.tables import forget, settle


def _least(links: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours."""
    return links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Connect each node's larger neighbours to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    moved = links.join(_least(links), "u")
    down = moved.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(moved.select("u", F.col("m").alias("v"))).distinct()


def _all_stars(links: DataFrame) -> bool:
    """Whether every larger end has one link only and is no smaller end: then each component is a star around its smallest node."""
    sides = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    sides = sides.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return found.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) of every node with a link; the component is its smallest node.

    Links have no direction; loops, repeated links and nulls are left out. Each
    round is written to the shared folder. No node's neighbours meet in one task:
    minima are combined before the shuffle, and joins may split a hot node.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` != `{b}`").distinct()
    now = settle(pairs, "links")
    while True:
        new = settle(_small_star(_large_star(now)), "stars")
        forget(now)
        now = new
        if _all_stars(now):
            break
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
