"""Prefix sums and places over an order, in blocks, so that no task holds a whole order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of an integer order that make one block.
BLOCK = 4096


def prefix_sum(df: DataFrame, value: str, order: str, keys: list[str] | None = None, out: str = "running", block: int = BLOCK) -> DataFrame:
    """The inclusive running sum of ``value`` by an integer ``order``, for each of ``keys``.

    Sums of blocks of the order are scanned first (one row for each block), then the rows within each block.
    """
    keys = keys or []
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    blocks = rows.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    earlier = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(*keys, "_block", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_inside", inside).join(blocks, [*keys, "_block"]).withColumn(out, F.col("_earlier") + F.col("_inside")).drop("_block", "_earlier", "_inside")


def numbered(df: DataFrame, keys: list[str], order: str, out: str = "place", block: int = BLOCK) -> DataFrame:
    """Places 1, 2, ... of the rows of each key by an integer ``order`` without ties."""
    return prefix_sum(df.withColumn("_one", F.lit(1)), "_one", order, keys, out, block).drop("_one")


def interval_lookup(points: DataFrame, value: str, intervals: DataFrame, low: str, high: str, total: float, buckets: int = 1024) -> DataFrame:
    """Each point with the interval (low, high] that holds its value: an equi-join on buckets, then the exact test.

    An interval is repeated for each bucket that it reaches into; a value of 0 falls to the interval that begins there.
    """
    scale = buckets / total if total else 0.0
    bucket = lambda c: F.greatest(F.floor(c * scale).cast("long"), F.lit(0))
    left = points.withColumn("_bucket", bucket(F.col(value)))
    right = intervals.withColumn("_bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    holds = ((F.col(value) > F.col(low)) | ((F.col(value) == 0) & (F.col(low) == 0))) & (F.col(value) <= F.col(high)) & (F.col(high) > F.col(low))
    return left.join(right, "_bucket").where(holds).drop("_bucket")


def placed(df: DataFrame, block: Column, order: list[str], out: str = "place") -> DataFrame:
    """Dense places 0, 1, ... by an integer ``block`` and, within it, by ``order`` without ties.

    Blocks are counted and their starts summed by :func:`prefix_sum`, so a task sorts one block at a time.
    """
    rows = df.withColumn("_at", block)
    counts = rows.groupBy("_at").agg(F.count("*").alias("_n"))
    starts = prefix_sum(counts, "_n", "_at", out="_end").select("_at", (F.col("_end") - F.col("_n")).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_at").orderBy(*order))
    return rows.withColumn("_inside", inside).join(starts, "_at").withColumn(out, F.col("_start") + F.col("_inside") - 1).drop("_at", "_start", "_inside")


def between(rows: DataFrame, marks: DataFrame, order: str, keys: list[str], value: str, block: int = BLOCK) -> DataFrame:
    """Each row with the value of the last mark at or before it (``before``) and of the first one after it (``after``), by a numeric ``order``, for each of ``keys``; null where there is none.

    An as-of join in both directions. Marks are looked for within blocks of the
    order; each block's first and last mark are handed on to the blocks beside
    it, so only one row a block meets in a window over a key. Of marks with one
    order the largest value comes last. Rows and marks with a null key or order
    meet nothing; such rows are kept with nulls.
    """
    known = F.col(order).isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    payload = [c for c in rows.columns if c not in (order, *keys)]
    left = rows.select(order, *keys, F.lit(1).alias("_kind"), F.struct(*payload, F.lit(1).alias("_one")).alias("_row"))
    right = marks.where(known).select(order, *keys, F.lit(0).alias("_kind"), F.col(value).alias("_mark")).where("_mark IS NOT NULL")
    every = left.unionByName(right, allowMissingColumns=True).withColumn("_block", F.floor(F.col(order) / block))
    ends = every.groupBy(*keys, "_block").agg(*[f("_mark", F.when(F.col("_mark").isNotNull(), F.struct(order, "_mark"))).alias(n) for f, n in ((F.min_by, "_first"), (F.max_by, "_last"))])
    of_key = Window.partitionBy(*keys).orderBy("_block")
    handed = ends.where("_block IS NOT NULL").select(
        *keys,
        "_block",
        F.last("_last", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(of_key.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order, "_kind", "_mark")
    back = F.last("_mark", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_mark", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))
    met = every.withColumns({"_back": back, "_ahead": ahead}).where("_kind = 1").join(handed, [*keys, "_block"], "left")
    found = [F.when(known, F.coalesce(a, b)).alias(n) for a, b, n in (("_back", "_earlier", "before"), ("_ahead", "_later", "after"))]
    return met.select(order, *keys, *[F.col(f"_row.{c}").alias(c) for c in payload], *found)
