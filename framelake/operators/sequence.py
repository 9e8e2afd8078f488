"""Operators over the frames of a clip in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def velocity(points: DataFrame, most: int = 6) -> DataFrame:
    """Constant-velocity prior at each frame from its last ``most`` centroids; one centroid gives 0."""
    w = Window.partitionBy("clip").orderBy("idx").rowsBetween(-(most - 1), 0)
    n = F.count("*").over(w)
    speed = lambda c: F.when(n < 2, F.lit(0.0)).otherwise((F.last(c).over(w) - F.first(c).over(w)) / (n - 1))
    return points.withColumn("vx", speed("cx")).withColumn("vy", speed("cy"))


def streaks(frames: DataFrame, good: Column) -> DataFrame:
    """Frames in a row, up to each, that are not good."""
    order = Window.partitionBy("clip").orderBy("idx")
    island = F.sum(good.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = frames.withColumn("_good", good).withColumn("_island", island)
    place = F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(Window.partitionBy("clip", "_island").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("streak", place.cast("int")).drop("_good", "_island")


def ewma(frames: DataFrame, value: str, rate: float = 0.08) -> DataFrame:
    """Exponentially weighted mean of each clip's values in order; the first value begins it."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", F.col(value).alias("v"))))
    lists = frames.groupBy("clip").agg(ordered.alias("s"))
    mean = F.aggregate(
        F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), F.get("s", F.lit(0))["v"].cast("double"), lambda a, x: a * (1 - rate) + x["v"] * rate
    )
    return lists.select("clip", mean.alias("ewma"))
