"""Plane operators over the pixel lens (clip, idx, y, x, values...).

Rows are dealt by frame once (``by_frame``); the row and column windows of every
operator are then inside a frame's partition and need sorts only.  Borders differ
by operator and are said at each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME = ["clip", "idx"]


def by_frame(px: DataFrame) -> DataFrame:
    """Rows dealt by frame; windows over parts of a frame don't shuffle again."""
    return px.repartition("clip", "idx")


def _along(axis: str):
    other = "y" if axis == "x" else "x"
    return Window.partitionBy(*FRAME, other).orderBy(axis)


def dilate(px: DataFrame, column: str, name: str, size: int) -> DataFrame:
    """Greatest value in a square of odd ``size``, cut off at the border."""
    r = size // 2
    rows = px.withColumn("_row", F.max(column).over(_along("x").rowsBetween(-r, r)))
    return rows.withColumn(name, F.max("_row").over(_along("y").rowsBetween(-r, r))).drop("_row")


def erode(px: DataFrame, column: str, name: str, size: int) -> DataFrame:
    """Least value in a square of odd ``size``; what is outside never erodes."""
    r = size // 2
    rows = px.withColumn("_row", F.min(column).over(_along("x").rowsBetween(-r, r)))
    return rows.withColumn(name, F.min("_row").over(_along("y").rowsBetween(-r, r))).drop("_row")


def opened(px: DataFrame, column: str, name: str, size: int) -> DataFrame:
    return dilate(erode(px, column, "_er", size), "_er", name, size).drop("_er")


def closed(px: DataFrame, column: str, name: str, size: int) -> DataFrame:
    return erode(dilate(px, column, "_di", size), "_di", name, size).drop("_di")


def cross_step(px: DataFrame, column: str, name: str) -> DataFrame:
    """Greatest of a pixel and its four neighbours."""
    near = [f(column).over(_along(a)) for a in "xy" for f in (F.lag, F.lead)]
    return px.withColumn(name, F.greatest(F.col(column), *near))


def dilate_octagon(px: DataFrame, column: str, name: str, radius: int) -> DataFrame:
    """A square of lround(.4142 r), then cross steps for the rest; the radius is at most 120."""
    radius = min(radius, 120)
    a = int(math.floor(0.4142 * radius + 0.5))
    out = dilate(px, column, name, 2 * a + 1) if a else px.withColumn(name, F.col(column))
    for _ in range(radius - a):
        out = cross_step(out, name, name)
    return out


def edge_shift(px: DataFrame, column: str, name: str, shift: float, top: float = 255) -> DataFrame:
    """Grow (+) or shrink (-) by whole pixels; under a quarter pixel nothing happens."""
    if abs(shift) < 0.25:
        return px.withColumn(name, F.col(column))
    radius = int(math.floor(abs(shift) + 0.5))
    if shift > 0:
        return dilate_octagon(px, column, name, radius)
    out = dilate_octagon(px.withColumn("_c", F.lit(top) - F.col(column)), "_c", "_c", radius)
    return out.withColumn(name, F.lit(top) - F.col("_c")).drop("_c")


def box_sum(px: DataFrame, column: str, name: str, radius: int) -> DataFrame:
    """Sum over a square of 2 radius + 1 with the border pixel repeated outside."""
    out, last = px, column
    for axis in "xy":
        w = _along(axis)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place, count = F.col(axis), F.max(axis).over(whole) + 1
        inside = F.sum(last).over(w.rowsBetween(-radius, radius))
        first, end = F.first(last).over(whole), F.last(last).over(whole)
        before = F.greatest(F.lit(radius) - place, F.lit(0))
        after = F.greatest(place + radius - (count - 1), F.lit(0))
        out = out.withColumn("_s", inside + before * first + after * end)
        out = out.withColumn(name, F.col("_s")).drop("_s")
        last = name
    return out


def box_blur(px: DataFrame, column: str, name: str, radius: int) -> DataFrame:
    """Mean over the square of ``box_sum``."""
    return box_sum(px, column, name, radius).withColumn(name, F.col(name) / ((2 * radius + 1) ** 2))


def downsample(px: DataFrame, column: str, factor: int) -> DataFrame:
    """Mean of each block of ``factor`` squared; blocks cut off at the border by what they have."""
    cell = lambda c: F.expr(f"cast({c} div {factor} as int)").alias(c)
    return px.groupBy(*FRAME, cell("y"), cell("x")).agg(F.avg(column).alias(column))


def _bilinear(px: DataFrame, column: str, at: DataFrame, fx: Column, fy: Column, clamp: bool) -> DataFrame:
    """Values of ``px`` at (fx, fy) of the rows ``at`` (clip, idx, y, x); outside is the border's value or 0.

    The four neighbours come by one join: each target names them in an array.
    """
    size = px.groupBy(*FRAME).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    rows = at.withColumns({"_fx": fx, "_fy": fy}).withColumns({"_x0": F.floor("_fx"), "_y0": F.floor("_fy")})
    rows = rows.withColumns({"_tx": F.col("_fx") - F.col("_x0"), "_ty": F.col("_fy") - F.col("_y0")}).join(size, FRAME)
    corner = lambda dx, dy, wx, wy: F.struct((F.col("_x0") + dx).alias("sx"), (F.col("_y0") + dy).alias("sy"), (wx * wy).alias("w"))
    tx, ty = F.col("_tx"), F.col("_ty")
    corners = F.array(corner(0, 0, 1 - tx, 1 - ty), corner(1, 0, tx, 1 - ty), corner(0, 1, 1 - tx, ty), corner(1, 1, tx, ty))
    rows = rows.select(*at.columns, "_w", "_h", F.explode(corners).alias("_c"))
    sx, sy = F.col("_c.sx"), F.col("_c.sy")
    if clamp:
        sx, sy = F.greatest(F.lit(0), F.least(sx, F.col("_w") - 1)), F.greatest(F.lit(0), F.least(sy, F.col("_h") - 1))
    source = px.select(*FRAME, F.col("x").cast("long").alias("_sx"), F.col("y").cast("long").alias("_sy"), F.col(column).alias("_v"))
    found = rows.withColumns({"_sx": sx.cast("long"), "_sy": sy.cast("long")}).join(source, [*FRAME, "_sx", "_sy"], "left")
    return found.groupBy(*at.columns).agg(F.sum(F.coalesce(F.col("_v"), F.lit(0)) * F.col("_c.w")).alias(column))


def upsample(px: DataFrame, column: str, factor: int) -> DataFrame:
    """Bilinear, centres at half pixels, the border's value outside."""
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    at = px.select(*FRAME, (F.col("y") * factor).alias("y"), (F.col("x") * factor).alias("x"))
    at = at.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps)).select(*FRAME, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    to = lambda c: (F.col(c) + 0.5) / factor - 0.5
    return _bilinear(px, column, at, to("x"), to("y"), clamp=True)


def warp(px: DataFrame, column: str, dx: Column, dy: Column) -> DataFrame:
    """Backward warp: each pixel takes the value at (x + dx, y + dy); outside is 0."""
    at = px.select(*FRAME, "y", "x")
    return _bilinear(px, column, at, F.col("x") + dx, F.col("y") + dy, clamp=False)


def guided(px: DataFrame, guide: str, value: str, name: str, radius: int, eps: float) -> DataFrame:
    """Guided filter of ``value`` by ``guide``."""
    out = px.withColumns({"_gv": F.col(guide) * F.col(value), "_gg": F.col(guide) * F.col(guide)})
    for c, m in ((guide, "_mg"), (value, "_mv"), ("_gv", "_mgv"), ("_gg", "_mgg")):
        out = box_blur(out, c, m, radius)
    a = (F.col("_mgv") - F.col("_mg") * F.col("_mv")) / (F.col("_mgg") - F.col("_mg") * F.col("_mg") + F.lit(eps))
    out = out.withColumn("_a", a).withColumn("_b", F.col("_mv") - F.col("_a") * F.col("_mg"))
    out = box_blur(box_blur(out, "_a", "_ma", radius), "_b", "_mb", radius)
    return out.withColumn(name, F.col("_ma") * F.col(guide) + F.col("_mb")).select(*px.columns, name)
