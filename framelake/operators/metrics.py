"""Quality metrics over the pixel lens (clip, idx, y, x, v).  A mask is ``v > threshold``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import kernels

FRAME = ["clip", "idx"]


def _count(condition: Column) -> Column:
    return F.sum(condition.cast("int")).cast("long")


def area(px: DataFrame, threshold: float = 0) -> DataFrame:
    """Pixels in the mask of each frame."""
    return px.groupBy(*FRAME).agg(_count(F.col("v") > threshold).alias("area"))


def bounding_box(px: DataFrame, threshold: float = 0) -> DataFrame:
    """Half-open box of the mask; nulls where it is empty."""
    inside = F.col("v") > threshold
    edge = lambda f, c: f(F.when(inside, F.col(c)))
    return px.groupBy(*FRAME).agg(
        edge(F.min, "x").alias("x0"), edge(F.min, "y").alias("y0"), (edge(F.max, "x") + 1).alias("x1"), (edge(F.max, "y") + 1).alias("y1")
    )


def centroid(px: DataFrame, threshold: float = 0) -> DataFrame:
    """Mean place of the mask's pixels, to six places."""
    inside = F.col("v") > threshold
    mean = lambda c: F.round(F.avg(F.when(inside, F.col(c))), 6)
    return px.groupBy(*FRAME).agg(mean("x").alias("cx"), mean("y").alias("cy"))


def previous(px: DataFrame, column: str = "v", name: str = "before") -> DataFrame:
    """Each pixel with the same pixel of the clip's frame before."""
    return px.withColumn(name, F.lag(column).over(Window.partitionBy("clip", "y", "x").orderBy("idx")))


def iou(pairs: DataFrame, predicted: Column, truth: Column) -> DataFrame:
    """Intersection over union of two masks in the same rows; an empty union gives 1."""
    both, either = _count(predicted & truth), _count(predicted | truth)
    return pairs.groupBy(*FRAME).agg(F.coalesce(both / F.nullif(either, F.lit(0)), F.lit(1.0)).alias("iou"))


def consecutive_iou(px: DataFrame, threshold: float = 0) -> DataFrame:
    """IoU of each frame's mask and the one before in its clip."""
    pairs = previous(px).filter(F.col("before").isNotNull())
    return iou(pairs, F.col("v") > threshold, F.col("before") > threshold)


def boundary_f(pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """Boundary F of integer masks ``p`` and ``g`` in the same rows (clip, idx, y, x, p, g).

    A mask's edge is the mask without its 3 x 3 erosion; an edge pixel counts if
    the other mask's edge is within the tolerance's square.  Nothing found gives 0.
    """
    from framelake.operators import plane

    size = 2 * tolerance + 1
    out = pairs
    for m in ("p", "g"):
        out = plane.erode(out, m, f"{m}_in", 3).withColumn(f"{m}_edge", ((F.col(m) == 1) & (F.col(f"{m}_in") == 0)).cast("int"))
        out = plane.dilate(out, f"{m}_edge", f"{m}_near", size)
    hit = lambda a, b: F.sum(F.col(f"{a}_edge") * F.col(f"{b}_near")) / F.greatest(F.sum(f"{a}_edge"), F.lit(1))
    rates = out.groupBy(*FRAME).agg(hit("p", "g").alias("precision"), hit("g", "p").alias("recall"))
    total = F.col("precision") + F.col("recall")
    return rates.select(*FRAME, F.when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(F.lit(0.0)).alias("f"))


def flicker(pairs: DataFrame) -> DataFrame:
    """Mean over a clip's frames but the first of how much more the prediction (p) changes than the truth (g); one frame gives 0."""
    w = Window.partitionBy("clip", "y", "x").orderBy("idx")
    moved = pairs.withColumn("dp", F.abs(F.col("p") - F.lag("p").over(w))).withColumn("dg", F.abs(F.col("g") - F.lag("g").over(w)))
    by_frame = moved.groupBy(*FRAME).agg(F.avg("dp").alias("dp"), F.avg("dg").alias("dg"))
    return by_frame.groupBy("clip").agg(_flicker().alias("flicker"))


def _flicker() -> Column:
    """Of frames with ``dp`` and ``dg``, which a first frame has not."""
    return F.coalesce(F.avg(F.when(F.col("dp").isNotNull(), F.greatest(F.col("dp") - F.col("dg"), F.lit(0.0)))), F.lit(0.0))


def area_jump(px: DataFrame, threshold: float = 0) -> DataFrame:
    """Largest change of (area + 1) from a frame to the next, relative to the earlier; one frame gives 0."""
    sized = area(px, threshold).withColumn("a", F.col("area") + 1)
    before = F.lag("a").over(Window.partitionBy("clip").orderBy("idx"))
    jumps = sized.withColumn("jump", F.abs(F.col("a") - before) / before)
    return jumps.groupBy("clip").agg(F.coalesce(F.max("jump"), F.lit(0.0)).alias("max_jump"))


def summarize(pairs: DataFrame, tolerance: int = 2) -> DataFrame:
    """Per clip: mean and least IoU, mean boundary F, flicker and largest area jump of p against g."""
    frames = iou(pairs, F.col("p") == 1, F.col("g") == 1).join(boundary_f(pairs, tolerance), FRAME)
    means = frames.groupBy("clip").agg(F.avg("iou").alias("iou_mean"), F.min("iou").alias("iou_min"), F.avg("f").alias("f_mean"))
    jumps = area_jump(pairs.withColumn("v", F.col("p")), 0)
    return means.join(flicker(pairs), "clip").join(jumps, "clip")


def histogram(pixels: DataFrame, bin_: Column) -> DataFrame:
    """Share of each frame's pixels in each bin; a frame without pixels has no rows."""
    counted = pixels.groupBy(*FRAME, bin_.alias("bin")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*FRAME)))


# ---- the same from whole planes -----------------------------------------------


def _arrays(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[np.ndarray | None, ...]]:
    """Each row's planes as (height, width) arrays; a null one is None."""
    widths, found = batch.column("w").to_pylist(), []
    for c in columns:
        column = batch.column(c)
        ends, flat, known = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
        found.append([flat[ends[k] : ends[k + 1]].reshape(-1, w) if known[k] else None for k, w in enumerate(widths)])
    yield from zip(*found, strict=True)


def _typed(frames: DataFrame, rest: str) -> str:
    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    return f"clip {types['clip']}, idx {types['idx']}, {rest}"


def plane_quality(frames: DataFrame, tolerance: int = 2) -> DataFrame:
    """(clip, idx, iou, f) of whole masks ``p`` and ``g`` (arrays of 0 and 1, ``w`` wide); a row a frame, no shuffle."""

    def run(batches):
        for batch in batches:
            out = [(float((p & g).sum() / max((p | g).sum(), 1)) if (p | g).any() else 1.0, kernels.boundary_f(p > 0, g > 0, tolerance)) for p, g in _arrays(batch, ["p", "g"])]
            columns = [pa.array(c, pa.float64()) for c in zip(*out, strict=True)] or [pa.array([], pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("idx"), *columns], names=["clip", "idx", "iou", "f"])

    return frames.select("clip", "idx", "w", "p", "g").mapInArrow(run, _typed(frames, "iou double, f double"))


def plane_totals(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(clip, idx, total, weighted): sums over ``kernel`` of whole planes (clip, idx, w, plane), plain and by the pixel's number; no shuffle."""

    def run(batches):
        for batch in batches:
            made = [kernel(p.astype(np.float64)).reshape(-1) for (p,) in _arrays(batch, ["plane"])]
            sums = [pa.array([float(f(m)) for m in made], pa.float64()) for f in (np.sum, lambda m: m @ np.arange(len(m)))]
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("idx"), *sums], names=["clip", "idx", "total", "weighted"])

    return frames.select("clip", "idx", "w", "plane").mapInArrow(run, _typed(frames, "total double, weighted double"))


def plane_pixels(frames: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """The pixel lens (clip, idx, y, x, ``name``) of ``kernel`` of whole planes (clip, idx, w, plane); no shuffle, one frame's rows at a time."""
    types = _typed(frames, f"y int, x int, `{name}` double")

    def run(batches):
        for batch in batches:
            for k, (p,) in enumerate(_arrays(batch, ["plane"])):
                made = kernel(p.astype(np.float64))
                y, x = np.indices(made.shape, np.int32)
                own = pa.array(np.full(made.size, k))
                columns = [batch.column("clip").take(own), batch.column("idx").take(own), pa.array(y.reshape(-1)), pa.array(x.reshape(-1)), pa.array(made.reshape(-1))]
                yield pa.RecordBatch.from_arrays(columns, names=["clip", "idx", "y", "x", name])

    return frames.select("clip", "idx", "w", "plane").mapInArrow(run, types)


def plane_leak(frames: DataFrame, least: float, sigma: float = 1.5) -> DataFrame:
    """(clip, idx, leak): the share of the mask ``m`` whose likelihood (``lik``, arrays ``w`` wide), blurred, is under ``least``; an empty mask gives 0."""

    def run(batches):
        for batch in batches:
            out = []
            for lik, m in _arrays(batch, ["lik", "m"]):
                inside = kernels.true_gaussian(lik.astype(np.float64), sigma)[m > 0]
                out.append(float((inside < least).mean()) if len(inside) else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("idx"), pa.array(out, pa.float64())], names=["clip", "idx", "leak"])

    return frames.select("clip", "idx", "w", "lik", "m").mapInArrow(run, _typed(frames, "leak double"))


def plane_changes(frames: DataFrame) -> DataFrame:
    """(clip, idx, dp, dg, area, jump): mean changes of the masks ``p`` and ``g`` from the frame before and the relative change of p's area + 1; nulls for a first frame.

    One shuffle of a row a frame.
    """
    w = Window.partitionBy("clip").orderBy("idx")
    rows = frames.withColumns({"bp": F.lag("p").over(w), "bg": F.lag("g").over(w)})
    change = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda s, x: s + x) / F.size(a)
    area_of = lambda c: F.aggregate(c, F.lit(1).cast("long"), lambda s, x: s + x)
    return rows.select("clip", "idx", change("p", "bp").alias("dp"), change("g", "bg").alias("dg"), (area_of("p") - 1).alias("area"), (F.abs(area_of("p") - area_of("bp")) / area_of("bp")).alias("jump"))


def plane_summary(frames: DataFrame, tolerance: int = 2) -> DataFrame:
    """``summarize`` from whole planes."""
    means = plane_quality(frames, tolerance).groupBy("clip").agg(F.avg("iou").alias("iou_mean"), F.min("iou").alias("iou_min"), F.avg("f").alias("f_mean"))
    moved = plane_changes(frames).groupBy("clip").agg(_flicker().alias("flicker"), F.coalesce(F.max("jump"), F.lit(0.0)).alias("max_jump"))
    return means.join(moved, "clip")


def plane_flicker(frames: DataFrame) -> DataFrame:
    """``flicker`` from whole planes."""
    return plane_changes(frames).groupBy("clip").agg(_flicker().alias("flicker"))


def colour_bin(b: Column, g: Column, r: Column) -> Column:
    """Bin of 8 x 8 x 8 for 8-bit channels."""
    return (F.shiftright(b, 5) * 8 + F.shiftright(g, 5)) * 8 + F.shiftright(r, 5)


def likelihood(fg: Column, bg: Column) -> Column:
    """How much a bin speaks for the subject."""
    return (fg + 1e-4) / (fg + bg + 2e-4)


def leak_fraction(px: DataFrame, least: float) -> DataFrame:
    """Share of the mask's pixels (column ``m``) whose likelihood (``lik``) is under ``least``; an empty mask gives 0."""
    inside = F.col("m") == 1
    return px.groupBy(*FRAME).agg(F.coalesce(F.avg(F.when(inside, (F.col("lik") < least).cast("int"))), F.lit(0.0)).alias("leak"))


def spill_tint(px: DataFrame) -> DataFrame:
    """Weighted mean background colour on the edge band (.02 < a < .98, weight a(1 - a)) and the channel that stands out by over .06."""
    band = (F.col("a") > 0.02) & (F.col("a") < 0.98)
    weight = F.when(band, F.col("a") * (1 - F.col("a"))).otherwise(F.lit(0.0))
    mean = lambda c: F.sum(weight * F.col(c)) / F.nullif(F.sum(weight), F.lit(0.0))
    out = px.groupBy(*FRAME).agg(*(mean(c).alias(f"tint_{c}") for c in "rgb"))
    top = F.greatest("tint_r", "tint_g", "tint_b")
    others = (F.col("tint_r") + F.col("tint_g") + F.col("tint_b") - top) / 2
    name = F.when(F.col("tint_r") == top, "r").when(F.col("tint_g") == top, "g").otherwise("b")
    return out.withColumn("key", F.when(top - others > 0.06, name))
