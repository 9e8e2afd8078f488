"""Tracking plans: the report, blob kernels over frames, and the tracker.

Recurrences run inside ``applyInArrow`` by clip (or by clip and job): parallel
over clips and keyframe segments, in order inside one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.operators import follower, kernels


def report(frames: DataFrame) -> DataFrame:
    """Area, box, centroid, IoU with the frame before, area jump and a low flag of frames (clip, idx, plane, w).

    Arrays stay whole: one shuffle of a row a frame, for the frame before, and
    expressions over the arrays; no row a pixel.
    """
    before = F.lag("plane").over(Window.partitionBy("clip").orderBy("idx"))
    inside = F.filter(F.sequence(F.lit(0), F.size("plane") - 1), lambda i: F.get("plane", i) > 0)
    rows = frames.withColumn("before", before).withColumn("on", inside)
    x, y = (F.transform("on", f) for f in (lambda i: i % F.col("w"), lambda i: F.floor(i / F.col("w")).cast("int")))
    rows = rows.withColumn("x", x).withColumn("y", y).withColumn("area", F.size("on").cast("long"))
    # a pixel of the frame before counts if this frame has it too
    held = F.filter("on", lambda i: F.get("before", i) > 0)
    rows = rows.withColumn("old", F.size(F.filter("before", lambda v: v > 0)).cast("long")).withColumn("both", F.size(held).cast("long"))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v) / F.nullif(F.col("area"), F.lit(0)), 6)
    overlap = F.coalesce(F.col("both") / F.nullif(F.col("area") + F.col("old") - F.col("both"), F.lit(0)), F.lit(1.0))
    out = rows.select(
        "clip", "idx", "area", F.array_min("x").alias("x0"), F.array_min("y").alias("y0"), (F.array_max("x") + 1).alias("x1"), (F.array_max("y") + 1).alias("y1"),
        mean("x").alias("cx"), mean("y").alias("cy"), F.when(F.col("before").isNotNull(), F.round(overlap, 6)).alias("iou"),
        F.when(F.col("before").isNotNull(), F.round(F.abs(F.col("area") - F.col("old")) / (F.col("old") + 1), 6)).alias("jump"),
    )
    return out.withColumn("low", F.coalesce(F.col("iou") < 0.55, F.lit(False)) | F.coalesce(F.col("jump") > 0.3, F.lit(False)))


def blobs(px: DataFrame, width: int, height: int) -> DataFrame:
    """(clip, idx, w, h, plane) with 32-bit values, from the pixel lens."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].cast("float"))
    return px.groupBy("clip", "idx").agg(ordered.alias("plane")).withColumn("w", F.lit(width)).withColumn("h", F.lit(height))


def in_order(table: pa.Table) -> tuple[list[int], Iterator[np.ndarray]]:
    """Frame numbers of a clip (idx, w, h, plane) in order, and its planes one after the other.

    Planes stay in Arrow's buffers until they are asked for: no lists of numbers.
    """
    table = table.select(["idx", "w", "h", "plane"]).sort_by("idx").combine_chunks()

    def planes() -> Iterator[np.ndarray]:
        for k in range(table.num_rows):
            values = table.column("plane")[k].values
            yield values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.column("h")[k].as_py(), -1)

    return table.column("idx").to_pylist(), planes()


def edge_frames(frames: DataFrame, scale: int = 2, params: kernels.EdgeParams = kernels.EdgeParams(feather=1.0)) -> DataFrame:
    """(clip, idx, area, mean, digest) of each frame's alpha at ``scale`` times its size."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                matte = np.asarray(row["plane"], np.float64).reshape(row["h"], row["w"])
                image = np.repeat(np.repeat(matte, scale, axis=0), scale, axis=1)[..., None].repeat(3, axis=2) / 255
                alpha = kernels.edge_alpha(matte, image, params)
                quantised = np.floor(alpha * 255 + 0.5).astype(np.uint8)
                out.append({"clip": row["clip"], "idx": row["idx"], "area": int((alpha > 0.5).sum()), "mean": round(float(alpha.mean()), 6), "digest": hashlib.sha256(quantised.tobytes()).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("clip", pa.int32()), ("idx", pa.int64()), ("area", pa.int64()), ("mean", pa.float64()), ("digest", pa.string())])
    return frames.mapInArrow(run, "clip int, idx long, area long, mean double, digest string")


def cutout_frames(spark: SparkSession, frames: int, width: int, height: int, params: kernels.EdgeParams = kernels.EdgeParams(), tasks: int | None = None) -> DataFrame:
    """(idx, area) of cutouts of an analytic disc that moves over a plain ground: the edge pipeline at any size."""

    def run(batches):
        yy, xx = np.mgrid[:height, :width]
        for batch in batches:
            areas = []
            for idx in batch.column(0).to_pylist():
                alpha = np.clip((height / 3 - np.hypot(yy - height / 2, xx - width / 2 - idx % 50)) / 3 + 0.5, 0, 1)
                image = alpha[..., None] * np.array([0.8, 0.2, 0.2]) + (1 - alpha[..., None]) * np.array([0.1, 0.7, 0.1])
                matte = np.floor(kernels.downsample(alpha, 2) * 255 + 0.5)
                areas.append(int((kernels.cutout(matte, image, params)[..., 3] > 0.5).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(areas, pa.int64())], names=["idx", "area"])

    return spark.range(frames, numPartitions=tasks or frames).withColumnRenamed("id", "idx").mapInArrow(run, "idx long, area long")


def points(frames: DataFrame, n: int) -> DataFrame:
    """(clip, idx, n, x, y) of up to ``n`` points deep in each frame's mask (over 127)."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                mask = (np.asarray(r["plane"]).reshape(r["h"], r["w"]) > 127).astype(float)
                out += [{"clip": r["clip"], "idx": r["idx"], "n": k, "x": x, "y": y} for k, (x, y, _) in enumerate(kernels.interior_points(mask, n))]
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("clip", pa.int32()), ("idx", pa.int64()), ("n", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])
    return frames.mapInArrow(run, "clip int, idx long, n int, x double, y double")


def stabilized(frames: DataFrame, params: kernels.StabilizerParams = kernels.StabilizerParams(least_area=2)) -> DataFrame:
    """(clip, idx, area, total) after the stabilizer, without motion, each frame held by the one before."""

    def run(table: pa.Table) -> pa.Table:
        clip = table.column("clip")[0].as_py()
        numbers, planes = in_order(table)
        before, out = None, []
        for idx, plane in zip(numbers, planes, strict=True):
            alpha = kernels.clamp01(plane / 255)
            before = kernels.stabilize(alpha, before, np.zeros_like(alpha), 1.0, params)
            out.append({"clip": clip, "idx": idx, "area": int((before > 0.5).sum()), "total": round(float(before.sum()), 6)})
        return pa.Table.from_pylist(out, schema=pa.schema([("clip", pa.int32()), ("idx", pa.int64()), ("area", pa.int64()), ("total", pa.float64())]))

    return frames.groupBy("clip").applyInArrow(run, "clip int, idx long, area long, total double")


# ---- the tracker --------------------------------------------------------------


TRACKED = "clip int, idx long, area long, confidence double, low boolean, lost boolean"


def tracked(frames: DataFrame, params: follower.Params = follower.Params()) -> DataFrame:
    """Each clip followed from its first frame, whose mask is what is brighter than half."""

    def run(table: pa.Table) -> pa.Table:
        clip = table.column("clip")[0].as_py()
        numbers, planes = in_order(table)
        first = next(planes)
        subject = follower.Follower(first, (first > 127).astype(float), params)
        out = [(clip, numbers[0], int(subject.alpha.sum()), 1.0, False, False)]
        for idx, image in zip(numbers[1:], planes, strict=True):
            got = subject.follow(image)
            out.append((clip, idx, int(follower.area(got.alpha)), round(got.confidence, 6), got.low, got.lost))
        names = [c.split()[0] for c in TRACKED.split(", ")]
        types = (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_())
        return pa.table({n: pa.array(v, t) for n, v, t in zip(names, zip(*out, strict=True), types, strict=True)})

    return frames.groupBy("clip").applyInArrow(run, TRACKED)


QUALITY = "clip string, idx long, iou double, f double, confidence double, low boolean, lost boolean"


def followed(footage: DataFrame, params: follower.Params = follower.Params()) -> DataFrame:
    """How near the tracker stays to the truth of footage (clip, idx, w, h, bgr, truth): IoU and boundary F of each frame (see QUALITY).

    A clip is one group, as the recurrence asks; its first frame's truth is the
    keyframe and has no row.  A frame's planes are unpacked when it is reached.
    """
    names = [c.split()[0] for c in QUALITY.split(", ")]
    types = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")

        def at(k: int) -> tuple[np.ndarray, np.ndarray]:
            row = {c: table.column(c)[k].as_py() for c in ("w", "h", "bgr", "truth")}
            shape = (row["h"], row["w"])
            return np.frombuffer(row["bgr"], np.uint8).reshape(*shape, 3).astype(np.float32), np.frombuffer(row["truth"], np.uint8).reshape(shape) / 255

        subject, out = follower.Follower(*at(0), params), []
        for k in range(1, table.num_rows):
            image, truth = at(k)
            got = subject.follow(image)
            quality = follower.iou(got.alpha, truth), kernels.boundary_f(follower.on(got.alpha), follower.on(truth))
            out.append((table.column("clip")[k].as_py(), table.column("idx")[k].as_py(), *(round(q, 6) for q in quality), round(got.confidence, 6), got.low, got.lost))
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return footage.groupBy("clip").applyInArrow(run, QUALITY)
