"""Connected components of masks, 8 neighbours.

``of_planes`` takes whole planes: a row a frame, one pass, no shuffle.  The others
work over the pixel lens, where labels start as the pixel's number and go to the least label around; a round is
a 3 x 3 minimum by windows and a jump to the label's label.  One scalar a round
comes to the driver.
"""

from __future__ import annotations

import os
import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.operators import kernels, metrics, plane


def label(px: DataFrame, width: int, max_rounds: int = 10_000, every: int = 4) -> DataFrame:
    """(clip, idx, y, x, label) of the pixels with ``m`` = 1; a label is the least y * width + x of its component."""
    spark = px.sparkSession
    number = F.col("y") * width + F.col("x")
    now = plane.by_frame(px.select("clip", "idx", "y", "x", F.when(F.col("m") == 1, number).alias("label")))
    total = -1
    for _ in range(max_rounds):
        for _ in range(every):
            now = plane.erode(now, "label", "_near", 3)
            # the least label of all pixels that had this one
            jump = F.min("_near").over(Window.partitionBy("clip", "idx", "label"))
            now = now.withColumn("label", F.when(F.col("label").isNotNull(), jump)).drop("_near")
        now = cut(spark, now)
        found = now.agg(F.sum("label")).first()[0]
        if found == total:
            break
        total = found
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    return now.filter(F.col("label").isNotNull())


def cut(spark, df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that spark.checkpoint.dir names."""
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "framelake-checkpoints"))
    return df.checkpoint()


def of_planes(frames: DataFrame, fraction: float = 0.0) -> DataFrame:
    """(clip, idx, label, area, left, top, width, height, held, kept) of each component of whole masks ``m`` (arrays of 0 and 1, ``w`` wide).

    A label is the least y * width + x of its component.  With a column ``support``
    (such a mask, or null) ``held`` is the share of the component on it, else 0;
    ``kept`` says that it has at least ``fraction`` of the frame's largest area or
    is more than half held.
    """
    named = frames if "support" in frames.columns else frames.withColumn("support", F.lit(None).cast("array<int>"))
    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    names = ["label", "area", "left", "top", "width", "height", "held", "kept"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()]

    def measured(mask: np.ndarray, support: np.ndarray | None) -> list[np.ndarray]:
        labels = kernels.label(mask > 0)
        at = np.flatnonzero(labels)
        of, (y, x) = labels.reshape(-1)[at] - 1, np.divmod(at, mask.shape[1])
        n = int(labels.max()) if labels.size else 0
        area = np.bincount(of, minlength=n)
        least, most = ([f.reduceat(v[order], starts) if n else np.zeros(0, int) for v in (x, y)] for order, starts in [(np.argsort(of, kind="stable"), np.cumsum(area) - area)] for f in (np.minimum, np.maximum))
        held = np.zeros(n) if support is None else np.bincount(of, weights=support.reshape(-1)[at] > 0, minlength=n) / area
        first = np.unique(of, return_index=True)[1]
        kept = (area >= fraction * area.max(initial=0)) | (held > 0.5)
        return [at[first], area, least[0], least[1], most[0] - least[0] + 1, most[1] - least[1] + 1, held, kept]

    def run(batches):
        for batch in batches:
            out = [measured(m, s) for m, s in metrics._arrays(batch, ["m", "support"])]
            rows = np.repeat(np.arange(len(out)), [len(o[0]) for o in out])
            columns = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("clip", "idx")), *columns], names=["clip", "idx", *names])

    schema = f"clip {types['clip']}, idx {types['idx']}, label int, area long, left int, top int, width int, height int, held double, kept boolean"
    return named.select("clip", "idx", "w", "m", "support").mapInArrow(run, schema)


def statistics(labelled: DataFrame) -> DataFrame:
    """Area and box of each component."""
    return labelled.groupBy("clip", "idx", "label").agg(
        F.count("*").alias("area"), F.min("x").alias("left"), F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"),
    )


def keep_large(labelled: DataFrame, fraction: float, support: DataFrame | None = None) -> DataFrame:
    """Components of at least ``fraction`` of the frame's largest, or more than half on ``support`` (clip, idx, y, x, s)."""
    sized = statistics(labelled).withColumn("largest", F.max("area").over(Window.partitionBy("clip", "idx")))
    keep = F.col("area") >= F.lit(fraction) * F.col("largest")
    if support is not None:
        on = labelled.join(support, ["clip", "idx", "y", "x"], "left")
        held = on.groupBy("clip", "idx", "label").agg(F.avg(F.coalesce("s", F.lit(0)).cast("double")).alias("held"))
        sized = sized.join(held, ["clip", "idx", "label"])
        keep = keep | (F.col("held") > 0.5)
    return sized.withColumn("kept", keep).drop("largest")
