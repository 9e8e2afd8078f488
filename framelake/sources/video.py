"""The boundary to video decoding, model files and previews.

Nothing here decodes video: ``decode`` is the user's function from a file's bytes
to its frames.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import kernels
from framelake.sources import images

FRAMES = "clip string, idx long, w int, h int, plane array<float>"


def proxy_frames(files: DataFrame, decode: Callable[[bytes], Iterable[np.ndarray]], most: int = 768) -> DataFrame:
    """Grey frames of ``binaryFile`` rows, made smaller to a long edge of at most ``most`` and even sides."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for idx, frame in enumerate(decode(content)):
                    scale = min(1.0, most / max(frame.shape))
                    h, w = (max(2, round(n * scale / 2) * 2) for n in frame.shape)
                    plane = kernels.resize(frame.astype(np.float64), h, w)
                    row = {"clip": path, "idx": idx, "w": w, "h": h, "plane": plane.reshape(-1).astype(np.float32).tolist()}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("clip", pa.string()), ("idx", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("plane", pa.list_(pa.float32()))])
    return files.select("path", "content").mapInArrow(run, FRAMES)


def frames(files: DataFrame, decode: Callable[[bytes], Iterable[np.ndarray]]) -> DataFrame:
    """(clip, idx, w, h, bgr) of ``binaryFile`` rows: the frames at full size and in colour, a row at a time; grey ones count as colours.

    ``proxy.build`` makes a clip's proxy of them.
    """
    schema = pa.schema([("clip", pa.string()), ("idx", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("bgr", pa.binary())])

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for idx, image in enumerate(decode(content)):
                    colours = image if image.ndim == 3 else np.repeat(image[..., None], 3, axis=2)
                    row = {"clip": path.rsplit("/", 1)[-1], "idx": idx, "w": image.shape[1], "h": image.shape[0], "bgr": np.ascontiguousarray(colours, np.uint8).tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)

    return files.select("path", "content").mapInArrow(run, "clip string, idx long, w int, h int, bgr binary")


def verified_models(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest (name, sha256) with ``state``: ok, damaged or missing, from ``binaryFile`` rows."""
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.lower("sha256") == F.col("found"), "ok").otherwise("damaged")
    return manifest.join(found, "name", "left").withColumn("state", state).drop("found")


def frame_number(name: Column) -> Column:
    """The number of a record's file name, null for other files."""
    return F.when(name.rlike(r"^[0-9]+\.acm$"), F.regexp_extract(name, r"^([0-9]+)", 1).cast("int"))


def preview(plane: np.ndarray) -> str:
    """A PNG of a 0 .. 1 plane, cut off to 8 bits, in base64."""
    import base64

    return base64.b64encode(images.png((np.clip(plane, 0, 1) * 255).astype(np.uint8))).decode()
