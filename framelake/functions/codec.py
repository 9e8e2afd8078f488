"""Run-length codec of 8-bit planes and the matte record.

Fixed values, the record's format, little-endian:
    magic 'ACM1', width u32, height u32, crc32 of the payload u32, flags u8,
    confidence u8, reserved u16, payload length u32; payload: (value u8, run u16)*
A run is at most 65535; longer ones are split.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC, HEAD = b"ACM1", struct.Struct("<4sIIIBBHI")
MOST_RUN, MOST_SIDE = 65535, 32768


def runs(px: DataFrame, most: int = MOST_RUN) -> DataFrame:
    """(clip, idx, seq, value, length) of each plane's runs in row order, from the pixel lens."""
    order = Window.partitionBy("clip", "idx").orderBy("y", "x")
    begins = F.when(F.col("v") == F.lag("v").over(order), 0).otherwise(1)
    islands = px.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("clip", "idx", "_run", F.col("v").alias("value")).agg(F.count("*").alias("n"))
    split = whole.withColumn("k", F.explode(F.expr(f"sequence(0, cast((n - 1) div {most} as int))")))
    length = F.least(F.col("n") - F.col("k") * most, F.lit(most))
    seq = F.row_number().over(Window.partitionBy("clip", "idx").orderBy("_run", "k")) - 1
    return split.select("clip", "idx", seq.cast("int").alias("seq"), "value", length.cast("int").alias("length"))


def expand(run_rows: DataFrame, width: int) -> DataFrame:
    """The pixel lens of runs."""
    before = F.sum("length").over(Window.partitionBy("clip", "idx").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = run_rows.withColumn("_at", F.coalesce(before, F.lit(0)))
    pixels = placed.select("clip", "idx", "value", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("length") - 1)).alias("p"))
    return pixels.select("clip", "idx", F.expr(f"cast(p div {width} as int)").alias("y"), F.expr(f"cast(p % {width} as int)").alias("x"), F.col("value").alias("v"))


def encode(plane: np.ndarray) -> bytes:
    """Payload of a plane; an empty one has none."""
    flat = np.ascontiguousarray(plane, np.uint8).reshape(-1)
    if not flat.size:
        return b""
    begins = np.concatenate([[0], 1 + np.flatnonzero(np.diff(flat))])
    lengths = np.diff(np.append(begins, flat.size))
    pieces = -(-lengths // MOST_RUN)
    value = np.repeat(flat[begins], pieces)
    out = np.zeros(len(value), np.dtype([("value", "u1"), ("run", "<u2")]))
    out["value"], out["run"] = value, MOST_RUN
    out["run"][np.cumsum(pieces) - 1] = lengths - (pieces - 1) * MOST_RUN
    return out.tobytes()


def decode(payload: bytes, width: int, height: int) -> np.ndarray:
    """Inverse of ``encode``; a payload of another size is an error."""
    if len(payload) % 3:
        raise ValueError("payload isn't whole runs")
    rows = np.frombuffer(payload, np.dtype([("value", "u1"), ("run", "<u2")]))
    if int(rows["run"].sum(dtype=np.int64)) != width * height:
        raise ValueError("runs don't fill the plane")
    return np.repeat(rows["value"], rows["run"]).reshape(height, width)


def pack(plane: np.ndarray, confidence: float, flags: int) -> bytes:
    """A matte record; the confidence goes to 0 .. 255, halves to the even number."""
    height, width = plane.shape
    payload = encode(plane)
    return HEAD.pack(MAGIC, width, height, zlib.crc32(payload), flags & 255, round(min(1.0, max(0.0, confidence)) * 255), 0, len(payload)) + payload


def unpack(record: bytes) -> dict | None:
    """Fields and plane of a record; None if it is damaged in any way or has no or too long sides."""
    if len(record) < HEAD.size:
        return None
    magic, width, height, crc, flags, confidence, _, size = HEAD.unpack_from(record)
    payload = record[HEAD.size :]
    if magic != MAGIC or len(payload) != size or zlib.crc32(payload) != crc or not (0 < width <= MOST_SIDE and 0 < height <= MOST_SIDE):
        return None
    try:
        alpha = decode(payload, width, height)
    except ValueError:
        return None
    return {"w": width, "h": height, "alpha": alpha.tobytes(), "confidence": confidence / 255, "flags": flags, "crc": crc}


def packed(frames: DataFrame) -> DataFrame:
    """(clip, idx, record) of mattes (clip, idx, w, h, alpha, confidence, flags)."""
    types = {f.name: f.dataType.simpleString() for f in frames.schema}

    def run(batches):
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("w", "h", "alpha", "confidence", "flags"))
            out = [pack(np.frombuffer(a, np.uint8).reshape(h, w), conf, flags) for w, h, a, conf, flags in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("idx"), pa.array(out, pa.binary())], names=["clip", "idx", "record"])

    return frames.select("clip", "idx", "w", "h", "alpha", "confidence", "flags").mapInArrow(run, f"clip {types['clip']}, idx {types['idx']}, record binary")


def unpacked(records: DataFrame) -> DataFrame:
    """(clip, idx, w, h, alpha, confidence, flags) of records (clip, idx, record); of a damaged one nulls."""
    types = {f.name: f.dataType.simpleString() for f in records.schema}
    kinds = {"w": pa.int32(), "h": pa.int32(), "alpha": pa.binary(), "confidence": pa.float64(), "flags": pa.int32()}

    def run(batches):
        for batch in batches:
            out = [unpack(r) or {} for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("clip"), batch.column("idx"), *(pa.array([o.get(k) for o in out], t) for k, t in kinds.items())], names=["clip", "idx", *kinds])

    return records.select("clip", "idx", "record").mapInArrow(run, f"clip {types['clip']}, idx {types['idx']}, w int, h int, alpha binary, confidence double, flags int")
