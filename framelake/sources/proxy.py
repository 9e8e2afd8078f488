"""Proxy frames: an index beside a blob of encoded images.

Fixed values, the index's format, little-endian: frames, width, height and 0 as
u32, frames a second f32, source width and height u32, then an offset u64 and a
size u32 for each frame.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.operators import kernels
from framelake.sources import images, matte_store

BLOB, INDEX = "proxy.bin", "proxy.idx"
HEAD, ENTRY = struct.Struct("<IIIIfII"), struct.Struct("<QI")


def write_index(width: int, height: int, source_width: int, source_height: int, fps: float, entries: list[tuple[int, int]]) -> bytes:
    return HEAD.pack(len(entries), width, height, 0, fps, source_width, source_height) + b"".join(ENTRY.pack(*e) for e in entries)


def _little(start: Column, size: int) -> Column:
    """A number of ``size`` bytes of ``content`` from byte ``start`` (from 1) on."""
    parts = (F.hex(F.substring(F.col("content"), start + size - 1 - k, F.lit(1))) for k in range(size))
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def clips(index_files: DataFrame) -> DataFrame:
    """(path, frames, width, height, source_width, source_height) of ``binaryFile`` rows of index files."""
    at = {"frames": 0, "width": 4, "height": 8, "source_width": 20, "source_height": 24}
    return index_files.select("path", *(_little(F.lit(k + 1), 4).cast("int").alias(n) for n, k in at.items()))


def entries(index_files: DataFrame) -> DataFrame:
    """(path, idx, offset, size) of ``binaryFile`` rows of index files, by built-in expressions; entries that are cut off are left out."""
    held = F.expr(f"cast((length(content) - {HEAD.size}) div {ENTRY.size} as int)")
    n = F.least(_little(F.lit(1), 4).cast("int"), held)
    rows = index_files.filter(F.length("content") >= HEAD.size).select("path", "content", n.alias("n")).filter("n > 0")
    rows = rows.select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    at = F.lit(HEAD.size + 1) + F.col("idx") * ENTRY.size
    return rows.select("path", "idx", _little(at, 8).alias("offset"), _little(at + 8, 4).alias("size"))


# ---- building and reading -----------------------------------------------------


def size(width: int, height: int, long_edge: int) -> tuple[int, int]:
    """Even sides (width, height) within a long edge; halves go to the even number."""
    scale = min(1.0, long_edge / max(width, height))
    return max(2, round(width * scale / 2) * 2), max(2, round(height * scale / 2) * 2)


SMALL = "clip string, idx long, w int, h int, source_w int, source_h int, image binary"
BUILT = "clip string, frames int, w int, h int, n_bytes long"


def shrink(frames: DataFrame, long_edge: int = 768, encode: Callable[[np.ndarray], bytes] = images.png) -> DataFrame:
    """Encoded proxies (see SMALL) of frames (clip, idx, w, h, bgr); a row a frame, where the frames lie."""
    names = [c.split()[0] for c in SMALL.split(", ")]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                w, h = size(r["w"], r["h"], long_edge)
                image = np.frombuffer(r["bgr"], np.uint8).reshape(r["h"], r["w"], 3)
                if (w, h) != (r["w"], r["h"]):
                    image = np.stack([np.floor(kernels.resize_area(image[..., c].astype(float), h, w) + 0.5) for c in range(3)], axis=-1).astype(np.uint8)
                row = (str(r["clip"]), r["idx"], w, h, r["w"], r["h"], encode(np.ascontiguousarray(image)))
                types = (pa.string(), pa.int64(), *[pa.int32()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    return frames.select("clip", "idx", "w", "h", "bgr").mapInArrow(run, SMALL)


def build(frames: DataFrame, root: str, fps: float = 24.0, long_edge: int = 768, encode: Callable[[np.ndarray], bytes] = images.png) -> DataFrame:
    """Write ``<clip>/proxy.bin`` and ``<clip>/proxy.idx`` of frames (clip, idx, w, h, bgr) under ``root``; a row a clip (see BUILT).

    Frames are made small where they lie; a clip's small ones meet in one task,
    which writes them in order, and the index last, so that a blob without an
    index doesn't count.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("idx")
        head = {c: table.column(c)[0].as_py() for c in ("clip", "w", "h", "source_w", "source_h")}
        files, base = matte_store.filesystem(root)
        folder, at, places = f"{base}/{head['clip']}", 0, []
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/{BLOB}") as out:
            for image in table.column("image"):
                data = image.as_py()
                out.write(data)
                places.append((at, len(data)))
                at += len(data)
        matte_store.put(files, f"{folder}/{INDEX}", write_index(head["w"], head["h"], head["source_w"], head["source_h"], fps, places))
        return pa.table({"clip": [head["clip"]], "frames": pa.array([len(places)], pa.int32()), "w": pa.array([head["w"]], pa.int32()), "h": pa.array([head["h"]], pa.int32()), "n_bytes": pa.array([at], pa.int64())})

    return shrink(frames, long_edge, encode).groupBy("clip").applyInArrow(run, BUILT)


def exists(root: str, clip: str) -> bool:
    files, base = matte_store.filesystem(root)
    return all(i.type == fs.FileType.File for i in files.get_file_info([f"{base}/{clip}/{n}" for n in (BLOB, INDEX)]))


def read(wanted: DataFrame, root: str, decode: Callable[[bytes], np.ndarray] = images.from_png) -> DataFrame:
    """Frames (clip, idx, frame, w, h, bgr) of rows (clip, idx): a number outside a clip means its first or last ``frame``.

    Each is one range read.  A clip without a proxy gives nulls; a damaged frame is an error.
    """
    schema = pa.schema([("clip", pa.string()), ("idx", pa.int64()), ("frame", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("bgr", pa.binary())])

    def run(batches):
        files, base = matte_store.filesystem(root)
        known: dict[str, bytes | None] = {}
        for batch in batches:
            for r in batch.to_pylist():
                clip = str(r["clip"])
                if clip not in known:
                    known.clear()  # rows of a clip come together
                    known[clip] = matte_store.get(files, f"{base}/{clip}/{INDEX}")
                yield pa.RecordBatch.from_pylist([_one(files, f"{base}/{clip}/{BLOB}", known[clip], clip, r["idx"], decode)], schema=schema)

    return wanted.select("clip", "idx").repartition("clip").sortWithinPartitions("clip", "idx").mapInArrow(run, "clip string, idx long, frame long, w int, h int, bgr binary")


def _one(files, blob: str, index: bytes | None, clip: str, idx: int, decode: Callable[[bytes], np.ndarray]) -> dict:
    n = 0 if index is None else HEAD.unpack_from(index)[0]
    if not n:
        return {"clip": clip, "idx": idx, "frame": None, "w": None, "h": None, "bgr": None}
    frame = max(0, min(n - 1, idx))
    offset, length = ENTRY.unpack_from(index, HEAD.size + frame * ENTRY.size)
    with files.open_input_file(blob) as source:
        source.seek(offset)
        image = decode(source.read(length))
    return {"clip": clip, "idx": idx, "frame": frame, "w": image.shape[1], "h": image.shape[0], "bgr": image.tobytes()}
