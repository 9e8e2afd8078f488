"""Frames as a sequence of PNG files: 8 or 16 bits, grey or RGBA."""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.operators import kernels
from framelake.sources import matte_store


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(plane: np.ndarray) -> bytes:
    """A (h, w), (h, w, 3) or (h, w, 4) array of 8- or 16-bit samples."""
    height, width = plane.shape[:2]
    depth, kind = 8 * plane.dtype.itemsize, 0 if plane.ndim == 2 else {3: 2, 4: 6}[plane.shape[2]]
    rows = plane.astype(plane.dtype.newbyteorder(">")).reshape(height, -1).view(np.uint8)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), rows], axis=1)
    head = struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples of a file that ``png`` made; anything else is an error."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth, kind = struct.unpack(">IIBB", data[16:26])
    at, packed = 8, []
    while at < len(data):
        size = struct.unpack_from(">I", data, at)[0]
        body = data[at + 4 : at + 8 + size]
        if len(data) < at + 12 + size or zlib.crc32(body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError("damaged PNG")
        if body[:4] == b"IDAT":
            packed.append(body[4:])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, -1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    channels = {0: (), 2: (3,), 6: (4,)}[kind]
    return np.ascontiguousarray(lines[:, 1:]).view(f">u{depth // 8}").reshape(height, width, *channels).astype(f"u{depth // 8}")


def _placed(files, folder: str, idx: int, data: bytes) -> str:
    """Write a file by way of a rename; its path."""
    files.create_dir(folder, recursive=True)
    draft, path = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/{idx:06d}.png"
    with files.open_output_stream(draft) as f:
        f.write(data)
    files.move(draft, path)
    return path


def write_cutouts(frames: DataFrame, mattes: DataFrame, out_dir: str, params: kernels.EdgeParams = kernels.EdgeParams(), kinds: tuple[str, ...] = ("alpha", "cutout"), premultiply: bool = False) -> DataFrame:
    """Render frames (clip, idx, w, h, bgr) with their mattes (clip, idx, mw, mh, alpha) to ``<clip>/<kind>/<idx>.png`` of 16 bits.

    ``alpha`` is the grey alpha, ``cutout`` the colours with it, multiplied by it if asked for.  Returns (clip, idx, kind, path); a
    frame without a matte is skipped and has one row without a path.
    """
    schema = pa.schema([("clip", pa.string()), ("idx", pa.int64()), ("kind", pa.string()), ("path", pa.string())])
    sixteen = lambda a: np.floor(np.clip(a, 0, 1) * 65535 + 0.5).astype(np.uint16)

    def run(batches):
        files, base = matte_store.filesystem(out_dir)
        for batch in batches:
            for r in batch.to_pylist():
                row = {"clip": str(r["clip"]), "idx": r["idx"]}
                out = [{**row, "kind": None, "path": None}]
                if r["alpha"] is not None:
                    matte = np.frombuffer(r["alpha"], np.uint8).reshape(r["mh"], r["mw"]).astype(float)
                    image = np.frombuffer(r["bgr"], np.uint8).reshape(r["h"], r["w"], 3)[..., ::-1] / 255
                    rgba = kernels.cutout(matte, image, params)
                    if premultiply:
                        rgba[..., :3] *= rgba[..., 3:]
                    rendered = sixteen(rgba)
                    planes = {"alpha": rendered[..., 3], "cutout": rendered}
                    out = [{**row, "kind": k, "path": _placed(files, f"{base}/{r['clip']}/{k}", r["idx"], png(np.ascontiguousarray(planes[k])))} for k in kinds]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    joined = frames.select("clip", "idx", "w", "h", "bgr").join(mattes.select("clip", "idx", "mw", "mh", "alpha"), ["clip", "idx"], "left")
    return joined.mapInArrow(run, "clip string, idx long, kind string, path string")


def write_sequence(frames: DataFrame, out_dir: str, bits: int = 16) -> DataFrame:
    """Write alpha planes (clip, idx, w, h, plane of 0 .. 1) as ``<clip>/<idx>.png``; returns (clip, idx, path, n_bytes).

    ``out_dir`` is a path or URI that all executors share; files get their names
    by a rename, so that a repeated task leaves the same.
    """
    top, kind = (1 << bits) - 1, np.uint16 if bits == 16 else np.uint8
    schema = pa.schema([("clip", pa.string()), ("idx", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64())])

    def run(batches):
        files, base = matte_store.filesystem(out_dir)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                plane = np.floor(np.clip(np.asarray(r["plane"], np.float64), 0, 1) * top + 0.5).astype(kind).reshape(r["h"], r["w"])
                data = png(plane)
                out.append({"clip": str(r["clip"]), "idx": r["idx"], "path": _placed(files, f"{base}/{r['clip']}", r["idx"], data), "n_bytes": len(data)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return frames.select("clip", "idx", "w", "h", "plane").mapInArrow(run, "clip string, idx long, path string, n_bytes long")
