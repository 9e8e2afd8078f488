"""Media columns: content-addressed payloads in tar shards.

A payload is stored once, as an 8-bit greyscale PNG of 64 columns, under the name
of its SHA-256 digest.  Rows carry digest, shard, offset and length.  Metadata
columns (width, height, bit depth) come from reads of a stored payload's first 33
bytes alone; features come from the whole stored payload, read back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import runtime

WIDTH, LEVEL = 64, 6
SHARD_BYTES = 64 << 20
PNG = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
#: Digests a task remembers; beyond it forgets them, and may store one again, which the places sort out.
MOST_SEEN = 1 << 18

PLACES = "digest binary, shard string, offset long, length long"
FEATURES = "digest binary, shard string, offset long, width int, height int, bit_depth int, payload_bytes long, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 0 up to a positive multiple of the width."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bit depth) from a PNG's first 33 bytes."""
    if head[:8] != PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, depth = struct.unpack(">IIB", head[16:25])
    return width, height, depth


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` made."""
    width, height, _ = png_header(stored)
    at, data = 8, []
    while at < len(stored):
        size = struct.unpack_from(">I", stored, at)[0]
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a hash of which of 64 blocks are over the mean."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    value = np.arange(256)
    mean = float((counts * value).sum() / len(x))
    deviation = float(np.sqrt(max(0.0, (counts * value * value).sum() / len(x) - mean * mean)))
    p = counts[counts > 0] / len(x)
    entropy = float(-(p * np.log2(p)).sum())
    edges = np.arange(65) * len(x) // 64
    sums = np.add.reduceat(x.astype(np.int64), edges[:-1])
    blocks = np.packbits(sums > mean * np.diff(edges)).tobytes().hex()
    return f"{mean:.4f},{deviation:.4f},{entropy:.4f},{blocks}"


class ShardWriter:
    """A tar file written front to back; tells where each member's bytes lie."""

    def __init__(self, sink):
        self.sink, self.at = sink, 0

    def add(self, name: str, data: bytes) -> int:
        info = tarfile.TarInfo(name)
        info.size, info.mode = len(data), 0o644
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.sink.write(head)
        self.sink.write(data)
        self.sink.write(bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return offset

    def close(self) -> None:
        self.sink.write(bytes(1024))


def store(docs: DataFrame, out_dir: str) -> DataFrame:
    """Write payloads where the rows lie; returns a row for each document: doc_id, n_bytes, digest, shard, offset, length.

    A task stores each digest once, of the last ``MOST_SEEN``.  A digest that is stored several times has one
    place that counts, the least (see ``places``); the other copies, at most one
    a task, are never pointed to.  A lost task's shards are in no manifest.  A
    null text is an empty one.
    """
    runtime.small_batches(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = runtime.filesystem(out_dir)
        sink = writer = None
        shard = ""
        seen: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                payload = padded(raw)
                digest = hashlib.sha256(payload)
                if digest.digest() not in seen:
                    if writer is not None and writer.at >= SHARD_BYTES:
                        writer.close()
                        sink.close()
                        writer = None
                    if writer is None:
                        fs.create_dir(base, recursive=True)
                        name = f"{uuid.uuid4().hex}.tar"
                        shard = f"{out_dir}/{name}"
                        sink = fs.open_output_stream(f"{base}/{name}")
                        writer = ShardWriter(sink)
                    stored = to_png(payload)
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen[digest.digest()] = shard, writer.add(f"{digest.hexdigest()}.png", stored), len(stored)
                for column, value in zip(rows, (doc, len(raw), digest.digest(), *seen[digest.digest()]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if writer is not None:
            writer.close()
            sink.close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return runtime.stage(texts.mapInArrow(runtime.frugal(write), "doc_id long, n_bytes long, " + PLACES), "media-rows")


def places(rows: DataFrame) -> DataFrame:
    """The place of each digest, dealt by ranges so that a task reads few shards, front to back."""
    least = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # by a hash of the path: the range bounds, and the sample they come from, stay small
    return least.repartitionByRange(F.xxhash64("shard"), "offset").sortWithinPartitions("shard", "offset")


def read_headers(found: DataFrame) -> DataFrame:
    """Places with width, height and bit_depth, by reads of 33 bytes each."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [png_header(head) for _, head in _ranges(batch, HEADER_BYTES)]
            w, h, d = zip(*heads, strict=True) if heads else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int32()) for c in (w, h, d))], names=[*batch.schema.names, "width", "height", "bit_depth"])

    return found.mapInArrow(runtime.frugal(read), PLACES + ", width int, height int, bit_depth int")


def read_features(headed: DataFrame) -> DataFrame:
    """Per digest, of the stored bytes read back (see FEATURES); a payload that doesn't match its digest is an error."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in FEATURES.split(", "))
            known = zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "width", "height", "bit_depth")), strict=True)
            for (digest, stored), more in zip(_ranges(batch, None), known, strict=True):
                payload = from_png(stored)
                if hashlib.sha256(payload).digest() != digest:
                    raise ValueError(f"payload {digest.hex()} is damaged")
                row = (digest, *more, len(payload), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).digest(), feature(payload))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, _TYPES[f.split()[1]]) for c, f in zip(out, FEATURES.split(", "), strict=True)], names=[f.split()[0] for f in FEATURES.split(", ")])

    return headed.mapInArrow(runtime.frugal(read), FEATURES)


_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32()}


def _ranges(batch: pa.RecordBatch, most: int | None) -> Iterator[tuple[bytes, bytes]]:
    """(digest, bytes) of each row's range, or of its first ``most`` bytes."""
    source, opened = None, None
    try:
        for digest, shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
            if shard != opened:
                if source is not None:
                    source.close()
                fs, path = runtime.filesystem(shard)
                source, opened = fs.open_input_file(path), shard
            source.seek(offset)
            yield digest, source.read(length if most is None else min(most, length))
    finally:
        if source is not None:
            source.close()


def media_columns(docs: DataFrame, out_dir: str) -> DataFrame:
    """Every row's doc_id and n_bytes with its payload's digest, place, metadata and features.

    Null texts are empty ones, whose payload is one row of bytes 0.  Equal texts
    share one place, and so do texts that differ in closing bytes 0 alone.
    Repeated and null ids are rows like any other; an empty table gives an empty
    one; extra columns are left out.
    """
    rows = store(docs, out_dir)
    found = runtime.stage(read_features(read_headers(places(rows))), "media-features")
    out = rows.select("doc_id", "n_bytes", "digest").join(found, "digest")
    hexed = {c: F.lower(F.hex(c)) for c in ("digest", "media_sha256")}
    return out.withColumns(hexed).withColumn("payload_sha256", F.col("digest"))
