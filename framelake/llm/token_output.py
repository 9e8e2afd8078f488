"""Token ids as binary files of bit-plane-shuffled blocks.

A file holds the ids of a run of documents in ascending ``doc_id`` order.  Its
ids are cut into blocks of a fixed number; a block is transposed into byte
planes (all low bytes, then all next bytes ...) or bit planes, and each plane is
compressed by zstandard on its own.  The footer has the documents (id, number of
ids) and the chunk index (where each block lies and how long its planes are), so
that a reader can fetch any range of ids.

    'FLTK' version:u8 planes:u8(0 byte, 1 bit) width:u8 pad:u8 block:u32
    blocks: the compressed planes one after the other
    footer: zstd(n_docs:u64 n_blocks:u64 nulls:u8[n_docs] doc_ids:i64[] counts:u64[]
                 offsets:u64[n_blocks] sizes:u32[n_blocks][n_planes] ids:u32[n_blocks])
    footer_len:u64 crc32(footer):u32 'KTLF'

All numbers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import runtime
from framelake.llm.tokens import encoder

MAGIC, END = b"FLTK", b"KTLF"
#: Ids of a block, ids after which a task begins another file.
BLOCK_IDS, FILE_IDS = 1 << 16, 1 << 23
BATCH_BYTES = 4 << 20
#: Files that one row of the upper level of the running sum stands for.
FILES_PER_BUCKET = 1024
#: Rows that a reader gives out at a time: a file of documents without words has millions.
READ_ROWS = 1 << 16

MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def to_planes(ids: np.ndarray, width: int, kind: str) -> list[bytes]:
    """The byte or bit planes of ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)[:, :width]
    if kind == "byte":
        return [raw[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, kind: str) -> np.ndarray:
    """Inverse of ``to_planes``."""
    raw = np.zeros((n, 4), np.uint8)
    if kind == "byte":
        for k in range(width):
            raw[:, k] = np.frombuffer(planes[k], np.uint8)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        raw[:, :width] = np.packbits(bits, axis=1, bitorder="little")
    return raw.view("<u4").reshape(-1).astype(np.uint32)


class PlaneWriter:
    """Writes one file; memory holds one block and the footer."""

    def __init__(self, sink, width: int, kind: str = "byte", block: int = BLOCK_IDS, level: int = 1):
        self.sink, self.width, self.kind, self.block = sink, width, kind, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = 0
        self.offsets: list[int] = []
        self.sizes: list[list[int]] = []
        self.block_ids: list[int] = []
        sink.write(struct.pack("<4sBBBBI", MAGIC, 1, int(kind == "bit"), width, 0, block))
        self.at = 12

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n_ids += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for i in range(0, whole, self.block):
                self._write(flat[i : i + self.block])
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.width, self.kind)]
        self.offsets.append(self.at)
        self.sizes.append([len(p) for p in planes])
        self.block_ids.append(len(ids))
        for p in planes:
            self.sink.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Length of the file."""
        flat = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        if len(flat):
            self._write(flat)
        nulls = np.array([d is None for d in self.docs], np.uint8)
        parts = [
            np.array([len(self.docs), len(self.offsets)], "<u8"), nulls,
            np.array([d or 0 for d in self.docs], "<i8"), np.array(self.counts, "<u8"),
            np.array(self.offsets, "<u8"), np.array(self.sizes, "<u4"), np.array(self.block_ids, "<u4"),
        ]
        footer = self.zstd.compress(b"".join(p.tobytes() for p in parts))
        self.sink.write(footer + struct.pack("<QI4s", len(footer), zlib.crc32(footer), END))
        return self.at + len(footer) + 16


class PlaneReader:
    """Reads a file by ranges: the footer, then the blocks that are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(0)
        magic, version, bit, self.width, _, self.block = struct.unpack("<4sBBBBI", source.read(12))
        source.seek(size - 16)
        footer_len, crc, end = struct.unpack("<QI4s", source.read(16))
        if magic != MAGIC or version != 1 or end != END:
            raise ValueError("not a token file")
        self.kind = "bit" if bit else "byte"
        source.seek(size - 16 - footer_len)
        footer = source.read(footer_len)
        if zlib.crc32(footer) != crc:
            raise ValueError("the footer is damaged")
        raw = zstandard.ZstdDecompressor().decompress(footer)
        n_docs, n_blocks = struct.unpack_from("<QQ", raw)
        n_planes = self.width * (8 if bit else 1)
        at = 16

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.nulls, self.docs, self.counts = take("u1", n_docs), take("<i8", n_docs), take("<u8", n_docs).astype(np.int64)
        self.offsets, self.sizes = take("<u8", n_blocks), take("<u4", n_blocks * n_planes).reshape(n_blocks, n_planes)
        self.block_ids = take("<u4", n_blocks).astype(np.int64)
        self.zstd = zstandard.ZstdDecompressor()

    def read_block(self, k: int) -> np.ndarray:
        self.source.seek(int(self.offsets[k]))
        planes = []
        for size in self.sizes[k]:
            planes.append(self.zstd.decompress(self.source.read(int(size))))
        return from_planes(planes, int(self.block_ids[k]), self.width, self.kind)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document in order; memory holds its blocks."""
        held, begin, k, start = np.zeros(0, np.uint32), 0, 0, 0
        for null, doc, n in zip(self.nulls, self.docs, self.counts, strict=True):
            if begin + n > len(held):
                parts, have = [held[begin:]], len(held) - begin
                while have < n:
                    parts.append(self.read_block(k))
                    have += len(parts[-1])
                    k += 1
                held, begin = np.concatenate(parts), 0
            yield (None if null else int(doc)), start, held[begin : begin + n]
            begin += n
            start += n


def write_tokens(docs: DataFrame, tokenizer_path: str, out_dir: str, end_id: int = 0, kind: str = "byte") -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write token files; returns their manifest.

    Texts are range-partitioned by ``doc_id`` (nulls first; equal ids are told
    apart by the text's hash, so that a repeated id isn't one task's), sorted
    inside their task, encoded whole and followed by ``end_id``.  A null text is
    an empty one: its ids are the end id alone.  Other columns are left out.  An
    empty table gives an empty manifest.  A task writes files under names of its
    own and reports them; what a lost task wrote is in no manifest.
    """
    runtime.small_batches(docs.sparkSession)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(tokenizer_path)
        width = 2 if max(len(enc.edge) - 1, end_id) < 1 << 16 else 4
        fs, base = runtime.filesystem(out_dir)
        part, rows, seq, writer, sink, path = TaskContext.get().partitionId(), [], 0, None, None, ""

        def close() -> None:
            nonlocal writer, seq
            n_bytes = writer.close()
            sink.close()
            rows.append((part, seq, path, len(writer.docs), writer.n_ids, n_bytes))
            writer, seq = None, seq + 1

        for batch in runtime.regrouped(batches, "text", BATCH_BYTES):
            ids, offsets = enc.encode(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    name = f"tokens-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.fltk"
                    path = f"{out_dir}/{name}"
                    sink = fs.open_output_stream(f"{base}/{name}")
                    writer = PlaneWriter(sink, width, kind)
                writer.add(doc, np.append(ids[offsets[k] : offsets[k + 1]], np.uint32(end_id)))
                if writer.n_ids >= FILE_IDS:
                    close()
        if writer is not None:
            close()
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = ["part", "seq", "path", "n_docs", "n_ids", "n_bytes"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "text")
    return runtime.stage(ordered.select("doc_id", "text").mapInArrow(runtime.frugal(write), MANIFEST), "token-manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """The manifest with ``file_start``: ids in all files before.

    Two levels: files inside a bucket of neighbouring parts, and the buckets.
    """
    bucketed = manifest.withColumn("bucket", F.expr(f"part div {FILES_PER_BUCKET}"))
    inside = Window.partitionBy("bucket").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy("bucket").agg(F.sum("n_ids").alias("bucket_ids"))
    before = totals.select("bucket", F.coalesce(F.sum("bucket_ids").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    local = bucketed.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return local.join(before, "bucket").select("part", "seq", "path", "n_docs", "n_ids", "n_bytes", (F.col("before") + F.col("inside")).alias("file_start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = runtime.filesystem(row["path"])
                with fs.open_input_file(path) as source:
                    out: tuple[list, ...] = ([], [], [], [])
                    for doc, start, ids in PlaneReader(source, row["n_bytes"]).documents():
                        for column, value in zip(out, (doc, row["file_start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        if len(out[0]) == READ_ROWS:
                            yield rows_of(out)
                            out = ([], [], [], [])
                    yield rows_of(out)

    def rows_of(columns: tuple[list, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = max(1, min(manifest.count(), 100_000))
    files = with_starts(manifest).select("path", "n_bytes", "file_start").repartition(spread, "path")
    return files.mapInArrow(runtime.frugal(read), "doc_id long, start long, n_tokens long, ids_crc32 long")
