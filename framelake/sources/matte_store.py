"""Matte sets in a shared folder, and their records as a Spark data source: ``spark.read.format("acm")``.

A set is a folder with ``meta.ini`` (key=value lines), sidecars of JSON, and
``<idx>.acm`` records in ``masks``; a root folder holds sets and ``_active.txt``, the
name of the one in use.  Folders are paths or URIs that all nodes reach; they are
read and written by pyarrow's file systems, never as local files of a node.

A damaged record counts as missing: reads leave it out, ``damaged`` lists it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from framelake.functions import codec

SCHEMA = "set string, idx int, w int, h int, alpha binary, confidence double, flags int"
NAME = re.compile(r"^([0-9]+)\.acm$")
#: Larger files hold no record.
MOST_BYTES = 256 << 20
MASKS, META, ACTIVE = "masks", "meta.ini", "_active.txt"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _folder(files: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    return files.get_file_info(fs.FileSelector(path, allow_not_found=True))


def put(files: fs.FileSystem, path: str, data: bytes) -> None:
    """Write a file by way of a rename, so that readers see all of it or what was there before."""
    folder, name = path.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(draft) as f:
        f.write(data)
    files.move(draft, path)


def get(files: fs.FileSystem, path: str) -> bytes | None:
    try:
        with files.open_input_stream(path) as f:
            return f.read()
    except FileNotFoundError:
        return None


# ---- records ------------------------------------------------------------------


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class MatteReader(DataSourceReader):
    """Lists the folder once on the driver and deals out the files."""

    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path.rstrip("/"), per_task

    def partitions(self) -> list[Files]:
        files, base = filesystem(self.path)
        found = sorted((int(m[1]), i.base_name) for i in _folder(files, base) if (m := NAME.match(i.base_name)) and i.size <= MOST_BYTES)
        names = [n for _, n in found]
        return [Files(names[i : i + self.per_task]) for i in range(0, len(names), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        files, base = filesystem(self.path)
        for name in partition.paths:
            got = codec.unpack(get(files, f"{base}/{name}") or b"")
            if got is not None:
                yield _set_of(f"{base}/{name}"), int(NAME.match(name)[1]), got["w"], got["h"], got["alpha"], got["confidence"], got["flags"]


def _set_of(path: str) -> str:
    """The set that a record's path tells: the folder, or that above ``masks``."""
    *above, folder, _ = path.split("/")
    return above[-1] if folder == MASKS and above else folder


@dataclass
class Drafts(WriterCommitMessage):
    """What a task wrote: (draft, name) of each record."""

    written: list[tuple[str, str]]


class MatteWriter(DataSourceWriter):
    """Tasks write drafts; only the commit names them, so that a lost or repeated task leaves nothing behind that counts.

    Appending replaces records of the same idx; overwriting leaves only the new
    ones.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, rows) -> Drafts:
        files, base = filesystem(self.path)
        folder, written = f"{base}/.drafts-{self.job}", []
        files.create_dir(folder, recursive=True)
        for row in rows:
            draft = f"{folder}/{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as f:
                f.write(codec.pack(np.frombuffer(row.alpha, np.uint8).reshape(row.h, row.w), row.confidence, row.flags))
            written.append((draft, f"{row.idx:06d}.acm"))
        return Drafts(written)

    def commit(self, messages) -> None:
        files, base = filesystem(self.path)
        drafts = [d for m in messages if m is not None for d in m.written]
        if self.overwrite:
            new = {name for _, name in drafts}
            for i in _folder(files, base):
                if NAME.match(i.base_name) and i.base_name not in new:
                    files.delete_file(i.path)
        for draft, name in drafts:
            files.move(draft, f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        files, base = filesystem(self.path)
        folder = f"{base}/.drafts-{self.job}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


class MatteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "acm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> MatteReader:
        return MatteReader(self.options["path"], int(self.options.get("filesPerTask", 64)))

    def writer(self, schema: StructType, overwrite: bool) -> MatteWriter:
        return MatteWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MatteSource)


_ARROW = pa.schema([("set", pa.string()), ("idx", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("alpha", pa.binary()), ("confidence", pa.float64()), ("flags", pa.int32())])


def _parsed(files: DataFrame) -> DataFrame:
    """path and SCHEMA of the sound records among ``binaryFile`` rows."""

    def parse(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m, got = NAME.match(path.rsplit("/", 1)[-1]), codec.unpack(content)
                if m and got is not None:
                    out.append({"path": path, "set": _set_of(path), "idx": int(m[1]), **{k: got[k] for k in ("w", "h", "alpha", "confidence", "flags")}})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW.insert(0, pa.field("path", pa.string())))

    return files.filter(F.col("length") <= MOST_BYTES).select("path", "content").mapInArrow(parse, "path string, " + SCHEMA)


def records(files: DataFrame) -> DataFrame:
    """Matte rows from ``binaryFile`` rows: the way for stores that only Spark reads."""
    return _parsed(files).drop("path")


def listed(files: DataFrame, path: str = "path") -> DataFrame:
    """The rows whose path names a record, with its ``set`` and ``idx``; nothing is read but names."""
    parts = F.split(path, "/")
    folder, above = F.element_at(parts, -2), F.try_element_at(parts, F.lit(-3))
    name = F.regexp_extract(F.element_at(parts, -1), NAME.pattern, 1)
    return files.filter((F.size(parts) > 1) & (name != "")).withColumns({"set": F.when((folder == MASKS) & above.isNotNull(), above).otherwise(folder), "idx": name.cast("int")})


def damaged(files: DataFrame) -> DataFrame:
    """Paths of the files that hold no sound record, of any set."""
    return listed(files.select("path")).select("path").join(_parsed(files).select("path"), "path", "left_anti")


def has(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (set, idx) with ``found``: whether there is a file."""
    there = listed(files.select("path")).select("set", "idx").distinct().withColumn("found", F.lit(True))
    return wanted.join(there, ["set", "idx"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def delete(paths: DataFrame) -> DataFrame:
    """Delete files (column ``path``) where the rows lie; (path, gone) of each when it is read.  One that is missing is not gone.

    With ``damaged`` it does away with broken records.
    """
    schema = pa.schema([("path", pa.string()), ("gone", pa.bool_())])

    def run(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                files, at = filesystem(path)
                there = files.get_file_info(at).type == fs.FileType.File
                if there:
                    files.delete_file(at)
                out.append({"path": path, "gone": there})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return paths.select("path").mapInArrow(run, "path string, gone boolean")


# ---- sets ---------------------------------------------------------------------


def set_properties(lines: DataFrame) -> DataFrame:
    """A map of a meta file's key=value lines (column ``value``); only the first = parts them, of equal keys the last counts."""
    parts = F.split("value", "=", 2)
    pairs = lines.filter(F.instr("value", "=") > 0).select(F.monotonically_increasing_id().alias("n"), F.get(parts, F.lit(0)).alias("k"), F.get(parts, F.lit(1)).alias("v"))
    last = pairs.groupBy("k").agg(F.max_by("v", "n").alias("v"))
    return last.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))


def masks(root: str, name: str) -> str:
    """Where a set's records are: the path to read and write in the format "acm"."""
    return f"{root.rstrip('/')}/{name}/{MASKS}"


def create(root: str, name: str, meta: Mapping[str, object], schema: int = 1) -> None:
    """A set with its meta file; what ``meta`` says of the schema counts."""
    files, base = filesystem(root)
    files.create_dir(f"{base}/{name}/{MASKS}", recursive=True)
    write_meta(root, name, {**meta, **({} if "schema" in meta else {"schema": schema})})


def write_meta(root: str, name: str, meta: Mapping[str, object]) -> None:
    files, base = filesystem(root)
    put(files, f"{base}/{name}/{META}", "".join(f"{k}={v}\n" for k, v in meta.items()).encode())


def read_meta(root: str, name: str) -> dict[str, str] | None:
    """A set's properties; None if there is no such set."""
    files, base = filesystem(root)
    raw = get(files, f"{base}/{name}/{META}")
    return None if raw is None else dict(line.split("=", 1) for line in raw.decode().split("\n") if "=" in line)


def sets(root: str) -> list[str]:
    """Names of the sets, sorted: the folders with a meta file."""
    files, base = filesystem(root)
    folders = [i.path for i in _folder(files, base) if i.type == fs.FileType.Directory]
    metas = files.get_file_info([f"{f}/{META}" for f in folders]) if folders else []
    return sorted(f.rsplit("/", 1)[-1] for f, i in zip(folders, metas, strict=True) if i.type == fs.FileType.File)


def activate(root: str, name: str) -> None:
    files, base = filesystem(root)
    put(files, f"{base}/{ACTIVE}", name.encode())


def active(root: str) -> str | None:
    files, base = filesystem(root)
    return (get(files, f"{base}/{ACTIVE}") or b"").decode().strip() or None


def write_sidecar(root: str, name: str, file: str, value: object) -> None:
    files, base = filesystem(root)
    put(files, f"{base}/{name}/{file}", json.dumps(value, indent=1).encode())


def read_sidecar(root: str, name: str, file: str, default: object = None) -> object:
    """A sidecar's value; the default if it is missing or not JSON."""
    files, base = filesystem(root)
    raw = get(files, f"{base}/{name}/{file}")
    try:
        return default if raw is None else json.loads(raw)
    except ValueError:
        return default


def reset(spark: SparkSession, root: str, name: str, state: str = "session.json") -> int:
    """Delete a set's records and empty its session's state; its meta file stays.  Returns how many records went."""
    files, base = filesystem(root)
    names = [i.path for i in _folder(files, f"{base}/{name}/{MASKS}") if NAME.match(i.base_name)]
    write_sidecar(root, name, state, {"keyframes": {}, "confidence": {}, "flags": {}, "signature": ""})
    if not names:
        return 0
    scheme = root[: root.index("://") + 3] if "://" in root else ""
    gone = delete(spark.createDataFrame([(scheme + n if scheme != "file://" else n,) for n in names], "path string"))
    return gone.filter("gone").count()
