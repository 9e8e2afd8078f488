"""Best-fit packing of token pieces, certified by lower bounds.

Documents are tokenised where they lie; from then on only (id, piece, length)
rows move.  Pieces are dealt to groups of a bounded number of rows; a group is
packed by best-fit decreasing and its bin count is held against a lower bound
from dual feasible functions.  Bins without a gap are final.  The bins with free
space of groups that are above their fractional bound are exchanged: bins of
many groups meet in one group, are packed anew, and the new packing counts if it
needs fewer bins.  The exchange ends
with a round that closes less than a hundredth of the open bins.  Every sequence
keeps the certificate of the partition that last held it: that partition's bins
and its bound.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import runtime
from framelake.llm.tokens import encoder

#: Rows of a group at first, and when open bins are exchanged.
GROUP_ROWS, EXCHANGE_ROWS = 4096, 16384
#: The exchange goes on while a round leaves at most this share of the open bins.
GAIN = 0.99
#: Equal rows that one task makes of a counted one at a time.
COPIES = 1 << 16
BATCH_BYTES = 4 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
CERTIFICATE = "partition_id long, partition_bins long, partition_bound long"
PACKED = f"{PIECES}, sequence_id long, offset long, home long, open boolean, {CERTIFICATE}"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document; only documents of over ``capacity`` ids are cut."""
    runtime.small_batches(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        for batch in runtime.regrouped(batches, "text", BATCH_BYTES):
            ids, offsets = enc.encode(batch.column("text"))
            raw = memoryview(ids.astype("<u4")).cast("B")
            rows: tuple[list, ...] = ([], [], [], [], [])
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                begin, n = int(offsets[k]), int(offsets[k + 1] - offsets[k]) + 1
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    last = start + length == n
                    crc = zlib.crc32(raw[4 * (begin + start) : 4 * (begin + start + length - last)])
                    for column, value in zip(rows, (doc, piece, start, length, zlib.crc32(tail, crc) if last else crc), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(runtime.frugal(cut), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and place in it of each length, and the free space of each bin.

    The longest first (ties by position), each to the fullest bin that takes it;
    among equally full bins to the one opened last.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    sizes = lengths.tolist()
    bins, places = [0] * len(sizes), [0] * len(sizes)
    free: list[int] = []
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0  # bit r: some bin has r free
    for i in order:
        size = sizes[i]
        fits = present >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = at[room].pop()
            if not at[room]:
                present &= ~(1 << room)
        else:
            b, room = len(free), capacity
            free.append(capacity)
        bins[i], places[i] = b, capacity - room
        free[b] = left = room - size
        if left:
            at[left].append(b)
            present |= 1 << left
    return np.array(bins, np.int64), np.array(places, np.int64), np.array(free, np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> float:
    """Fractional number of bins that no packing can go below; ``counts`` is by length.

    The largest sum of three families of dual feasible functions: the length
    itself; lengths over capacity - e count whole and those under e nothing; and
    the length rounded to (k + 1)-ths.
    """
    size = np.arange(capacity + 1)
    weight = counts * size
    best = weight.sum() / capacity
    many, volume = np.cumsum(counts), np.cumsum(weight)
    e = np.flatnonzero(counts[: capacity // 2 + 1])
    e = e[e > 0]
    if len(e):
        large = many[-1] - many[capacity - e]
        middle = volume[capacity - e] - volume[e - 1]
        best = max(best, (large + middle / capacity).max())
    for k in range(1, 21):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size / capacity, (scaled // capacity) / k)
        best = max(best, (counts * value).sum())
    return float(best)


def _pack(table: pa.Table, capacity: int, round_: int, group: int) -> pa.Table:
    """Best-fit decreasing over one group; bins with free space are open if the group is above its bound."""
    columns = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("length", "start", "ids_crc32", "piece")}
    docs = np.array([-(1 << 62) if d is None else d for d in table.column("doc_id").to_pylist()], np.int64)
    order = np.lexsort((columns["start"], columns["ids_crc32"], columns["piece"], docs))
    table = table.take(pa.array(order))
    lengths = columns["length"][order]
    bins, places, free = best_fit_decreasing(lengths, capacity)
    bound = lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    old = table.column("sequence_id").to_numpy()
    if round_ and len(np.unique(old)) <= len(free):
        sequence, offset = old, table.column("offset").to_numpy()
        names, which = np.unique(old, return_inverse=True)
        free = capacity - np.bincount(which, weights=lengths).astype(np.int64)
        bins = which
    else:
        sequence, offset = (np.int64(round_) << 56) + (np.int64(group) << 20) + bins, places
    # with the fraction: what a bin lacks here another partition may lack too
    above = len(free) > bound + 1e-9
    n = len(lengths)
    told = ((round_ << 40) + group, len(free), int(np.ceil(bound - 1e-9)))
    return pa.table({
        **{c: table.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")},
        "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
        "home": pa.array(np.full(n, group), pa.int64()), "open": pa.array((free[bins] > 0) & above),
        **{c.split()[0]: pa.array(np.full(n, v, np.int64)) for c, v in zip(CERTIFICATE.split(", "), told, strict=True)},
    })


def _packer(capacity: int, round_: int):
    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _pack(table, capacity, round_, key[0].as_py())

    return packed


def dealt(items: DataFrame, groups: int) -> DataFrame:
    """``items`` with the group each row goes to, by a hash of the row and of its rank among equal rows.

    Equal rows are counted before they move, and made again where their count is:
    however many there are, each group gets its share.
    """
    names = items.columns
    counted = items.groupBy(*names).agg(F.count("*").alias("n"))
    chunks = counted.select(*names, "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES})")).alias("chunk"))
    ranked = chunks.select(*names, F.explode(F.expr(f"sequence(chunk * {COPIES}, least(n, (chunk + 1) * {COPIES}) - 1)")).alias("rank"))
    return ranked.withColumn("home", F.pmod(F.xxhash64(*names, "rank"), F.lit(groups))).drop("rank")


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pack piece rows (see PIECES) into sequences of at most ``capacity``.

    Adds sequence_id and offset (gapless from 0), and the certificate of the
    partition that packed the sequence: partition_id, the bins it needed and the
    least that any packing of what it held needs.  A length must be in 1 ..
    capacity.  Null and repeated ids are rows like any other, and equal rows any
    number of times; ties are broken by id, piece and checksum, so that reruns
    agree; an empty table gives an empty one.  Extra columns are left out.
    """
    items = items.select(*(c.split()[0] for c in PIECES.split(", ")))
    groups = max(1, -(-items.count() // GROUP_ROWS))
    keyed = dealt(items, groups).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    done: DataFrame | None = None
    before = None
    for round_ in itertools.count():
        result = runtime.stage(keyed.groupBy("home").applyInArrow(_packer(capacity, round_), PACKED), f"packed-{round_}")
        left = result.filter("open")
        rows, now = left.agg(F.count("*"), F.count_distinct("sequence_id")).first()
        # one group can't gain by being packed again
        if not rows or groups == 1 or (before is not None and now > GAIN * before):
            return result if done is None else done.unionByName(result)
        closed = result.filter(~F.col("open"))
        done = closed if done is None else done.unionByName(closed)
        before, groups = now, -(-rows // EXCHANGE_ROWS)
        names = [c.split()[0] for c in PIECES.split(", ")]
        keyed = left.select(*names, "sequence_id", "offset", F.expr(f"pmod(xxhash64(home, sequence_id, {round_}), {groups})").alias("home"))


def certificate(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, the lower bound over all lengths, and the gap between them."""
    spark = packed.sparkSession
    by_length = {r[0]: r[1] for r in packed.groupBy("length").count().collect()}  # at most ``capacity`` rows
    counts = np.array([by_length.get(k, 0) for k in range(capacity + 1)], np.int64)
    bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
    bound = int(np.ceil(lower_bound(counts, capacity) - 1e-9))
    return spark.createDataFrame([(bins, bound, bins - bound)], "sequences long, bound long, gap long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); a null text is empty and still has its end id."""
    cut = runtime.stage(pieces(docs, tokenizer_path, capacity, end_id), "pieces")
    return pack(cut, capacity).drop("home", "open")
