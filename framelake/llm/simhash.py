"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of at most 23 bits.  The perfect
Golay code of 23 bits has a codeword within 3 bits of every word; a word's keys
are the (12-bit) indices of all codewords within 4 bits of it: 1, or 6 where the
nearest is 3 away.  Two words that differ in at most 2 bits have a key in common.

Of 4 differing bits over three segments, the two segments with the fewest have
at most 2 together.  So some pair of segments has a common key in both, and a
join on (pair, key, key) finds every link.  Candidates are verified bit by bit.
Links are never listed pairwise: in a bucket only a spanning forest of them is
kept, which is what components need.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import runtime

SHINGLE, MOST_BITS = 4, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Fingerprints of a bucket that one task compares; larger ones go to pairs of blocks.
BUCKET_ROWS = 100_000
#: Key rows are counted in so many cells first, keys one by one only in cells that may hold a large bucket.
CELLS = 1 << 16
#: Buckets up to this size are compared all at once by shifts.
SMALL_BUCKET = 32
BATCH_BYTES = 8 << 20

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


# ---- fingerprints -------------------------------------------------------------


def fingerprint(text: str) -> int:
    """SimHash of the four-word shingles, repeats included; no words: 0."""
    words = WORD.findall(text.encode("utf-8", "surrogatepass").lower())  # bytes.lower() maps A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    n = max(1, len(words) - SHINGLE + 1)
    last = ends[-1] if len(words) < SHINGLE else 0
    stops = [last - 1] if last else [e - 1 for e in ends[SHINGLE - 1 :]]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        part = hashes[i : i + (1 << 15)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, column: str = "fp") -> DataFrame:
    """``docs`` with its fingerprint as a (signed) long; a null text counts as empty."""
    runtime.small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, fp], names=[*names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` long"
    return docs.mapInArrow(runtime.frugal(run), schema)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- the Golay code -----------------------------------------------------------


@functools.cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndrome of each 23-bit half-word table, error patterns by syndrome, how many of them).

    Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.  A syndrome's
    patterns are the words of weight up to 4 in its coset: one of weight up to 2,
    or one of weight 3 and five of weight 4.
    """
    poly = 0b101011100011

    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= poly << (bit - 11)
        return word

    unit = np.array([remainder(1 << b) for b in range(23)], np.int32)
    tables = np.zeros((3, 256), np.int32)
    for k in range(3):
        for b in range(8):
            if 8 * k + b < 23:
                tables[k] ^= np.where(np.arange(256) >> b & 1, unit[8 * k + b], 0).astype(np.int32)
    patterns = np.zeros((2048, 6), np.int32)
    count = np.zeros(2048, np.int32)

    def grow(first: int, word: int, syndrome: int, weight: int) -> None:
        if weight < 4 or count[syndrome] and bin(int(patterns[syndrome, 0])).count("1") == 3:
            patterns[syndrome, count[syndrome]] = word
            count[syndrome] += 1

    from itertools import combinations

    for weight in range(5):
        for bits in combinations(range(23), weight):
            word = syndrome = 0
            for b in bits:
                word |= 1 << b
                syndrome ^= int(unit[b])
            grow(0, word, syndrome, weight)
    return tables, patterns, count


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits of each 23-bit word: an (n, 6) array and how many count."""
    tables, patterns, count = golay()
    syndrome = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16 & 255]
    return (words[:, None] ^ patterns[syndrome]) >> 11, count[syndrome]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (uint64): pair of segments and an index in each."""
    found = []
    for start, size in SEGMENTS:
        words = (fps >> np.uint64(start) & np.uint64((1 << size) - 1)).astype(np.int64)
        found.append(segment_keys(words))
    rows, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        (ka, na), (kb, nb) = found[a], found[b]
        live = (np.arange(6)[None, :, None] < na[:, None, None]) & (np.arange(6)[None, None, :] < nb[:, None, None])
        key = (np.int64(p) << 24) | (ka[:, :, None].astype(np.int64) << 12) | kb[:, None, :]
        rows.append(np.nonzero(live)[0])
        keys.append(key[live])
    return np.concatenate(rows), np.concatenate(keys)


# ---- links --------------------------------------------------------------------


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST_BITS


def forest(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as (root, member).

    Breadth first: a frontier's members are held against those not reached yet,
    which a dense group quickly uses up.
    """
    left = np.sort(fps)
    roots, members = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        frontier = np.array([root], np.uint64)
        while len(frontier) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, (1 << 20) // len(left))
            for i in range(0, len(frontier), step):
                hit |= _close(frontier[i : i + step, None], left[None, :]).any(axis=0)
            frontier, left = left[hit], left[~hit]
            roots.append(np.full(len(frontier), root, np.uint64))
            members.append(frontier)
    none = np.zeros(0, np.uint64)
    return np.concatenate(roots or [none]), np.concatenate(members or [none])


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of rows sorted by key."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(begins, len(keys)))
    small = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
    k, f = keys[small], fps[small]
    left, right = [], []
    for d in range(1, SMALL_BUCKET):
        if len(k) <= d:
            break
        hit = (k[d:] == k[:-d]) & _close(f[d:], f[:-d])
        left.append(np.minimum(f[d:], f[:-d])[hit])
        right.append(np.maximum(f[d:], f[:-d])[hit])
        if not (k[d:] == k[:-d]).any():
            break
    for at, size in zip(begins[sizes > SMALL_BUCKET], sizes[sizes > SMALL_BUCKET], strict=True):
        a, b = forest(fps[at : at + size])
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


LINKS = "a long, b long"


def _links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
    signed = pairs.astype(np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[:, 0].copy()), pa.array(signed[:, 1].copy())], names=["a", "b"])


def _expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, fp) for each key of each fingerprint."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.column(0).slice(i, 1024).to_numpy().view(np.uint64)
            row, key = bucket_keys(part)
            # a fingerprint's rows side by side compress well in the shuffle
            order = np.argsort(row, kind="stable")
            row, key = row[order], key[order]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row].view(np.int64))], names=["key", "fp"])


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by key; holds a bucket, which is bounded, and a little more."""
    held_k, held_f, held = [], [], 0
    for batch in batches:
        k, f = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(k):
            continue
        held_k.append(k)
        held_f.append(f)
        held += len(k)
        if held < 1 << 18 or held_k[0][0] == k[-1]:
            continue
        k, f = np.concatenate(held_k), np.concatenate(held_f)
        cut = np.searchsorted(k, k[-1])  # the last bucket may go on
        yield _links_batch(*bucket_links(k[:cut], f[:cut]))
        held_k, held_f, held = [k[cut:]], [f[cut:]], len(k) - cut
    if held_k:
        yield _links_batch(*bucket_links(np.concatenate(held_k), np.concatenate(held_f)))


def large_buckets(keyed: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame | None:
    """(key, n) of the buckets of over ``bucket_rows`` fingerprints, as a written table; None if there are none.

    Cells of keys are counted with map-side sums; only in cells that hold more
    than ``bucket_rows`` are keys counted, which at any size loses none.
    """
    cell = F.pmod(F.xxhash64("key"), F.lit(CELLS)).cast("int").alias("cell")
    # at most CELLS numbers, on the driver and in the broadcast
    full = [(r.cell,) for r in keyed.groupBy(cell).count().filter(F.col("count") > bucket_rows).select("cell").collect()]
    if not full:
        return None
    cells = F.broadcast(keyed.sparkSession.createDataFrame(full, "cell int"))
    rows = keyed.withColumn("cell", cell).join(cells, "cell", "left_semi")
    large = runtime.stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows), "large-buckets")
    return None if large.isEmpty() else large


def links(fps: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) whose components are those of all links.

    Buckets are counted before their rows move: those of over ``bucket_rows``
    never meet in a task, but as pairs of blocks of half that size.
    """
    keyed = fps.select("fp").mapInArrow(runtime.frugal(_expand), "key long, fp long")
    with runtime.large_batches(fps.sparkSession):
        large = large_buckets(keyed, bucket_rows)
        small = keyed if large is None else keyed.join(large, "key", "left_anti")
        edges = runtime.stage(small.repartition("key").sortWithinPartitions("key").mapInArrow(runtime.frugal(_compare), LINKS), "links")
    if large is None:
        return edges
    # the exact way for large buckets: every pair of blocks of a bucket is a group of its own
    n_blocks = F.ceil(F.col("n") / max(1, bucket_rows // 2)).cast("int").alias("n_blocks")
    blocks = keyed.join(large.select("key", n_blocks), "key").withColumn("block", F.expr("cast(pmod(xxhash64(fp), n_blocks) as int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    paired = blocks.withColumn("other", other).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))

    def block_pair(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_links_batch(*forest(np.unique(table.column("fp").to_numpy().view(np.uint64))))])

    more = paired.select("key", "i", "j", "fp").groupBy("key", "i", "j").applyInArrow(block_pair, LINKS)
    return edges.unionByName(runtime.stage(more, "large-links"))


# ---- components ---------------------------------------------------------------


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge; nodes of a component have one root.

    Contraction: each node goes to the least of itself and its neighbours (by
    value in the first round, then by a hash that changes with the round), edges
    are renamed, and what is left is contracted again; about half of the nodes
    go in a round.  Only joins and map-side combined minima, each on a written
    table, so that a hub's rows can be split.
    """
    steps: list[DataFrame] = []
    edges = runtime.stage(edges.filter("a <> b").distinct(), "edges-0")
    for round_ in range(max_rounds):
        if edges.isEmpty():
            break
        rank = (lambda c: c) if round_ == 0 else (lambda c, r=round_: F.xxhash64(F.lit(r), c))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("rank"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(rank(F.col("a")).alias("rank"), F.col("a").alias("to"))
        step = runtime.stage(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["to"].alias("to")), f"step-{round_}")
        steps.append(step)
        left = edges.join(step.select(F.col("node").alias("a"), F.col("to").alias("new_a")), "a")
        right = left.join(step.select(F.col("node").alias("b"), F.col("to").alias("new_b")), "b")
        renamed = right.select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        edges = runtime.stage(renamed.filter("a <> b").distinct(), f"edges-{round_ + 1}")
    else:
        raise RuntimeError(f"components: edges are left after {max_rounds} rounds")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        up = step.join(roots.withColumnRenamed("node", "to"), "to", "left")
        roots = up.select("node", F.coalesce("root", "to").alias("root"))
    return runtime.stage(roots, "roots")


def component_ids(printed: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, component_id, keeper_fp) for the distinct fingerprints of ``printed`` (doc_id, fp).

    component_id is the smallest doc_id of the component (null only if it has no
    other) and keeper_fp the fingerprint of the document with it.
    """
    distinct = runtime.stage(printed.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = components(links(distinct, bucket_rows))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("fp").alias("fp"))
    named = runtime.stage(rooted.groupBy("root").agg(F.min(first).alias("m")), "components")
    return rooted.join(named, "root").select("fp", F.col("m.id").alias("component_id"), F.col("m.fp").alias("keeper_fp"))


def near_duplicates(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row.

    A null or empty text has fingerprint zero and is linked like any other; null
    ids are never a component's id unless it has no other; repeated rows each
    give a row.  An empty table gives an empty one; extra columns are left out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    printed = runtime.stage(with_fingerprints(texts).select("doc_id", "fp"), "printed")
    found = component_ids(printed, bucket_rows)
    return printed.join(found, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest doc_id (nulls last).

    Of rows with that id the one with the least hash of its text stays.  A null
    or empty text has fingerprint zero; an empty table gives an empty one.  What
    is kept is decided on numbers: texts move only where the rows that go are too
    many to be broadcast, which Spark knows, and then once.
    """
    row, fp = runtime.fresh(docs, "row"), runtime.fresh(docs, "fp")
    printed = runtime.stage(with_fingerprints(docs, fp).withColumn(row, F.monotonically_increasing_id()), "printed-docs")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = runtime.stage(printed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.xxhash64(text).alias("text"), F.col(row).alias("row")), "printed-ids")
    components_of = component_ids(ids, bucket_rows)
    # the first row of each fingerprint, then of each component: map-side minima, however many rows are equal
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text", "row")
    first = ids.groupBy("fp").agg(F.min(order).alias("first")).join(components_of, "fp")
    kept = first.groupBy("keeper_fp").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))
    goes = runtime.stage(ids.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", row), "rows-that-go")
    return printed.join(goes, row, "left_anti").select(*docs.columns)
