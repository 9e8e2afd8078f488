"""Ids by words equal the library's ids of whole texts; packing and token files."""

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from framelake.llm import packing, runtime, token_output
from framelake.llm.tokens import WordEncoder

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ["", " a", "a  b", "a\n\nb", "a \n b\t c", "x  y", "<|endoftext|> hi<|endoftext|>", "<|STARTOFTEXT|> A", "it's we'll\nthe 12 3.4 !!?", "\n", "É ́x",
       "a\r\nb c\x1cd e　f", None, "word, word. WORD; Word!", " x  y", "don't.\nStop,,, no?!", "\x00a \x01b", "ﬁne ½ Ⅷ x²"]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return WordEncoder(path, pool_words=50), Tokenizer.from_file(path)


def check(pair, texts):
    mine, library = pair
    ids, offsets = mine.encode(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_odd_texts(pair):
    check(pair, ODD)
    check(pair, [])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'aAbé1<|ß́ !"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_text(texts):
    for name in FILES:
        path = public_tokenizers.path(name)
        encoder = _cached(path)
        check(encoder, texts)


_CACHE = {}


def _cached(path):
    if path not in _CACHE:
        _CACHE[path] = WordEncoder(path), Tokenizer.from_file(path)
    return _CACHE[path]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, length int, start string")


ROWS = [(3, "hello world " * 3000, "a", 1, "x"), (1, "", "b", 2, "y"), (None, "no id", None, 3, "z"), (2, None, "a", 4, "w"), (2, "twice", "a", 5, "v"), (2, "twice", "a", 5, "v")]


# ---- token files --------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(kind, width):
    rng = np.random.default_rng(0)
    sink = io.BytesIO()
    writer = token_output.PlaneWriter(sink, width, kind, block=100)
    lists = [rng.integers(0, 1 << (8 * width - 1), n).astype(np.uint32) for n in (0, 1, 99, 1, 350, 7)]
    for k, ids in enumerate(lists):
        writer.add(None if k == 1 else k, ids)
    size = writer.close()
    assert size == len(sink.getvalue())
    reader = token_output.PlaneReader(io.BytesIO(sink.getvalue()), size)
    got = list(reader.documents())
    assert [g[0] for g in got] == [0, None, 2, 3, 4, 5]
    assert [g[1] for g in got] == [0, 0, 1, 100, 101, 451]
    for (_, _, ids), want in zip(got, lists, strict=True):
        assert (ids == want).all()
    assert (reader.read_block(2) == np.concatenate(lists)[200:300]).all()


def test_damaged_footer_is_an_error():
    sink = io.BytesIO()
    writer = token_output.PlaneWriter(sink, 2)
    writer.add(1, np.arange(10, dtype=np.uint32))
    size = writer.close()
    raw = bytearray(sink.getvalue())
    raw[-20] ^= 1
    with pytest.raises(ValueError):
        token_output.PlaneReader(io.BytesIO(bytes(raw)), size)


def test_token_files(spark):
    path = public_tokenizers.path(FILES[1])
    library = Tokenizer.from_file(path)
    manifest = token_output.write_tokens(docs(spark, ROWS), path, runtime.new_path(spark, "t"), end_id=0)
    got = token_output.read_tokens(manifest).orderBy("start").collect()
    want, start = [], 0
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in ordered:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((g.doc_id, g.n_tokens, g.ids_crc32) for g in got), key=repr) == sorted(want, key=repr)
    for g in got:
        assert g.start == start
        start += g.n_tokens
    assert [g.doc_id for g in got] == [r[0] for r in ordered]
    empty = token_output.write_tokens(docs(spark, []), path, runtime.new_path(spark, "t"))
    assert token_output.read_tokens(empty).count() == 0


# ---- packing ------------------------------------------------------------------


def valid(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pack_documents(spark):
    path = public_tokenizers.path(FILES[0])
    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs(spark, ROWS), path, 4096, 1).collect()
    valid(rows, 4096)
    want = []
    for r in ROWS:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((r[0], k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    assert packing.pack_documents(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_exchange_comes_near_the_bound(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 100)
    monkeypatch.setattr(packing, "EXCHANGE_ROWS", 300)
    rng = random.Random(seed)
    lengths = [min(1000, int(rng.lognormvariate(5, 1)) + 1) for _ in range(1500)]
    items = spark.createDataFrame([(k, 0, 0, n, k) for k, n in enumerate(lengths)], packing.PIECES)
    packed = packing.pack(items, 1000)
    rows = packed.collect()
    assert len(rows) == 1500 and sorted(r.length for r in rows) == sorted(lengths)
    bins = valid(rows, 1000)
    proof = packing.certificate(packed, 1000).first()
    assert proof.sequences == bins and proof.gap <= 1 + 0.01 * bins
    again = {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(items, 1000).collect()}
    assert again == {r.doc_id: (r.sequence_id, r.offset) for r in rows}


def test_equal_rows_are_dealt_to_all_groups(spark):
    """A million equal rows, such as null ids with empty texts, beside others."""
    row = "cast(null as long) as doc_id", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32"
    equal = spark.range(1_000_000).selectExpr(*row)
    others = spark.range(50_000).selectExpr("id as doc_id", "0 as piece", "0L as start", "300 + id % 500 as length", "id as ids_crc32")
    items = equal.unionByName(others)
    groups = 1_050_000 // packing.GROUP_ROWS
    sizes = [r["count"] for r in packing.dealt(items, groups).groupBy("home").count().collect()]
    assert sum(sizes) == 1_050_000 and len(sizes) == groups and max(sizes) < 1.2 * packing.GROUP_ROWS
    packed = packing.pack(items)
    assert packed.count() == 1_050_000 and packing.certificate(packed).first().gap <= 10
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).filter("n > 4096 or n <> end").count() == 0
    # each partition's certificate: its sequences are as many as it says, and not below its bound
    told = packed.groupBy("partition_id").agg(F.count_distinct("sequence_id").alias("n"), F.max("partition_bins").alias("bins"), F.max("partition_bound").alias("bound")).collect()
    assert all(r.bound <= r.bins and r.n <= r.bins for r in told)


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bound_is_below_every_packing(sizes):
    def fewest(left, bins, best):
        if len(bins) >= best:
            return best
        if not left:
            return len(bins)
        first, *rest = left
        for k in range(len(bins)):
            if bins[k] >= first and bins[k] not in bins[:k]:
                bins[k] -= first
                best = fewest(rest, bins, best)
                bins[k] += first
        return fewest(rest, [*bins, 20 - first], best)

    least = fewest(sorted(sizes, reverse=True), [], len(sizes) + 1)
    bound = packing.lower_bound(np.bincount(sizes, minlength=21), 20)
    assert bound <= least + 1e-9
    _, _, free = packing.best_fit_decreasing(np.array(sizes), 20)
    assert len(free) >= least


def test_large_pieces_need_the_other_functions():
    counts = np.bincount([51] * 10, minlength=101)
    assert packing.lower_bound(counts, 100) == 10  # by volume alone it would be 5.1
    assert packing.certificate is not None and F is not None
