import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.functions import codec, register, scalars
from framelake.sources import matte_store, proxy


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 30), st.integers(1, 30), st.integers(0, 2**32 - 1))
def test_round_trip(h, w, seed):
    plane = (np.random.default_rng(seed).random((h, w)) < 0.5).astype(np.uint8) * 255
    assert (codec.decode(codec.encode(plane), w, h) == plane).all()


def test_long_runs_are_split():
    plane = np.full((400, 400), 255, np.uint8)
    payload = codec.encode(plane)
    assert len(payload) == 9 and (codec.decode(payload, 400, 400) == 255).all()
    assert codec.encode(np.zeros((0, 0), np.uint8)) == b""


def record():
    plane = np.zeros((32, 48), np.uint8)
    plane[5:20, 10:30] = 200
    return codec.pack(plane, 0.8, 1)


def test_record():
    got = codec.unpack(record())
    assert (got["w"], got["h"], got["flags"], got["confidence"]) == (48, 32, 1, 204 / 255)
    assert codec.unpack(codec.pack(np.ones((1, 1), np.uint8), 0.3, 0))["confidence"] == 76 / 255


@pytest.mark.parametrize("damage", [lambda r: r[:10], lambda r: r[:-2] + bytes([r[-2] ^ 255]) + r[-1:], lambda r: b"XXXX" + r[4:], lambda r: r + b"\0", lambda r: b""])
def test_damage_is_missing(damage):
    assert codec.unpack(damage(record())) is None


def test_data_source(spark, tmp_path):
    matte_store.register(spark)
    rows = [("s", k, 4, 2, bytes([k * 10] * 8), 0.5, 0) for k in range(3)]
    out = str(tmp_path / "s")
    spark.createDataFrame(rows, matte_store.SCHEMA).write.format("acm").mode("append").option("path", out).save()
    back = spark.read.format("acm").option("path", out).load()
    assert sorted((r.idx, r.alpha) for r in back.collect()) == [(k, bytearray([k * 10] * 8)) for k in range(3)]
    path = tmp_path / "s" / "000001.acm"
    raw = bytearray(path.read_bytes())
    raw[24] ^= 0x55
    path.write_bytes(raw)
    (tmp_path / "s" / "notes.txt").write_text("x")
    assert sorted(r.idx for r in spark.read.format("acm").option("path", out).load().collect()) == [0, 2]
    files = spark.read.format("binaryFile").load(out)
    assert sorted(r.idx for r in matte_store.records(files).collect()) == [0, 2]
    assert [r.path.rsplit("/", 1)[1] for r in matte_store.damaged(files).collect()] == ["000001.acm"]


def write(spark, path, rows, mode="append"):
    spark.createDataFrame(rows, matte_store.SCHEMA).write.format("acm").mode(mode).option("path", path).save()


def row(k, value=7):
    return ("s", k, 4, 2, bytes([value] * 8), 0.5, 0)


def test_overwrite_and_append(spark, tmp_path):
    matte_store.register(spark)
    out = f"file://{tmp_path}/s"
    read = lambda: {r.idx: r.alpha[0] for r in spark.read.format("acm").option("path", out).load().collect()}
    write(spark, out, [row(k) for k in (1, 2, 3)])
    write(spark, out, [row(3, 9), row(4)])
    assert read() == {1: 7, 2: 7, 3: 9, 4: 7}
    write(spark, out, [row(9)], "overwrite")
    assert read() == {9: 7} and [p.name for p in (tmp_path / "s").iterdir()] == ["000009.acm"]
    with pytest.raises(Exception, match="reshape|bytes|cannot"):
        write(spark, out, [row(5), ("s", 6, 4, 2, b"too short", 0.5, 0)])
    assert read() == {9: 7} and [p.name for p in (tmp_path / "s").iterdir()] == ["000009.acm"]


def test_damaged_of_several_sets(spark, tmp_path):
    matte_store.register(spark)
    for name in "AB":
        write(spark, str(tmp_path / name), [row(k) for k in (3, 4)])
    (tmp_path / "A" / "000003.acm").write_bytes(b"broken")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert [r.path.rsplit("/", 2)[1:] for r in matte_store.damaged(files).collect()] == [["A", "000003.acm"]]
    wanted = spark.createDataFrame([("A", 3), ("A", 5), ("B", 4)], "set string, idx int")
    assert {(r.set, r.idx): r.found for r in matte_store.has(files, wanted).collect()} == {("A", 3): True, ("A", 5): False, ("B", 4): True}
    gone = matte_store.delete(matte_store.damaged(files)).collect()
    assert [r.gone for r in gone] == [True] and not (tmp_path / "A" / "000003.acm").exists()
    assert not matte_store.delete(spark.createDataFrame([(str(tmp_path / "A" / "000003.acm"),)], "path string")).first().gone


def test_sets(spark, tmp_path):
    matte_store.register(spark)
    root = f"file://{tmp_path}/root"
    assert matte_store.sets(root) == [] and matte_store.active(root) is None and matte_store.read_meta(root, "x") is None
    matte_store.create(root, "b", {"fps": 24.0, "note": "a=b"})
    matte_store.create(root, "a", {"schema": 3})
    (tmp_path / "root" / "no-meta").mkdir()
    assert matte_store.sets(root) == ["a", "b"]
    assert matte_store.read_meta(root, "b") == {"fps": "24.0", "note": "a=b", "schema": "1"} and matte_store.read_meta(root, "a") == {"schema": "3"}
    matte_store.activate(root, "b")
    matte_store.activate(root, "a")
    assert matte_store.active(root) == "a"
    matte_store.write_sidecar(root, "b", "session.json", {"keyframes": {"1": "manual"}})
    assert matte_store.read_sidecar(root, "b", "session.json") == {"keyframes": {"1": "manual"}}
    (tmp_path / "root" / "b" / "broken.json").write_text("{")
    assert matte_store.read_sidecar(root, "b", "broken.json", 5) == 5 == matte_store.read_sidecar(root, "b", "none.json", 5)
    write(spark, matte_store.masks(root, "b"), [row(k) for k in range(3)])
    assert {r.set for r in spark.read.format("acm").option("path", matte_store.masks(root, "b")).load().collect()} == {"b"}
    assert matte_store.reset(spark, root, "b") == 3 and matte_store.reset(spark, root, "b") == 0
    assert matte_store.sets(root) == ["a", "b"] and matte_store.read_sidecar(root, "b", "session.json")["keyframes"] == {}


def test_properties(spark):
    lines = spark.createDataFrame([("name=x",), ("name=a=b",), ("fps=24.0",), ("no pair",)], "value string")
    assert matte_store.set_properties(lines).first()[0] == {"name": "a=b", "fps": "24.0"}


def test_proxy_index(spark, tmp_path):
    (tmp_path / "proxy.idx").write_bytes(proxy.write_index(768, 432, 1920, 1080, 24.0, [(0, 100), (2**33, 7)]))
    rows = proxy.entries(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("idx").collect()
    assert [(r.idx, r.offset, r.size) for r in rows] == [(0, 0, 100), (1, 2**33, 7)]
    clip = proxy.clips(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert (clip.frames, clip.width, clip.height, clip.source_width, clip.source_height) == (2, 768, 432, 1920, 1080)


def test_fingerprint(spark):
    import hashlib
    import struct

    row = spark.createDataFrame([("/A/b.MP4", 5, 77, b"hello", b"mm", b"tt"), ("/A/b.MP4", 3 << 20, 77, b"hello", b"mm", b"tt")], "path string, size long, mtime long, head binary, middle binary, tail binary")
    got = [r.f for r in row.select(scalars.fingerprint(*(F.col(c) for c in row.columns)).alias("f")).collect()]
    want = [hashlib.sha256(b"/a/b.mp4" + struct.pack("<QQ", n, 77) + data).hexdigest()[:16] for n, data in ((5, b"hello"), (3 << 20, b"hellommtt"))]
    assert got == want


def test_registered(spark):
    register.register(spark)
    got = spark.sql("SELECT * FROM rle_runs(X'05030006FFFF')").collect()
    assert [tuple(r) for r in got] == [(0, 5, 3), (1, 6, 65535)]
    assert spark.sql("SELECT rle_decode(rle_encode(X'01010202', 2), 2, 2) AS p").first().p == bytes([1, 1, 2, 2])
    mask = "00" * 9 + ("00" + "01" * 7 + "00") * 7 + "00" * 9
    assert spark.sql(f"SELECT x, y FROM interior_points(X'{mask}', 9, 1)").first() == (4.0, 4.0)


def test_names(spark):
    df = spark.createDataFrame([(7,), (1234567,)], "i int").select(scalars.frame_name(F.col("i")).alias("n"))
    assert [r.n for r in df.collect()] == ["000007", "1234567"]
    h = lambda m: scalars.settings_hash(F.create_map(*(F.lit(x) for kv in m for x in kv)))
    row = spark.range(1).select(h([("a", "1"), ("b", "2")]).alias("x"), h([("b", "2"), ("a", "1")]).alias("y"), h([("a", "1"), ("b", "3")]).alias("z")).first()
    assert row.x == row.y != row.z
    # by key, not by the written part: "a" comes before "a1"
    import hashlib

    two = spark.range(1).select(h([("a1", "2"), ("a", "1")]).alias("x")).first()
    assert two.x == hashlib.sha256(b"a=1|a1=2").hexdigest()[:8]


def test_proxy_round_trip(spark, tmp_path):
    from framelake.operators import kernels

    rng = np.random.default_rng(5)
    frames = {(c, k): rng.integers(0, 256, (30, 50, 3), dtype=np.uint8) for c, n in (("a", 5), ("b", 2)) for k in range(n)}
    rows = [(c, k, 50, 30, f.tobytes()) for (c, k), f in frames.items()]
    root = f"file://{tmp_path}/proxies"
    built = proxy.build(spark.createDataFrame(rows, "clip string, idx long, w int, h int, bgr binary").repartition(3), root, 25.0, 20).collect()
    assert sorted((r.clip, r.frames, r.w, r.h) for r in built) == [("a", 5, 20, 12), ("b", 2, 20, 12)]
    assert proxy.exists(root, "a") and not proxy.exists(root, "c")
    wanted = spark.createDataFrame([("a", 3), ("a", -4), ("a", 99), ("b", 1), ("c", 0)], "clip string, idx long")
    got = {(r.clip, r.idx): r for r in proxy.read(wanted, root).collect()}
    for (clip, idx), frame in {("a", 3): 3, ("a", -4): 0, ("a", 99): 4, ("b", 1): 1}.items():
        r = got[clip, idx]
        want = np.stack([kernels.resize_area(frames[clip, frame][..., c].astype(float), 12, 20) for c in range(3)], axis=-1)
        assert r.frame == frame and np.abs(np.frombuffer(r.bgr, np.uint8).reshape(12, 20, 3) - want).max() <= 0.5
    assert got["c", 0].frame is None
    clip = {r.path.rsplit("/", 2)[1]: r for r in proxy.clips(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.idx").load(root)).collect()}
    assert (clip["a"].frames, clip["a"].source_width, clip["a"].source_height) == (5, 50, 30)
    assert proxy.size(1920, 1080, 768) == (768, 432) and proxy.size(10, 3, 768) == (10, 4)


@pytest.mark.parametrize("shape, kind", [((3, 5), np.uint8), ((3, 5), np.uint16), ((4, 2, 3), np.uint8), ((4, 2, 4), np.uint16)])
def test_png_round_trip(shape, kind):
    from framelake.sources import images

    plane = np.random.default_rng(1).integers(0, 256, shape).astype(kind) * (257 if kind is np.uint16 else 1)
    data = images.png(plane)
    assert (images.from_png(data) == plane).all()
    for broken in (data[:-20], data[:45] + bytes([data[45] ^ 1]) + data[46:], b"x" + data):
        with pytest.raises(ValueError):
            images.from_png(broken)
