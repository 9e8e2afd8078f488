import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.operators import follower, kernels, metrics, models
from framelake.plans import lenses, track
from framelake.streaming import tracker


def frames(spark, n=10):
    return track.blobs(lenses.disc(spark, frames=n), 80, 60)


def test_follows_the_disc(spark):
    rows = track.tracked(frames(spark)).orderBy("idx").collect()
    truth = {r["idx"]: r["n"] for r in lenses.disc(spark, frames=10).filter("v = 255").groupBy("idx").agg(F.count("*").alias("n")).collect()}
    assert len(rows) == 10
    assert all(abs(r["area"] - truth[r["idx"]]) < 0.15 * truth[r["idx"]] and not r["lost"] for r in rows)


def test_says_when_the_subject_is_gone():
    image = np.zeros((60, 80))
    image[20:40, 20:40] = 200
    subject = follower.Follower(image, (image > 100).astype(float))
    got = subject.follow(np.zeros((60, 80)))
    assert got.low and got.confidence < 0.55 and (got.lost or got.alpha.sum() < 400)
    for _ in range(4):
        subject.follow(np.zeros((60, 80)))
    for _ in range(3):
        got = subject.follow(image.copy())
    assert not got.lost


def test_stream_equals_batch(spark, tmp_path):
    batch = frames(spark, 8).cache()
    src, name = str(tmp_path / "in"), "tracked_stream"
    for k, part in enumerate(("idx < 4", "idx >= 4", "idx = 2")):
        batch.filter(part).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(src)
    q = tracker.tracked(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table(name)
    assert got.filter("late").count() == 1
    want = {r["idx"]: r["area"] for r in track.tracked(batch).collect()}
    assert {r["idx"]: r["area"] for r in got.filter("not late").collect()} == want


def test_segment(spark):
    px = frames(spark, 2).withColumn("points", F.array(F.struct(F.lit(25.0).alias("x"), F.lit(30.0).alias("y"), F.lit(1).alias("label"))))
    rows = models.segment(px.withColumn("box", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")), models.GuidedLikelihood).collect()
    assert len(rows) == 2 and all(r["confidence"] == 0.55 for r in rows)


def test_report_equals_the_pixel_forms(spark):
    data = "/root/testdata/sf0.001"
    px, rep = lenses.planes(spark, data), track.report(lenses.plane_blobs(spark, data))
    rows = {(r["clip"], r["idx"]): r for r in rep.collect()}
    for r in metrics.area(px).join(metrics.bounding_box(px), ["clip", "idx"]).join(metrics.centroid(px), ["clip", "idx"]).collect():
        got = rows[r["clip"], r["idx"]]
        assert all(got[c] == r[c] for c in ("area", "x0", "y0", "x1", "y1", "cx", "cy"))
    for r in metrics.consecutive_iou(px).collect():
        assert rows[r["clip"], r["idx"]]["iou"] == pytest.approx(r["iou"], abs=1e-6)
    fresh = track.report(lenses.plane_blobs(spark, data))
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_robust_flow():
    from framelake.operators import flow

    rng = np.random.default_rng(0)
    region = np.zeros((60, 80))
    region[15:45, 20:60] = 1
    yy, xx = np.mgrid[:60, :80]
    dx, dy = 0.02 * xx + 1.5, -0.01 * yy + 0.5
    broken = rng.random(region.shape) < 0.2
    bx, by, model = flow.robust_flow(np.where(broken, 30.0, dx), np.where(broken, -30.0, dy), region)
    inside = region > 0
    assert np.abs(bx - dx)[inside].max() < 0.1 and np.abs(by - dy)[inside].max() < 0.1
    assert abs(flow.determinant(model) - 1.02 * 0.99) < 0.01
    assert flow.robust_flow(dx, dy, np.zeros_like(region))[2] is None
    prior = np.array([[1.0, 0, 2], [0, 1.0, 0]])
    assert flow.robust_flow(np.full(region.shape, 50.0), dy * 0, region, prior)[0][30, 40] == 2.0


def test_scenarios(spark):
    from framelake.sources import scenes

    with pytest.raises(ValueError, match="footage"):
        scenes.render(spark, scenes.Scenario("a", zoom=0.1))
    still = scenes.render(spark, scenes.Scenario("a", frames=4, width=80, height=60))
    rows = still.groupBy("idx").agg(F.sum("m").alias("n"), F.avg(F.when(F.col("m") == 1, F.col("v"))).alias("inside"), F.avg(F.when(F.col("m") == 0, F.col("v"))).alias("outside")).collect()
    assert len(rows) == 4 and all(r.n > 100 and r.inside > r.outside + 50 for r in rows)


def test_footage():
    from dataclasses import replace

    from framelake.sources import scenes

    by = {s.name: replace(s, width=320, height=180) for s in scenes.SCENARIOS}
    assert len(by) == 10
    (picture, truth), (again, _) = (scenes.frame(by["static"], 3) for _ in range(2))
    assert picture.shape == (180, 320, 3) and (picture == again).all() and 3000 < (truth > 127).sum() < 30000
    inside, outside = picture[truth > 250].mean(axis=0), picture[truth == 0].mean(axis=0)
    assert inside[2] > outside[2] + 50 and outside[1] > inside[1] + 30  # red on green
    size = lambda name, k: int((scenes.frame(by[name], k)[1] > 127).sum())
    assert size("zoom", 39) > 1.3 * size("zoom", 0) and size("occlusion", 26) < 0.95 * size("occlusion", 0) and size("hair", 3) > size("static", 3)
    assert scenes.frame(by["lowlight"], 0)[0].mean() < 0.4 * picture.mean()


@pytest.mark.parametrize("name, least", [("fast", 0.85), ("occlusion", 0.6), ("similar_bg", 0.7)])
def test_tracking_quality(spark, name, least):
    from dataclasses import replace

    from framelake.sources import scenes

    s = next(replace(s, width=320, height=180, frames=16, speed=s.speed / 2) for s in scenes.SCENARIOS if s.name == name)
    got = track.followed(scenes.footage(spark, (s,))).collect()
    assert len(got) == 15 and np.mean([r.iou for r in got]) > least


def test_boundary_f_equals_the_pixel_form(spark):
    rng = np.random.default_rng(4)
    p, g = (kernels.gaussian(rng.random((20, 30)), 2.0) > 0.5 for _ in range(2))
    rows = [(0, 0, y, x, int(p[y, x]), int(g[y, x])) for y in range(20) for x in range(30)]
    want = metrics.boundary_f(spark.createDataFrame(rows, "clip int, idx long, y int, x int, p int, g int"), 2).first().f
    assert kernels.boundary_f(p, g) == pytest.approx(want)


def disc(x, y, r=12, shape=(60, 80)):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    return ((xx - x) ** 2 + (yy - y) ** 2 <= r * r).astype(float)


def test_gates():
    image = 200.0 * disc(40, 30)
    colours = follower.Colours(0.08)
    colours.learn(image, disc(40, 30))

    def gated(mask, reference=disc(40, 30), lost=False):
        q = follower.Proposal(mask, 0.9, reference, image, colours, follower.Params(), lost)
        return follower.pass_gates(q), q

    assert gated(disc(40, 30)) [0] == [] and gated(disc(40, 30))[1].confidence == pytest.approx(0.96)
    names, q = gated(np.zeros((60, 80)))
    assert names == ["vanished", "shrunk", "astray"] and q.confidence <= 0.1
    names, q = gated(disc(40, 30, 20))
    assert names[0] == "grown" and q.confidence <= 0.5 and follower.area(q.mask) < follower.area(disc(40, 30, 15))
    names, q = gated(disc(40, 30, 8))
    assert names == ["shrunk"] and (q.mask == disc(40, 30, 8)).all()
    names, q = gated(np.maximum(disc(48, 30), 0))
    assert "leaking" in names and not (q.mask > disc(40, 30, 14)).any()
    assert gated(disc(70, 30, 12), lost=True)[0] == gated(disc(70, 30, 12))[0][:-1] and gated(disc(70, 30, 12))[0][-1] == "astray"


def test_colour_regions():
    small, whole = disc(40, 30, 4), np.ones((60, 80))
    subject, ring = follower.Colours.regions(small)
    assert (subject == (small > 0)).all() and ring.sum() >= 50 and not (ring & (disc(40, 30, 6) > 0)).any()
    subject, ring = follower.Colours.regions(whole)
    assert subject.sum() > 50 and ring.sum() == 0
    grey, colour = np.full((4, 4), 255.0), np.full((4, 4, 3), 255.0)
    assert follower.Colours.bins(grey).max() == 63 and follower.Colours.bins(colour).max() == 511


def test_motion_reaches_with_the_frame():
    rng = np.random.default_rng(2)
    wide = kernels.gaussian(rng.random((200, 400)) * 255, 2.0) * 4
    now, before = wide[40:160, 40:360], wide[46:166, 28:348]
    dx, dy = follower.dense_motion(now, before)
    inner = (slice(30, 90), slice(40, 280))
    assert np.median(dx[inner]) == 12 and np.median(dy[inner]) == -6
    assert follower.steady_motion([(0, 0), (3, 1), (6, 2)]).tolist() == [[1, 0, -3], [0, 1, -1]]
    assert follower.steady_motion([]).tolist() == [[1, 0, 0], [0, 1, 0]]


def test_png_sequence(spark, tmp_path):
    from framelake.sources import images

    rows = [(0, k, 3, 2, [0.0, 0.5, 1.0, 0.25, 0.75, 1.0]) for k in range(2)]
    written = images.write_sequence(spark.createDataFrame(rows, "clip int, idx long, w int, h int, plane array<double>"), str(tmp_path / "out"))
    got = written.collect()
    assert sorted(r.path.rsplit("/", 2)[-1] for r in got) == ["000000.png", "000001.png"]
    data = (tmp_path / "out" / "0" / "000001.png").read_bytes()
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and data[24] == 16


def test_session(spark):
    from framelake.plans import session

    rows = frames(spark, 12)
    truth = lenses.disc(spark, frames=12).withColumn("v", F.when(F.col("v") == 255, 255).otherwise(0))
    mattes = track.blobs(truth, 80, 60).select("clip", "idx", F.transform("plane", lambda v: (v / 255).cast("double")).alias("alpha"))
    keys = mattes.filter("idx in (3, 8)")
    got = {r["idx"]: r for r in session.run(rows, keys).collect()}
    assert sorted(got) == list(range(12))
    assert [i for i, r in sorted(got.items()) if r["flags"] == 1] == [3, 8]
    want = {r["idx"]: np.array(r["alpha"]) for r in mattes.collect()}
    for i, r in got.items():
        assert follower.iou(np.array(r["alpha"]), want[i]) > 0.85, i
    kinds = {r["kind"] for r in session.plan(rows, keys, changed=keys.filter("idx = 8")).collect()}
    assert kinds == {"between", "forward"}
    with pytest.raises(Exception, match="without a matte"):
        session.plan(rows, keys.withColumn("alpha", F.lit(None).cast("array<double>"))).collect()
    assert session.signature(a=1, b=2) == session.signature(b=2, a=1) != session.signature(a=1, b=3)


def test_video_boundary(spark, tmp_path):
    from framelake.sources import video

    (tmp_path / "a.bin").write_bytes(bytes(range(2)))
    files = spark.read.format("binaryFile").load(str(tmp_path))
    out = video.proxy_frames(files, lambda raw: [np.full((20, 40), b) for b in raw], most=16).orderBy("idx").collect()
    assert [(r.idx, r.w, r.h, r.plane[0]) for r in out] == [(0, 16, 8, 0.0), (1, 16, 8, 1.0)]
    whole = video.frames(files, lambda raw: [np.full((4, 6), b, np.uint8) for b in raw]).orderBy("idx").collect()
    assert [(r.clip, r.idx, r.w, r.h, r.bgr) for r in whole] == [("a.bin", k, 6, 4, bytes([k] * 72)) for k in range(2)]
    import hashlib

    manifest = spark.createDataFrame([("a.bin", hashlib.sha256(bytes(range(2))).hexdigest()), ("b.bin", "00")], "name string, sha256 string")
    assert {r["name"]: r.state for r in video.verified_models(manifest, files).collect()} == {"a.bin": "ok", "b.bin": "missing"}
    assert video.preview(np.ones((2, 2))).startswith("iVBOR")
    names = spark.createDataFrame([("000012.acm",), ("x.acm",), ("12.txt",)], "n string").select(video.frame_number(F.col("n")).alias("i"))
    assert [r.i for r in names.collect()] == [12, None, None]


def test_modes():
    image = np.zeros((100, 200))
    boxes = lambda _: [(10, 10, 50, 50, 0.05), (100, 20, 40, 60, 0.9)]
    assert models.starting_prompts("person", image, boxes).box == pytest.approx((103.2, 22.4, 136.8, 77.6))
    assert models.starting_prompts("face", image, boxes).box == pytest.approx((2.5, 0.0, 67.5, 65.0))
    assert models.starting_prompts("person", image, lambda _: []).box == (50, 25, 150, 75) == models.starting_prompts("object", image).box
    with pytest.raises(ValueError):
        models.starting_prompts("cloud", image)


class Node:
    def __init__(self, name):
        self.name = name


class FakeSession:
    """Stands for an ONNX session: remembers what it was run with."""

    def __init__(self, inputs, outputs, answer):
        self.names, self.outputs, self.answer, self.runs = inputs, outputs, answer, []

    def get_inputs(self):
        return [Node(n) for n in self.names]

    def get_outputs(self):
        return [Node(n) for n in self.outputs]

    def run(self, _, given):
        self.runs.append(given)
        return self.answer


def test_onnx_engine():
    logits = np.full((1, 2, 8, 8), -4.0, np.float32)
    logits[0, 0, :, :4], logits[0, 1, :, 4:] = 4.0, 4.0
    encoder = FakeSession(["image"], ["embed"], [np.zeros((1, 3))])
    decoder = FakeSession(["embed", "point_coords", "point_labels", "mask_input", "has_mask_input"], ["masks", "ious"], [logits, np.array([[0.8, 0.7]], np.float32)])
    engine = models.OnnxEngine(side=64, sessions=[encoder, decoder])
    image = np.arange(32 * 16 * 3, dtype=float).reshape(16, 32, 3) % 255
    mask, sure = engine.predict(image, models.Prompts(points=((16, 8, 1), (0, 0, 0)), box=(8, 4, 24, 12)))
    assert mask.shape == (16, 32) and mask[:, :10].min() > 0.5 > mask[:, 20:].max() and sure == pytest.approx(0.8)
    given = decoder.runs[0]
    assert given["point_coords"].tolist() == [[[32, 32], [0, 0], [16, 16], [48, 48]]] and given["point_labels"].tolist() == [[1, 0, 2, 3]] and given["has_mask_input"].tolist() == [0]
    guide = np.zeros((16, 32))
    guide[:, 16:] = 1
    mask, sure = engine.predict(image.copy(), models.Prompts(guide=guide))
    assert mask[:, 20:].min() > 0.5 and sure == pytest.approx(0.7)  # by the overlap
    given = decoder.runs[1]
    assert given["point_labels"].tolist() == [[-1]] and given["mask_input"].shape == (1, 1, 256, 256) and given["mask_input"][0, 0, 0].tolist()[::255] == [-6, 6]
    assert len(encoder.runs) == 1  # of one image, once
    engine.predict(image + 1, models.Prompts())
    assert len(encoder.runs) == 2 and encoder.runs[0]["image"].shape == (1, 3, 64, 64)


def test_resize_area():
    a = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(kernels.resize_area(a, 2, 3), kernels.downsample(a, 2)) and np.allclose(kernels.resize_area(a, 4, 6), a)
    assert np.allclose(kernels.resize_area(a, 3, 4).mean(), a.mean()) and kernels.resize_area(a, 8, 3).shape == (8, 3)


def test_commit_and_refine(spark):
    from framelake.plans import session

    rows = frames(spark, 3)
    alpha = F.transform("plane", lambda v: F.when(v > 127, 255).otherwise(0))
    packed = F.expr("unhex(array_join(transform(a, v -> lpad(hex(v), 2, '0')), ''))")
    mattes = rows.withColumn("a", alpha).select("clip", "idx", "w", "h", packed.alias("alpha"), F.lit(0.4).alias("confidence"), F.lit(2).alias("flags"))
    keys = spark.createDataFrame([(0, 0, "ai")], session.KEYFRAMES)
    point = F.array(F.struct(F.lit(25.0).alias("x"), F.lit(30.0).alias("y"), F.lit(1).alias("label")))
    clicks = spark.createDataFrame([(0, 0), (0, 2)], "clip int, idx long").withColumn("points", point).withColumn("box", F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>"))
    new_keys, new = session.refine(rows, keys, mattes, clicks, models.GuidedLikelihood)
    assert sorted(map(tuple, new_keys.collect())) == [(0, 0, "manual"), (0, 2, "manual")]
    got = {r.idx: r for r in new.collect()}
    assert sorted(got) == [0, 1, 2] and [got[i].flags for i in range(3)] == [1, 2, 1] and [got[i].confidence for i in range(3)] == [0.9, 0.4, 0.9]
    old = {r.idx: r for r in mattes.collect()}
    assert follower.iou(np.frombuffer(got[2].alpha, np.uint8) / 255, np.frombuffer(old[2].alpha, np.uint8) / 255) > 0.8
    state = session.status(rows, new_keys, new).first()
    assert (state.frames, state.cached, state.keyframes, state.low_confidence) == (3, 3, [0, 2], [1])
    none = session.reset(new_keys, new, spark.createDataFrame([(0,)], "clip int"))
    assert [df.count() for df in none] == [0, 0]
    empty = session.status(rows, *none).first()
    assert (empty.frames, empty.cached, empty.keyframes, empty.low_confidence) == (3, 0, [], [])


def test_cutouts(spark, tmp_path):
    import struct
    import zlib

    from framelake.sources import images

    bgr = bytes([10, 120, 250] * 12)
    clips = spark.createDataFrame([("c", 0, 4, 3, bgr), ("c", 1, 4, 3, bgr)], "clip string, idx long, w int, h int, bgr binary")
    mattes = spark.createDataFrame([("c", 0, 4, 3, bytes([255] * 6 + [0] * 6))], "clip string, idx long, mw int, mh int, alpha binary")
    got = sorted((r.idx, r.kind or "", r.path) for r in images.write_cutouts(clips, mattes, f"file://{tmp_path}/x", kernels.EdgeParams(refine=0)).collect())
    assert [g[:2] for g in got] == [(0, "alpha"), (0, "cutout"), (1, "")] and got[2][2] is None
    data = (tmp_path / "x" / "c" / "cutout" / "000000.png").read_bytes()
    assert struct.unpack(">IIBB", data[16:26]) == (4, 3, 16, 6)
    size = struct.unpack(">I", data[33:37])[0]
    lines = np.frombuffer(zlib.decompress(data[41 : 41 + size]), np.uint8).reshape(3, -1)[:, 1:].copy().view(">u2").reshape(3, 4, 4)
    assert (lines[0, 0, :3] == np.floor(np.array([250, 120, 10]) / 255 * 65535 + 0.5)).all() and lines[0, 0, 3] == 65535 and lines[2, 3, 3] == 0
