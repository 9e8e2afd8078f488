"""Kernels: hand-made values, metamorphic properties, and the same results as the pixel lens."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.operators import components, kernels, metrics, plane
from framelake.plans import lenses


def as_pixels(spark, planes):
    rows = [(0, k, y, x, float(p[y, x])) for k, p in enumerate(planes) for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "clip int, idx long, y int, x int, v double")


def as_planes(df, column, shape):
    out = {}
    for r in df.select("idx", "y", "x", column).collect():
        out.setdefault(r["idx"], np.zeros(shape))[r["y"], r["x"]] = r[column]
    return [out[k] for k in sorted(out)]


@pytest.fixture(scope="module")
def random_planes():
    rng = np.random.default_rng(1)
    return [rng.integers(0, 256, (9, 12)).astype(float) for _ in range(2)]


@pytest.mark.parametrize(
    "pixel, blob",
    [
        (lambda p: plane.box_blur(p, "v", "o", 2), lambda a: kernels.box_blur(a, 2)),
        (lambda p: plane.dilate(p, "v", "o", 5), lambda a: kernels.dilate(a, 5)),
        (lambda p: plane.erode(p, "v", "o", 3), lambda a: kernels.erode(a, 3)),
        (lambda p: plane.dilate_octagon(p, "v", "o", 4), lambda a: kernels.octagon(a, 4)),
        (lambda p: plane.edge_shift(p, "v", "o", -2.0), lambda a: 255 * kernels.edge_shift(a / 255, -2.0)),
        (lambda p: plane.warp(p, "v", F.lit(1.25), F.lit(-0.5)).withColumnRenamed("v", "o"), lambda a: kernels.warp(a, np.full(a.shape, 1.25), np.full(a.shape, -0.5))),
        (lambda p: plane.guided(p.withColumn("g", F.col("x") / 12.0), "g", "v", "o", 1, 0.01), lambda a: kernels.guided(np.tile(np.arange(12) / 12, (9, 1)), a, 1, 0.01)),
    ],
)
def test_lenses_agree(spark, random_planes, pixel, blob):
    got = as_planes(pixel(plane.by_frame(as_pixels(spark, random_planes))), "o", (9, 12))
    for a, b in zip(got, random_planes, strict=True):
        np.testing.assert_allclose(a, blob(b), atol=1e-6)


def test_resampling_agrees(spark, random_planes):
    px = as_pixels(spark, random_planes)
    down = as_planes(plane.downsample(px, "v", 4), "v", (3, 3))
    up = as_planes(plane.upsample(px, "v", 2), "v", (18, 24))
    for d, u, p in zip(down, up, random_planes, strict=True):
        np.testing.assert_allclose(d, kernels.downsample(p, 4))
        np.testing.assert_allclose(u, kernels.upsample(p, 2, 18, 24))


def test_components_agree(spark):
    rng = np.random.default_rng(3)
    masks = [(rng.random((10, 11)) < 0.45).astype(float) for _ in range(3)] + [np.zeros((10, 11))]
    px = as_pixels(spark, masks).withColumn("m", F.col("v").cast("int"))
    sizes = components.statistics(components.label(px, 11)).groupBy("idx").agg(F.sort_array(F.collect_list("area")).alias("a"))
    got = {r["idx"]: r["a"] for r in sizes.collect()}
    for k, m in enumerate(masks):
        labels = kernels.label(m > 0)
        assert sorted(np.bincount(labels.reshape(-1))[1:].tolist()) == got.get(k, [])


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 12), st.integers(1, 12), st.integers(0, 4), st.randoms(use_true_random=False))
def test_box_blur_is_a_padded_mean(h, w, r, rnd):
    a = np.array([[rnd.random() for _ in range(w)] for _ in range(h)])
    p = np.pad(a, r, mode="edge")
    want = [[p[y : y + 2 * r + 1, x : x + 2 * r + 1].mean() for x in range(w)] for y in range(h)]
    np.testing.assert_allclose(kernels.box_blur(a, r), want, atol=1e-9)


def disc(h=320, w=480, cy=160, cx=240, r=110):
    yy, xx = np.mgrid[:h, :w]
    return np.clip((r - np.hypot(yy - cy, xx - cx)) / 3 + 0.5, 0, 1)


def scene():
    a = disc()
    image = a[..., None] * np.array([0.8, 0.2, 0.2]) + (1 - a[..., None]) * np.array([0.1, 0.7, 0.1])
    matte = np.floor(kernels.downsample(a, 2) * 255 + 0.5)
    return a, image, matte


def test_alpha_of_a_disc():
    a, image, matte = scene()
    assert np.abs(kernels.edge_alpha(matte, image) - a).mean() < 0.02
    assert not kernels.edge_alpha(np.zeros_like(matte), image).any()


@pytest.mark.parametrize("shift", [6.0, -6.0])
def test_shift_moves_the_radius(shift):
    _, image, matte = scene()
    area = lambda s: (kernels.edge_alpha(matte, image, kernels.EdgeParams(shift=s, refine=0)) > 0.5).sum()
    moved = np.sqrt(area(shift) / np.pi) - np.sqrt(area(0.0) / np.pi)
    assert 4 <= moved * np.sign(shift) <= 8


def test_feather_widens():
    _, image, matte = scene()
    soft = lambda f: ((a := kernels.edge_alpha(matte, image, kernels.EdgeParams(feather=f))) > 0.02).sum() - (a > 0.98).sum()
    assert soft(4.0) > 1.5 * soft(0.0)


def test_decontamination_takes_the_background_out():
    a, image, _ = scene()
    out = kernels.decontaminate(image, a, kernels.EdgeParams(decontaminate=1.0, spill=1.0))
    band = (a > 0.3) & (a < 0.9)
    assert out[band, 1].mean() < image[band, 1].mean()


def test_stabilizer():
    rng = np.random.default_rng(0)
    truth = np.zeros((120, 160))
    truth[40:80, 50:110] = 1
    noisy = [np.clip(truth + rng.normal(0, 0.15, truth.shape), 0, 1) for _ in range(12)]
    before, out = None, []
    for a in noisy:
        before = kernels.stabilize(a, before, np.zeros(a.shape), 0.95)
        out.append(before)
    change = lambda s: np.mean([np.abs(a - b).mean() for a, b in zip(s[1:], s, strict=False)])
    assert change(out) < 0.7 * change(noisy)
    moved = np.roll(truth, 25, axis=1)
    fast = kernels.stabilize(moved, kernels.warp(truth, np.full(truth.shape, -25.0), np.zeros(truth.shape)), np.full(truth.shape, 25.0), 0.95)
    assert ((fast > 0.5) & (moved > 0.5)).sum() / ((fast > 0.5) | (moved > 0.5)).sum() > 0.97
    flat = kernels.stabilize(truth * 0.0, truth, None, 0.25)
    assert flat.max() > 0  # no flow, low confidence: half the relaxed weight


def test_islands_and_support():
    a = np.zeros((20, 20))
    a[2:14, 2:14] = 1
    a[18, 18] = 1
    assert kernels.remove_islands(a, None, 0.05)[18, 18] == 0
    assert kernels.remove_islands(a, a, 0.05)[18, 18] == 1


def test_distance_and_points():
    mask = np.zeros((21, 21), bool)
    mask[3:18, 3:18] = True
    d = kernels.distance(mask)
    assert d[10, 10] == 8 and d[3, 3] == 1 and d[0, 0] == 0
    points = kernels.interior_points(mask.astype(float), 3)
    assert points[0][:2] == (10.0, 10.0) and len(points) >= 1
    assert kernels.interior_points(np.zeros((4, 4)), 3) == []


def test_disc_lens_is_integer(spark):
    assert lenses.disc(spark, 2, 20, 10).agg(F.count("*"), F.max("v")).first()[0] == 400


def test_cutout_keeps_the_colours_outside():
    _, image, matte = scene()
    out = kernels.cutout(matte, image, kernels.EdgeParams(decontaminate=1.0, spill=0.5))
    assert out.shape == (*image.shape[:2], 4) and (out[0, 0, :3] == image[0, 0]).all() and out[0, 0, 3] == 0
    assert (kernels.cutout(np.zeros_like(matte), image)[..., 3] == 0).all()


def test_resample_is_sample_on_a_grid():
    a = np.random.default_rng(0).random((7, 9))
    fy, fx = np.linspace(-1, 8, 13), np.linspace(-2, 10, 17)
    np.testing.assert_allclose(kernels.resample(a, fy, fx), kernels.sample(a, *np.meshgrid(fy, fx, indexing="ij")), atol=1e-12)


# ---- whole planes and the pixel lens ------------------------------------------


def both_lenses(spark):
    """Random masks p and g of two clips, one with a single frame, as pixels and as planes."""
    rng = np.random.default_rng(11)
    px, planes = [], []
    for clip, n in ((0, 4), (1, 1), (2, 3)):
        for idx in range(n):
            p, g = ((kernels.gaussian(rng.random((9, 12)), 1.0) > 0.5).astype(int) * (clip != 2 or idx != 1) for _ in range(2))
            px += [(clip, idx, y, x, int(p[y, x]), int(g[y, x])) for y in range(9) for x in range(12)]
            planes.append((clip, idx, 12, p.reshape(-1).tolist(), g.reshape(-1).tolist()))
    return spark.createDataFrame(px, "clip int, idx long, y int, x int, p int, g int"), spark.createDataFrame(planes, "clip int, idx long, w int, p array<int>, g array<int>")


def as_rows(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_plane_metrics_equal_the_pixel_forms(spark):
    px, planes = both_lenses(spark)
    quality = metrics.plane_quality(planes, 1)
    assert as_rows(quality.select("clip", "idx", "f")) == as_rows(metrics.boundary_f(px, 1).select("clip", "idx", "f"))
    assert as_rows(quality.select("clip", "idx", "iou")) == as_rows(metrics.iou(px, F.col("p") == 1, F.col("g") == 1).select("clip", "idx", "iou"))
    assert as_rows(metrics.plane_flicker(planes)) == as_rows(metrics.flicker(px))
    columns = ["clip", "iou_mean", "iou_min", "f_mean", "flicker", "max_jump"]
    assert as_rows(metrics.plane_summary(planes, 1).select(*columns)) == as_rows(metrics.summarize(px, 1).select(*columns))
    plan = metrics.plane_changes(planes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_flicker_leaves_the_first_frame_out(spark):
    rows = [(0, i, 2, [i % 2, 0], [0, 0]) for i in range(3)] + [(1, 0, 2, [1, 0], [1, 0])]
    got = metrics.plane_flicker(spark.createDataFrame(rows, "clip int, idx long, w int, p array<int>, g array<int>"))
    assert {r.clip: r.flicker for r in got.collect()} == {0: 0.5, 1: 0.0}


def test_plane_components_equal_the_pixel_forms(spark):
    px, planes = both_lenses(spark)
    labelled = components.label(px.withColumn("m", F.col("p")), 12)
    names = ["clip", "idx", "label", "area", "left", "top", "width", "height"]
    found = components.of_planes(planes.withColumnRenamed("p", "m").withColumn("support", F.when(F.col("idx") > 0, F.col("g"))), 0.5)
    assert as_rows(found.select(*names)) == as_rows(components.statistics(labelled).select(*names))
    support = px.filter("idx > 0").select("clip", "idx", "y", "x", F.col("g").alias("s"))
    kept = components.keep_large(labelled, 0.5, support)
    assert as_rows(found.select("clip", "idx", "label", "held", "kept")) == as_rows(kept.select("clip", "idx", "label", "held", "kept"))
    assert components.of_planes(planes.limit(0).withColumnRenamed("p", "m")).count() == 0


@pytest.mark.parametrize("before, now, want", [(100, 100, 1.0), (100, 200, None), (100, 40, None), (40, 200, 1.0)])
def test_area_is_held(before, now, want):
    old, new = (np.arange(400).reshape(20, 20) < n for n in (before, now))
    out = kernels.held_area(new.astype(float), old.astype(float), kernels.StabilizerParams())
    ratio = now / before
    excess = max(ratio / 1.45, 0.65 / ratio)
    share = 0.0 if want or excess <= 1 else min(0.9, max(0.3, 1 - 1 / excess))
    assert np.allclose(out, share * old + (1 - share) * new) and (share > 0) == (want is None)


def test_islands_take_their_halo():
    alpha = np.zeros((12, 20))
    alpha[2:8, 2:8] = 1.0
    alpha[5, 12] = 1.0
    alpha[4:7, 11:14] = np.maximum(alpha[4:7, 11:14], 0.4)
    alpha[4, 9] = 0.3  # near the large one only
    out = kernels.remove_islands(alpha, None, 0.1)
    assert out[5, 12] == 0 and out[4:7, 11:14].max() == 0 and out[4, 9] == 0.3 and (out[2:8, 2:8] == 1).all()
    support = np.zeros((12, 20))
    support[5, 12] = 1.0
    assert (kernels.remove_islands(alpha, support, 0.1) == alpha).all() and (kernels.remove_islands(out, None, 0.1) == out).all()
