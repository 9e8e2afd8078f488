"""Scalar expressions: sizes, names, quantisation, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(c: Column) -> Column:
    return c.cast("int")


def quantise8(a: Column) -> Column:
    """0 .. 1 to 0 .. 255, to the nearest."""
    return _int(F.least(F.greatest(a * 255 + 0.5, F.lit(0.0)), F.lit(255.0)))


def quantise8_preview(a: Column) -> Column:
    """0 .. 1 to 0 .. 255, cut off."""
    return _int(F.least(F.greatest(a * 255, F.lit(0.0)), F.lit(255.0)))


def quantise16(a: Column) -> Column:
    """0 .. 1 to 0 .. 65535, to the nearest."""
    return _int(F.least(F.greatest(a * 65535 + 0.5, F.lit(0.0)), F.lit(65535.0)))


def proxy_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Even size whose long edge is at most ``most``; halves go to the even number."""
    scale = F.least(F.lit(1.0), F.lit(float(most)) / F.greatest(width, height))
    even = lambda v: F.greatest(F.lit(2), _int(F.bround(v * scale / 2) * 2))
    return even(width), even(height)


def clamped_index(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, i))


def frame_name(i: Column) -> Column:
    """At least six digits."""
    s = i.cast("string")
    return F.when(F.length(s) >= 6, s).otherwise(F.lpad(s, 6, "0"))


def set_name(clip: Column, settings: Column, model: Column, version: Column) -> Column:
    """clip-settings-model@version with what isn't a letter, digit, - _ or . made _ in the model's part."""
    model_part = F.regexp_replace(F.concat(model, F.lit("@"), version), r"[^\p{L}\p{N}\-_.]", "_")
    return F.concat_ws("-", clip, settings, model_part)


def settings_hash(settings: Column) -> Column:
    """First eight hex digits of the SHA-256 of a map's key=value parts in the order of the keys; values are given as they are to be written."""
    parts = F.transform(F.array_sort(F.map_entries(settings)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 8)


def _little64(n: Column) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*(F.substring(digits, k, 2) for k in range(15, 0, -2))))


def fingerprint(path: Column, size: Column, mtime: Column, head: Column, middle: Column, tail: Column, large: int = 2 << 20) -> Column:
    """Identity of a file: 16 hex digits of the SHA-256 of its path in lower case, size and time (u64) and first MiB, of large files also one in the middle and the last."""
    ends = F.when(size > large, F.concat(middle, tail)).otherwise(F.lit(b""))
    return F.substring(F.sha2(F.concat(F.encode(F.lower(path), "UTF-8"), _little64(size), _little64(mtime), head, ends), 256), 1, 16)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-30.0)), F.lit(30.0))))


def mask_to_logit(m: Column) -> Column:
    return (m * 2 - 1) * 6


def normalise(v: Column, mean: float, deviation: float) -> Column:
    """8-bit channel by a mean and deviation of the 0 .. 1 scale."""
    return (v - mean * 255) / (deviation * 255)


def magnitude(dx: Column, dy: Column) -> Column:
    return F.hypot(dx, dy)


def expand_box(box: dict[str, Column], share: float, width: Column, height: Column) -> dict[str, Column]:
    """A box grown by a share of its size on each side, inside the frame."""
    ex, ey = (box["x1"] - box["x0"]) * share, (box["y1"] - box["y0"]) * share
    return {
        "x0": F.greatest(F.lit(0.0), box["x0"] - ex), "y0": F.greatest(F.lit(0.0), box["y0"] - ey),
        "x1": F.least(width, box["x1"] + ex), "y1": F.least(height, box["y1"] + ey),
    }


def to_pixels(points: Column, width: Column, height: Column) -> Column:
    """Prompt points of 0 .. 1 in pixels; without a label a point is positive."""
    return F.transform(points, lambda p: F.struct((p["x"] * width).alias("x"), (p["y"] * height).alias("y"), F.coalesce(p["label"], F.lit(1)).alias("label")))


def eta(elapsed: Column, done: Column, total: Column) -> Column:
    """Seconds left; null before anything is done."""
    return F.when(done > 0, elapsed / done * (total - done))


def affine(model: dict[str, Column], x: Column, y: Column) -> tuple[Column, Column]:
    return model["a"] * x + model["b"] * y + model["tx"], model["c"] * x + model["d"] * y + model["ty"]


def determinant(model: dict[str, Column]) -> Column:
    """Of the model's linear part; 1 where it is not between .3 and 3."""
    det = model["a"] * model["d"] - model["b"] * model["c"]
    return F.when((det > 0.3) & (det < 3), det).otherwise(F.lit(1.0))


def person_box(box: dict[str, Column]) -> dict[str, Column]:
    """A people detector's box, which is loose, drawn in by 8 % at the sides and 4 % above and below."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return {"x0": box["x0"] + 0.08 * w, "y0": box["y0"] + 0.04 * h, "x1": box["x1"] - 0.08 * w, "y1": box["y1"] - 0.04 * h}


def head_box(box: dict[str, Column]) -> dict[str, Column]:
    """A face detector's box grown to the head: 15 % left and right, 30 % above, 10 % below."""
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    return {"x0": box["x0"] - 0.15 * w, "y0": box["y0"] - 0.30 * h, "x1": box["x1"] + 0.15 * w, "y1": box["y1"] + 0.10 * h}
