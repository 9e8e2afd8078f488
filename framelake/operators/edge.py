"""Region of interest, levels and output modes as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("original", "mask", "alpha", "cutout", "overlay", "composite", "checkerboard")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def levels(v: Column, black: float = 0.03, white: float = 0.97) -> Column:
    """Values up to ``black`` become 0, from ``white`` on 1."""
    return clamp((v - black) / (max(white, black + 1e-3) - black))


def luma(r: Column, g: Column, b: Column) -> Column:
    return clamp(0.299 * r + 0.587 * g + 0.114 * b)


def checker(x: Column, y: Column, size: int) -> Column:
    """Light and dark squares."""
    odd = (F.floor(x / size) + F.floor(y / size)) % 2 == 1
    return F.when(odd, F.lit(0.62)).otherwise(F.lit(0.38))


def margin(long_edge: int, shift: float = 0, feather: float = 0, smooth: float = 0, quality: int = 1, colour: bool = False, scale: float = 1.0) -> float:
    """How far around the matte the edge stages reach, in pixels."""
    out = (abs(shift) + 3 * feather + 3 * smooth) * scale + 0.012 * long_edge * (1 + quality) + 8
    return out + (0.05 * long_edge if colour else 0)


def roi(px: DataFrame, width: int, height: int, matte_width: int, matte_height: int, around: float) -> DataFrame:
    """Half-open box of the matte (v > 2) in the source's pixels with ``around`` on all sides; none for an empty matte."""
    inside = F.col("v") > 2
    edge = lambda f, c: f(F.when(inside, F.col(c)))
    box = px.groupBy("clip", "idx").agg(edge(F.min, "x").alias("bx0"), edge(F.min, "y").alias("by0"), edge(F.max, "x").alias("bx1"), edge(F.max, "y").alias("by1"))
    sx, sy = width / matte_width, height / matte_height
    low = lambda c, s: F.greatest(F.lit(0), F.floor(F.col(c) * s - around).cast("int"))
    high = lambda c, s, n: F.least(F.lit(n), F.ceil((F.col(c) + 1) * s + around).cast("int"))
    out = box.filter(F.col("bx0").isNotNull())
    return out.select("clip", "idx", low("bx0", sx).alias("x0"), low("by0", sy).alias("y0"), high("bx1", sx, width).alias("x1"), high("by1", sy, height).alias("y1"))


def output(mode: str, colour: dict[str, Column], alpha: Column, raw: Column, source_alpha: Column, background: dict[str, Column] | None = None, tint=(1.0, 0.1, 0.1), opacity: float = 0.55, premultiply: bool = False) -> dict[str, Column]:
    """Channels r, g, b, a of an output mode.  Without a matte (null alpha) the source passes with alpha 1."""
    if mode == "original":
        return {**colour, "a": source_alpha}
    if mode in ("mask", "alpha"):
        v = raw if mode == "mask" else alpha
        out = {**dict.fromkeys("rgb", v), "a": F.lit(1.0)}
    elif mode == "cutout":
        out = {**({c: v * alpha for c, v in colour.items()} if premultiply else colour), "a": alpha}
    elif mode == "overlay":
        k = alpha * opacity
        out = {**{c: v * (1 - k) + t * k for (c, v), t in zip(colour.items(), tint, strict=True)}, "a": F.lit(1.0)}
    elif mode in ("composite", "checkerboard"):
        if background is None:
            raise ValueError(f"{mode} needs a background")
        out = {**{c: v * alpha + background[c] * (1 - alpha) for c, v in colour.items()}, "a": F.lit(1.0)}
    else:
        raise ValueError(f"no such mode: {mode}")
    passed = {**colour, "a": F.lit(1.0)}
    return {c: F.when(alpha.isNull(), passed[c]).otherwise(v) for c, v in out.items()}


def despill(channels: dict[str, Column], key: str, amount: float) -> dict[str, Column]:
    """The key channel brought down toward the mean of the others."""
    others = [v for c, v in channels.items() if c != key]
    limit = (others[0] + others[1]) / 2
    v = channels[key]
    return {**channels, key: F.when(v > limit, v - amount * (v - limit)).otherwise(v)}


def bgr_to_rgba(b: Column, g: Column, r: Column) -> dict[str, Column]:
    """8-bit blue, green, red to float channels."""
    return {"r": r / 255.0, "g": g / 255.0, "b": b / 255.0, "a": F.lit(1.0)}
