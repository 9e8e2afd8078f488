"""Plane kernels in numpy for the blob lens: one row a frame, planes in binary columns.

Each has a twin over the pixel lens (``plane``, ``components``, ``edge``) or is a
composition of ones that do.  Planes are float64 arrays (height, width); border
rules are those of the twins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np


def clamp01(a: np.ndarray) -> np.ndarray:
    return np.clip(a, 0.0, 1.0)


# ---- blurs, morphology --------------------------------------------------------


def box_blur(a: np.ndarray, radius: int) -> np.ndarray:
    """Mean over a square, the border repeated outside; running sums, so the radius costs nothing."""
    if radius < 1:
        return a.copy()
    out = a.astype(np.float64)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius + 1, radius)
        total = np.cumsum(np.pad(out, pad, mode="edge"), axis=axis)
        size = 2 * radius + 1
        hi, lo = [slice(None)] * 2, [slice(None)] * 2
        hi[axis], lo[axis] = slice(size, None), slice(None, -size)
        out = (total[tuple(hi)] - total[tuple(lo)]) / size
    return out


def gauss_boxes(sigma: float, n: int = 3) -> list[int]:
    """Radii of the n boxes whose variance comes nearest to a Gaussian's; none for a sigma under .3."""
    if sigma < 0.3:
        return []
    ideal = math.sqrt(12 * sigma * sigma / n + 1)
    low = max(1, math.floor(ideal) - (math.floor(ideal) % 2 == 0))
    # so many of the smaller size that the variances add up to sigma squared
    m = round((n * (low * low + 4 * low + 3) - 12 * sigma * sigma) / (4 * low + 4))
    return [(low - 1) // 2 if k < m else (low + 1) // 2 for k in range(n)]


def gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    for radius in gauss_boxes(sigma):
        a = box_blur(a, radius)
    return a


def true_gaussian(a: np.ndarray, sigma: float) -> np.ndarray:
    """Truncated at four sigma, mirrored at the border; this engine's own kernel, not a library's."""
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        p = np.pad(a, pad, mode="reflect" if min(a.shape) > r else "edge")
        a = np.apply_along_axis(np.convolve, axis, p, k, mode="valid")
    return a


def dilate(a: np.ndarray, size: int) -> np.ndarray:
    """Maximum over a square of odd size, cut off at the border."""
    r = size // 2
    low = a.min() if a.size else 0
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        a = np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, constant_values=low), size, axis=axis).max(axis=-1)
    return a


def erode(a: np.ndarray, size: int) -> np.ndarray:
    return -dilate(-a.astype(np.float64), size).astype(np.float64)


def octagon(a: np.ndarray, radius: int) -> np.ndarray:
    radius = min(radius, 120)
    square = int(math.floor(0.4142 * radius + 0.5))
    out = dilate(a, 2 * square + 1) if square else a.copy()
    for _ in range(radius - square):
        p = np.pad(out, 1, constant_values=out.min())
        out = np.maximum.reduce([out, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]])
    return out


def edge_shift(a: np.ndarray, shift: float) -> np.ndarray:
    if abs(shift) < 0.25:
        return a
    radius = int(math.floor(abs(shift) + 0.5))
    return octagon(a, radius) if shift > 0 else 1.0 - octagon(1.0 - a, radius)


# ---- resampling ---------------------------------------------------------------


def downsample(a: np.ndarray, factor: int) -> np.ndarray:
    """Means of blocks, those at the border of what they have."""
    rows, columns = np.arange(0, a.shape[0], factor), np.arange(0, a.shape[1], factor)
    total = np.add.reduceat(np.add.reduceat(a.astype(np.float64), rows, axis=0), columns, axis=1)
    count = np.outer(np.diff(np.append(rows, a.shape[0])), np.diff(np.append(columns, a.shape[1])))
    return total / count


def sample(a: np.ndarray, fy: np.ndarray, fx: np.ndarray, border: str = "edge") -> np.ndarray:
    """Bilinear samples at (fy, fx); outside is the border's value or 0."""
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    ty, tx = fy - y0, fx - x0

    def at(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        v = a[np.clip(y, 0, a.shape[0] - 1), np.clip(x, 0, a.shape[1] - 1)]
        if border == "edge":
            return v
        return np.where((y >= 0) & (y < a.shape[0]) & (x >= 0) & (x < a.shape[1]), v, 0.0)

    top = at(y0, x0) * (1 - tx) + at(y0, x0 + 1) * tx
    return top * (1 - ty) + (at(y0 + 1, x0) * (1 - tx) + at(y0 + 1, x0 + 1) * tx) * ty


def resample(a: np.ndarray, fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """Bilinear samples on the grid of rows fy and columns fx, a direction after the other; outside is the border's value."""
    for axis, at in ((0, fy), (1, fx)):
        low = np.floor(at)
        t = (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        near, far = (np.clip(low.astype(int) + d, 0, a.shape[axis] - 1) for d in (0, 1))
        first = a.take(near, axis=axis)
        a = first + (a.take(far, axis=axis) - first) * t
    return a


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with centres at half pixels."""
    return resample(a, (np.arange(height) + 0.5) * a.shape[0] / height - 0.5, (np.arange(width) + 0.5) * a.shape[1] / width - 0.5)


def resize_area(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the source area of each target pixel; a direction that grows is interpolated instead."""

    def shares(full: int, size: int) -> np.ndarray:
        """(size, full): how much of each source pixel lies in a target one, a row adding up to 1."""
        edges = np.arange(size + 1) * full / size
        inside = np.minimum(edges[1:, None], np.arange(1, full + 1)) - np.maximum(edges[:-1, None], np.arange(full))
        return np.maximum(inside, 0) * size / full

    rows, columns = min(height, a.shape[0]), min(width, a.shape[1])
    out = shares(a.shape[0], rows) @ a @ shares(a.shape[1], columns).T
    return out if (rows, columns) == (height, width) else resize(out, height, width)


def upsample(a: np.ndarray, factor: int, height: int, width: int) -> np.ndarray:
    return resample(a, (np.arange(height) + 0.5) / factor - 0.5, (np.arange(width) + 0.5) / factor - 0.5)


def warp(a: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """Backward warp; outside is 0."""
    y, x = np.mgrid[: a.shape[0], : a.shape[1]]
    return sample(a, y + dy, x + dx, border="zero")


# ---- filters ------------------------------------------------------------------


def guided_coefficients(guide: np.ndarray, p: np.ndarray, radius: int, eps: float) -> tuple[np.ndarray, np.ndarray]:
    mean_g, mean_p = box_blur(guide, radius), box_blur(p, radius)
    a = (box_blur(guide * p, radius) - mean_g * mean_p) / (box_blur(guide * guide, radius) - mean_g**2 + eps)
    return box_blur(a, radius), box_blur(mean_p - a * mean_g, radius)


def guided(guide: np.ndarray, p: np.ndarray, radius: int, eps: float, sub: int = 1, least_side: int = 128) -> np.ndarray:
    """Guided filter; on planes that are not small the coefficients come from a grid ``sub`` times smaller."""
    if sub <= 1 or min(p.shape) < least_side:
        a, b = guided_coefficients(guide, p, radius, eps)
    else:
        a, b = (upsample(c, sub, *p.shape) for c in guided_coefficients(downsample(guide, sub), downsample(p, sub), max(1, radius // sub), eps))
    return a * guide + b


def foreground(image: np.ndarray, alpha: np.ndarray, f: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A step of blur fusion: foreground and background colours (h, w, 3) from estimates f and b."""
    weight = box_blur(alpha, radius)
    out_f, out_b = np.empty_like(image), np.empty_like(image)
    for c in range(3):
        near_f = box_blur(f[..., c] * alpha, radius) / (weight + 1e-5)
        near_b = box_blur(b[..., c] * (1 - alpha), radius) / (1 - weight + 1e-5)
        out_f[..., c] = near_f + alpha * (image[..., c] - alpha * near_f - (1 - alpha) * near_b)
        out_b[..., c] = near_b
    return out_f, out_b


# ---- components, distance -----------------------------------------------------


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components: 0 outside, else 1 .. n in the order of their first pixel.

    Runs of rows are joined where they touch; a run's root is the least run.
    """
    height, width = mask.shape
    flat = np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(flat, axis=1)
    row, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    root = np.arange(len(row))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    first = np.searchsorted(row, np.arange(height + 1))
    for y in range(1, height):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if begin[i] <= end[j] and begin[j] <= end[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    roots = np.array([find(k) for k in range(len(row))], int)
    names = np.zeros(len(row), int)
    _, names[:] = np.unique(roots, return_inverse=True) if len(row) else (None, 0)
    out = np.zeros((height, width), np.int32)
    for y, a, b, n in zip(row, begin, end, names, strict=True):
        out[y, a:b] = n + 1
    return out


def remove_islands(alpha: np.ndarray, support: np.ndarray | None, fraction: float) -> np.ndarray:
    """Without components of less than ``fraction`` of the largest's area, unless most of one lies on ``support``.

    A component that goes takes the pixels next to it along, but for those next to one that stays.
    """
    labels = label(alpha > 0.5)
    flat = labels.reshape(-1)
    sizes = np.bincount(flat)  # of the background first
    if len(sizes) < 3:
        return alpha
    share = np.zeros(len(sizes)) if support is None else np.bincount(flat, weights=(support > 0.5).reshape(-1), minlength=len(sizes)) / np.maximum(sizes, 1)
    # 1: the component goes, 2: it stays; the background is neither
    fate = np.where((sizes < fraction * sizes[1:].max()) & (share <= 0.5), 1, 2).astype(np.int8)
    fate[0] = 0
    if not (fate == 1).any():
        return alpha
    # the strongest fate next to a pixel decides
    return np.where(dilate(fate[labels], 3) == 1, 0.0, alpha)


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance to the nearest pixel outside the mask (rows, then lower envelopes of columns)."""
    height, width = mask.shape
    far = height + width
    line = np.where(mask, far, 0).astype(float)
    for x in range(1, width):
        line[:, x] = np.minimum(line[:, x], line[:, x - 1] + 1)
    for x in range(width - 2, -1, -1):
        line[:, x] = np.minimum(line[:, x], line[:, x + 1] + 1)
    y = np.arange(height)
    squared = np.empty((height, width))
    for x in range(width):
        squared[:, x] = ((y[:, None] - y[None, :]) ** 2 + line[None, :, x] ** 2).min(axis=1)
    return np.sqrt(squared)


def interior_points(mask: np.ndarray, n: int) -> list[tuple[float, float, int]]:
    """Up to n points deep in the mask; each blots out a disc of 1.6 times its depth, none is less than 1.5 deep."""
    inside = mask > 0.5
    if not inside.any():
        return []
    # beyond the mask's box, and a pixel around it, nothing is nearer
    (top, bottom), (left, right) = ((max(0, at.min() - 1), at.max() + 2) for at in np.nonzero(inside))
    depth = distance(inside[top:bottom, left:right])
    yy, xx = np.mgrid[: depth.shape[0], : depth.shape[1]]
    out = []
    for _ in range(n):
        y, x = np.unravel_index(np.argmax(depth), depth.shape)
        deepest = depth[y, x]
        if deepest < 1.5:
            break
        out.append((float(x + left), float(y + top), 1))
        depth[(yy - y) ** 2 + (xx - x) ** 2 <= max(3, int(1.6 * deepest)) ** 2] = 0
    return out


# ---- quality ------------------------------------------------------------------


def boundary_f(mask: np.ndarray, truth: np.ndarray, tolerance: int = 2) -> float:
    """Boundary F of two masks (see ``metrics.boundary_f``), without a row a pixel."""
    edges = [m & ~(erode(m.astype(float), 3) > 0.5) for m in (mask, truth)]
    near = [dilate(e.astype(np.int8), 2 * tolerance + 1) > 0 for e in edges]
    precision, recall = ((edges[k] & near[1 - k]).sum() / max(edges[k].sum(), 1) for k in (0, 1))
    return float(2 * precision * recall / (precision + recall)) if precision + recall else 0.0


# ---- the edge pipeline --------------------------------------------------------


# The defaults of the edge stages and of the stabilizer.
@dataclass(frozen=True)
class EdgeParams:
    """Lengths in source pixels, the others shares."""

    shift: float = 0.0
    feather: float = 0.0
    smooth: float = 0.0
    refine: float = 0.5
    decontaminate: float = 0.0
    spill: float = 0.0
    black: float = 0.03
    white: float = 0.97
    quality: int = 1


def refine(alpha: np.ndarray, guide: np.ndarray, p: EdgeParams, long_edge: int) -> np.ndarray:
    """The uncertain band follows the image's edges."""
    radius = max(2, int(math.floor((0.0015 + 0.0015 * p.quality) * long_edge * (0.5 + p.refine) + 0.5)))
    sub = {0: 4, 1: 2}.get(p.quality, 1)
    q = clamp01(guided(guide, alpha, radius, 2e-4, sub))
    band = box_blur(((alpha > 0.004) & (alpha < 0.996)).astype(float), radius)
    weight = np.minimum(1.0, 3 * band) * p.refine
    return alpha * (1 - weight) + clamp01((q - 0.5) * (1 + 3 * p.refine) + 0.5) * weight


def region(matte: np.ndarray, height: int, width: int, p: EdgeParams) -> tuple[slice, slice] | None:
    """Rows and columns of the image that the matte and the edge stages reach; None for an empty matte."""
    from framelake.operators.edge import margin

    rows, columns = np.flatnonzero((matte > 2).any(axis=1)), np.flatnonzero((matte > 2).any(axis=0))
    if not len(rows):
        return None
    around = margin(max(height, width), p.shift, p.feather, p.smooth, p.quality, p.decontaminate > 0 or p.spill > 0)
    out = []
    for hit, size, full in ((rows, matte.shape[0], height), (columns, matte.shape[1], width)):
        scale = full / size
        out.append(slice(max(0, math.floor(hit[0] * scale - around)), min(full, math.ceil((hit[-1] + 1) * scale + around))))
    return out[0], out[1]


def smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    """Blurred and made steep again, with a little of what it was; nothing up to .3."""
    return 0.85 * clamp01((gaussian(a, sigma) - 0.5) * 2.5 + 0.5) + 0.15 * a if sigma > 0.3 else a


def feather(a: np.ndarray, sigma: float) -> np.ndarray:
    return gaussian(a, sigma) if sigma > 0.3 else a


def edge_alpha(matte: np.ndarray, image: np.ndarray, p: EdgeParams = EdgeParams()) -> np.ndarray:
    """Alpha (h, w) at the image's size from an 8-bit matte; 0 where the matte's surroundings don't reach."""
    height, width = image.shape[:2]
    out = np.zeros((height, width))
    inside = region(matte, height, width, p)
    if inside is None:
        return out
    fy, fx = ((np.arange(s.start, s.stop) + 0.5) * size / full - 0.5 for s, size, full in zip(inside, matte.shape, (height, width), strict=True))
    a = resample(matte / 255.0, fy, fx)
    a = clamp01((a - p.black) / (max(p.white, p.black + 1e-3) - p.black))
    a = edge_shift(a, p.shift)
    if p.refine > 0.01:
        part = image[inside]
        guide = clamp01(0.299 * part[..., 0] + 0.587 * part[..., 1] + 0.114 * part[..., 2])
        a = refine(a, guide, p, max(height, width))
    out[inside] = feather(smooth(a, p.smooth), p.feather)
    return out


def cutout(matte: np.ndarray, image: np.ndarray, p: EdgeParams = EdgeParams()) -> np.ndarray:
    """RGBA (h, w, 4): the image's colours, decontaminated where the matte reaches, and the alpha."""
    alpha = edge_alpha(matte, image, p)
    out = np.concatenate([image, alpha[..., None]], axis=-1)
    inside = region(matte, *image.shape[:2], p)
    if inside is not None and (p.decontaminate > 0 or p.spill > 0):
        out[inside][..., :3] = decontaminate(image[inside], alpha[inside], p)
    return out


def edge_colours(image: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated colours of the subject and of the background everywhere: a wide fusion, at a quarter of the size where the frame is large, then a fine one."""
    height, width = alpha.shape
    wide, fine = max(6, int(0.04 * max(alpha.shape))), max(2, int(0.004 * max(alpha.shape)))
    if min(height, width) < 256:
        subject, ground = foreground(image, alpha, image, image, wide)
    else:
        each = lambda f, planes: np.stack([f(c) for c in np.moveaxis(planes, -1, 0)], axis=-1)
        quarter = each(lambda c: downsample(c, 4), image)
        subject, ground = (each(lambda c: upsample(c, 4, height, width), e) for e in foreground(quarter, downsample(alpha, 4), quarter, quarter, max(2, wide // 4)))
    sharp, _ = foreground(image, alpha, np.maximum(subject, 0), ground, fine)
    return np.maximum(sharp, 0), ground


def key_channel(ground: np.ndarray, alpha: np.ndarray) -> int | None:
    """The channel that tints the edge: the background's strongest there, if it is clearly above the others' mean."""
    edge = (alpha > 0.02) & (alpha < 0.98)
    if not edge.any():
        return None
    tint = np.average(ground[edge], axis=0, weights=(alpha * (1 - alpha))[edge])
    strongest = int(tint.argmax())
    return strongest if tint[strongest] - (tint.sum() - tint[strongest]) / 2 > 0.06 else None


def decontaminate(image: np.ndarray, alpha: np.ndarray, p: EdgeParams) -> np.ndarray:
    """Colours without what the background adds at the edge, and without its tint."""
    subject, ground = edge_colours(image, alpha)
    out = image + p.decontaminate * (subject - image)
    channel = key_channel(ground, alpha) if p.spill > 0 else None
    if channel is not None:
        rest = (out.sum(axis=-1) - out[..., channel]) / 2
        excess = np.where(alpha > 0, np.maximum(out[..., channel] - rest, 0), 0)
        out[..., channel] -= p.spill * excess
    return out


# ---- the stabilizer -----------------------------------------------------------


@dataclass(frozen=True)
class StabilizerParams:
    strength: float = 0.6
    motion: float = 3.0
    grow: float = 1.45
    shrink: float = 0.65
    island: float = 0.004
    relax: float = 0.5
    least_area: int = 50


def held_area(new: np.ndarray, before: np.ndarray, p: StabilizerParams) -> np.ndarray:
    """``new`` drawn towards ``before`` as far as its area jumps out of the allowed band; small subjects may jump."""
    then, now = (float((a > 0.5).sum()) for a in (before, new))
    if then <= p.least_area:
        return new
    ratio = now / max(then, 1.0)
    excess = max(ratio / p.grow, p.shrink / max(ratio, 1e-3))  # over 1 outside of the band, on either side
    if excess <= 1:
        return new
    share = float(np.clip(1 - 1 / excess, 0.3, 0.9))
    return share * before + (1 - share) * new


def stabilize(new: np.ndarray, before: np.ndarray | None, flow: np.ndarray | None, confidence: float, p: StabilizerParams = StabilizerParams()) -> np.ndarray:
    """The new alpha held by the motion-compensated one before: jumps of area drawn back, still parts averaged.

    The weight of the past falls with how far a pixel moved (without any motion
    given it is half), and with a confidence below ``relax``, to a fifth at least.
    """
    if before is None:
        return remove_islands(new, None, p.island)
    stillness = 0.5 if flow is None else np.exp(-((flow / p.motion) ** 2))
    trust = 1.0 if confidence >= p.relax else max(0.2, confidence / p.relax)
    past = p.strength * trust * stillness
    mixed = past * before + (1 - past) * held_area(new, before, p)
    return remove_islands(clamp01(mixed), before, p.island)
