"""Following a subject from frame to frame: motion, colours, gates, search.

A frame is taken in four moves.  The reference mask and the last alpha are carried
along the motion between the frames.  A segmentation engine, prompted with the
carried reference, proposes a mask.  The proposal goes through ``GATES``, a table
of what may be wrong with a mask and what is done about it.  What passes all
``RENEWALS`` becomes the new reference; otherwise the carried one stays, and after
some such frames the subject is searched for by its colours.

Images are planes (height, width) or (height, width, 3) of 0 .. 255.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from framelake.operators import flow, kernels
from framelake.operators.models import Engine, Prompts


# The tracker's thresholds.
@dataclass(frozen=True)
class Params:
    low: float = 0.55
    lost: float = 0.30
    good: float = 0.80
    again: float = 0.72
    least_area: float = 0.0004
    grow: float = 1.28
    shrink: float = 0.72
    reference: tuple[float, float] = (0.90, 1.22)
    leak: float = 0.22
    leak_likelihood: float = 0.12
    patience: int = 3
    ratio: tuple[float, float] = (0.5, 1.7)
    rate: float = 0.08
    box: float = 0.04
    search_box: float = 0.10
    points: int = 3
    remembered: int = 6


def on(alpha: np.ndarray) -> np.ndarray:
    return alpha > 0.5


def area(alpha: np.ndarray) -> float:
    return float(on(alpha).sum())


def iou(a: np.ndarray, b: np.ndarray) -> float:
    union = (on(a) | on(b)).sum()
    return float((on(a) & on(b)).sum() / union) if union else 1.0


def _odd(share: float, mask: np.ndarray, least: int) -> int:
    """An odd window: a share of the long edge, at least so much."""
    return max(least, int(share * max(mask.shape[:2]))) | 1


def _window(mask: np.ndarray, size: int) -> np.ndarray:
    return kernels.dilate(mask.astype(np.int8), size) > 0


# ---- motion -------------------------------------------------------------------


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image.mean(axis=2)


def dense_motion(now: np.ndarray, before: np.ndarray, coarsest: int = 96, finest: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(dx, dy) by which each pixel of ``now`` looks back into ``before``; a stand-in for dense optical flow.

    Coarse to fine: on each level of a pyramid the best of the shifts within two
    pixels of what the level above found, by the mean difference around a pixel.
    So the reach grows with the frame, to about a thirtieth of its long edge on
    the coarsest level.  Levels over ``finest`` pixels are not searched.
    """
    levels = [(grey(now).astype(float), grey(before).astype(float))]
    while max(levels[-1][0].shape) > coarsest:
        levels.append(tuple(kernels.downsample(g, 2) for g in levels[-1]))
    dx = dy = np.zeros(levels[-1][0].shape, int)
    for at, (a, b) in enumerate(reversed(levels)):
        height, width = a.shape
        if at:
            dx, dy = (2 * np.repeat(np.repeat(d, 2, axis=0), 2, axis=1)[:height, :width] for d in (dx, dy))
        if at and max(a.shape) > finest:
            continue
        y, x = np.mgrid[:height, :width]
        best, found_x, found_y = np.full(a.shape, np.inf), dx, dy
        for sy in range(-2, 3):
            for sx in range(-2, 3):
                there = b[np.clip(y + dy + sy, 0, height - 1), np.clip(x + dx + sx, 0, width - 1)]
                cost = kernels.box_blur(np.abs(a - there), 3) + 0.02 * (abs(sx) + abs(sy))
                less = cost < best
                best = np.where(less, cost, best)
                found_x, found_y = np.where(less, dx + sx, found_x), np.where(less, dy + sy, found_y)
        dx, dy = found_x, found_y
    return dx.astype(float), dy.astype(float)


def steady_motion(centroids: list[tuple[float, float]]) -> np.ndarray:
    """The model that looks back by the mean velocity of the centroids; of less than two, by none."""
    path = np.array(centroids, float).reshape(-1, 2)
    velocity = (path[-1] - path[0]) / (len(path) - 1) if len(path) > 1 else np.zeros(2)
    return np.column_stack([np.eye(2), -velocity])


# ---- colours ------------------------------------------------------------------


class Colours:
    """Histograms of the subject's interior and of the ring around it: 8 x 8 x 8 bins of colours, or 64 of grey."""

    def __init__(self, rate: float):
        self.rate = rate
        self.counts: np.ndarray | None = None  # (2, bins): subject, surroundings

    @staticmethod
    def bins(image: np.ndarray) -> np.ndarray:
        if image.ndim == 2:
            return np.clip(image / 4, 0, 63).astype(int)
        each = np.clip(image / 32, 0, 7).astype(int)
        return each @ np.array([64, 8, 1])

    @staticmethod
    def regions(alpha: np.ndarray, least: int = 50) -> tuple[np.ndarray, np.ndarray]:
        """The eroded mask and the ring between two dilations; where one is too small the mask, and all beyond the nearer dilation."""
        mask = on(alpha)
        inner = kernels.erode(mask.astype(float), _odd(0.012, mask, 3)) > 0.5
        near, far = _window(mask, _odd(0.03, mask, 5)), _window(mask, _odd(0.14, mask, 9))
        ring = far & ~near
        return (inner if inner.sum() >= least else mask), (ring if ring.sum() >= least else ~near)

    def learn(self, image: np.ndarray, alpha: np.ndarray) -> None:
        bins, size = self.bins(image), 64 if image.ndim == 2 else 512
        seen = np.stack([np.bincount(bins[r], minlength=size) / max(r.sum(), 1) for r in self.regions(alpha)])
        self.counts = seen if self.counts is None else (1 - self.rate) * self.counts + self.rate * seen

    def likelihood(self, image: np.ndarray) -> np.ndarray:
        if self.counts is None:
            return np.full(image.shape[:2], 0.5)
        subject, around = self.counts + 1e-4
        return (subject / (subject + around))[self.bins(image)]


# ---- engines ------------------------------------------------------------------


class LikelihoodEngine:
    """A stand-in for a segmentation model: colour odds and nearness to the guide mask, both smoothed, must add up to the subject."""

    def __init__(self, colours: Colours):
        self.colours = colours

    def predict(self, image: np.ndarray, prompts: Prompts) -> tuple[np.ndarray, float]:
        like = np.clip(self.colours.likelihood(image), 0.05, 0.95)
        long_edge = max(like.shape)
        odds = kernels.gaussian(np.log(like / (1 - like)), max(0.8, long_edge / 400))
        if prompts.guide is not None:
            guide = on(prompts.guide)
            odds = odds + 2 * (2 * kernels.gaussian(guide.astype(float), max(1.0, long_edge / 80)) - 1)
            allowed = _window(guide, 2 * max(2, long_edge // 40) + 1)
        else:
            x0, y0, x1, y1 = prompts.box or (0, 0, like.shape[1], like.shape[0])
            y, x = np.mgrid[: like.shape[0], : like.shape[1]]
            allowed = (x >= x0) & (x < x1) & (y >= y0) & (y < y1)
        mask = ((odds > 0) & allowed).astype(float)
        mask = kernels.erode(kernels.dilate(mask, 3), 3)
        return mask, 0.9 if mask.any() else 0.1


def box_around(mask: np.ndarray, grow: float) -> tuple[float, float, float, float] | None:
    ys, xs = np.nonzero(on(mask))
    if not len(xs):
        return None
    x0, y0, x1, y1 = xs.min(), ys.min(), xs.max() + 1, ys.max() + 1
    ex, ey = (x1 - x0) * grow, (y1 - y0) * grow
    return max(0.0, x0 - ex), max(0.0, y0 - ey), min(float(mask.shape[1]), x1 + ex), min(float(mask.shape[0]), y1 + ey)


# ---- gates --------------------------------------------------------------------


@dataclass
class Proposal:
    """A proposed mask beside what is expected; gates change the mask and the confidence."""

    mask: np.ndarray
    confidence: float
    reference: np.ndarray
    image: np.ndarray
    colours: Colours
    params: Params
    was_lost: bool
    agreement: float = 0.0
    ratio: float = 0.0

    def __post_init__(self):
        self.agreement = iou(self.mask, self.reference)
        self.confidence = 0.4 * self.confidence + 0.6 * min(1.0, self.agreement / 0.8)
        self.measure()

    def measure(self) -> None:
        self.ratio = area(self.mask) / (area(self.reference) + 1e-6)

    def likelihood(self) -> np.ndarray:
        return kernels.true_gaussian(self.colours.likelihood(self.image), 1.5)

    def leak(self) -> float:
        """The share of the mask that clearly looks like the surroundings."""
        inside = self.likelihood()[on(self.mask)]
        return float((inside < self.params.leak_likelihood).mean()) if len(inside) else 0.0


@dataclass(frozen=True)
class Gate:
    """If ``applies``, the mask is replaced by ``remedy``'s and the confidence by ``share`` of it, at most ``cap``."""

    name: str
    applies: Callable[[Proposal], bool]
    cap: float
    share: float = 1.0
    remedy: Callable[[Proposal], np.ndarray] | None = None
    measured_anew: bool = False


GATES = (
    Gate("vanished", lambda q: area(q.mask) < q.params.least_area * q.mask.size, 0.1),
    # more than motion explains: only a thin band around the reference can be the subject
    Gate("grown", lambda q: q.ratio > q.params.grow, 0.5, 0.6, lambda q: q.mask * _window(on(q.reference), _odd(0.012, q.mask, 3))),
    # less may be an occlusion, so the visible part stays as it is
    Gate("shrunk", lambda q: q.ratio < q.params.shrink, 0.5, 0.7),
    Gate("leaking", lambda q: q.leak() > q.params.leak, 0.45, 0.6, lambda q: q.mask * (q.likelihood() > q.params.leak_likelihood), measured_anew=True),
    Gate("astray", lambda q: not q.was_lost and q.agreement < 0.35, 0.45, remedy=lambda q: 0.7 * q.reference + 0.3 * q.mask),
)


def pass_gates(q: Proposal, gates: tuple[Gate, ...] = GATES) -> list[str]:
    """Names of the gates that applied, in the table's order."""
    applied = [g for g in gates if _pass(q, g)]
    return [g.name for g in applied]


def _pass(q: Proposal, gate: Gate) -> bool:
    if not gate.applies(q):
        return False
    if gate.remedy is not None:
        q.mask = gate.remedy(q)
    if gate.measured_anew:
        q.measure()
    q.confidence = min(gate.share * q.confidence, gate.cap)
    return True


@dataclass
class Result:
    """A frame's outcome; ``ratio`` is the mask's area to the expected one."""

    alpha: np.ndarray
    confidence: float
    lost: bool
    ratio: float
    low: bool = False


#: What a frame must pass for its alpha to become the reference.
RENEWALS: tuple[Callable[[Result, Params], bool], ...] = (
    lambda r, p: not r.lost,
    lambda r, p: r.confidence >= p.good,
    lambda r, p: bool(on(r.alpha).any()),
    lambda r, p: p.reference[0] <= r.ratio <= p.reference[1],
)


# ---- the follower -------------------------------------------------------------


@dataclass
class Follower:
    """What is carried from frame to frame of a clip; it can be pickled."""

    image: np.ndarray
    alpha: np.ndarray
    params: Params = Params()
    engine: Engine | None = None
    colours: Colours | None = None
    reference: np.ndarray | None = None
    centroids: list[tuple[float, float]] = field(default_factory=list)
    size: float = 0.0
    lost: bool = False
    degraded: bool = False
    streak: int = 0

    def __post_init__(self):
        self.colours = Colours(self.params.rate)
        self.engine = self.engine or LikelihoodEngine(self.colours)
        if on(self.alpha).any():
            self.renew(self.image, self.alpha)
        self.reference = self.alpha

    def renew(self, image: np.ndarray, alpha: np.ndarray) -> None:
        """Take an alpha that is sure as the reference, and learn from it."""
        ys, xs = np.nonzero(on(alpha))
        self.centroids = [*self.centroids, (float(xs.mean()), float(ys.mean()))][-self.params.remembered :]
        self.colours.learn(image, alpha)
        self.reference, self.size = alpha, area(alpha)

    def motion(self, image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The motion into this frame; near the subject what is far from its affine motion follows that.

        While the reference is not sure that motion isn't fitted but extrapolated,
        since what moves there may be what hides the subject.
        """
        dx, dy = dense_motion(image, self.image)
        prior = steady_motion(self.centroids) if self.degraded else None
        dx, dy, _ = flow.robust_flow(dx, dy, kernels.warp(self.reference, dx, dy), prior)
        return dx, dy

    def propose(self, image: np.ndarray, reference: np.ndarray) -> Result:
        """The engine's mask after the gates."""
        p = self.params
        if area(reference) < max(1.0, p.least_area * reference.size):
            return Result(np.zeros_like(reference), 0.0, True, 0.0)
        points = tuple(kernels.interior_points(reference, p.points))
        mask, sure = self.engine.predict(image, Prompts(points, box_around(reference, p.box), reference))
        q = Proposal(mask, sure, reference, image, self.colours, p, self.lost)
        pass_gates(q)
        if not self.lost:
            return Result(q.mask, q.confidence, q.confidence < p.lost, q.ratio)
        if q.confidence >= p.again and q.agreement > 0.3:
            return Result(q.mask, q.confidence, False, q.ratio)
        return Result(np.zeros_like(mask), min(q.confidence, 0.2), True, q.ratio)

    def search(self, image: np.ndarray) -> Result | None:
        """The subject among the three largest regions that look like it: the surest by confidence less leak, ties to the larger."""
        p = self.params
        like = (kernels.true_gaussian(self.colours.likelihood(image), 2.0) > 0.65).astype(float)
        like = kernels.dilate(kernels.erode(like, 5), 5)
        labels = kernels.label(kernels.erode(kernels.dilate(like, 9), 9) > 0.5)
        sizes = np.bincount(labels.reshape(-1))[1:]
        large = [k for k in np.argsort(-sizes, kind="stable")[:3] if sizes[k] >= 0.25 * self.size]
        tried = []
        for k in large:
            part = (labels == k + 1).astype(float)
            mask, sure = self.engine.predict(image, Prompts(tuple(kernels.interior_points(part, p.points)), box_around(part, p.search_box)))
            leak = Proposal(mask, sure, part, image, self.colours, p, True).leak()
            if sure >= p.again and leak < 0.15 and p.ratio[0] <= area(mask) / max(self.size, 1.0) <= p.ratio[1]:
                tried.append((sure - leak, mask, sure))
        if not tried:
            return None
        _, mask, sure = max(tried, key=lambda c: c[0])
        return Result(mask, min(0.85, sure), False, 1.0)

    def follow(self, image: np.ndarray) -> Result:
        """Take the next frame."""
        p = self.params
        dx, dy = self.motion(image)
        carried, before = (kernels.warp(a, dx, dy) for a in (self.reference, self.alpha))
        out = self.propose(image, carried)
        if not out.lost:
            out.alpha = kernels.stabilize(out.alpha, before if out.confidence >= p.low else None, np.hypot(dx, dy), out.confidence)
        if (out.lost or out.confidence < p.low) and self.streak >= p.patience and self.size > 100:
            found = self.search(image)
            if found is not None:
                out, carried, self.centroids = found, found.alpha, []
        self.degraded = not all(passes(out, p) for passes in RENEWALS)
        if self.degraded:
            self.reference, self.streak = carried, self.streak + 1
        else:
            self.renew(image, out.alpha)
            self.streak = 0
        self.image, self.alpha, self.lost = image, out.alpha, out.lost
        out.low = out.lost or out.confidence < p.low or out.ratio < 0.95 * p.reference[0]
        return out
