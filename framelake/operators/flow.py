"""Robust motion of a subject from dense flow: an affine fit, and the outliers replaced by it."""

from __future__ import annotations

import numpy as np

from framelake.operators import kernels

MOST_POINTS, LEAST_POINTS, NEAR = 4000, 200, 2.0
#: Pixels around the region in which vectors are replaced.
MARGIN = 15


def modular_sample(n: int, most: int) -> np.ndarray:
    """Indices of at most ``most`` of n, by a fixed modular hash."""
    if n <= most:
        return np.arange(n)
    return np.sort(np.argsort((np.arange(n, dtype=np.int64) * 2654435761 + 12345) % 4294967296, kind="stable")[:most])


def fit_affine(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray, rounds: int = 5) -> np.ndarray:
    """2 x 3 model of x + dx, y + dy: least squares, refitted on what lies within two pixels (or the nearer half)."""
    a = np.stack([x, y, np.ones(len(x))], axis=1)
    target = np.stack([x + dx, y + dy], axis=1)
    keep = np.ones(len(x), bool)
    model = np.zeros((3, 2))
    for _ in range(rounds):
        model, *_ = np.linalg.lstsq(a[keep], target[keep], rcond=None)
        off = np.hypot(*(a @ model - target).T)
        keep = off <= max(NEAR, np.median(off))
    return model.T


def robust_flow(dx: np.ndarray, dy: np.ndarray, region: np.ndarray, prior: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Flow with vectors near the subject that are far from its affine motion replaced by it, and the model.

    A region of under 200 pixels changes nothing; with a ``prior`` model (a
    subject that is hard to see) that one is used in place of a fit.
    """
    ys, xs = np.nonzero(region > 0.5)
    if len(xs) < LEAST_POINTS:
        return dx, dy, None
    pick = modular_sample(len(xs), MOST_POINTS)
    model = prior if prior is not None else fit_affine(xs[pick], ys[pick], dx[ys, xs][pick], dy[ys, xs][pick])
    yy, xx = np.mgrid[: region.shape[0], : region.shape[1]]
    mx = model[0, 0] * xx + model[0, 1] * yy + model[0, 2] - xx
    my = model[1, 0] * xx + model[1, 1] * yy + model[1, 2] - yy
    zone = kernels.dilate((region > 0.5).astype(np.int8), 2 * MARGIN + 1) > 0
    far = zone & (np.hypot(dx - mx, dy - my) > 3 + 0.25 * np.hypot(mx, my))
    return np.where(far, mx, dx), np.where(far, my, dy), model


def determinant(model: np.ndarray) -> float:
    """Of the linear part; 1 where it is not between .3 and 3."""
    det = float(model[0, 0] * model[1, 1] - model[0, 1] * model[1, 0])
    return det if 0.3 < det < 3 else 1.0
