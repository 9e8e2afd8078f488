"""The tracker and the stabilizer as keyed stateful streams.

A clip's state is what its next frame needs; frames of a micro-batch are taken in
the order of ``idx``.  A frame whose idx is not above the last one seen comes out
flagged ``late`` and changes nothing.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from framelake.operators import follower, kernels

OUT = "clip int, idx long, area long, confidence double, low boolean, lost boolean, late boolean"
STATE = "last long, state binary"
COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _frames(pdfs: Iterator[pd.DataFrame]) -> list[tuple[int, np.ndarray]]:
    rows = [(int(r.idx), np.asarray(r.plane, np.float64).reshape(int(r.h), int(r.w))) for pdf in pdfs for r in pdf.itertuples(index=False)]
    return sorted(rows, key=lambda r: r[0])


def _stream(frames: DataFrame, first, following) -> DataFrame:
    def run(key, pdfs, group: GroupState):
        clip, out = int(key[0]), []
        last, held = (group.get[0], pickle.loads(group.get[1])) if group.exists else (None, None)
        for idx, plane in _frames(pdfs):
            if last is not None and idx <= last:
                out.append((clip, idx, 0, 0.0, False, False, True))
                continue
            if held is None:
                held, row = first(plane)
            else:
                held, row = following(held, plane)
            out.append((clip, idx, *row, False))
            last = idx
        if last is not None:
            group.update((last, pickle.dumps(held)))
        yield pd.DataFrame(out, columns=COLUMNS)

    return frames.groupBy("clip").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def tracked(frames: DataFrame, params: follower.Params = follower.Params()) -> DataFrame:
    """Frames (clip, idx, w, h, plane) of a stream, each clip followed from its first."""

    def first(plane: np.ndarray):
        subject = follower.Follower(plane, (plane > 127).astype(float), params)
        return subject, (int(subject.alpha.sum()), 1.0, False, False)

    def following(subject: follower.Follower, plane: np.ndarray):
        got = subject.follow(plane)
        return subject, (int(follower.area(got.alpha)), round(got.confidence, 6), got.low, got.lost)

    return _stream(frames, first, following)


def stabilized(frames: DataFrame, params: kernels.StabilizerParams = kernels.StabilizerParams(least_area=2)) -> DataFrame:
    """Frames of a stream through the stabilizer; the state is the alpha before."""

    def first(plane: np.ndarray):
        alpha = kernels.stabilize(kernels.clamp01(plane / 255), None, None, 1.0, params)
        return alpha, (int((alpha > 0.5).sum()), 1.0, False, False)

    def following(before: np.ndarray, plane: np.ndarray):
        alpha = kernels.stabilize(kernels.clamp01(plane / 255), before, np.zeros_like(plane), 1.0, params)
        return alpha, (int((alpha > 0.5).sum()), 1.0, False, False)

    return _stream(frames, first, following)
