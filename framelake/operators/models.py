"""The boundary to segmentation models.

An engine is any object with ``predict(image, prompts) -> (mask, confidence)``;
``segment`` runs one over frames joined with their prompts, made once a Python
worker.  ``GuidedLikelihood`` is a stand-in without a neural model; ``OnnxEngine``
runs an encoder and a decoder file where onnxruntime and weights are at hand.  No
parity with any published model is claimed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from framelake.operators import kernels


@dataclass(frozen=True)
class Prompts:
    """Points (x, y, label), a box (x0, y0, x1, y1) and a guide mask; each may be missing."""

    points: tuple[tuple[float, float, int], ...] = ()
    box: tuple[float, float, float, float] | None = None
    guide: np.ndarray | None = None


class Engine(Protocol):
    def predict(self, image: np.ndarray, prompts: Prompts) -> tuple[np.ndarray, float]: ...


def automatic(image: np.ndarray) -> Prompts:
    """A box around the middle half."""
    h, w = image.shape[:2]
    return Prompts(box=(w / 4, h / 4, 3 * w / 4, 3 * h / 4))


Detector = Callable[[np.ndarray], list[tuple[float, float, float, float, float]]]

#: Modes that begin with a detector's box, and how much of it is taken (left, top, right, bottom, in shares of its size; + inward).
DETECTED = {"person": (0.08, 0.04, 0.08, 0.04), "face": (0.15, 0.30, 0.15, 0.10)}
#: A face is a part of the head, so its box grows; a person's box is loose, so it shrinks.
INWARD = {"person": 1.0, "face": -1.0}


def starting_prompts(mode: str, image: np.ndarray, detect: Detector | None = None) -> Prompts:
    """Prompts of a mode without a click: of 'person' and 'face' the best of the detector's boxes (x, y, w, h, weight), else the automatic ones.

    A person is picked by area times weight (at least .1), a face by area; the
    first of equals.  Without a detector, or if it finds nothing, the automatic
    prompts are used.
    """
    if mode not in ("object", "custom", *DETECTED):
        raise ValueError(f"no such mode: {mode}")
    found = detect(image) if detect is not None and mode in DETECTED else []
    if not found:
        return automatic(image)
    x, y, w, h, _ = max(found, key=lambda b: b[2] * b[3] * (max(b[4], 0.1) if mode == "person" else 1.0))
    left, top, right, bottom = (INWARD[mode] * k for k in DETECTED[mode])
    height, width = image.shape[:2]
    return Prompts(box=(max(0.0, x + left * w), max(0.0, y + top * h), min(float(width), x + w - right * w), min(float(height), y + h - bottom * h)))


class GuidedLikelihood:
    """Seeds from guide, box or points; pixels whose grey is more frequent inside than outside."""

    def seeds(self, image: np.ndarray, prompts: Prompts) -> np.ndarray:
        h, w = image.shape
        yy, xx = np.mgrid[:h, :w]
        if prompts.guide is not None:
            return prompts.guide > 0.5
        if prompts.box is not None:
            x0, y0, x1, y1 = prompts.box
            return (xx >= x0) & (xx < x1) & (yy >= y0) & (yy < y1)
        out = np.zeros((h, w), bool)
        for x, y, label in prompts.points:
            near = (xx - x) ** 2 + (yy - y) ** 2 <= (max(h, w) / 8) ** 2
            out = out | near if label else out & ~near
        return out

    def predict(self, image: np.ndarray, prompts: Prompts) -> tuple[np.ndarray, float]:
        seeds = self.seeds(image, prompts)
        bins = np.clip(image / 4, 0, 63).astype(int)
        share = lambda m: np.bincount(bins[m], minlength=64) / max(m.sum(), 1)
        fg, bg = share(seeds), share(~seeds)
        mask = ((fg + 1e-4) / (fg + bg + 2e-4))[bins] > 0.5
        mask &= kernels.dilate(seeds.astype(np.int8), 2 * max(2, max(image.shape) // 20) + 1) > 0
        return mask.astype(float), 0.55 if 0.001 < mask.mean() < 0.95 else 0.1


class OnnxEngine:
    """Encoder and decoder sessions, loaded at first use; ``sessions`` can be given instead.

    An image is encoded once for as many prompts as come for it.  The decoder gets
    points and box corners in the encoder's pixels, a padding point if there are
    none, and the guide as a mask of logits; of these what its graph has inputs for.
    """

    #: Labels of a box's corners, and of a point that stands for none.
    CORNERS, PADDING = (2, 3), -1
    MASK_SIDE, MASK_LOGIT = 256, 6.0
    MEAN, DEVIATION = np.array([0.485, 0.456, 0.406]), np.array([0.229, 0.224, 0.225])

    def __init__(self, encoder: str = "", decoder: str = "", side: int = 1024, sessions=None):
        self.paths, self.side, self.sessions = (encoder, decoder), side, sessions
        self.seen: np.ndarray | None = None
        self.features: dict[str, np.ndarray] = {}

    def encode(self, image: np.ndarray) -> None:
        """Keep the features of an image (grey, or blue, green, red; 0 .. 255); of the one seen last they are there already."""
        if self.seen is not None and np.array_equal(self.seen, image):
            return
        if self.sessions is None:
            import onnxruntime

            self.sessions = [onnxruntime.InferenceSession(p, providers=onnxruntime.get_available_providers()) for p in self.paths]
        encoder = self.sessions[0]
        colours = np.repeat(image[..., None], 3, axis=2) if image.ndim == 2 else image[..., ::-1]
        square = np.stack([kernels.resize(colours[..., c], self.side, self.side) for c in range(3)], axis=-1) / 255
        planes = ((square - self.MEAN) / self.DEVIATION).transpose(2, 0, 1)[None].astype(np.float32)
        values = encoder.run(None, {encoder.get_inputs()[0].name: planes})
        self.features, self.seen = {o.name: v for o, v in zip(encoder.get_outputs(), values, strict=True)}, image.copy()

    def inputs(self, shape: tuple[int, int], prompts: Prompts) -> dict[str, np.ndarray]:
        """What the prompts say, by the names of a decoder's inputs."""
        marks = [(x, y, float(bool(label))) for x, y, label in prompts.points]
        if prompts.box is not None:
            marks += [(*prompts.box[2 * k : 2 * k + 2], float(label)) for k, label in enumerate(self.CORNERS)]
        marks = marks or [(0.0, 0.0, float(self.PADDING))]
        scale = np.array([self.side / shape[1], self.side / shape[0], 1.0])
        coords = (np.array(marks) * scale).astype(np.float32)[None]
        guide = np.zeros((self.MASK_SIDE, self.MASK_SIDE)) if prompts.guide is None else self.MASK_LOGIT * (2 * kernels.resize_area(prompts.guide, self.MASK_SIDE, self.MASK_SIDE) - 1)
        return {
            "point_coords": coords[..., :2], "point_labels": coords[..., 2],
            "mask_input": guide[None, None].astype(np.float32), "has_mask_input": np.array([float(prompts.guide is not None)], np.float32),
        }

    def predict(self, image: np.ndarray, prompts: Prompts) -> tuple[np.ndarray, float]:
        """The candidate of the best score, of equals the first; with a guide, half of the score is the overlap with it."""
        self.encode(image)
        decoder = self.sessions[1]
        given = {**self.features, **self.inputs(image.shape[:2], prompts)}
        logits, sure = (v[0] for v in decoder.run(None, {i.name: given[i.name] for i in decoder.get_inputs()})[:2])
        score = sure
        if prompts.guide is not None:
            guide = kernels.resize_area(prompts.guide, *logits.shape[1:]) > 0.5
            overlap = (logits > 0) & guide
            score = 0.5 * sure + 0.5 * overlap.sum(axis=(1, 2)) / (((logits > 0) | guide).sum(axis=(1, 2)) + 1e-6)
        best = int(np.argmax(score))
        wide = kernels.resize(logits[best].astype(float), *image.shape[:2])
        return 1 / (1 + np.exp(-np.clip(wide, -30, 30))), float(np.clip(sure[best], 0, 1))


OUT = "clip int, idx long, w int, h int, alpha binary, confidence double"


def segment(frames: DataFrame, make_engine: Callable[[], Engine]) -> DataFrame:
    """Mattes of frames (clip, idx, w, h, plane, points, box and, if there, guide: alpha bytes); without prompts the automatic ones are used."""

    def run(batches):
        engine = make_engine()
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                image = np.asarray(r["plane"], np.float64).reshape(r["h"], r["w"])
                points = tuple((p["x"], p["y"], p["label"]) for p in r.get("points") or ())
                box = tuple(r["box"][c] for c in ("x0", "y0", "x1", "y1")) if r.get("box") else None
                guide = np.frombuffer(r["guide"], np.uint8).reshape(image.shape) / 255 if r.get("guide") else None
                prompts = Prompts(points, box, guide) if points or box or guide is not None else automatic(image)
                mask, conf = engine.predict(image, prompts)
                alpha = np.floor(np.clip(mask, 0, 1) * 255 + 0.5).astype(np.uint8)
                out.append({"clip": r["clip"], "idx": r["idx"], "w": r["w"], "h": r["h"], "alpha": alpha.tobytes(), "confidence": conf})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("clip", pa.int32()), ("idx", pa.int64()), ("w", pa.int32()), ("h", pa.int32()), ("alpha", pa.binary()), ("confidence", pa.float64())])
    return frames.mapInArrow(run, OUT)
