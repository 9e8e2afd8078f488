"""A compression classifier of text quality.

Two zstandard dictionaries are trained, one on pieces of good and one on pieces
of bad labelled texts.  A text is compressed with each, piece by piece; the
difference of the two sizes, normalised, is calibrated by a logistic curve to the
probability that the text is good.  Nothing else is read off a text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm import fitting, runtime

LEVEL, PIECE, DICTIONARY, FOLDS = 3, 1024, 112_640, 4
#: For the dictionaries, of every text drawn: pieces at most, evenly spread over all of it, and bytes of a piece.
SAMPLE_PIECES, SAMPLE_PIECE = 8, 2048
#: Bytes of text by which differences are shrunk: those of a few words say little.
SHRINK = 250


@dataclass(frozen=True)
class Model:
    """Dictionaries, curve and, where one label only is known, the constant score."""

    good: bytes = b""
    bad: bytes = b""
    curve: tuple[float, ...] = ()
    constant: float = 0.5


def pieces_of(text: str) -> list[bytes]:
    """What of a text its dictionary is trained on; the first and the last piece are among them."""
    raw = text.encode("utf-8", "surrogatepass")
    n = -(-len(raw) // SAMPLE_PIECE)
    most = min(n, SAMPLE_PIECES)
    starts = [k * (n - 1) // max(1, most - 1) * SAMPLE_PIECE for k in range(most)]
    return [raw[i : i + SAMPLE_PIECE] for i in starts]


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary, smaller where there is little to train on."""
    size = min(DICTIONARY, sum(map(len, pieces)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError, TypeError):  # too little: the text itself
        return b"".join(pieces)[-DICTIONARY:]


def dictionaries(good: list[bytes], bad: list[bytes]) -> Model:
    return Model(_dictionary(good), _dictionary(bad))


class Sizes:
    """Compressed sizes of texts with both dictionaries."""

    def __init__(self, model: Model):
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, write_checksum=False) for d in (model.good, model.bad)]

    def __call__(self, text: str) -> tuple[int, int, int]:
        raw = text.encode("utf-8", "surrogatepass")
        good = bad = 0
        for i in range(0, max(1, len(raw)), PIECE):
            piece = raw[i : i + PIECE]
            good += len(self.by[0].compress(piece))
            bad += len(self.by[1].compress(piece))
        return good, bad, len(raw)


def features(sizes: np.ndarray) -> np.ndarray:
    """The size difference normalised by the text's length, by both sizes and by the length's root (a rate, and how sure
    it is), each shrunk; then what is to be expected of a difference at that length, so that none at all speaks against a
    long text and not against a short one.
    """
    good, bad, n = sizes[:, 0], sizes[:, 1], sizes[:, 2]
    more = bad - good
    return np.stack([np.ones(len(n)), 20 * more / (n + SHRINK), 10 * more / (good + bad + SHRINK / 2), more / np.sqrt(n + SHRINK), 4 * n / (n + SHRINK)], axis=1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = fitting.FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0; without both labels the score is constant.

    The driver gets pieces of the drawn texts (``SAMPLE_PIECES`` of
    ``SAMPLE_PIECE`` bytes each, at most) for the dictionaries, and three sizes of
    each whole text for the curve, which is fitted on sizes by dictionaries that
    have not seen the text.
    """
    sample = fitting.labelled_sample(docs, labels, "quality", fitting.crc_of_id() % 5 != 0, rows)
    sample = sample.withColumn("fold", F.expr(f"cast(pmod(xxhash64(doc_id), {FOLDS}) as int)"))
    runtime.small_batches(docs.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pieces_of(t) for t in batch.column("text").to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(f) for f in found])
            parts = pa.array([p for f in found for p in f], pa.binary())
            place = pa.array([k for f in found for k in range(len(f))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in ("doc_id", "label", "fold")), place, parts], names=["doc_id", "label", "fold", "place", "piece"])

    schema = "doc_id long, label int, fold int, place int, piece binary"
    pieces = sample.mapInArrow(runtime.frugal(cut), schema).toArrow().sort_by([("doc_id", "ascending"), ("place", "ascending")])
    label, fold, piece = pieces["label"].to_numpy(), pieces["fold"].to_numpy(), pieces["piece"]
    take = lambda mask: piece.filter(pa.array(mask)).to_pylist()
    models = [dictionaries(take((label == 1) & (fold != f)), take((label == 0) & (fold != f))) for f in range(FOLDS)]

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [Sizes(m) for m in models]
        for batch in batches:
            got = [sizes[f](t) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist(), strict=True)]
            columns = [pa.array(c, pa.int64()) for c in zip(*got, strict=True)] if got else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], names=["doc_id", "label", "good", "bad", "n"])

    known = sample.mapInArrow(runtime.frugal(measured), "doc_id long, label int, good long, bad long, n long").toArrow().sort_by("doc_id")
    y = known["label"].to_numpy().astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    curve = fitting.logistic(features(np.stack([known[c].to_numpy() for c in ("good", "bad", "n")], axis=1).astype(float)), y, l2=0.01)
    whole = dictionaries(take(label == 1), take(label == 0))
    return Model(whole.good, whole.bad, tuple(curve.tolist()))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with its score in 0 .. 1, from the whole text alone.

    A null text counts as empty; an empty text gets what the curve gives for it.
    All rows and columns stay.
    """
    runtime.small_batches(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Sizes(model) if model.curve else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if measure is None or not texts:
                values = np.full(len(texts), model.constant)
            else:
                values = fitting.sigmoid(features(np.array([measure(t or "") for t in texts], float)) @ np.array(model.curve))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], names=[*names, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{column}` double"
    return docs.mapInArrow(runtime.frugal(run), schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = fitting.FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted (1: good) of every row; repeated and null ids are rows like any other."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(texts, fit(docs, labels, rows))
    return scored.select("doc_id", F.coalesce(fitting.crc_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows that aren't rejected, as they are."""
    column = runtime.fresh(docs, "quality_score")
    return score(docs, fit(docs, labels), column).filter(F.col(column) >= threshold).select(*docs.columns)
