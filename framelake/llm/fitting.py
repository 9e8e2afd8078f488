"""Samples of labelled documents, bounded in rows, and logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm import runtime

#: Labelled documents that a model is fitted on, at most.
FIT_ROWS = 12_000


def crc_of_id() -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, whole text and label of at most ``rows`` training documents, drawn by a hash of the id; a written table.

    ``train`` is a condition on doc_id.  Null labels and ids aren't drawn; of a
    repeated id's labels the largest counts, and of its texts the one with the
    least hash, so that fits agree.  Texts of any length are drawn, and stay on
    the executors.
    """
    draw = F.xxhash64(F.lit("fit"), F.col("doc_id"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & train).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    drawn = known.withColumn("draw", draw).orderBy("draw", "doc_id").limit(rows).select("doc_id", "label")
    # what is broadcast is bounded by ``rows``
    found = texts.join(F.broadcast(drawn), "doc_id")
    one = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("hash"), F.col("text").alias("text"))).alias("least"))
    return runtime.stage(one.select("doc_id", F.col("least.text").alias("text"), "label"), "fit-sample")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients by Newton's method; the first column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (p - y) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
