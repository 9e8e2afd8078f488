"""SQL names for the scalar expressions, and table functions over planes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake.functions import codec


def _rle_encode(planes: pd.Series, widths: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else codec.encode(np.frombuffer(p, np.uint8).reshape(-1, w)) for p, w in zip(planes, widths, strict=True)])


def _rle_decode(payloads: pd.Series, widths: pd.Series, heights: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else codec.decode(p, w, h).tobytes() for p, w, h in zip(payloads, widths, heights, strict=True)])


class RleRuns:
    """Rows (seq, value, length) of a payload."""

    def eval(self, payload: bytes):
        for k in range(0, len(payload or b""), 3):
            yield k // 3, payload[k], payload[k + 1] | payload[k + 2] << 8


class InteriorPoints:
    """Rows (n, x, y) of points deep in a mask, given as bytes, 0 outside."""

    def eval(self, plane: bytes, width: int, n: int):
        from framelake.operators import kernels

        mask = np.frombuffer(plane, np.uint8).reshape(-1, width) > 0
        for k, (x, y, _) in enumerate(kernels.interior_points(mask.astype(float), n)):
            yield k, x, y


def register(spark: SparkSession) -> None:
    """rle_encode, rle_decode (Arrow batches), rle_runs and interior_points (table functions)."""
    spark.udf.register("rle_encode", F.pandas_udf(_rle_encode, T.BinaryType()))
    spark.udf.register("rle_decode", F.pandas_udf(_rle_decode, T.BinaryType()))
    spark.udtf.register("rle_runs", F.udtf(RleRuns, returnType="seq int, value int, length int"))
    spark.udtf.register("interior_points", F.udtf(InteriorPoints, returnType="n int, x double, y double"))
