"""Driver tables seen as planes and sequences.

``planes``: embeddings as 8 x 8 planes in the pixel lens (clip, idx, y, x, v).
``sequences``: events as one record a frame (clip, idx, value, kind).
``disc``: a moving disc over texture, from integers alone, at any size.
The SQL of each lens is the beginning of the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, idx, y, x, v): v = floor(255 e), one row a pixel; a pixel is in the mask if v > 0."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("label").alias("clip"), F.col("vec_id").alias("idx"), F.posexplode("embedding").alias("pos", "e")
    )
    return rows.select(
        "clip", "idx", F.expr(f"cast(pos div {SIDE} as int)").alias("y"), (F.col("pos") % SIDE).cast("int").alias("x"),
        F.floor(F.col("e").cast("double") * 255).cast("int").alias("v"),
    )


def plane_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, idx, plane, w): the same planes, one row a frame, as arrays of 64 whole numbers."""
    plane = F.transform("embedding", lambda e: F.floor(e.cast("double") * 255).cast("int"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("label").alias("clip"), F.col("vec_id").alias("idx"), plane.alias("plane"), F.lit(SIDE).alias("w"))


PLANES_SQL = """px AS (
  SELECT clip, idx, (p // 8)::INT AS y, (p % 8)::INT AS x, floor(e::DOUBLE * 255)::INT AS v
  FROM (SELECT label AS clip, vec_id AS idx, unnest(range(64)) AS p, unnest(embedding) AS e FROM embeddings))"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip, idx, event_id, value, kind) in the order of (ts, event_id) inside a clip, idx from 0."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select(
        F.col("user_id").alias("clip"), (F.row_number().over(order) - 1).cast("int").alias("idx"), "event_id", "value", F.col("event_type").alias("kind")
    )


SEQUENCES_SQL = """seq AS (
  SELECT user_id AS clip, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS idx, event_id, value, event_type AS kind
  FROM events)"""


def grid(spark: SparkSession, frames: int, width: int, height: int) -> DataFrame:
    """(f, i, y, x) of every pixel of every frame."""
    n = width * height
    out = spark.range(frames * n)
    return out.select(F.expr(f"cast(id div {n} as int)").alias("f"), (F.col("id") % n).cast("int").alias("i")).select(
        "f", "i", F.expr(f"cast(i div {width} as int)").alias("y"), (F.col("i") % width).cast("int").alias("x")
    )


def disc(spark: SparkSession, frames: int = 6, width: int = 80, height: int = 60) -> DataFrame:
    """(clip, idx, y, x, v): a disc of 255 that moves a pixel a frame over a texture of 0 .. 4."""
    inside = F.pow(F.col("x") - 25 - F.col("f"), F.lit(2)) + F.pow(F.col("y") - 30, F.lit(2)) < 300
    return grid(spark, frames, width, height).select(
        F.lit(0).alias("clip"), F.col("f").cast("long").alias("idx"), "y", "x",
        F.when(inside, 255).otherwise((F.col("i") * 7 + F.col("f") * 13) % 5).cast("int").alias("v"),
    )


def disc_sql(frames: int = 6, width: int = 80, height: int = 60) -> str:
    return f"""px AS (
  SELECT 0 AS clip, f AS idx, (i // {width})::INT AS y, (i % {width})::INT AS x,
         (CASE WHEN (i % {width} - 25 - f) * (i % {width} - 25 - f) + (i // {width} - 30) * (i // {width} - 30) < 300 THEN 255 ELSE (i * 7 + f * 13) % 5 END)::INT AS v
  FROM (SELECT unnest(range({frames})) AS f), (SELECT unnest(range({width * height})) AS i))"""
