"""The joins, neighbour look-ups and picks of a frame-sequence store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_CONFIDENCE = 2


def low_confidence(frames: DataFrame) -> DataFrame:
    """Frames whose flags have the low-confidence bit."""
    return frames.filter(F.col("flags").bitwiseAND(F.lit(LOW_CONFIDENCE)) != 0)


def keyframe_pairs(keys: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Neighbouring keyframes (a, b) of a clip with frames between them, that overlap [low, high]."""
    after = F.lead("idx").over(Window.partitionBy("clip").orderBy("idx"))
    pairs = keys.select("clip", F.col("idx").alias("a"), after.alias("b")).filter(F.col("b") - F.col("a") > 1)
    if low is not None:
        pairs = pairs.filter(F.col("b") >= low)
    if high is not None:
        pairs = pairs.filter(F.col("a") <= high)
    return pairs


def track_jobs(keys: DataFrame, lengths: DataFrame, direction: str = "both") -> DataFrame:
    """Jobs (clip, kind, a, b): between keyframes, after the last and before the first."""
    ends = keys.groupBy("clip").agg(F.min("idx").alias("first"), F.max("idx").alias("last")).join(lengths, "clip")
    jobs = keyframe_pairs(keys).select("clip", F.lit("between").alias("kind"), "a", "b")
    if direction in ("both", "forward"):
        tail = ends.filter(F.col("last") < F.col("frames") - 1)
        jobs = jobs.unionByName(tail.select("clip", F.lit("forward").alias("kind"), F.col("last").alias("a"), (F.col("frames") - 1).alias("b")))
    if direction in ("both", "backward"):
        head = ends.filter(F.col("first") > 0)
        jobs = jobs.unionByName(head.select("clip", F.lit("backward").alias("kind"), F.col("first").alias("a"), F.lit(0).alias("b")))
    return jobs


def nearest_keys(frames: DataFrame, is_key: Column) -> DataFrame:
    """Each frame with the nearest keyframe before (``key_left``) and after it (``key_right``)."""
    key = F.when(is_key, F.col("idx"))
    order = Window.partitionBy("clip").orderBy("idx")
    left = F.max(key).over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.min(key).over(order.rowsBetween(1, Window.unboundedFollowing))
    return frames.withColumn("key_left", left).withColumn("key_right", right)


def stale_jobs(jobs: DataFrame, changed: DataFrame) -> DataFrame:
    """Of the jobs only those that end at a changed keyframe; the others keep their frames."""
    at_end = changed.select(F.col("clip").alias("c"), F.col("idx").alias("k"))
    return jobs.join(at_end, (F.col("clip") == F.col("c")) & F.col("k").isin(F.col("a"), F.col("b")), "left_semi")


def without(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of ``left`` that have no match (keyframes without a matte, documents without a label)."""
    return left.join(right.select(*on).distinct(), on, "left_anti")


def missing_frames(ranges: DataFrame, stored: DataFrame) -> DataFrame:
    """How many frames of each range (clip, lo, hi) are not stored; 0 means all are."""
    asked = ranges.withColumn("idx", F.explode(F.sequence("lo", "hi")))
    gone = asked.join(stored.select("clip", "idx").distinct(), ["clip", "idx"], "left_anti").groupBy("clip").agg(F.count("*").alias("missing"))
    return ranges.join(gone, "clip", "left").withColumn("missing", F.coalesce("missing", F.lit(0)).cast("long"))


def blend(forward: DataFrame, backward: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Frames tracked from both ends: (clip, idx, value, conf, low, lost), weighted by distance and confidence.

    Inputs are (clip, idx, a, b, value, conf, low, lost) with the ends of the job.
    A value is a number or a plane as an array.  A frame that one side has is taken from it.
    """
    f, g = forward.alias("f"), backward.alias("g")
    both = f.join(g, [F.col("f.clip") == F.col("g.clip"), F.col("f.idx") == F.col("g.idx")], "full_outer")
    start, end, i = F.coalesce(f"f.{a}", f"g.{a}"), F.coalesce(f"f.{b}", f"g.{b}"), F.coalesce("f.idx", "g.idx")
    wf = (end - i) / (end - start) * F.greatest(F.col("f.conf"), F.lit(0.05))
    wg = (i - start) / (end - start) * F.greatest(F.col("g.conf"), F.lit(0.05))
    total = wf + wg
    planes = dict(forward.dtypes)["value"].startswith("array")

    def mixed(c: str) -> Column:
        x, y = F.col(f"f.{c}"), F.col(f"g.{c}")
        both_ways = F.zip_with(x, y, lambda p, q: (wf * p + wg * q) / total) if c == "value" and planes else (wf * x + wg * y) / total
        return F.when(F.col("f.idx").isNull(), y).when(F.col("g.idx").isNull(), x).otherwise(both_ways)

    flag = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(True)) & F.coalesce(F.col(f"g.{c}"), F.lit(True))
    return both.select(F.coalesce("f.clip", "g.clip").alias("clip"), i.alias("idx"), mixed("value").alias("value"), mixed("conf").alias("conf"), flag("low").alias("low"), flag("lost").alias("lost"))


def timeline(frames: DataFrame, results: DataFrame) -> DataFrame:
    """Each frame's confidence to three places, -1 where there is none, and its flags."""
    out = frames.join(results, ["clip", "idx"], "left")
    return out.select("clip", "idx", F.coalesce(F.round("confidence", 3), F.lit(-1.0)).alias("confidence"), F.coalesce("flags", F.lit(0)).alias("flags"))


def render_counts(frames: DataFrame, mattes: DataFrame) -> DataFrame:
    """Frames of each clip with a matte and without."""
    out = frames.join(mattes.select("clip", "idx", F.lit(1).alias("has")), ["clip", "idx"], "left")
    return out.groupBy("clip").agg(F.count("has").alias("rendered"), F.sum(F.col("has").isNull().cast("long")).alias("skipped"))


def at_offset(times: DataFrame, frames: DataFrame, first: int, offset: int) -> DataFrame:
    """Frames of a timeline's times: idx = round(t) - first + offset."""
    asked = times.withColumn("idx", (F.round("t") - first + offset).cast("int"))
    return asked.join(frames, ["clip", "idx"])


def top_components(components: DataFrame, n: int = 3, least: float = 0.25) -> DataFrame:
    """The n largest components of a frame (ties: lower label) of at least ``least`` of the reference area."""
    rank = F.row_number().over(Window.partitionBy("clip", "idx").orderBy(F.col("area").desc(), "label"))
    return components.withColumn("rank", rank).filter((F.col("rank") <= n) & (F.col("area") >= F.lit(least) * F.col("ref_area")))


def best(candidates: DataFrame, keys: list[str], score: Column, tie: str) -> DataFrame:
    """The candidate of the highest score; the first by ``tie`` wins."""
    order = Window.partitionBy(*keys).orderBy(score.desc(), tie)
    return candidates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def reacquire(candidates: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """The best candidate (conf, leak, ratio) that may be taken for the lost subject."""
    fit = (F.col("conf") >= 0.72) & (F.col("leak") < 0.15) & F.col("ratio").between(0.5, 1.7)
    return best(candidates.filter(fit), keys, F.col("conf") - F.col("leak"), tie)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Frames after a write: a manual keyframe stays, else the new one counts (clip, idx, manual, version, value)."""
    order = Window.partitionBy("clip", "idx").orderBy(F.col("manual").desc(), F.col("version").desc())
    return old.unionByName(new).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def detector_pick(found: DataFrame, keys: list[str], tie: str) -> DataFrame:
    """Of a people detector's boxes the one of the largest area times weight (at least .1)."""
    return best(found, keys, F.col("w") * F.col("h") * F.greatest("weight", F.lit(0.1)), tie)


def sample_without_replacement(rows: DataFrame, keys: list[str], number: Column, most: int) -> DataFrame:
    """At most ``most`` rows of each key, drawn by a modular hash of ``number``; a sampling operator, reruns agree."""
    hashed = (number * 2654435761 + 12345) % 4294967296
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(hashed, number))
    return rows.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")
