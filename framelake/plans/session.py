"""A tracking session as one plan: keyframes to jobs, jobs to tracks, tracks to mattes.

``run`` is the whole verb "track": it plans the jobs between, after and before
keyframes, follows the subject in each (those between keyframes from both ends),
blends what meets, and keeps manual keyframes.  With ``changed`` keyframes only the
jobs that end at one are run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import follower, models, relational
from framelake.plans import track

PASS = "clip int, idx long, a long, b long, kind string, value array<double>, conf double, low boolean, lost boolean"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.float64(), pa.bool_(), pa.bool_())


def plan(frames: DataFrame, keys: DataFrame, direction: str = "both", changed: DataFrame | None = None) -> DataFrame:
    """Jobs (clip, kind, a, b); a keyframe without a matte is an error."""
    lengths = frames.groupBy("clip").agg((F.max("idx") + 1).alias("frames"))
    missing = F.raise_error(F.concat(F.lit("keyframe without a matte: "), F.col("idx").cast("string")))
    checked = keys.withColumn("idx", F.when(F.col("alpha").isNull(), missing.cast("long")).otherwise(F.col("idx")))
    jobs = relational.track_jobs(checked.select("clip", "idx"), lengths, direction)
    return jobs if changed is None else relational.stale_jobs(jobs, changed)


def passes(jobs: DataFrame) -> DataFrame:
    """A row for each way a job is gone: (clip, kind, way, a, b, start, stop)."""
    ways = F.when(F.col("kind") == "between", F.array(F.lit(1), F.lit(-1))).when(F.col("kind") == "forward", F.array(F.lit(1))).otherwise(F.array(F.lit(-1)))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rows = jobs.select("clip", "kind", low.cast("long").alias("a"), high.cast("long").alias("b"), F.explode(ways).alias("way"))
    # a job between keyframes leaves both ends as they are
    inner = F.when(F.col("kind") == "between", 1).otherwise(0)
    start = F.when(F.col("way") == 1, F.col("a")).otherwise(F.col("b"))
    stop = F.when(F.col("way") == 1, F.col("b") - inner).otherwise(F.col("a") + inner)
    return rows.withColumn("start", start).withColumn("stop", stop)


def follow(frames: DataFrame, keys: DataFrame, jobs: DataFrame, params: follower.Params = follower.Params()) -> DataFrame:
    """The results of all passes (see PASS and ``way``), a group a pass; frames meet their passes by an equi-join on (clip, idx)."""
    asked = passes(jobs).withColumn("idx", F.explode(F.sequence(F.least("start", "stop"), F.greatest("start", "stop"))))
    rows = asked.join(frames.select("clip", "idx", "w", "h", "plane"), ["clip", "idx"]).join(keys.select("clip", F.col("idx").alias("start"), "alpha"), ["clip", "start"])

    def run(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("clip", "a", "b", "kind", "way", "w", "h")}
        alpha = table.column("alpha")[0].values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(first["h"], first["w"])
        # a pass against the clip's order sees its frames by their negated numbers
        turned = table.set_column(table.schema.get_field_index("idx"), "idx", pc.multiply(table.column("idx"), first["way"]))
        numbers, planes = track.in_order(turned)
        subject, out = follower.Follower(next(planes), alpha, params), []
        for number, image in zip(numbers[1:], planes, strict=True):
            got = subject.follow(image)
            out.append((first["clip"], number * first["way"], first["a"], first["b"], first["kind"], got.alpha.reshape(-1), got.confidence, got.low, got.lost))
        columns = list(zip(*out, strict=True)) or [()] * len(_TYPES)
        arrays = [pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
        return pa.table([*arrays, pa.array([first["way"]] * len(out), pa.int32())], names=[*(c.split()[0] for c in PASS.split(", ")), "way"])

    return rows.groupBy("clip", "a", "b", "kind", "way").applyInArrow(run, PASS + ", way int")


def merge(results: DataFrame) -> DataFrame:
    """(clip, idx, value, conf, low, lost): passes from both ends blended by distance and confidence."""
    columns = ["clip", "idx", "a", "b", "value", "conf", "low", "lost"]
    forward, backward = (results.filter(F.col("way") == w).select(*columns) for w in (1, -1))
    return relational.blend(forward, backward)


def run(frames: DataFrame, keys: DataFrame, direction: str = "both", changed: DataFrame | None = None, params: follower.Params = follower.Params()) -> DataFrame:
    """Mattes (clip, idx, alpha, confidence, flags) of all frames that jobs reach; keyframes stay as they are, flagged manual."""
    jobs = plan(frames, keys, direction, changed)
    tracked = merge(follow(frames, keys, jobs, params))
    new = relational.without(tracked, keys, ["clip", "idx"])
    made = new.select("clip", "idx", F.col("value").alias("alpha"), F.col("conf").alias("confidence"), F.when(F.col("low"), 2).otherwise(0).alias("flags"))
    manual = keys.select("clip", "idx", F.col("alpha").cast("array<double>").alias("alpha"), F.lit(1.0).alias("confidence"), F.lit(1).alias("flags"))
    return made.unionByName(manual)


# ---- verbs on keyframes and mattes --------------------------------------------


KEYFRAMES = "clip int, idx long, kind string"
MANUAL, LOW = 1, 2


def _written(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same frame."""
    return relational.without(old, new, ["clip", "idx"]).unionByName(new)


def commit(keys: DataFrame, mattes: DataFrame, made: DataFrame, manual: bool = False) -> tuple[DataFrame, DataFrame]:
    """(keyframes, mattes) after frames' mattes (clip, idx, w, h, alpha, confidence) became keyframes; the last write of a frame counts."""
    kind = made.select("clip", "idx", F.lit("manual" if manual else "ai").alias("kind"))
    rows = made.withColumn("flags", F.lit(MANUAL if manual else 0)).select(*mattes.columns)
    return _written(keys, kind), _written(mattes, rows)


def refine(frames: DataFrame, keys: DataFrame, mattes: DataFrame, clicks: DataFrame, make_engine: Callable[[], models.Engine]) -> tuple[DataFrame, DataFrame]:
    """(keyframes, mattes) after clicked frames (clip, idx, points, box) were segmented anew, guided by their mattes, as manual keyframes.

    A correction is sure at .9 at least.  A frame without a matte is segmented by its clicks alone.
    """
    guides = mattes.select("clip", "idx", F.col("alpha").alias("guide"))
    asked = frames.select("clip", "idx", "w", "h", "plane").join(clicks.select("clip", "idx", "points", "box"), ["clip", "idx"]).join(guides, ["clip", "idx"], "left")
    made = models.segment(asked, make_engine).withColumn("confidence", F.greatest("confidence", F.lit(0.9)))
    return commit(keys, mattes, made, manual=True)


def reset(keys: DataFrame, mattes: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyframes, mattes) without those of ``clips``."""
    return relational.without(keys, clips, ["clip"]), relational.without(mattes, clips, ["clip"])


def status(frames: DataFrame, keys: DataFrame, mattes: DataFrame) -> DataFrame:
    """Per clip with frames: how many, how many have a matte, the keyframes, and the frames of low confidence, in order.

    Lists are of keyframes and doubtful frames of one clip, as a person goes through them.
    """
    count = lambda df, name: df.groupBy("clip").agg(F.count_distinct("idx").alias(name))
    listed = lambda df, name: df.groupBy("clip").agg(F.array_sort(F.collect_set("idx")).alias(name))
    low = mattes.filter(F.col("flags").bitwiseAND(LOW) != 0)
    out = count(frames, "frames").join(count(mattes, "cached"), "clip", "left").join(listed(keys, "keyframes"), "clip", "left").join(listed(low, "low_confidence"), "clip", "left")
    none = F.array().cast(frames.select(F.array("idx").alias("a")).schema["a"].dataType)
    return out.withColumns({"cached": F.coalesce("cached", F.lit(0)), "keyframes": F.coalesce("keyframes", none), "low_confidence": F.coalesce("low_confidence", none)})


def signature(**settings) -> str:
    """What a track's results depend on; equal signatures and no missing frames mean there is nothing to do."""
    return hashlib.sha256(repr(sorted(settings.items())).encode()).hexdigest()[:16]
