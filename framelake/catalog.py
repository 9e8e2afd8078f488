"""The queries over the driver's tables and their SQL.

A query is an operator applied to a lens (``plans.lenses``); its SQL says the
same for DuckDB, written on its own.  Means and other quotients are rounded to
six places on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions import codec, scalars
from framelake.operators import components, edge, follower, kernels, metrics, plane, relational, sequence
from framelake.plans import lenses, session, track
from framelake.sources import matte_store, scenes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PX = f"WITH {lenses.PLANES_SQL}"
SEQ = f"WITH {lenses.SEQUENCES_SQL}"
DISC = f"WITH {lenses.disc_sql()}"


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with flags (purchase: manual keyframe 1, error: low confidence 2) and a confidence of 0 .. .999."""
    flags = F.when(F.col("kind") == "purchase", 1).when(F.col("kind") == "error", 2).otherwise(0)
    conf = (F.col("event_id") * 37 % 1000) / 1000
    return lenses.sequences(spark, sf_dir).withColumn("flags", flags).withColumn("confidence", conf)


FRAMES = SEQ + """, fr AS (
  SELECT *, CASE kind WHEN 'purchase' THEN 1 WHEN 'error' THEN 2 ELSE 0 END AS flags, (event_id * 37 % 1000) / 1000.0::DOUBLE AS confidence FROM seq)"""


# ---- metrics ------------------------------------------------------------------


@query(PX + " SELECT clip, idx, (count(*) FILTER (v > 0))::BIGINT AS area FROM px GROUP BY ALL")
def frame_area(spark, sf_dir):
    return metrics.area(lenses.planes(spark, sf_dir))


@query(PX + """ SELECT clip, idx, min(x) FILTER (v > 0) AS x0, min(y) FILTER (v > 0) AS y0, (max(x) FILTER (v > 0) + 1)::INT AS x1,
  (max(y) FILTER (v > 0) + 1)::INT AS y1 FROM px GROUP BY ALL""")
def frame_bbox(spark, sf_dir):
    return metrics.bounding_box(lenses.planes(spark, sf_dir))


@query(PX + " SELECT clip, idx, round(avg(x) FILTER (v > 0), 6) AS cx, round(avg(y) FILTER (v > 0), 6) AS cy FROM px GROUP BY ALL")
def frame_centroid(spark, sf_dir):
    return metrics.centroid(lenses.planes(spark, sf_dir))


BEFORE = ", bf AS (SELECT *, lag(v) OVER (PARTITION BY clip, y, x ORDER BY idx) AS before FROM px)"


@query(PX + BEFORE + """ SELECT clip, idx, round(coalesce((count(*) FILTER (v > 0 AND before > 0))::DOUBLE / nullif(count(*) FILTER (v > 0 OR before > 0), 0), 1), 6) AS iou
  FROM bf WHERE before IS NOT NULL GROUP BY ALL""")
def frame_iou(spark, sf_dir):
    """From whole planes; ``metrics.consecutive_iou`` is its pixel form."""
    return track.report(lenses.plane_blobs(spark, sf_dir)).filter("iou IS NOT NULL").select("clip", "idx", "iou")


def _plane_pairs(spark, sf_dir) -> DataFrame:
    """Whole masks p (v > 0) and g (v > 20); ``metrics`` has the pixel forms of what is done with them."""
    mask = lambda least: F.transform("plane", lambda v: (v > least).cast("int"))
    return lenses.plane_blobs(spark, sf_dir).select("clip", "idx", "w", mask(0).alias("p"), mask(20).alias("g"))


def _square_sql(source: str, column: str, name: str, r: int, f: str) -> str:
    """CTEs ``<name>_r`` and ``<name>``: the source's rows with a column ``name`` of the square's f of ``column``."""
    return f""", {name}_r AS (SELECT *, {f}({column}) OVER (PARTITION BY clip, idx, y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {name}_t FROM {source}),
{name}_c AS (SELECT *, {f}({name}_t) OVER (PARTITION BY clip, idx, x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS {name} FROM {name}_r)"""


MASKS = ", masks AS (SELECT clip, idx, y, x, (v > 0)::INT AS p, (v > 20)::INT AS g FROM px)"
EDGES = (
    MASKS + _square_sql("masks", "p", "pi", 1, "min") + _square_sql("pi_c", "g", "gi", 1, "min")
    + ", edges AS (SELECT clip, idx, y, x, p, g, (p = 1 AND pi = 0)::INT AS pe, (g = 1 AND gi = 0)::INT AS ge FROM gi_c)"
    + _square_sql("edges", "pe", "pn", 1, "max") + _square_sql("pn_c", "ge", "gn", 1, "max")
    + """, rates AS (SELECT clip, idx, sum(pe * gn)::DOUBLE / greatest(sum(pe), 1) AS pr, sum(ge * pn)::DOUBLE / greatest(sum(ge), 1) AS rc FROM gn_c GROUP BY ALL),
bound AS (SELECT clip, idx, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f FROM rates)"""
)


@query(PX + EDGES + " SELECT clip, idx, round(f, 6) AS f FROM bound")
def frame_boundary_f(spark, sf_dir):
    return six(metrics.plane_quality(_plane_pairs(spark, sf_dir), 1).select("clip", "idx", "f"), "f")


FLICKER = """, moved AS (SELECT clip, idx, abs(p - lag(p) OVER w) AS dp, abs(g - lag(g) OVER w) AS dg FROM masks WINDOW w AS (PARTITION BY clip, y, x ORDER BY idx)),
flick AS (SELECT clip, coalesce(avg(greatest(dp - dg, 0)) FILTER (dp IS NOT NULL), 0)::DOUBLE AS flicker FROM (SELECT clip, idx, avg(dp) AS dp, avg(dg) AS dg FROM moved GROUP BY ALL) GROUP BY ALL)"""


@query(PX + MASKS + FLICKER + " SELECT clip, round(flicker, 6) AS flicker FROM flick")
def clip_flicker(spark, sf_dir):
    return six(metrics.plane_flicker(_plane_pairs(spark, sf_dir)), "flicker")


JUMPS = """, areas AS (SELECT clip, idx, count(*) FILTER (v > 0) + 1 AS a FROM px GROUP BY ALL),
jumps AS (SELECT clip, coalesce(max(abs(a - b)::DOUBLE / b), 0)::DOUBLE AS max_jump FROM (SELECT *, lag(a) OVER (PARTITION BY clip ORDER BY idx) AS b FROM areas) GROUP BY ALL)"""


@query(PX + JUMPS + " SELECT clip, round(max_jump, 6) AS max_jump FROM jumps")
def clip_area_jump(spark, sf_dir):
    return six(metrics.area_jump(lenses.planes(spark, sf_dir)), "max_jump")


@query(PX + EDGES + FLICKER + JUMPS + """, ious AS (SELECT clip, idx, coalesce(sum(p * g)::DOUBLE / nullif(sum(greatest(p, g)), 0), 1) AS iou FROM masks GROUP BY ALL)
  SELECT clip, round(avg(iou), 6) AS iou_mean, round(min(iou), 6) AS iou_min, round(avg(f), 6) AS f_mean, round(any_value(flicker), 6) AS flicker, round(any_value(max_jump), 6) AS max_jump
  FROM ious JOIN bound USING (clip, idx) JOIN flick USING (clip) JOIN jumps USING (clip) GROUP BY clip""")
def clip_summary(spark, sf_dir):
    return six(metrics.plane_summary(_plane_pairs(spark, sf_dir), 1), "iou_mean", "iou_min", "f_mean", "flicker", "max_jump")


def _coloured(spark, sf_dir) -> DataFrame:
    """Planes with a bin 0 .. 511 made of the value and the place."""
    channel = lambda k: F.abs(F.col("v") * k + F.col("x") * 11 + F.col("y") * 13) % 256
    return lenses.planes(spark, sf_dir).withColumn("bin", metrics.colour_bin(channel(1), channel(3), channel(7)))


COLOURED = """, col AS (SELECT *, (((abs(v + x * 11 + y * 13) % 256) >> 5) * 8 + ((abs(v * 3 + x * 11 + y * 13) % 256) >> 5)) * 8 + ((abs(v * 7 + x * 11 + y * 13) % 256) >> 5) AS bin FROM px)"""


@query(PX + COLOURED + " SELECT clip, idx, bin::INT AS bin, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY clip, idx), 6) AS share FROM col GROUP BY clip, idx, bin")
def colour_hist(spark, sf_dir):
    return six(metrics.histogram(_coloured(spark, sf_dir), F.col("bin")), "share")


def _model(spark, sf_dir) -> DataFrame:
    """Foreground and background share of each bin of a clip, and its likelihood."""
    px = _coloured(spark, sf_dir)
    inside = (F.col("v") > 0).cast("long")
    counts = px.groupBy("clip", "bin").agg(F.sum(inside).alias("f"), F.sum(1 - inside).alias("b"))
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(Window.partitionBy("clip")), F.lit(1))
    return counts.select("clip", "bin", share("f").alias("fg"), share("b").alias("bg")).withColumn("lik", metrics.likelihood(F.col("fg"), F.col("bg")))


MODEL = COLOURED + """, cnt AS (SELECT clip, bin, count(*) FILTER (v > 0) AS f, count(*) FILTER (NOT v > 0) AS b FROM col GROUP BY ALL),
shr AS (SELECT clip, bin, f::DOUBLE / greatest(sum(f) OVER (PARTITION BY clip), 1) AS fg, b::DOUBLE / greatest(sum(b) OVER (PARTITION BY clip), 1) AS bg FROM cnt),
lik AS (SELECT *, (fg + 1e-4::DOUBLE) / (fg + bg + 2e-4::DOUBLE) AS lik FROM shr)"""


@query(PX + MODEL + " SELECT clip, bin::INT AS bin, round(fg, 6) AS fg, round(bg, 6) AS bg, round(lik, 6) AS lik FROM lik")
def colour_likelihood(spark, sf_dir):
    return six(_model(spark, sf_dir), "fg", "bg", "lik")


@query(PX + MODEL + " SELECT clip, idx, round(coalesce(avg((lik < 0.5)::INT) FILTER (v > 0), 0), 6) AS leak FROM col JOIN lik USING (clip, bin) GROUP BY ALL")
def leak_fraction(spark, sf_dir):
    model = _model(spark, sf_dir).select("clip", "bin", "lik")
    px = _coloured(spark, sf_dir).join(model, ["clip", "bin"]).withColumn("m", (F.col("v") > 0).cast("int"))
    return six(metrics.leak_fraction(px, 0.5), "leak")


def _along_sql(source: str, name: str, axis: str, taps: dict[int, float], border: str) -> str:
    """A CTE ``name``: the source's ``a`` folded with the taps along an axis of 8, the border repeated (edge) or mirrored."""
    at = f"p.{axis} + o.d"
    at = f"least(greatest({at}, 0), 7)" if border == "edge" else f"(CASE WHEN {at} < 0 THEN -({at}) WHEN {at} > 7 THEN 14 - ({at}) ELSE {at} END)"
    other = "y" if axis == "x" else "x"
    values = ", ".join(f"({d}, {w!r}::DOUBLE)" for d, w in taps.items())
    return f""", {name} AS (SELECT p.clip, p.idx, p.y, p.x, sum(q.a * o.w) AS a FROM {source} p CROSS JOIN (VALUES {values}) o(d, w)
      JOIN {source} q ON q.clip = p.clip AND q.idx = p.idx AND q.{other} = p.{other} AND q.{axis} = {at} GROUP BY p.clip, p.idx, p.y, p.x)"""


def _gaussian_sql(source: str, name: str, sigma: float) -> str:
    r = max(1, int(4 * sigma + 0.5))
    weights = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)}
    taps = {d: w / sum(weights.values()) for d, w in weights.items()}
    return _along_sql(source, f"{name}_y", "y", taps, "mirror") + _along_sql(f"{name}_y", name, "x", taps, "mirror")


def _boxes_sql(source: str, name: str, sigma: float) -> str:
    out = ""
    for k, r in enumerate(kernels.gauss_boxes(sigma)):
        taps = dict.fromkeys(range(-r, r + 1), 1 / (2 * r + 1))
        out += _along_sql(source, f"{name}_{k}y", "y", taps, "edge") + _along_sql(f"{name}_{k}y", f"{name}_{k}", "x", taps, "edge")
        source = f"{name}_{k}"
    return out + f", {name} AS (SELECT * FROM {source})"


UNIT = ", unit AS (SELECT clip, idx, y, x, v / 255.0::DOUBLE AS a FROM px)"
TOTALS = " SELECT clip, idx, round(sum(a), 4) AS total, round(sum(a * (y * 8 + x)), 4) AS weighted FROM {} GROUP BY clip, idx"


def _totals(spark, sf_dir, kernel) -> DataFrame:
    out = metrics.plane_totals(lenses.plane_blobs(spark, sf_dir), kernel)
    return out.select("clip", "idx", F.round("total", 4).alias("total"), F.round("weighted", 4).alias("weighted"))


@query(PX + UNIT + _gaussian_sql("unit", "g", 1.5) + TOTALS.format("g"))
def gaussian(spark, sf_dir):
    return _totals(spark, sf_dir, lambda a: kernels.true_gaussian(a / 255, 1.5))


@query(PX + UNIT + _boxes_sql("unit", "g", 1.2) + TOTALS.format("g"))
def box_gaussian(spark, sf_dir):
    return _totals(spark, sf_dir, lambda a: kernels.gaussian(a / 255, 1.2))


@query(PX + UNIT + _boxes_sql("unit", "g", 0.8) + ", s AS (SELECT u.clip, u.idx, u.y, u.x, 0.85::DOUBLE * greatest(0, least(1, (g.a - 0.5::DOUBLE) * 2.5::DOUBLE + 0.5::DOUBLE)) + 0.15::DOUBLE * u.a AS a FROM unit u JOIN g USING (clip, idx, y, x))"
       + _boxes_sql("s", "f", 0.6) + TOTALS.format("f"))
def smooth_feather(spark, sf_dir):
    """The edge stages smooth, then feather."""
    return _totals(spark, sf_dir, lambda a: kernels.feather(kernels.smooth(a / 255, 0.8), 0.6))


@query(PX + """, off AS (SELECT clip, idx, y, x FROM px WHERE v <= 0),
  d AS (SELECT p.clip, p.idx, p.y, p.x, CASE WHEN any_value(p.v) > 0 THEN min(sqrt((p.y - o.y) * (p.y - o.y) + (p.x - o.x) * (p.x - o.x))) ELSE 0 END AS a FROM px p JOIN off o ON o.clip = p.clip AND o.idx = p.idx GROUP BY p.clip, p.idx, p.y, p.x)"""
       + TOTALS.format("d"))
def distance(spark, sf_dir):
    """Distances to the nearest pixel outside the mask, of frames that have one."""
    some = lenses.plane_blobs(spark, sf_dir).filter(F.exists("plane", lambda v: v <= 0))
    out = metrics.plane_totals(some, lambda a: kernels.distance(a > 0))
    return out.select("clip", "idx", F.round("total", 4).alias("total"), F.round("weighted", 4).alias("weighted"))


@query(PX + MODEL + ", unit AS (SELECT clip, idx, y, x, lik AS a FROM col JOIN lik USING (clip, bin))" + _gaussian_sql("unit", "g", 1.5)
       + " SELECT clip, idx, round(coalesce(avg((g.a < 0.5)::INT) FILTER (v > 0), 0), 6) AS leak FROM px JOIN g USING (clip, idx, y, x) GROUP BY clip, idx")
def leak_blurred(spark, sf_dir):
    """The tracker's leak fraction: the likelihood is blurred before it is held against the threshold."""
    px = _coloured(spark, sf_dir).join(_model(spark, sf_dir).select("clip", "bin", "lik"), ["clip", "bin"])
    cells = F.array_sort(F.collect_list(F.struct("y", "x", "lik", (F.col("v") > 0).cast("int").alias("m"))))
    frames = px.groupBy("clip", "idx").agg(cells.alias("c")).select("clip", "idx", F.lit(lenses.SIDE).alias("w"), F.col("c.lik").alias("lik"), F.col("c.m").alias("m"))
    return six(metrics.plane_leak(frames, 0.5), "leak")


def _box_sql(source: str, expression: str, name: str, r: int) -> str:
    """A CTE ``name`` (clip, idx, y, x, a): box means of an expression over the source's columns."""
    taps = dict.fromkeys(range(-r, r + 1), 1 / (2 * r + 1))
    start = f", {name}_s AS (SELECT clip, idx, y, x, {expression} AS a FROM {source})"
    return start + _along_sql(f"{name}_s", f"{name}_y", "y", taps, "edge") + _along_sql(f"{name}_y", name, "x", taps, "edge")


def _fusion_sql(source: str, name: str, r: int) -> str:
    """A step of blur fusion of the source's im, al, f and b: the same with new f and b."""
    means = _box_sql(source, "al", f"{name}_w", r) + _box_sql(source, "f * al", f"{name}_f", r) + _box_sql(source, "b * (1 - al)", f"{name}_b", r)
    near = f"SELECT u.clip, u.idx, u.y, u.x, u.im, u.al, f.a / (w.a + 1e-5::DOUBLE) AS nf, b.a / (1 - w.a + 1e-5::DOUBLE) AS nb FROM {source} u JOIN {name}_w w USING (clip, idx, y, x) JOIN {name}_f f USING (clip, idx, y, x) JOIN {name}_b b USING (clip, idx, y, x)"
    return means + f", {name} AS (SELECT clip, idx, y, x, im, al, nf + al * (im - al * nf - (1 - al) * nb) AS f, nb AS b FROM ({near}))"


@query(PX + ", u0 AS (SELECT *, im AS f, im AS b FROM (SELECT clip, idx, y, x, ((x * 7 + y * 3) % 11) / 10.0::DOUBLE AS im, least(greatest(v / 255.0::DOUBLE, 0), 1) AS al FROM px))" + _fusion_sql("u0", "u1", 6)
       + ", u2 AS (SELECT clip, idx, y, x, im, al, greatest(f, 0) AS f, b FROM u1)" + _fusion_sql("u2", "u3", 2)
       + ", done AS (SELECT clip, idx, y, x, im + 0.8::DOUBLE * (greatest(f, 0) - im) AS a FROM u3)" + TOTALS.format("done"))
def decontaminated(spark, sf_dir):
    """Edge colours by two steps of blur fusion; three equal channels, of which one is summed."""

    def one(a: np.ndarray) -> np.ndarray:
        y, x = np.indices(a.shape)
        image = np.repeat(((x * 7 + y * 3) % 11 / 10)[..., None], 3, axis=2)
        return kernels.decontaminate(image, kernels.clamp01(a / 255), kernels.EdgeParams(decontaminate=0.8, spill=0.0))[..., 0]

    return _totals(spark, sf_dir, one)


@query(PX + ", msk AS (SELECT clip, idx, y, x, (v > 127)::INT AS m FROM px)" + _square_sql("msk", "m", "mi", 1, "min") + _square_sql("mi_c", "m", "mn", 2, "max") + _square_sql("mn_c", "m", "mf", 4, "max")
       + """, n AS (SELECT clip, idx, sum(mi) AS inner_n, sum(mf * (1 - mn)) AS ring_n FROM mf_c GROUP BY ALL),
  r AS (SELECT clip, idx, y, x, CASE WHEN inner_n >= 5 THEN mi ELSE m END + 2 * CASE WHEN ring_n >= 5 THEN mf * (1 - mn) ELSE 1 - mn END AS a FROM mf_c JOIN n USING (clip, idx))""" + TOTALS.format("r"))  # fmt: skip
def colour_regions(spark, sf_dir):
    """Where the tracker learns the subject's colours (1) and its surroundings' (2)."""

    def parts(a: np.ndarray) -> np.ndarray:
        subject, ring = follower.Colours.regions((a > 127).astype(float), 5)
        return subject + 2.0 * ring

    return _totals(spark, sf_dir, parts)


def _le(n: str, size: int) -> str:
    return f"printf('{'%02x' * size}', {', '.join(f'(({n}) // {256**k}) % 256' for k in range(size))})"


@query(PX + f""", u AS (SELECT clip, idx, y, x, greatest(0, least(255, v)) AS v FROM px),
  marked AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM u WINDOW w AS (PARTITION BY clip, idx ORDER BY y, x)),
  run AS (SELECT *, sum(new) OVER (PARTITION BY clip, idx ORDER BY y, x) AS run FROM marked),
  runs AS (SELECT clip, idx, run, any_value(v)::BIGINT AS value, count(*)::BIGINT AS length FROM run GROUP BY clip, idx, run),
  payload AS (SELECT clip, idx, flatten(list([value, length % 256, length // 256] ORDER BY run)) AS b FROM runs GROUP BY clip, idx),
  summed AS (SELECT clip, idx, b, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
      lambda c, v: list_reduce(list_prepend(xor(c, v), range(8)), lambda k, i: CASE WHEN k % 2 = 1 THEN xor(k // 2, 3988292384::BIGINT) ELSE k // 2 END))) AS crc FROM payload)
  SELECT clip, idx, '41434d31' || {_le('8', 4)} || {_le('8', 4)} || {_le('crc', 4)} || {_le('idx % 5', 1)} || {_le('round_even(idx % 11 / 10.0::DOUBLE * 255, 0)::BIGINT', 1)} || '0000' || {_le('len(b)', 4)}
      || list_aggregate(list_transform(b, lambda v: printf('%02x', v)), 'string_agg', '') AS record, round(round_even(idx % 11 / 10.0::DOUBLE * 255, 0) / 255, 6) AS confidence, idx % 5 AS flags,
    (SELECT sum(v) FROM u WHERE u.clip = s.clip AND u.idx = s.idx)::BIGINT AS total FROM summed s""")
def matte_records(spark, sf_dir):
    """Planes packed as records, in hexadecimal, and what comes out of them."""
    byte = F.transform("plane", lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("long")), 2, "0"))
    mattes = lenses.plane_blobs(spark, sf_dir).select(
        "clip", "idx", "w", F.lit(lenses.SIDE).alias("h"), F.unhex(F.array_join(byte, "")).alias("alpha"), (F.col("idx") % 11 / 10).alias("confidence"), (F.col("idx") % 5).cast("int").alias("flags"))
    records = codec.packed(mattes)
    read = codec.unpacked(records).withColumn("bytes", F.regexp_extract_all(F.hex("alpha"), F.lit("(..)")))
    total = F.aggregate("bytes", F.lit(0).cast("long"), lambda a, b: a + F.conv(b, 16, 10).cast("long"))
    out = records.join(read.select("clip", "idx", "confidence", F.col("flags").cast("long").alias("flags"), total.alias("total")), ["clip", "idx"])
    return six(out.withColumn("record", F.lower(F.hex("record"))), "confidence")


@query(PX + """, t AS (SELECT clip, idx, greatest(least(v, 255), 0) / 255.0::DOUBLE AS a, x / 7.0::DOUBLE AS r, y / 7.0::DOUBLE AS g, 0.25::DOUBLE AS b FROM px),
  w AS (SELECT *, CASE WHEN a > 0.02 AND a < 0.98 THEN a * (1 - a) ELSE 0 END AS w FROM t),
  m AS (SELECT clip, idx, sum(w * r) / nullif(sum(w), 0) AS r, sum(w * g) / nullif(sum(w), 0) AS g, sum(w * b) / nullif(sum(w), 0) AS b FROM w GROUP BY ALL)
  SELECT clip, idx, round(r, 6) AS tint_r, round(g, 6) AS tint_g, round(b, 6) AS tint_b,
    CASE WHEN greatest(r, g, b) - (r + g + b - greatest(r, g, b)) / 2 > 0.06 THEN CASE greatest(r, g, b) WHEN r THEN 'r' WHEN g THEN 'g' ELSE 'b' END END AS key FROM m""")
def spill_tint(spark, sf_dir):
    px = lenses.planes(spark, sf_dir)
    px = px.withColumns({"a": F.greatest(F.least("v", F.lit(255)), F.lit(0)) / 255.0, "r": F.col("x") / 7.0, "g": F.col("y") / 7.0, "b": F.lit(0.25)})
    return six(metrics.spill_tint(px), "tint_r", "tint_g", "tint_b")


# ---- components ---------------------------------------------------------------

COMPONENTS = """WITH RECURSIVE """ + lenses.PLANES_SQL + """,
on_px AS (SELECT clip, idx, y, x, y * 8 + x AS n FROM px WHERE v > 0),
reach(clip, idx, seed, y, x) AS (
  SELECT clip, idx, n, y, x FROM on_px UNION
  SELECT r.clip, r.idx, r.seed, o.y, o.x FROM reach r JOIN on_px o ON r.clip = o.clip AND r.idx = o.idx AND abs(r.y - o.y) <= 1 AND abs(r.x - o.x) <= 1),
lab AS (SELECT clip, idx, y, x, min(seed) AS label FROM reach GROUP BY ALL),
comp AS (SELECT clip, idx, label, count(*) AS area, min(x) AS "left", min(y) AS top, (max(x) - min(x) + 1)::INT AS width, (max(y) - min(y) + 1)::INT AS height FROM lab GROUP BY clip, idx, label)"""


def _masks(spark, sf_dir) -> DataFrame:
    """Whole masks of the planes."""
    mask = F.transform("plane", lambda v: (v > 0).cast("int"))
    return lenses.plane_blobs(spark, sf_dir).select("clip", "idx", "w", mask.alias("m"))


@query(COMPONENTS + """ SELECT clip, idx, label::INT AS label, area, "left", top, width, height FROM comp""")
def component_stats(spark, sf_dir):
    return components.of_planes(_masks(spark, sf_dir)).select("clip", "idx", "label", "area", "left", "top", "width", "height")


@query(COMPONENTS + """, ref AS (SELECT clip, idx, count(*) AS ref_area FROM px WHERE v > 0 GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY clip, idx ORDER BY area DESC, label)::INT AS rank FROM comp JOIN ref USING (clip, idx))
  SELECT clip, idx, label::INT AS label, area, rank FROM ranked WHERE rank <= 3 AND area >= 0.25 * ref_area""")
def top3_components(spark, sf_dir):
    ref = metrics.area(lenses.planes(spark, sf_dir)).withColumnRenamed("area", "ref_area")
    return relational.top_components(component_stats(spark, sf_dir).join(ref, ["clip", "idx"])).select("clip", "idx", "label", "area", "rank")


@query(COMPONENTS + """, prev AS (SELECT clip, idx, y, x, lag((v > 0)::INT) OVER (PARTITION BY clip, y, x ORDER BY idx) AS s FROM px),
  held AS (SELECT clip, idx, label, avg(coalesce(s, 0)) AS held FROM lab JOIN prev USING (clip, idx, y, x) GROUP BY ALL)
  SELECT clip, idx, label::INT AS label, area, round(held, 6) AS held, area >= 0.2 * max(area) OVER (PARTITION BY clip, idx) OR held > 0.5 AS kept FROM comp JOIN held USING (clip, idx, label)""")
def islands(spark, sf_dir):
    before = F.lag("m").over(Window.partitionBy("clip").orderBy("idx"))
    found = components.of_planes(_masks(spark, sf_dir).withColumn("support", before), 0.2)
    return six(found.select("clip", "idx", "label", "area", "held", "kept"), "held")


# ---- codec, names -------------------------------------------------------------


@query(PX + """, marked AS (SELECT *, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS new FROM px WINDOW w AS (PARTITION BY clip, idx ORDER BY y, x)),
  run AS (SELECT *, sum(new) OVER (PARTITION BY clip, idx ORDER BY y, x) AS run FROM marked)
  SELECT clip, idx, (run - 1)::INT AS seq, any_value(v) AS value, count(*)::INT AS length FROM run GROUP BY clip, idx, run""")
def rle_runs(spark, sf_dir):
    return codec.runs(lenses.planes(spark, sf_dir))


@query(DISC + " SELECT clip, idx, count(*) AS n, sum(v)::BIGINT AS total, sum(v * (y * 80 + x))::BIGINT AS weighted FROM px GROUP BY ALL")
def rle_roundtrip(spark, sf_dir):
    """Runs cut at 100 pixels, expanded again."""
    px = codec.expand(codec.runs(lenses.disc(spark), 100), 80)
    return px.groupBy("clip", "idx").agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"), F.sum(F.col("v") * (F.col("y") * 80 + F.col("x"))).cast("long").alias("weighted"))


@query("SELECT doc_id, substr(sha256('lang=''' || lang || '''|n_chars=' || n_chars || '|source=''' || source || ''''), 1, 8) AS hash FROM documents")
def settings_hash(spark, sf_dir):
    quoted = lambda c: F.concat(F.lit("'"), F.col(c), F.lit("'"))
    docs = _table(spark, sf_dir, "documents")
    settings = F.create_map(F.lit("source"), quoted("source"), F.lit("n_chars"), F.col("n_chars").cast("string"), F.lit("lang"), quoted("lang"))
    return docs.select("doc_id", scalars.settings_hash(settings).alias("hash"))


@query("SELECT doc_id, source || '-' || lang || '-' || regexp_replace(lang || '/m ' || source || '@1.0+b', '[^A-Za-z0-9._-]', '_', 'g') AS name FROM documents")
def set_name(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", scalars.set_name(F.col("source"), F.col("lang"), F.concat("lang", F.lit("/m "), "source"), F.lit("1.0+b")).alias("name"))


@query("SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k') AS INT), -1) AS k, coalesce(TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.none') AS INT), 0) AS none FROM events")
def sidecar_json(spark, sf_dir):
    """Fields of a JSON sidecar, defaults where it is missing or broken."""
    read = F.from_json("props", "k int, none int")
    return _table(spark, sf_dir, "events").select("event_id", F.coalesce(read["k"], F.lit(-1)).alias("k"), F.coalesce(read["none"], F.lit(0)).alias("none"))


STORE_SQL = """WITH files AS (
    SELECT event_id, 'file:/store/' || event_type || '/' || CASE WHEN event_id % 2 = 0 THEN 'masks/' ELSE '' END || lpad((event_id % 500)::VARCHAR, 6, '0') || CASE WHEN event_id % 7 = 0 THEN '.tmp' WHEN event_id % 11 = 0 THEN 'x.acm' ELSE '.acm' END AS path FROM events),
  listed AS (SELECT event_id, split_part(path, '/', 3) AS "set", TRY_CAST(regexp_extract(path, '/([0-9]+)[.]acm$', 1) AS INT) AS idx FROM files WHERE regexp_matches(path, '/[0-9]+[.]acm$'))"""


def _store_files(spark, sf_dir):
    """Events as the listing of a store with sets, some of whose names are no records."""
    end = F.when(F.col("event_id") % 7 == 0, ".tmp").when(F.col("event_id") % 11 == 0, "x.acm").otherwise(".acm")
    folder = F.when(F.col("event_id") % 2 == 0, "masks/").otherwise("")
    name = F.lpad((F.col("event_id") % 500).cast("string"), 6, "0")
    return _table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("file:/store/"), "event_type", F.lit("/"), folder, name, end).alias("path"))


@query(STORE_SQL + ' SELECT event_id, "set", idx FROM listed')
def store_listing(spark, sf_dir):
    """Set and frame number of what is a record by its name."""
    return matte_store.listed(_store_files(spark, sf_dir)).select("event_id", "set", "idx")


@query(STORE_SQL + """, wanted AS (SELECT DISTINCT event_type AS "set", (event_id * 3 % 600)::INT AS idx FROM events)
  SELECT w."set", w.idx, EXISTS (SELECT 1 FROM listed l WHERE l."set" = w."set" AND l.idx = w.idx) AS found FROM wanted w""")
def store_has(spark, sf_dir):
    wanted = _table(spark, sf_dir, "events").select(F.col("event_type").alias("set"), (F.col("event_id") * 3 % 600).cast("int").alias("idx")).distinct()
    return matte_store.has(_store_files(spark, sf_dir), wanted).select("set", "idx", "found")


@query("SELECT event_id, round(least(greatest(0.299::DOUBLE * (event_id % 256) / 255 + 0.587::DOUBLE * (event_id * 7 % 300) / 255 + 0.114::DOUBLE * (event_id * 13 % 256) / 255, 0), 1), 6) AS luma FROM events")
def luma(spark, sf_dir):
    r, g, b = (F.col("event_id") * k % most / 255 for k, most in ((1, 256), (7, 300), (13, 256)))
    return six(_table(spark, sf_dir, "events").select("event_id", edge.luma(r, g, b).alias("luma")), "luma")


@query("SELECT event_id, CASE WHEN length((event_id * 997)::VARCHAR) >= 6 THEN (event_id * 997)::VARCHAR ELSE lpad((event_id * 997)::VARCHAR, 6, '0') END AS name, greatest(0, least(99, event_id - 50)) AS clamped FROM events")
def frame_names(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", scalars.frame_name(F.col("event_id") * 997).alias("name"), scalars.clamped_index(F.col("event_id") - 50, F.lit(100)).alias("clamped"))


@query("""WITH s AS (SELECT event_id, event_id % 4000 + 1 AS w, event_id % 2200 + 1 AS h FROM events), k AS (SELECT *, least(1.0::DOUBLE, 512.0::DOUBLE / greatest(w, h)) AS f FROM s)
  SELECT event_id, greatest(2, round_even(w * f / 2, 0) * 2)::INT AS pw, greatest(2, round_even(h * f / 2, 0) * 2)::INT AS ph FROM k""")
def proxy_size(spark, sf_dir):
    w, h = scalars.proxy_size(F.col("event_id") % 4000 + 1, F.col("event_id") % 2200 + 1, 512)
    return _table(spark, sf_dir, "events").select("event_id", w.alias("pw"), h.alias("ph"))


@query("""WITH s AS (SELECT event_id, (event_id % 1201 - 100) / 1000.0::DOUBLE AS a FROM events)
  SELECT event_id, trunc(least(greatest(a * 255 + 0.5, 0), 255))::INT AS q8, trunc(least(greatest(a * 255, 0), 255))::INT AS preview, trunc(least(greatest(a * 65535 + 0.5, 0), 65535))::INT AS q16 FROM s""")
def quantise(spark, sf_dir):
    a = (F.col("event_id") % 1201 - 100) / 1000.0
    return _table(spark, sf_dir, "events").select("event_id", scalars.quantise8(a).alias("q8"), scalars.quantise8_preview(a).alias("preview"), scalars.quantise16(a).alias("q16"))


@query("""SELECT event_id, round(1 / (1 + exp(-least(greatest(value / 50, -30), 30))), 6) AS sigmoid, round((value / 100 * 2 - 1) * 6, 6) AS logit, round((value - 0.485::DOUBLE * 255) / (0.229::DOUBLE * 255), 6) AS normal,
  round(sqrt(value * value + (event_id % 7) * (event_id % 7)), 6) AS magnitude FROM events""")
def scalar_curves(spark, sf_dir):
    v = F.col("value")
    out = _table(spark, sf_dir, "events").select("event_id", scalars.sigmoid(v / 50).alias("sigmoid"), scalars.mask_to_logit(v / 100).alias("logit"), scalars.normalise(v, 0.485, 0.229).alias("normal"), scalars.magnitude(v, F.col("event_id") % 7).alias("magnitude"))
    return six(out, "sigmoid", "logit", "normal", "magnitude")


@query(PX + """, bx AS (SELECT clip, idx, min(x)::DOUBLE AS x0, min(y)::DOUBLE AS y0, max(x) + 1.0::DOUBLE AS x1, max(y) + 1.0::DOUBLE AS y1 FROM px WHERE v > 0 GROUP BY ALL)
  SELECT clip, idx, round(greatest(0, x0 - (x1 - x0) * 0.04::DOUBLE), 6) AS x0, round(greatest(0, y0 - (y1 - y0) * 0.04::DOUBLE), 6) AS y0, round(least(8, x1 + (x1 - x0) * 0.04::DOUBLE), 6) AS x1, round(least(8, y1 + (y1 - y0) * 0.04::DOUBLE), 6) AS y1 FROM bx""")
def prompt_box(spark, sf_dir):
    box = metrics.bounding_box(lenses.planes(spark, sf_dir)).filter("x0 IS NOT NULL")
    grown = scalars.expand_box({c: F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")}, 0.04, F.lit(8.0), F.lit(8.0))
    return six(box.select("clip", "idx", *(v.alias(c) for c, v in grown.items())), "x0", "y0", "x1", "y1")


# ---- joins and picks ----------------------------------------------------------


@query(FRAMES + " SELECT clip, idx FROM fr WHERE flags & 2 <> 0")
def low_conf_frames(spark, sf_dir):
    return relational.low_confidence(_frames(spark, sf_dir)).select("clip", "idx")


KEYS = FRAMES + ", k AS (SELECT clip, idx FROM fr WHERE flags = 1), pr AS (SELECT clip, idx AS a, lead(idx) OVER (PARTITION BY clip ORDER BY idx) AS b FROM k)"


def _keys(spark, sf_dir) -> DataFrame:
    return _frames(spark, sf_dir).filter("flags = 1").select("clip", "idx")


@query(KEYS + " SELECT clip, a, b FROM pr WHERE b - a > 1")
def keyframe_pairs(spark, sf_dir):
    return relational.keyframe_pairs(_keys(spark, sf_dir))


JOBS = KEYS + """, ends AS (SELECT clip, min(k.idx) AS first, max(k.idx) AS last, any_value(n) AS n FROM k JOIN (SELECT clip, count(*)::INT AS n FROM fr GROUP BY ALL) USING (clip) GROUP BY clip),
jobs AS (SELECT clip, 'between' AS kind, a, b FROM pr WHERE b - a > 1 UNION ALL SELECT clip, 'forward', last, (n - 1)::INT FROM ends WHERE last < n - 1 UNION ALL SELECT clip, 'backward', first, 0 FROM ends WHERE first > 0)"""


def _jobs(spark, sf_dir) -> DataFrame:
    lengths = _frames(spark, sf_dir).groupBy("clip").agg(F.count("*").cast("int").alias("frames"))
    return relational.track_jobs(_keys(spark, sf_dir), lengths)


@query(JOBS + " SELECT * FROM jobs")
def track_jobs(spark, sf_dir):
    return _jobs(spark, sf_dir)


@query(JOBS + " SELECT j.* FROM jobs j WHERE EXISTS (SELECT 1 FROM k WHERE k.clip = j.clip AND k.idx % 5 = 0 AND k.idx IN (j.a, j.b))")
def stale_jobs(spark, sf_dir):
    return relational.stale_jobs(_jobs(spark, sf_dir), _keys(spark, sf_dir).filter("idx % 5 = 0"))


@query(FRAMES + """ SELECT clip, idx, max(CASE WHEN flags = 1 THEN idx END) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS key_left,
  min(CASE WHEN flags = 1 THEN idx END) OVER (PARTITION BY clip ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS key_right FROM fr""")
def keyframe_asof(spark, sf_dir):
    return relational.nearest_keys(_frames(spark, sf_dir), F.col("flags") == 1).select("clip", "idx", "key_left", "key_right")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_keyframes(spark, sf_dir):
    return relational.without(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", "source")


@query(FRAMES + """, rg AS (SELECT clip, min(idx) AS lo, max(idx) AS hi FROM fr GROUP BY ALL), st AS (SELECT clip, idx FROM fr WHERE flags <> 2), a AS (SELECT clip, lo, hi, unnest(range(lo, hi + 1)) AS idx FROM rg)
  SELECT clip, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (s.idx IS NULL) AS missing FROM a LEFT JOIN st s USING (clip, idx) GROUP BY clip""")
def coverage_gap(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    ranges = frames.groupBy("clip").agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    return relational.missing_frames(ranges, frames.filter("flags <> 2").select("clip", "idx"))


TRACKED = FRAMES + """, ln AS (SELECT clip, 0 AS a, max(idx) + 1 AS b FROM fr GROUP BY clip),
fw AS (SELECT clip, idx, a, b, value, confidence AS conf, flags = 2 AS low, event_id % 11 = 0 AS lost FROM fr JOIN ln USING (clip) WHERE event_id % 5 <> 0),
bw AS (SELECT clip, idx, a, b, value / 2 AS value, 1 - confidence AS conf, flags <> 0 AS low, event_id % 3 = 0 AS lost FROM fr JOIN ln USING (clip) WHERE event_id % 7 <> 0),
bl AS (SELECT coalesce(f.clip, g.clip) AS clip, coalesce(f.idx, g.idx) AS idx, f.value AS fv, g.value AS gv, f.conf AS fc, g.conf AS gc, f.low AS fl, g.low AS gl, f.lost AS fo, g.lost AS go,
  (coalesce(f.b, g.b) - coalesce(f.idx, g.idx))::DOUBLE / (coalesce(f.b, g.b) - coalesce(f.a, g.a)) * greatest(f.conf, 0.05::DOUBLE) AS wf,
  (coalesce(f.idx, g.idx) - coalesce(f.a, g.a))::DOUBLE / (coalesce(f.b, g.b) - coalesce(f.a, g.a)) * greatest(g.conf, 0.05::DOUBLE) AS wg
  FROM fw f FULL JOIN bw g ON f.clip = g.clip AND f.idx = g.idx)"""


@query(TRACKED + """ SELECT clip, idx, round(CASE WHEN fv IS NULL THEN gv WHEN gv IS NULL THEN fv ELSE (wf * fv + wg * gv) / (wf + wg) END, 6) AS value,
  round(CASE WHEN fc IS NULL THEN gc WHEN gc IS NULL THEN fc ELSE (wf * fc + wg * gc) / (wf + wg) END, 6) AS conf, coalesce(fl, true) AND coalesce(gl, true) AS low, coalesce(fo, true) AND coalesce(go, true) AS lost FROM bl""")
def fwd_bwd_blend(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    ends = frames.groupBy("clip").agg((F.max("idx") + 1).alias("b"))
    frames = frames.join(ends, "clip").withColumn("a", F.lit(0))
    forward = frames.filter("event_id % 5 <> 0").select("clip", "idx", "a", "b", "value", F.col("confidence").alias("conf"), (F.col("flags") == 2).alias("low"), (F.col("event_id") % 11 == 0).alias("lost"))
    backward = frames.filter("event_id % 7 <> 0").select("clip", "idx", "a", "b", (F.col("value") / 2).alias("value"), (1 - F.col("confidence")).alias("conf"), (F.col("flags") != 0).alias("low"), (F.col("event_id") % 3 == 0).alias("lost"))
    return six(relational.blend(forward, backward), "value", "conf")


@query(FRAMES + " SELECT f.clip, f.idx, coalesce(round(r.confidence, 3), -1)::DOUBLE AS confidence, coalesce(r.flags, 0)::INT AS flags FROM fr f LEFT JOIN (SELECT * FROM fr WHERE event_id % 3 <> 0) r USING (clip, idx)")
def timeline(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    return relational.timeline(frames.select("clip", "idx"), frames.filter("event_id % 3 <> 0").select("clip", "idx", "confidence", "flags"))


@query("SELECT source AS clip, count(l.doc_id) AS rendered, (count(*) - count(l.doc_id))::BIGINT AS skipped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def render_join(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select(F.col("source").alias("clip"), F.col("doc_id").alias("idx"))
    mattes = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("source").alias("clip"), F.col("doc_id").alias("idx"))
    return relational.render_counts(docs, mattes)


@query(FRAMES + ", t AS (SELECT clip, idx + 0.5::DOUBLE AS t FROM fr) SELECT t.clip, t.t, f.idx, f.event_id FROM t JOIN fr f ON f.clip = t.clip AND f.idx = (round(t.t) - 3 + 1)::INT")
def frame_offset(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    times = frames.select("clip", (F.col("idx") + 0.5).alias("t"))
    return relational.at_offset(times, frames.select("clip", "idx", "event_id"), 3, 1).select("clip", "t", "idx", "event_id")


@query(FRAMES + ", c AS (SELECT clip, kind, event_id, 0.5::DOUBLE * confidence + 0.5::DOUBLE * ((event_id * 7 % 100) / 100.0::DOUBLE) AS score FROM fr) SELECT clip, kind, event_id, round(score, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY clip, kind ORDER BY score DESC, event_id) = 1")
def argmax_candidate(spark, sf_dir):
    score = 0.5 * F.col("confidence") + 0.5 * ((F.col("event_id") * 7 % 100) / 100.0)
    rows = _frames(spark, sf_dir).select("clip", "kind", "event_id", score.alias("score"))
    return six(relational.best(rows, ["clip", "kind"], F.col("score"), "event_id"), "score")


@query(FRAMES + """, c AS (SELECT clip, event_id, confidence AS conf, (event_id * 13 % 100) / 400.0::DOUBLE AS leak, (event_id * 11 % 200) / 100.0::DOUBLE AS ratio FROM fr)
  SELECT clip, event_id, conf, leak FROM c WHERE conf >= 0.72 AND leak < 0.15 AND ratio BETWEEN 0.5 AND 1.7 QUALIFY row_number() OVER (PARTITION BY clip ORDER BY conf - leak DESC, event_id) = 1""")
def reacquire_pick(spark, sf_dir):
    e = F.col("event_id")
    rows = _frames(spark, sf_dir).select("clip", "event_id", F.col("confidence").alias("conf"), ((e * 13 % 100) / 400.0).alias("leak"), ((e * 11 % 200) / 100.0).alias("ratio"))
    return relational.reacquire(rows, ["clip"], "event_id").select("clip", "event_id", "conf", "leak")


@query(FRAMES + """, m AS (SELECT * FROM fr WHERE event_id % 3 > 0)
  SELECT f.clip, count(*) AS frames, (SELECT count(*) FROM m WHERE m.clip = f.clip) AS cached, coalesce(string_agg(f.idx::VARCHAR, ',' ORDER BY f.idx) FILTER (f.flags = 1), '') AS keyframes,
    coalesce(string_agg(f.idx::VARCHAR, ',' ORDER BY f.idx) FILTER (f.flags = 2 AND f.event_id % 3 > 0), '') AS low_confidence FROM fr f GROUP BY f.clip""")
def session_status(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    found = session.status(frames, frames.filter("flags = 1"), frames.filter("event_id % 3 > 0"))
    text = lambda c: F.array_join(F.transform(c, lambda i: i.cast("string")), ",").alias(c)
    return found.select("clip", "frames", "cached", text("keyframes"), text("low_confidence"))


@query(FRAMES + """, gone AS (SELECT DISTINCT clip FROM fr WHERE event_id % 50 = 0), made AS (SELECT clip, idx, value + 1 AS value FROM fr WHERE event_id % 4 = 0)
  SELECT f.clip, f.idx, coalesce(made.value, f.value) AS value, CASE WHEN made.clip IS NULL THEN f.flags ELSE 1 END AS flags FROM fr f LEFT JOIN made ON made.clip = f.clip AND made.idx = f.idx
  WHERE f.clip NOT IN (SELECT clip FROM gone)""")
def session_commit(spark, sf_dir):
    """Every fourth frame committed by hand, then some clips reset."""
    frames = _frames(spark, sf_dir)
    keys = frames.filter("flags = 1").select("clip", "idx", F.lit("manual").alias("kind"))
    made = frames.filter("event_id % 4 = 0").select("clip", "idx", (F.col("value") + 1).alias("value"))
    keys, mattes = session.commit(keys, frames.select("clip", "idx", "value", "flags"), made, manual=True)
    return session.reset(keys, mattes, frames.filter("event_id % 50 = 0").select("clip").distinct())[1]


@query(FRAMES + """, w AS (SELECT clip, idx, flags = 1 AS manual, 1 AS version, value FROM fr UNION ALL SELECT clip, idx, false, 2, value + 1 FROM fr WHERE idx % 2 = 0)
  SELECT clip, idx, manual, version, value FROM w QUALIFY row_number() OVER (PARTITION BY clip, idx ORDER BY manual DESC, version DESC) = 1""")
def upsert_precedence(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    old = frames.select("clip", "idx", (F.col("flags") == 1).alias("manual"), F.lit(1).alias("version"), "value")
    new = frames.filter("idx % 2 = 0").select("clip", "idx", F.lit(False).alias("manual"), F.lit(2).alias("version"), (F.col("value") + 1).alias("value"))
    return relational.upsert(old, new)


@query("""WITH t AS (SELECT doc_id, lang, n_chars, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 ELSE 3 END AS preference, source FROM documents)
  SELECT source, lang, doc_id FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY preference, doc_id) = 1""")
def model_pick(spark, sf_dir):
    """The first installed in the order of preference."""
    preference = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "de", 2).otherwise(3)
    rows = _table(spark, sf_dir, "documents").select("source", "lang", "doc_id", preference.alias("preference"))
    return relational.best(rows, ["source"], -F.col("preference"), "doc_id").select("source", "lang", "doc_id")


@query("""WITH t AS (SELECT user_id AS clip, event_id, event_id % 40 + 10 AS w, event_id % 70 + 20 AS h, (event_id * 7 % 20) / 10.0::DOUBLE AS weight FROM events)
  SELECT clip, event_id, round(w * h * greatest(weight, 0.1::DOUBLE), 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY clip ORDER BY w * h * greatest(weight, 0.1::DOUBLE) DESC, event_id) = 1""")
def detector_pick(spark, sf_dir):
    e = F.col("event_id")
    found = _table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "event_id", (e % 40 + 10).alias("w"), (e % 70 + 20).alias("h"), ((e * 7 % 20) / 10.0).alias("weight"))
    picked = relational.detector_pick(found, ["clip"], "event_id")
    return picked.select("clip", "event_id", F.round(F.col("w") * F.col("h") * F.greatest("weight", F.lit(0.1)), 6).alias("score"))


@query("SELECT user_id AS clip, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_id * 2654435761 + 12345) % 4294967296, event_id) <= 20")
def sampled(spark, sf_dir):
    """A sampling operator: 20 rows a clip."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "event_id")
    return relational.sample_without_replacement(rows, ["clip"], F.col("event_id"), 20)


@query("""WITH b AS (SELECT event_id, (event_id % 50)::DOUBLE AS x0, (event_id % 30)::DOUBLE AS y0, (event_id % 50 + event_id % 17 + 4)::DOUBLE AS x1, (event_id % 30 + event_id % 23 + 4)::DOUBLE AS y1 FROM events)
  SELECT event_id, round(x0 + 0.08::DOUBLE * (x1 - x0), 6) AS person_x0, round(y1 - 0.04::DOUBLE * (y1 - y0), 6) AS person_y1, round(y0 - 0.30::DOUBLE * (y1 - y0), 6) AS head_y0, round(x1 + 0.15::DOUBLE * (x1 - x0), 6) AS head_x1 FROM b""")
def detector_boxes(spark, sf_dir):
    e = F.col("event_id")
    box = {"x0": e % 50, "y0": e % 30, "x1": e % 50 + e % 17 + 4, "y1": e % 30 + e % 23 + 4}
    box = {k: v.cast("double") for k, v in box.items()}
    person, head = scalars.person_box(box), scalars.head_box(box)
    out = _table(spark, sf_dir, "events").select("event_id", person["x0"].alias("person_x0"), person["y1"].alias("person_y1"), head["y0"].alias("head_y0"), head["x1"].alias("head_x1"))
    return six(out, "person_x0", "person_y1", "head_y0", "head_x1")


@query("SELECT event_id, round((event_id % 100) / 100.0::DOUBLE * 640, 6) AS x, round((event_id % 90) / 90.0::DOUBLE * 360, 6) AS y, CASE WHEN event_id % 3 = 0 THEN 1 ELSE (event_id % 2)::INT END AS label FROM events")
def prompt_points(spark, sf_dir):
    e = F.col("event_id")
    label = F.when(e % 3 != 0, (e % 2).cast("int"))
    points = F.array(F.struct((e % 100 / 100.0).alias("x"), (e % 90 / 90.0).alias("y"), label.alias("label")))
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(scalars.to_pixels(points, F.lit(640), F.lit(360))).alias("p"))
    return six(rows.select("event_id", "p.x", "p.y", "p.label"), "x", "y")


@query("""WITH m AS (SELECT event_id, 1 + (event_id % 5) / 10.0::DOUBLE AS a, (event_id % 7) / 10.0::DOUBLE AS b, 1 - (event_id % 3) / 2.0::DOUBLE AS d, value AS x, value / 2 AS y FROM events)
  SELECT event_id, round(a * x + b * y + 3, 6) AS px, round(-b * x + d * y - 1, 6) AS py, round(CASE WHEN a * d + b * b > 0.3 AND a * d + b * b < 3 THEN a * d + b * b ELSE 1 END, 6) AS det FROM m""")
def affine_points(spark, sf_dir):
    e = F.col("event_id")
    b = e % 7 / 10.0
    model = {"a": 1 + e % 5 / 10.0, "b": b, "tx": F.lit(3.0), "c": -b, "d": 1 - e % 3 / 2.0, "ty": F.lit(-1.0)}
    px, py = scalars.affine(model, F.col("value"), F.col("value") / 2)
    return six(_table(spark, sf_dir, "events").select("event_id", px.alias("px"), py.alias("py"), scalars.determinant(model).alias("det")), "px", "py", "det")


@query("SELECT event_id, CASE WHEN event_id % 50 > 0 THEN round(value / (event_id % 50) * (100 - event_id % 50), 6) END AS eta FROM events")
def progress_eta(spark, sf_dir):
    done = F.col("event_id") % 50
    return six(_table(spark, sf_dir, "events").select("event_id", scalars.eta(F.col("value"), done, F.lit(100)).alias("eta")), "eta")


@query(PX + """, f AS (SELECT clip, idx, count(*) FILTER (v > 0) AS area FROM px GROUP BY ALL), s AS (SELECT clip, round(avg(area), 6) AS mean_area, count(*) AS frames FROM f GROUP BY ALL) SELECT * FROM s""")
def bench_means(spark, sf_dir):
    """Mean over a clip's frames, the frames counted."""
    out = metrics.area(lenses.planes(spark, sf_dir)).groupBy("clip").agg(F.avg("area").alias("mean_area"), F.count("*").alias("frames"))
    return six(out, "mean_area")


# ---- sequences ----------------------------------------------------------------


@query(SEQ + """, p AS (SELECT clip, idx, value AS cx, value * 0.5 + idx AS cy FROM seq)
  SELECT clip, idx, round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (last_value(cx) OVER w - first_value(cx) OVER w) / (count(*) OVER w - 1) END, 6) AS vx,
  round(CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (last_value(cy) OVER w - first_value(cy) OVER w) / (count(*) OVER w - 1) END, 6) AS vy FROM p WINDOW w AS (PARTITION BY clip ORDER BY idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def velocity(spark, sf_dir):
    points = lenses.sequences(spark, sf_dir).select("clip", "idx", F.col("value").alias("cx"), (F.col("value") * 0.5 + F.col("idx")).alias("cy"))
    return six(sequence.velocity(points).select("clip", "idx", "vx", "vy"), "vx", "vy")


@query(FRAMES + """, i AS (SELECT *, sum((flags <> 2)::INT) OVER (PARTITION BY clip ORDER BY idx) AS island FROM fr)
  SELECT clip, idx, (sum(CASE WHEN flags <> 2 THEN 0 ELSE 1 END) OVER (PARTITION BY clip, island ORDER BY idx))::INT AS streak FROM i""")
def streaks(spark, sf_dir):
    return sequence.streaks(_frames(spark, sf_dir), F.col("flags") != 2).select("clip", "idx", "streak")


@query(SEQ + " SELECT clip, round(list_reduce(list(value ORDER BY idx), lambda a, x: a * (1 - 0.08::DOUBLE) + x * 0.08::DOUBLE), 6) AS ewma FROM seq GROUP BY clip")
def ewma_hist(spark, sf_dir):
    return six(sequence.ewma(lenses.sequences(spark, sf_dir), "value"), "ewma")


# ---- planes -------------------------------------------------------------------


def _pad_sum_sql(r: int) -> str:
    near = lambda c: f"greatest(0, least(7, {c}))"
    return f"""SELECT a.clip, a.idx, a.y, a.x, sum(b.v)::BIGINT AS s FROM px a, (SELECT unnest(range({-r}, {r + 1})) AS dy) d, (SELECT unnest(range({-r}, {r + 1})) AS dx) e, px b
  WHERE b.clip = a.clip AND b.idx = a.idx AND b.y = {near('a.y + d.dy')} AND b.x = {near('a.x + e.dx')} GROUP BY ALL"""


def _dealt(spark, sf_dir) -> DataFrame:
    return plane.by_frame(lenses.planes(spark, sf_dir))


@query(PX + " " + _pad_sum_sql(1))
def box_blur(spark, sf_dir):
    """The box's sum, an integer; ``plane.box_blur`` divides it."""
    return plane.box_sum(_dealt(spark, sf_dir), "v", "s", 1).select("clip", "idx", "y", "x", F.col("s").cast("long").alias("s"))


@query(PX + _square_sql("px", "v", "d", 1, "max") + " SELECT clip, idx, y, x, d FROM d_c")
def dilate_square(spark, sf_dir):
    return plane.dilate(_dealt(spark, sf_dir), "v", "d", 3).select("clip", "idx", "y", "x", "d")


@query(PX + _square_sql("px", "v", "e", 1, "min") + _square_sql("e_c", "e", "o", 1, "max") + _square_sql("o_c", "o", "f", 1, "max") + _square_sql("f_c", "f", "c", 1, "min") + " SELECT clip, idx, y, x, o AS opened, c AS closed FROM c_c")
def open_close(spark, sf_dir):
    """Opened, and the opened closed."""
    px = plane.closed(plane.opened(_dealt(spark, sf_dir), "v", "opened", 3), "opened", "closed", 3)
    return px.select("clip", "idx", "y", "x", "opened", "closed")


def _octagon_sql(source: str, column: str, name: str, radius: int) -> str:
    """Greatest over the offsets that a square of .4142 r and cross steps reach."""
    a = int(0.4142 * radius + 0.5)
    b = radius - a
    offsets = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if max(0, abs(dy) - a) + max(0, abs(dx) - a) <= b]
    values = ", ".join(f"({dy}, {dx})" for dy, dx in offsets)
    return f""", {name}_o AS (SELECT s.clip, s.idx, s.y, s.x, max(n.{column}) AS {name} FROM {source} s, (VALUES {values}) o(dy, dx), {source} n
  WHERE n.clip = s.clip AND n.idx = s.idx AND n.y = s.y + o.dy AND n.x = s.x + o.dx GROUP BY ALL)"""


@query(PX + _octagon_sql("px", "v", "d", 3) + " SELECT clip, idx, y, x, d FROM d_o")
def dilate_octagon(spark, sf_dir):
    return plane.dilate_octagon(_dealt(spark, sf_dir), "v", "d", 3).select("clip", "idx", "y", "x", "d")


@query(DISC + ", inv AS (SELECT clip, idx, y, x, 255 - v AS v FROM px)" + _octagon_sql("inv", "v", "d", 2) + " SELECT clip, idx, y, x, (255 - d)::INT AS d FROM d_o")
def edge_shift(spark, sf_dir):
    px = plane.edge_shift(plane.by_frame(lenses.disc(spark)), "v", "d", -2.0)
    return px.select("clip", "idx", "y", "x", F.col("d").cast("int").alias("d"))


@query(PX + " SELECT clip, idx, (y // 4)::INT AS y, (x // 4)::INT AS x, round(avg(v), 6) AS v FROM px GROUP BY ALL")
def downsample(spark, sf_dir):
    return six(plane.downsample(lenses.planes(spark, sf_dir), "v", 4), "v")


def _bilinear_sql(grid: str, fy: str, fx: str, clamp: bool) -> str:
    near = (lambda c: f"greatest(0, least(7, {c}))") if clamp else (lambda c: c)
    return f""", spots AS ({grid}), pos AS (SELECT clip, idx, y, x, {fy} AS fy, {fx} AS fx FROM spots), cell AS (SELECT *, floor(fy)::INT AS y0, floor(fx)::INT AS x0 FROM pos),
corner AS (SELECT clip, idx, y, x, y0 + dy AS sy, x0 + dx AS sx, CASE dy WHEN 0 THEN 1 - (fy - y0) ELSE fy - y0 END * CASE dx WHEN 0 THEN 1 - (fx - x0) ELSE fx - x0 END AS w FROM cell, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
SELECT c.clip, c.idx, c.y, c.x, round(sum(coalesce(p.v, 0) * w), 6) AS v FROM corner c LEFT JOIN px p ON p.clip = c.clip AND p.idx = c.idx AND p.y = {near('c.sy')} AND p.x = {near('c.sx')} GROUP BY ALL"""


@query(PX + _bilinear_sql("SELECT clip, idx, (y * 2 + dy)::INT AS y, (x * 2 + dx)::INT AS x FROM px, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx)", "(y + 0.5::DOUBLE) / 2 - 0.5::DOUBLE", "(x + 0.5::DOUBLE) / 2 - 0.5::DOUBLE", True))
def upsample(spark, sf_dir):
    """From whole planes; ``plane.upsample`` is its pixel form."""
    return six(metrics.plane_pixels(lenses.plane_blobs(spark, sf_dir), lambda a: kernels.upsample(a, 2, 2 * a.shape[0], 2 * a.shape[1]), "v"), "v")


@query(PX + _bilinear_sql("SELECT clip, idx, y, x FROM px", "y - 0.25::DOUBLE", "x + 0.5::DOUBLE", False))
def warp(spark, sf_dir):
    return six(plane.warp(lenses.planes(spark, sf_dir), "v", F.lit(0.5), F.lit(-0.25)), "v")


def _means_sql(source: str, columns: dict[str, str], name: str) -> str:
    near = lambda c: f"greatest(0, least(7, {c}))"
    sums = ", ".join(f"sum(b.{c}) / 9.0::DOUBLE AS {n}" for c, n in columns.items())
    return f""", {name} AS (SELECT a.clip, a.idx, a.y, a.x, {sums} FROM {source} a, (SELECT unnest(range(-1, 2)) AS dy) d, (SELECT unnest(range(-1, 2)) AS dx) e, {source} b
  WHERE b.clip = a.clip AND b.idx = a.idx AND b.y = {near('a.y + d.dy')} AND b.x = {near('a.x + e.dx')} GROUP BY ALL)"""


@query(PX + ", pl AS (SELECT clip, idx, y, x, v / 255.0::DOUBLE AS p, ((x * 7 + y * 3) % 11) / 10.0::DOUBLE AS g FROM px), sq AS (SELECT *, g * p AS gp, g * g AS gg FROM pl)"
       + _means_sql("sq", {"g": "mg", "p": "mp", "gp": "mgp", "gg": "mgg"}, "mean")
       + ", ab AS (SELECT clip, idx, y, x, (mgp - mg * mp) / (mgg - mg * mg + 0.01::DOUBLE) AS a, mp - (mgp - mg * mp) / (mgg - mg * mg + 0.01::DOUBLE) * mg AS b FROM mean)"
       + _means_sql("ab", {"a": "ma", "b": "mb"}, "coef") + " SELECT clip, idx, y, x, round(ma * g + mb, 4) + 0 AS q FROM coef JOIN pl USING (clip, idx, y, x)")
def guided(spark, sf_dir):
    """From whole planes; ``plane.guided`` is its pixel form."""

    def filtered(a: np.ndarray) -> np.ndarray:
        y, x = np.indices(a.shape)
        return kernels.guided((x * 7 + y * 3) % 11 / 10, a / 255, 1, 0.01)

    px = metrics.plane_pixels(lenses.plane_blobs(spark, sf_dir), filtered, "q")
    return px.withColumn("q", F.round("q", 4) + F.lit(0.0))


@query(DISC + """, bx AS (SELECT clip, idx, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE v > 2 GROUP BY ALL), m AS (SELECT 0.012::DOUBLE * 160 * 2 + 8 + 3 AS around)
  SELECT clip, idx, greatest(0, floor(x0 * 2 - around))::INT AS x0, greatest(0, floor(y0 * 2 - around))::INT AS y0, least(160, ceil((x1 + 1) * 2 + around))::INT AS x1, least(120, ceil((y1 + 1) * 2 + around))::INT AS y1 FROM bx, m""")
def roi(spark, sf_dir):
    return edge.roi(lenses.disc(spark), 160, 120, 80, 60, edge.margin(160, shift=3.0))


@query(PX + " SELECT clip, idx, y, x, round(least(greatest((v / 255.0::DOUBLE - 0.03::DOUBLE) / (0.97::DOUBLE - 0.03::DOUBLE), 0), 1), 6) AS a FROM px")
def levels(spark, sf_dir):
    return lenses.planes(spark, sf_dir).select("clip", "idx", "y", "x", F.round(edge.levels(F.col("v") / 255.0), 6).alias("a"))


def _channels() -> tuple[dict, object]:
    return {"r": F.col("x") / 80.0, "g": F.col("y") / 60.0, "b": F.lit(0.5)}, F.col("v") / 255.0


@query(DISC + """, s AS (SELECT *, v / 255.0::DOUBLE AS a, x / 80.0::DOUBLE AS r, y / 60.0::DOUBLE AS g, CASE WHEN (x // 8 + y // 8) % 2 = 1 THEN 0.62::DOUBLE ELSE 0.38::DOUBLE END AS c FROM px)
  SELECT clip, idx, y, x, round(r * a, 6) AS cutout_r, round(r * (1 - a * 0.55::DOUBLE) + a * 0.55::DOUBLE, 6) AS overlay_r, round(g * (1 - a * 0.55::DOUBLE) + 0.1::DOUBLE * (a * 0.55::DOUBLE), 6) AS overlay_g,
  round(r * a + c * (1 - a), 6) AS checker_r, round(0.5::DOUBLE * a + 0.6::DOUBLE * (1 - a), 6) AS solid_b, round(a, 6) AS mask FROM s""")
def composite_modes(spark, sf_dir):
    colour, a = _channels()
    made = lambda mode, **k: edge.output(mode, colour, a, a, F.lit(1.0), **k)
    cell = edge.checker(F.col("x"), F.col("y"), 8)
    out = {
        "cutout_r": made("cutout", premultiply=True)["r"], "overlay_r": made("overlay")["r"], "overlay_g": made("overlay")["g"],
        "checker_r": made("checkerboard", background=dict.fromkeys("rgb", cell))["r"], "solid_b": made("composite", background={"r": F.lit(0.0), "g": F.lit(0.0), "b": F.lit(0.6)})["b"], "mask": made("mask")["r"],
    }
    return lenses.disc(spark).select("clip", "idx", "y", "x", *(F.round(c, 6).alias(n) for n, c in out.items()))


@query("SELECT doc_id, round(n_chars / 1000.0::DOUBLE, 6) AS r, CASE WHEN quality IS NULL THEN 1.0::DOUBLE ELSE quality::DOUBLE END AS a FROM documents LEFT JOIN labels USING (doc_id)")
def passthrough(spark, sf_dir):
    """Frames without a matte pass with alpha 1."""
    rows = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    v, a = F.col("n_chars") / 1000.0, F.col("quality").cast("double")
    out = edge.output("cutout", dict.fromkeys("rgb", v), a, a, F.lit(0.5))
    return rows.select("doc_id", F.round(out["r"], 6).alias("r"), out["a"].alias("a"))


@query("""WITH g AS (SELECT unnest(range(4800)) AS i) SELECT (i // 80)::INT AS y, (i % 80)::INT AS x, ((i * 1103515245 + 12345) % 2147483648 % 64)::INT AS texture,
  round(least(greatest((20 - sqrt((i % 80 - 40) * (i % 80 - 40) + (i // 80 - 30) * (i // 80 - 30))) / 3 + 0.5::DOUBLE, 0), 1), 6) AS soft FROM g""")
def scene(spark, sf_dir):
    """A hashed texture and a disc with a soft edge."""
    px = lenses.grid(spark, 1, 80, 60)
    texture = (F.col("i").cast("long") * 1103515245 + 12345) % 2147483648 % 64
    d = F.sqrt(F.pow(F.col("x") - 40, F.lit(2)) + F.pow(F.col("y") - 30, F.lit(2)))
    return px.select("y", "x", texture.cast("int").alias("texture"), F.round(edge.clamp((20 - d) / 3 + 0.5), 6).alias("soft"))


# ---- kernels over the blob lens ---------------------------------------------


@query()
def edge_pipeline(spark, sf_dir):
    """Alpha of the disc at twice its size, by the numpy pipeline; rows of a digest a frame."""
    return track.edge_frames(track.blobs(lenses.disc(spark), 80, 60), scale=2)


@query(scenes.SQL)
def scenarios(spark, sf_dir):
    """Area and mean value of each frame of the synthetic scenarios."""
    out = None
    for s in scenes.PIXEL_SCENARIOS:
        px = scenes.render(spark, s)
        one = px.groupBy("clip", "idx").agg(F.sum("m").alias("area"), F.round(F.avg("v"), 6).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def interior_points(spark, sf_dir):
    """Up to three points deep in the disc of each frame."""
    return track.points(track.blobs(lenses.disc(spark), 80, 60), 3)


@query("""WITH RECURSIVE """ + lenses.PLANES_SQL + """,
fr AS (SELECT clip, idx, row_number() OVER (PARTITION BY clip ORDER BY idx) AS k, list(greatest(least(v / 255.0::DOUBLE, 1), 0) ORDER BY y, x) AS a FROM px GROUP BY clip, idx),
st(clip, k, idx, s) AS (
  SELECT clip, k, idx, a FROM fr WHERE k = 1 UNION ALL
  SELECT clip, k, idx, list_transform(range(1, 65), lambda i: 0.6::DOUBLE * s[i] + 0.4::DOUBLE * (pull * s[i] + (1 - pull) * a[i])) FROM (
    SELECT *, CASE WHEN old <= 2 THEN 0 WHEN ratio > 1.45 THEN least(0.9, greatest(0.3, 1 - 1.45::DOUBLE / ratio)) WHEN ratio < 0.65 THEN least(0.9, greatest(0.3, 1 - greatest(ratio, 1e-3::DOUBLE) / 0.65::DOUBLE)) ELSE 0 END::DOUBLE AS pull FROM (
      SELECT f.clip, f.k, f.idx, f.a, st.s, len(list_filter(st.s, lambda x: x > 0.5)) AS old, len(list_filter(f.a, lambda x: x > 0.5))::DOUBLE / greatest(len(list_filter(st.s, lambda x: x > 0.5)), 1) AS ratio
      FROM st JOIN fr f ON f.clip = st.clip AND f.k = st.k + 1)))
SELECT clip, idx, len(list_filter(s, lambda x: x > 0.5)) AS area, round(list_sum(s), 6) AS total FROM st""")
def stabilized(spark, sf_dir):
    """The temporal stabilizer over each clip's planes."""
    return track.stabilized(track.blobs(lenses.planes(spark, sf_dir), 8, 8))


@query()
def tracked(spark, sf_dir):
    """The disc followed from its first frame by the likelihood engine."""
    return track.tracked(track.blobs(lenses.disc(spark, frames=12), 80, 60))


@query(PX + BEFORE + JUMPS.replace(", areas", ", areas0").replace("FROM areas)", "FROM areas0)") + """, per AS (
    SELECT clip, idx, count(*) FILTER (v > 0) AS area, min(x) FILTER (v > 0) AS x0, min(y) FILTER (v > 0) AS y0, (max(x) FILTER (v > 0) + 1)::INT AS x1, (max(y) FILTER (v > 0) + 1)::INT AS y1,
      round(avg(x) FILTER (v > 0), 6) AS cx, round(avg(y) FILTER (v > 0), 6) AS cy,
      round(CASE WHEN count(before) = 0 THEN NULL ELSE coalesce((count(*) FILTER (v > 0 AND before > 0))::DOUBLE / nullif(count(*) FILTER (v > 0 OR before > 0), 0), 1) END, 6) AS iou
    FROM bf GROUP BY clip, idx),
  rep AS (SELECT *, round(abs(area - lag(area) OVER w)::DOUBLE / (lag(area) OVER w + 1), 6) AS jump FROM per WINDOW w AS (PARTITION BY clip ORDER BY idx))
  SELECT *, coalesce(iou < 0.55, false) OR coalesce(jump > 0.3, false) AS low FROM rep""")
def track_report(spark, sf_dir):
    """Flagship: area, box, centroid, IoU with the frame before, area jump and a low-confidence flag for each frame."""
    return track.report(lenses.plane_blobs(spark, sf_dir))
