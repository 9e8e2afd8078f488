"""Mixing sources to target weights along a time-varying curriculum.

Every source has a target number of words and a weight schedule, piecewise
linear over training time 0 .. 1.  The schedule's integral, scaled to the target,
is the source's cumulative demand; a document's place in its source's shuffled
stream (an epoch after the other) is a cumulative number of words, and the
inverse of the demand there is its training position.  A range sort by position
interleaves the sources as their schedules ask.

The running sum inside a source is taken over hash buckets of a bounded number
of rows and then, level by level, over buckets of buckets: no source is one
task's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import runtime

#: Weights of the sources in code point order, repeating; null is last.
WEIGHTS = (3, 1, 2)
SHARE, MOST_EPOCHS = 1.5, 2.0
#: Weight schedules, as factors at equally spaced times, repeating like the weights.
SCHEDULES = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
BUCKET_ROWS, FAN_OUT = 512, 1024

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of words (runs of other than space and 09 to 0D); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(sized: DataFrame) -> DataFrame:
    """source, source_size and rank (0 for the first by code point, null last); a written table.

    Sources are counted and range-sorted like any rows, since there can be as many
    as host names; a rank is a partition's first one and the place in it.
    """
    order = F.col("source").asc_nulls_last()
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = runtime.stage(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33).alias("part")
    # a row a partition
    firsts = placed.groupBy(part).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranks = placed.withColumn("part", part).join(firsts, "part")
    return runtime.stage(ranks.select("source", "source_size", (F.col("first") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).alias("rank")), "source-ranks")


def targets(ranked: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """``ranked`` (see ranked_sources) with ``target``: ``share`` of all words by weight, none above ``most`` times its size, the excess shared anew.

    The words a unit of weight gets only grow while sources reach their limit, so
    each round is one aggregate over the sources: those above their limit at the
    rate so far, and the rate for the others.  Only sums come to the driver.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    limit = F.lit(float(most)) * F.col("source_size")
    weighed = ranked.withColumn("weight", weight)
    words, active = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    total = share * (words or 0)
    rate, n_over = (total / active if active else 0.0), 0
    while True:
        over = F.col("weight") * F.lit(rate) > limit
        n, capped, active = weighed.agg(F.count_if(over), F.sum(F.when(over, limit).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n == n_over or not active:
            break
        rate, n_over = (total - capped) / active, n
    return weighed.withColumn("target", F.when(over, limit).otherwise(F.col("weight") * F.lit(rate))).drop("weight")


def running_before(rows: DataFrame, parts: list[str], order: list[str], value: str, n_buckets: int) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over earlier rows of the same ``parts``.

    ``bucket`` (0 .. n_buckets - 1) must not decrease along ``order``.
    """
    inside = Window.partitionBy(*parts, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    sums = rows.groupBy(*parts, "bucket").agg(F.sum(value).alias("v"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*parts, "bucket"]]
    if n_buckets <= FAN_OUT:
        upper = Window.partitionBy(*parts).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.withColumn("before", F.coalesce(F.sum("v").over(upper), F.lit(0)))
    else:
        above = sums.withColumnRenamed("bucket", "lower").withColumn("bucket", F.expr(f"lower div {FAN_OUT}"))
        starts = running_before(above, parts, ["lower"], "v", -(-n_buckets // FAN_OUT)).drop("bucket").withColumnRenamed("lower", "bucket")
    starts = starts.select(*parts, "bucket", "before")
    joined = local.alias("l").join(starts.alias("r"), same)
    return joined.select("l.*", (F.col("r.before") + F.col("l.inside")).alias("before")).drop("inside", "bucket")


def _position(amount: Column, demand: Column, factors: Column) -> Column:
    """Inverse of the cumulative demand at ``amount`` words.

    ``factors`` are the schedule's values at equally spaced times.  Inside a
    segment demand is quadratic in time.
    """
    k = F.size(factors) - 1
    pieces = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.get(factors, i) + F.get(factors, i + 1)) / 2)
    area = F.aggregate(pieces, F.lit(0.0), lambda a, x: a + x)
    goal = F.when(demand > 0, amount / demand).otherwise(F.lit(0.0)) * area
    start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    # a segment is passed only if all before it are
    seg = F.aggregate(
        pieces, start,
        lambda a, x: F.when(
            (a["i"] == a["at"]) & (a["sum"] + x <= goal) & (a["i"] < k - 1), F.struct((a["i"] + 1).alias("i"), (a["sum"] + x).alias("sum"), (a["at"] + 1).alias("at"))
        ).otherwise(F.struct(a["i"].alias("i"), a["sum"].alias("sum"), (a["at"] + 1).alias("at"))),
    )
    rest = F.greatest(goal - seg["sum"], F.lit(0.0))
    w0, w1 = F.get(factors, seg["i"]), F.get(factors, seg["i"] + 1)
    root = F.sqrt(w0 * w0 + 2 * (w1 - w0) * rest)
    inside = F.when(rest == 0, F.lit(0.0)).otherwise(2 * rest / (w0 + root))
    return (seg["i"] + F.least(inside, F.lit(1.0))) / k


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, schedules=SCHEDULES, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, key, size, source_size, target, copies, taken, positions.

    ``copies`` is how often the mix takes the document and ``positions`` the
    training position of each copy; a document's whole words are taken or none.
    A null or empty text has no words; it is taken as often as its place in the
    shuffled stream says.  Null sources are a source, the last one.
    Rows that are equal in id and text are told apart by nothing, and are
    interchangeable; reruns agree.  An empty table gives an empty plan.  Other
    columns are left out.
    """
    text = F.col("text").cast("string")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    sized = runtime.stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), key.alias("key"), word_count(text).alias("size")), "sizes")
    factors = F.element_at(F.array(*(F.array(*(F.lit(float(f)) for f in each)) for each in schedules)), (F.col("rank") % len(schedules) + 1).cast("int"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = targets(ranked_sources(sized), weights, share, most).select(F.col("source").alias("name"), "source_size", "target", epochs.cast("int").alias("epochs"), factors.alias("factors"))
    # as large as there are sources: Spark broadcasts it if its size, which it knows, is small
    table = runtime.stage(goals.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "goals")
    n_buckets = max(1, -(-sized.count() // BUCKET_ROWS))
    placed = sized.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.lit(n_buckets) / F.lit(float(1 << 32))).cast("long"))
    summed = running_before(placed, ["source"], ["key", "doc_id"], "size", n_buckets)
    of_source = F.col("source").eqNullSafe(F.col("name"))
    end = F.col("before") + F.col("size")
    joined = runtime.stage(summed.join(table, of_source).drop("name"), "streams")
    # the last epoch takes whole documents while they fit, then the one whose size comes nearest to what is left
    filled = joined.groupBy("source").agg(F.coalesce(F.max(F.when(end <= F.col("rest"), end)), F.lit(0)).alias("filled")).withColumnRenamed("source", "name")
    filled = runtime.stage(filled, "filled")  # written, its size is known before the join is planned
    left = F.col("rest") - F.col("filled")
    gap = F.abs(left - F.col("size"))
    with_left = joined.join(filled, of_source).drop("name")
    last = with_left.filter((end > F.col("rest")) & (gap < left)).groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "key", "doc_id", "before")).alias("last")).withColumnRenamed("source", "name")
    last = runtime.stage(last, "last")
    chosen = with_left.join(last, of_source, "left").drop("name")
    is_last = F.struct("key", "doc_id", "before").eqNullSafe(F.struct("last.key", "last.doc_id", "last.before")) & F.col("last").isNotNull()
    copies = (F.col("epochs") + F.when((F.col("rest") > 0) & ((end <= F.col("rest")) | is_last), 1).otherwise(0)).cast("int")
    counted = chosen.withColumn("copies", copies)
    amount = lambda e: e * F.col("source_size") + F.col("before") + F.col("size") / 2
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: _position(amount(e), F.col("target"), F.col("factors")))).otherwise(F.array().cast("array<double>"))
    return counted.select("doc_id", "source", "key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"), positions.alias("positions"))


def by_position(planned: DataFrame) -> DataFrame:
    """The plan's documents range-sorted by their first position; those the mix doesn't take come last."""
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    keyed = planned.withColumn("first", first)
    return keyed.repartitionByRange("first", "key").sortWithinPartitions("first", "key", "doc_id").drop("first")


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each copy, range-sorted by training position, with ``mix_position``
    (under a longer name if ``docs`` has that one).

    A row is found again by its key, the hash of id and text.  Rows that are
    equal in both stand for one document there: all copies the mix takes of any
    of them are made from one.
    """
    planned = runtime.stage(plan(docs, seed=seed, **options).select("key", "positions"), "plan")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), text).cast("binary"))
    name, places, place = (runtime.fresh(docs, n) for n in ("mix_key", "mix_positions", "mix_position"))
    keyed = docs.withColumn(name, key)
    if not planned.groupBy("key").count().filter("count > 1").isEmpty():
        keyed = keyed.dropDuplicates([name])
    out = keyed.join(planned.filter(F.size("positions") > 0).select(F.col("key").alias(name), F.col("positions").alias(places)), name)
    rows = out.withColumn(place, F.explode(places)).drop(places)
    return rows.repartitionByRange(place, name).sortWithinPartitions(place, name).drop(name)


def _sql_position(epoch: str) -> str:
    """The inverse of the demand at the middle of a document's copy, in SQL, for schedules of two segments."""
    goal = f"(({epoch}) * source_size + before + size / 2.0::DOUBLE) / target * ((f[1] + f[2]) / 2 + (f[2] + f[3]) / 2)"
    rest = f"greatest({goal} - (f[1] + f[2]) / 2, 0)"
    inside = lambda r, a, b: f"least(CASE WHEN {r} = 0 THEN 0 ELSE 2 * {r} / ({a} + sqrt({a} * {a} + 2 * ({b} - {a}) * {r})) END, 1)"
    return f"round(CASE WHEN {goal} >= (f[1] + f[2]) / 2 THEN (1 + {inside(rest, 'f[2]', 'f[3]')}) / 2 ELSE {inside(goal, 'f[1]', 'f[2]')} / 2 END, 6)"


ORACLE_SQL = (r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         [[1.0, 1.0, 1.0], [0.5, 1.0, 1.5], [1.5, 1.0, 0.5]][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE[] AS f
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS total, sum(weight) OVER () AS weights,
         coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER w, 0)::DOUBLE AS gone
  FROM per_source WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rates AS (SELECT *, (total - capped) / (weights - gone) AS rate FROM ranked),
final_rate AS (SELECT arg_min(rate, 2.0::DOUBLE * source_size / weight) FILTER (WHERE weight * rate <= 2.0::DOUBLE * source_size) AS rate FROM rates),
goals AS (
  SELECT source, source_size, f, CASE WHEN weight * r.rate > 2.0::DOUBLE * source_size OR r.rate IS NULL THEN 2.0::DOUBLE * source_size ELSE weight * r.rate END AS target
  FROM per_source, final_rate r),
streamed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS before
  FROM sized),
joined AS (
  SELECT s.*, g.source_size, g.target, g.f, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs, target - epochs * source_size AS rest
  FROM streamed s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
filled AS (SELECT *, rest - coalesce(max(CASE WHEN before + size <= rest THEN before + size END) OVER (PARTITION BY source), 0) AS left_over FROM joined),
nearest AS (
  SELECT *, before + size > rest AND abs(left_over - size) < left_over AS candidate,
         row_number() OVER (PARTITION BY source, candidate ORDER BY abs(left_over - size), key, doc_id, before) AS place
  FROM filled),
counted AS (
  SELECT *, (epochs + CASE WHEN rest > 0 AND (before + size <= rest OR (candidate AND place = 1)) THEN 1 ELSE 0 END)::INT AS copies
  FROM nearest)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
       CASE WHEN copies > 0 THEN @FIRST@ END::DOUBLE AS first_position, CASE WHEN copies > 0 THEN @LAST@ END::DOUBLE AS last_position
FROM counted
""").replace("@FIRST@", _sql_position("0")).replace("@LAST@", _sql_position("copies - 1"))
