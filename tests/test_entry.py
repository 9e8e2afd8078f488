import __spark_entry__ as entry
from framelake.operators import metrics, plane, relational, sequence
from pyspark.sql import functions as F


def test_contract(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_empty_conventions(spark):
    none = spark.createDataFrame([(0, 0, 0, 0, 0, 0)], "clip int, idx int, y int, x int, p int, g int")
    assert metrics.iou(none, F.col("p") == 1, F.col("g") == 1).first().iou == 1.0
    assert metrics.boundary_f(none, 2).first().f == 0.0
    assert metrics.flicker(none).first().flicker == 0.0
    assert metrics.area_jump(none.withColumn("v", F.col("p"))).first().max_jump == 0.0


def test_windows_share_one_shuffle(spark):
    px = plane.by_frame(spark.range(64).selectExpr("0 as clip", "0 as idx", "cast(id div 8 as int) as y", "cast(id % 8 as int) as x", "id as v"))
    plan = plane.dilate(plane.erode(px, "v", "e", 3), "e", "d", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_blend_and_streaks(spark):
    side = lambda rows: spark.createDataFrame(rows, "clip int, idx int, a int, b int, value double, conf double, low boolean, lost boolean")
    out = relational.blend(side([(0, 1, 0, 4, 1.0, 1.0, True, False), (0, 2, 0, 4, 1.0, 1.0, True, False)]), side([(0, 2, 0, 4, 0.0, 1.0, False, False), (0, 3, 0, 4, 0.0, 0.0, False, False)]))
    got = {r.idx: (r.value, r.low) for r in out.collect()}
    assert got == {1: (1.0, True), 2: (0.5, False), 3: (0.0, False)}
    seq = spark.createDataFrame([(0, k, g) for k, g in enumerate([True, False, False, True, False])], "clip int, idx int, good boolean")
    assert [r.streak for r in sequence.streaks(seq, F.col("good")).orderBy("idx").collect()] == [0, 1, 2, 0, 1]
