import os

import pyarrow as pa
import pytest

from framelake.llm import runtime


def test_stage_and_sweep(spark):
    kept = list(runtime._made)
    runtime._made.clear()
    out = runtime.stage(spark.range(5), "x")
    path = runtime._made[0]
    assert path.startswith("file:") and out.count() == 5
    other = runtime.stage(spark.range(3), "y")
    assert runtime.sweep(spark, [runtime._made[1]]) == 1 and not os.path.exists(runtime.filesystem(path)[1])
    assert other.count() == 3 and runtime.sweep(spark) == 1 and not runtime._made
    runtime._made.extend(kept)


def test_regrouped():
    batches = [pa.RecordBatch.from_pydict({"t": ["x" * n]}) for n in (10, 20, 500, 1)] + [pa.RecordBatch.from_pydict({"t": pa.array([], pa.string())})]
    got = list(runtime.regrouped(batches, "t", 100))
    assert [b.num_rows for b in got] == [3, 1] and sum(b.num_rows for b in got) == 4


def test_fresh(spark):
    df = spark.range(1).selectExpr("id as Fp", "id as fp_")
    assert runtime.fresh(df, "fp") == "fp__" and runtime.fresh(df, "other") == "other"


def test_large_batches_restores(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    runtime.small_batches(spark)
    with runtime.large_batches(spark, 7):
        assert spark.conf.get(key) == "7"
    assert spark.conf.get(key) == str(runtime.BATCH_ROWS)


def test_no_shared_folder(spark, monkeypatch):
    """On a cluster a folder must be named; this machine's own will not do."""

    class Conf:
        get = staticmethod(lambda key, default: None)

    class Context:
        master, getCheckpointDir = "spark://somewhere:7077", staticmethod(lambda: None)

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)
