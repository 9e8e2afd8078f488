"""Models and results are the same in another process with another hash seed."""

import os
import subprocess
import sys

import pytest

CODE = """
from pyspark.sql import SparkSession
from framelake.llm import quality, toxicity
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", "SHARED").getOrCreate()
texts = [("ba ko li mu " * 9) + str(k % 7) + (" zorgak" + "ab"[k % 2] + " ba zorgaka mu" if k % 3 == 0 else "") for k in range(90)]
docs = spark.createDataFrame([(k % 90, t) for k, t in enumerate(texts * 2)], "doc_id long, text string")
labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 != 0)) for k in range(90)], "doc_id long, toxic int, quality int")
model = toxicity.fit(docs, labels)
print(model.entries, [round(c, 9) for c in model.curve])
print([round(c, 6) for c in quality.fit(docs, labels).curve])
"""


@pytest.mark.parametrize("seeds", [("1", "2")])
def test_other_hash_seed(seeds, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = [subprocess.run([sys.executable, "-c", CODE.replace("SHARED", f"file://{tmp_path}")], env=os.environ | {"PYTHONHASHSEED": s, "PYTHONPATH": root}, capture_output=True, text=True, check=True).stdout for s in seeds]
    assert out[0] == out[1] and "zorgak" in out[0]
