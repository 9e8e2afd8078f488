"""Each stage against a plain re-computation of what it decides."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from framelake.llm import mixing, packing, quality, runtime, simhash, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(runtime.stage(stage(spark, out[-1], DATA), name))
    return out


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark, steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_dedup", "mixing", "packing"]
    docs, good, clean, unique, mixed, packed = steps
    assert all(s.columns == docs.columns for s in steps[:-1])
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert ids(good) == ids(quality.classify(docs, labels).filter("predicted = 1"))
    assert ids(clean) == ids(toxicity.classify(good, labels).filter("predicted = 0"))
    assert ids(unique) == sorted({r.component_id for r in simhash.near_duplicates(clean).collect()})
    copies = {r.doc_id: r.copies for r in mixing.plan(unique).collect()}
    assert ids(mixed) == sorted(i for i, n in copies.items() for _ in range(n))
    assert packed.select("doc_id").distinct().count() == mixed.select("doc_id").distinct().count()
    assert packing.certificate(packed).first().gap <= 1
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0


def test_run(spark, steps):
    got = corpus_pipeline.run(spark, DATA)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, steps[-1].select(*key).collect()))


def test_run_sweeps(spark):
    before = runtime.made()
    other = runtime.stage(spark.range(3), "other")
    got = corpus_pipeline.run(spark, DATA)
    left = [p.rsplit("/", 1)[1].split("-")[0] for p in runtime.made() if p not in before]
    assert left[0] == "other" and set(left) == {"other", "pipeline", "pieces", "packed"} and left.count("pipeline") == 1
    assert other.count() == 3 and got.count() > 0


CLASH = "doc_id long, text string, lang string, source string, n_chars long, fp string, row int, score int, quality_score int, toxic_score string, mix_key string, mix_position int, label int"


def test_edges(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names, through every stage."""
    good = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars > 400").orderBy("doc_id").limit(3).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in good]
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, None), (5, None, None, None, None), (6, "", "en", "s", 0), (None, None, None, None, None), (9, (rows[2][1] + "\n") * 400, "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, "y", "z", 4, 5) for r in rows], CLASH)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        kept = [tuple(r) for r in out.collect()]
        assert set(kept) <= {tuple(r) for r in docs.collect()}, name
        if name == "near_dedup":
            # of the documents equal in text the least id, of its repeated rows one; all empty texts are one group
            assert len(kept) == len({t for t in kept}) and sum(k[1] in (None, "") for k in kept) == 1 and sum(k[1] == rows[0][1] for k in kept) == 1
    packed = corpus_pipeline.packing_stage(spark, docs, DATA).collect()
    assert len({(r.doc_id, r.piece, r.start, r.ids_crc32, r.sequence_id, r.offset) for r in packed}) == len(packed) >= len(rows)


def test_empty(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        assert out.count() == 0, name
