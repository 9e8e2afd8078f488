"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns
a DataFrame: the columns of ``documents`` but for the last, which returns packed
pieces.  ``run`` writes what a stage returns and reads it for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from framelake.llm import mixing, packing, quality, runtime, simhash, toxicity

CAPACITY, END_ID = 4096, 1


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; null and empty texts are scored like others, rows stay as they are."""
    return quality.keep_good(docs, _labels(spark, sf_dir), threshold=0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon finds toxic go; null and empty texts match nothing and stay."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir), threshold=0.7)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the least id, null last; of its rows the text with the least hash."""
    return simhash.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document, in training order; rows equal in id and text are made from one."""
    return mixing.mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, END_ID)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifiers' models and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` of ``sf_dir``.

    Once a stage's rows are written, what it and the stage before left in the
    shared folder is deleted; other queries' tables stay.
    """
    before = runtime.made()
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, out, sf_dir)
        if k < len(STAGES) - 1:
            out = runtime.stage(out, f"pipeline-{name}")
            runtime.sweep(spark, [*before, runtime.made()[-1]])
    return out
