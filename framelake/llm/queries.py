"""The ``opN_<name>`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import html_text, licenses, media, mixing, packing, quality, rules, runtime, simhash, token_output, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")
    return media.media_columns(_table(spark, sf_dir, "documents"), runtime.new_path(spark, "media")).select(*columns)


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runtime.new_path(spark, "tokens")
    manifest = token_output.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), out, end_id=0)
    return token_output.read_tokens(manifest)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.by_position(mixing.plan(_table(spark, sf_dir, "documents")))
    first, last = (F.round(F.get("positions", at), 6) for at in (F.lit(0), F.col("copies") - 1))
    return planned.select("doc_id", "size", "source_size", "target", "taken", "copies", first.alias("first_position"), last.alias("last_position"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "stop_word_ratio", "base_failed", "kept")
    return rules.apply_rules(_table(spark, sf_dir, "documents")).select(*columns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_media": op2_media,
    "op3_tokens": op3_tokens,
    "op4_simhash": op4_simhash,
    "op5_licenses": op5_licenses,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_mix": op9_mix,
    "op10_rules": op10_rules,
}

ORACLE_SQL: dict[str, str] = {
    "op5_licenses": licenses.ORACLE_SQL,
    "op9_mix": mixing.ORACLE_SQL,
    "op10_rules": rules.ORACLE_SQL,
}
