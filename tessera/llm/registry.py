"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    decontaminate,
    html_extract,
    licenses,
    line_dedup,
    mixing,
    near_dedup,
    quality_model,
    quality_rules,
    sharding,
    token_store,
)
from tessera.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents")).select(
        "doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "lang", "source", "n_chars",
        (F.col("_bytes") <= sharding.TARGET_BYTES).alias("in_live_shard"),
    )


#: Rows that did not come through a file of the last version, or came from one over the target size, would differ.
OP10_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5, lang, source, n_chars, TRUE AS in_live_shard FROM documents"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        op1_minhash_near_dedup, op2_quality_classifier, op3_line_dedup, op4_html_extraction, op5_token_output,
        op6_source_mixing, op7_license_scan, op8_quality_rules, op9_decontamination, op10_sharding,
    ]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op9_decontamination": decontaminate.REPORT_SQL, "op10_sharding": OP10_SQL}
