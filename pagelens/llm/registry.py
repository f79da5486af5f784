"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversation_repair import damaged, repair_report
from .decontaminate import overlap_report
from .gif_media import media_columns
from .license_scan import license_report
from .minmax_dedup import mark_near_duplicates
from .ngram_join import link_documents
from .packing import pack
from .quality import THRESHOLD, held_out, score_documents
from .secret_scan import secret_report
from .sharding import assign
from .spelling_variants import DAMAGE, count_words, group_variants
from .substring_dedup import remove_repeats
from .token_counts import count_tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(_table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_table(spark, sf_dir, "documents"), with_bytes=False)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_variants(count_words(_table(spark, sf_dir, "documents"), damage=DAMAGE))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_report(damaged(conversations), conversations)


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import ORACLES

    return dict(ORACLES)
