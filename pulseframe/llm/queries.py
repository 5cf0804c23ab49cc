"""Thin queries over the operators of this subpackage, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_classes

    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op2_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    model = fit_quality(docs, _table(spark, sf_dir, "labels"))
    return score_quality(docs, model, keep=["doc_id"])


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .binary import read_token_files, write_token_files
    from .shared import shared_dir
    from .tokens import vocabulary_file

    out = shared_dir(spark, "token-files")
    write_token_files(_table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY), out)
    return read_token_files(spark, out)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens, vocabulary_file

    return count_tokens(_table(spark, sf_dir, "documents"), vocabulary_file(VOCABULARY), keep=["doc_id"])


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language_model import score_texts

    training = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(True))
    return score_texts(_table(spark, sf_dir, "documents"), training)


def op4_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .pii import find_pii, span_counts, span_text

    found = find_pii(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *span_counts(F.col("base")), F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def op9_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_preferences, paired_by_parity

    return format_preferences(paired_by_parity(_table(spark, sf_dir, "conversations")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit_toxicity(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import audit_sources

    return audit_sources(_table(spark, sf_dir, "documents"))


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .top_products import query_rows, top_products

    return top_products(_table(spark, sf_dir, "embeddings"), query_rows(50))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (op1_jaccard_join, op2_quality_trees, op3_language_model, op4_fair_mix, op5_benchmark_leaks, op6_token_files, op7_token_counts, op8_personal_data, op9_preference_pairs, op10_toxicity, op11_source_divergence, op12_top_products, op13_target_resampling)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import chat, divergence, mixing, top_products

    return {"op4_fair_mix": mixing.ORACLE, "op9_preference_pairs": chat.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_top_products": top_products.ORACLE}
