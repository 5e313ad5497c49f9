"""The operators' queries over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.llm import conversation_repair, embedding_dedup, fill_middle, html_density, language_id, minhash_dedup, packing, paragraph_dedup, pii, quality_llr, scaled_sketch, sentencepiece_fst, url_filter
from inkspan.llm.common import cut, table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings"))


def op2_viterbi_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.predict_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op5_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_sentencepiece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text as a digest, and whether decoding them gives the text back (marks and spaces alike)."""
    encoded = sentencepiece_fst.encode(table(spark, sf_dir, "documents"), round_trip=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_xxhash64"), "round_trip")


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op8_likelihood_ratio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_filter(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(table(spark, sf_dir, "pages"))


def op11_rope_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every output and of the text rebuilt from it; only these narrow rows are written."""
    filled = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    filled = filled.withColumn("output_sha256", F.sha2(F.col("output").cast("binary"), 256))
    back = fill_middle.restore(filled).withColumn("restored_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return cut(back.drop("text"), "filled")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repair_conversations(damaged, times_col="times")


def op13_threshold_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.compare_neighbours(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_viterbi_language_spans,
        op3_weak_supervision_pii,
        op4_minhash_near_dedup,
        op5_redirect_equivalence,
        op6_sentencepiece_transducer,
        op7_paragraph_dedup,
        op8_likelihood_ratio_quality,
        op9_best_fit_packing,
        op10_text_density,
        op11_rope_fill_in_middle,
        op12_conversation_repair,
        op13_threshold_scaled_sketch,
    )
}

ORACLE_SQL: dict[str, str] = {}
