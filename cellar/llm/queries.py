"""The corpus operators bound to the given tables, with DuckDB SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellar.llm import decontaminate, jaccard_join, language_id, license_scan, mixing, quality_rules, spelling, substring_dedup, suffix_tree_lm, token_alignment, token_counts, topk_search, toxicity
from cellar.llm.oracles import ORACLES
from cellar.llm.support import fold
from cellar.session import materialize, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    narrow = materialize(d.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words")))
    rows, _ = mixing.plan(narrow, mixing.cycling_weights(), size_of=F.col("words"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents")).drop("th", "class_th")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(d, report=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = fold(F.col("doc_id"), 3) == 1
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held)


def op5_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 7) == 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold(F.col("doc_id"), 4) == 2
    dicts = language_id.fit_dictionaries(d, ~held)
    out = language_id.identify(d.select("doc_id", "text"), dicts)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.section_tokens(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_jaccard_join,
        op3_substring_dedup,
        op4_toxicity,
        op5_suffix_tree_lm,
        op6_language_id,
        op7_token_counts,
        op8_license_scan,
        op9_pivot_topk,
        op10_decontaminate,
        op11_quality_rules,
        op12_token_alignment,
        op13_spelling_variants,
    )
}
__all__ = ["ORACLES", "QUERIES"]
