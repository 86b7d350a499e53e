"""A corpus preparation pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns the columns of documents; ``run`` writes every stage's result as
Parquet in the checkpoint folder and reads it again. The last stage adds
``copy``: a row repeats as often as the mix takes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellar.llm import decontaminate, jaccard_join, language_id, mixing, substring_dedup
from cellar.llm.support import join_key
from cellar.session import materialize, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is clear; null, letterless and undecided texts go."""
    return language_id.accept(docs, language_id.fit_dictionaries(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the least (doc_id, text hash), of each group linked by copies or similarity.

    The group names it, so one stays also where ids are null or repeat. Wordless texts are nobody's copies and stay. Of rows that repeat both id
    and text one stays.
    """
    found = jaccard_join.jaccard_join(docs)
    named = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))
    keep = found.where(named).groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    keep = materialize(keep)
    rows = join_key(docs, keep.where("n = 1").drop("n"), "left_semi")
    repeated = keep.where("n > 1").drop("n")
    if not repeated.isEmpty():
        rows = rows.unionAll(join_key(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))
    return rows


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut sentences covered by a repeated span; n_chars follows the text, no row goes."""
    out = substring_dedup.remove_repeats(docs)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop every document that holds a window of a benchmark item."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources meet their target weights."""
    return mixing.mix_documents(docs, mixing.cycling_weights())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing to target weights", mix_sources),
]

#: Compression, hashing and tokenisation of the stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
