"""Spark helpers shared by the corpus operators."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellar.llm.kernels import test_bits
from cellar.session import materialize


def free(taken, *names: str) -> list[str]:
    """Column names like ``names`` that do not occur (in any case) in ``taken``."""
    used = {c.lower() for c in taken}
    out = []
    for n in names:
        out.append(next(x for x in itertools.chain([n], (f"{n}_{i}" for i in itertools.count(1))) if x.lower() not in used))
        used.add(out[-1].lower())
    return out


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and text alone, under fixed names (other columns cannot clash)."""
    return df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))


def with_text_key(docs: DataFrame) -> DataFrame:
    """Adds ``th``, a hash of the whole text: (doc_id, th) names a document.

    Rows that repeat both are one document and share every decision.
    """
    return docs.withColumn("th", F.xxhash64("text"))


def fold(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def join_key(df: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Join whole rows with ``keys(doc_id, th, ...)`` on the document's name (nulls equal).

    The added columns of ``keys`` must not occur in ``df``; doc_id and th of
    ``keys`` do not appear in the result.
    """
    kd, kt = free([*df.columns, *keys.columns], "key_doc", "key_th")
    k = keys.withColumnsRenamed({"doc_id": kd, "th": kt})
    cond = df[id_col].eqNullSafe(k[kd]) & (F.xxhash64(df[text_col].cast("string")) == k[kt])
    out = df.join(k, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(kd, kt)


def bitmap(df: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """Packed bitmap of the slots ``hash mod 2**log2_bits``: a filter of fixed size.

    The words are OR-ed in the executors; at most 2**(log2_bits - 6) of them,
    whatever the input, reach the driver. A set slot means "maybe present", so
    a join on the hash must follow.
    """
    slot = F.col(column).bitwiseAND(F.lit((1 << log2_bits) - 1))
    word = F.shiftright(slot, 6)
    bit = F.expr("shiftleft(1L, int(slot & 63))")
    rows = (
        df.select(slot.alias("slot"), word.alias("word"))
        .groupBy("word")
        .agg(F.bit_or(bit).alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (log2_bits - 6), dtype=np.int64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def matching_texts(docs: DataFrame, keys: DataFrame, log2_bits: int = 24) -> DataFrame:
    """The rows of ``docs(doc_id, text, th)`` whose th may be in ``keys(th)``: a join on th must follow.

    A fixed-size bitmap of the keys is broadcast, so texts without a partner
    are left out before anything is shuffled.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(keys, "th", log2_bits))

    def task(batches):
        for b in batches:
            th = b.column(b.schema.get_field_index("th")).to_numpy().view(np.uint64)
            yield b.filter(pa.array(test_bits(bits.value, th)))

    return docs.mapInArrow(task, docs.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges(a, b)``: label is the least node it is connected to.

    Alternating large-star and small-star steps (a logarithmic number of
    rounds). Each step takes the least neighbour by a partially aggregated
    ``min`` and joins it back from a written table, so that a node with very
    many neighbours is split by the skew join and never gathered in one task.
    The edge table of each round is written to the checkpoint folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e)
    last = None
    while True:
        # large star: every larger neighbour of u is linked to u's least neighbour
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        big = materialize(big)
        # small star: u and its smaller neighbours are linked to the least of them
        low = materialize(big.groupBy("u").agg(F.min("v").alias("m")))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return materialize(e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(roots).distinct())


def input_bytes_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
