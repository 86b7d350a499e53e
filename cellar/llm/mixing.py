"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / size`` copies. The prefix sum
of the expected copies runs over the documents in order of size; one random
offset is added, and a document is emitted once for each integer boundary that
its stretch crosses. Because the order is by size, the words taken differ from
the target by less than the largest document's size. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellar.llm.support import free
from cellar.session import materialize

MAX_REPEAT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    parts = F.split(text.cast("string"), r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(F.filter(parts, lambda x: x != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """``sources(source_key, weight, size)`` with ``target``: words to take from each source.

    The sum of all sizes is shared by weight; a target stops at ``max_repeat``
    times its source's size and the excess is reshared by weight until none is
    above. In order of size per weight the capped sources come first, so the
    water level is found with two prefix sums. One row per source: the windows
    hold the sources of the mixture, not documents.
    """
    by = Window.orderBy(F.col("size") / F.col("weight"), "source_key")
    up, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = sources.select(
        "*",
        F.sum("size").over(whole).alias("_all"),
        F.coalesce(F.sum(F.col("size") * max_repeat).over(up), F.lit(0)).alias("_capped"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0))).alias("_open"),
    )
    s = s.withColumn("_level", (F.col("_all") - F.col("_capped")) / F.col("_open"))
    fits = F.col("_level") * F.col("weight") <= F.col("size") * max_repeat
    s = s.withColumn("_water", F.min(F.when(fits, F.struct(F.col("size") / F.col("weight"), "source_key", "_level"))).over(whole)["_level"])
    cap = (F.col("size") * max_repeat).cast("double")
    return s.withColumn("target", F.coalesce(F.least(F.col("_water") * F.col("weight"), cap), cap)).drop("_all", "_capped", "_open", "_level", "_water")


def _unit(text: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) from a text."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def plan(docs: DataFrame, weights, id_col="doc_id", text_col="text", source_col="source", size_of: Column | None = None, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> tuple[DataFrame, dict[str, str]]:
    """All rows and columns of ``docs`` with size, source_size, target and copies; and the added columns' names.

    A document's size is ``size_of``, or the number of its text's words. ``weights`` maps the table of sources (source, null included; source_key;
    size; n) to the same with a column ``weight`` > 0. Documents of a source
    are ordered by size, then by the md5 of their id, so reruns agree however
    the table is laid out. The order is counted in three levels: sizes within a
    source, md5 buckets within a size, rows within a bucket. With sqrt(rows)
    buckets no window holds more than about sqrt(rows) rows, even if one source
    or one size has most of the table. A null text has size 0, a null id counts
    as the empty text; repeated rows count each; a source without words has
    target 0; an empty table gives no rows.
    """
    size, ssize, target, copies, key, mark, hb, cell, k, s, b, rate, offset = free(
        docs.columns, "size", "source_size", "target", "copies", "mix_key", "mix_mark", "mix_bucket", "mix_before", "mix_k", "mix_s", "mix_b", "mix_rate", "mix_offset"
    )
    n = docs.count()
    buckets = max(1, int(n**0.5))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    d = docs.select(
        "*",
        (word_count(F.col(text_col)) if size_of is None else size_of).alias(size),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias(key),
        F.md5(ident.cast("binary")).alias(mark),
    )
    d = d.withColumn(hb, F.floor(F.conv(F.substring(mark, 1, 8), 16, 10).cast("double") / float(1 << 32) * buckets))
    cells = materialize(d.groupBy(F.col(key).alias("k"), F.col(size).alias("s"), F.col(hb).alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(source_col).alias("source")))
    sizes = cells.groupBy("k", "s").agg(F.sum("c").alias("c"), F.min("source").alias("source"))
    before_size = F.coalesce(F.sum("c").over(Window.partitionBy("k").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sources = sizes.groupBy("k").agg(F.min("source").alias("source"), F.sum(F.col("s") * F.col("c")).alias("size"), F.sum("c").alias("n"))
    mix = targets(weights(sources.withColumnRenamed("k", "source_key")), max_repeat).select(
        F.col("source_key").alias("k"), F.col("size").alias("total"), F.col("target").alias("goal"),
        F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(F.lit(0.0)).alias("rate"),
        _unit(F.concat(F.lit(seed), "source_key")).alias("offset"),
    )
    sizes = sizes.select("k", "s", before_size.alias("b4"))
    in_size = F.coalesce(F.sum("c").over(Window.partitionBy("k", "s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = cells.select("k", "s", "b", in_size.alias("b5")).join(sizes, ["k", "s"]).join(mix, "k")
    steps = steps.select(
        F.col("k").alias(k), F.col("s").alias(s), F.col("b").alias(b), (F.col("b4") + F.col("b5")).alias(cell),
        F.col("total").alias(ssize), F.col("goal").alias(target), F.col("rate").alias(rate), F.col("offset").alias(offset),
    )
    j = d.join(materialize(steps), (F.col(key) == F.col(k)) & (F.col(size) == F.col(s)) & (F.col(hb) == F.col(b)))
    rank = F.row_number().over(Window.partitionBy(k, s, b).orderBy(mark, ident)) + F.col(cell)
    edge = lambda r: F.floor(r * F.col(rate) + F.col(offset))
    out = j.withColumn(copies, rank).withColumn(copies, F.least(edge(F.col(copies)) - edge(F.col(copies) - 1), F.lit(int(max_repeat))))
    out = out.select(*docs.columns, size, ssize, target, copies)
    return out, {"size": size, "source_size": ssize, "target": target, "copies": copies}


def mix_documents(docs: DataFrame, weights, copy_col: str = "copy", **kw) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the sample takes it, numbered from 1 in ``copy_col``."""
    rows, name = plan(docs, weights, **kw)
    (copy,) = free(docs.columns, copy_col)
    taken = rows.where(F.col(name["copies"]) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col(name["copies"]).cast("int"))).alias(copy))


def cycling_weights(cycle=(5.0, 2.0, 1.0)):
    """Weights that repeat over the sources in code-point order, null last."""

    def weights(sources: DataFrame) -> DataFrame:
        no = F.row_number().over(Window.orderBy("source_key")) - 1
        w = F.element_at(F.array(*map(F.lit, cycle)), (F.col("no") % len(cycle) + 1).cast("int"))
        return sources.withColumn("no", no).withColumn("weight", w).drop("no")

    return weights
