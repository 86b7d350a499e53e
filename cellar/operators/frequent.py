"""Most frequent values and distinct counts without shuffling a column's values or texts.

Modes: every value falls by its hash into one of SLOTS slots, and the rows of
each slot are counted (a small, partially aggregated table). A slot's total
bounds the count of every value in it, so after the fullest slots have been
counted value by value, only slots whose total still reaches the best count can
hold the mode; the others are never looked at. Where the values are so even that
nothing can be ruled out, the slots are hash ranges, counted ROUND_ROWS rows at
a time.

Texts: 128-bit digests stand for the values, with the first PREFIX characters to
decide ties; a longer winner is fetched by a semi-join on its digest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellar.functions.safe import require_columns
from cellar.session import materialize

SLOTS = 1024
#: slots counted first, and rows of later rounds
FIRST_SLOTS, ROUND_ROWS = 4, 1_000_000_000
PREFIX = 32


def _plain(c: Column, t: T.DataType) -> Column:
    """NaN as missing, and one zero: equal values get equal hashes."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(t))
    return c


def _slot(v: Column, n: int) -> Column:
    return F.when(v.isNotNull(), F.pmod(F.xxhash64(v), F.lit(n)).cast("int"))


def _one_type_modes(df: DataFrame, exprs: list[Column], slots: int, round_rows: int) -> list[tuple]:
    """(value, count) of each expression, all of one type; (None, 0) where there is no value."""
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), _slot(v, slots).alias("slot")) for i, v in enumerate(exprs)]))
    totals = df.select(tagged.alias("s")).select("s.*").where("slot is not null").groupBy("i", "slot").agg(F.count(F.lit(1)).alias("n"))
    open_: dict[int, list[tuple[int, int]]] = {}
    for r in totals.collect():  # at most ``slots`` rows a column
        open_.setdefault(r["i"], []).append((r["n"], r["slot"]))
    for v in open_.values():
        v.sort(reverse=True)
    best: list[tuple] = [(None, 0)] * len(exprs)
    while open_:
        now: dict[int, list[int]] = {}
        for i, left in open_.items():
            rows = 0
            while left and (not now.get(i) or (rows + left[0][0] <= round_rows if best[i][1] else len(now[i]) < FIRST_SLOTS)):
                n, slot = left.pop(0)
                rows += n
                now.setdefault(i, []).append(slot)
        picked = [F.struct(F.lit(i).alias("i"), F.when(_slot(exprs[i], slots).isin(chosen), exprs[i]).alias("v")) for i, chosen in now.items()]
        counted = df.select(F.explode(F.array(*picked)).alias("s")).select("s.*").where("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        top = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("v").alias("v"))).alias("t"))
        for r in top.collect():  # a row for each column
            i, n, v = r["i"], -r["t"]["less"], r["t"]["v"]
            if n > best[i][1] or (n == best[i][1] and v < best[i][0]):
                best[i] = (v, n)
        # a slot with fewer rows than the best count holds no value as frequent
        open_ = {i: kept for i, left in open_.items() if (kept := [x for x in left if x[0] >= best[i][1]])}
    return best


def column_modes(df: DataFrame, columns: Sequence[str], as_type: str | None = None, slots: int = SLOTS, round_rows: int = ROUND_ROWS) -> dict[str, tuple]:
    """column -> (most frequent value, its count): exact, ties to the smallest value, (None, 0) without values.

    Text columns go through ``text_summary``; the other types are counted
    together, one type after the other.
    """
    require_columns(df, columns)
    by_type: dict[T.DataType, list[str]] = {}
    kind = T._parse_datatype_string(as_type) if as_type else None
    for c in columns:
        by_type.setdefault(kind or df.schema[c].dataType, []).append(c)
    out: dict[str, tuple] = {}
    for t, cols in by_type.items():
        if isinstance(t, T.StringType):
            out |= {r["column"]: (r["top_value"], r["top_count"]) for r in text_summary(df, cols).collect()}
        else:
            out |= dict(zip(cols, _one_type_modes(df, [_plain(F.col(c).cast(t), t) for c in cols], slots, round_rows)))
    return {c: out.get(c, (None, 0)) for c in columns}


def _digest(v: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), v).alias("h1"), F.xxhash64(F.lit(2), v).alias("h2")]


def digest_counts(df: DataFrame, columns: Sequence[str], prefix: bool = False) -> DataFrame:
    """(column, h1, h2, cnt[, prefix]): rows of every distinct non-null value, as text, by its digest."""
    require_columns(df, columns)
    items = []
    for c in columns:
        v = F.col(c).cast("string")
        fields = [F.lit(c).alias("column"), *_digest(v)]
        items.append(F.when(v.isNotNull(), F.struct(*fields, *([F.substring(v, 1, PREFIX).alias("prefix")] if prefix else []))))
    d = df.select(F.explode(F.array(*items)).alias("s")).where("s is not null").select("s.*")
    # equal digests have equal beginnings; as a key, unlike as a minimum, the beginning needs no sort
    return d.groupBy("column", "h1", "h2", *(["prefix"] if prefix else [])).agg(F.count(F.lit(1)).alias("cnt"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n): distinct non-null values of each column that has any."""
    return digest_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def text_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, count, unique, top_value, top_count) of text columns; ties go to the smallest text.

    No row for a column without values. The result is a small local table; the
    passes over the data run when it is built.
    """
    d = materialize(digest_counts(df, columns, prefix=True))
    per = d.groupBy("column").agg(F.sum("cnt").alias("count"), F.count(F.lit(1)).alias("unique"), F.min(F.struct((-F.col("cnt")).alias("less"), "prefix")).alias("t"))
    found = {r["column"]: r for r in per.collect()}  # a row for each column
    value = {c: r["t"]["prefix"] for c, r in found.items()}
    longer = [c for c in found if len(value[c]) >= PREFIX]
    if longer:
        # of the most frequent values of a column, those with the smallest beginning: one, or a few near copies
        is_top = F.lit(False)
        rows = []
        for c in longer:
            is_top |= (F.col("column") == c) & (F.col("cnt") == -found[c]["t"]["less"]) & (F.col("prefix") == value[c])
            v = F.col(c).cast("string")
            rows.append(F.when(F.startswith(v, F.lit(value[c])), F.struct(F.lit(c).alias("column"), *_digest(v), v.alias("v"))))
        texts = df.select(F.explode(F.array(*rows)).alias("s")).where("s is not null").select("s.*")
        least = texts.join(d.where(is_top).select("column", "h1", "h2"), ["column", "h1", "h2"], "left_semi").groupBy("column").agg(F.min("v").alias("v"))
        value |= {r["column"]: r["v"] for r in least.collect()}
    out = [(c, r["count"], r["unique"], value[c], -r["t"]["less"]) for c, r in found.items()]
    return df.sparkSession.createDataFrame(out, "column string, count long, unique long, top_value string, top_count long")
