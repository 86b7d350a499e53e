"""Conditional formatting as per-row flag columns.

Column statistics (min, max, mean, quantiles) are scalar subqueries: computed
once per query, then compared row by row with no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import require_columns
from cellar.operators.quantiles import column_quantiles


def _stat(df: DataFrame, expr):
    return df.select(expr).scalar()


def _quantile(df: DataFrame, column: str, p: float):
    return column_quantiles(df, [column], [p]).select("q").scalar()


def color_scale(df: DataFrame, column: str, reverse: bool = False, name: str | None = None) -> DataFrame:
    """cf_color_scale / cf_color_scale_rev: (x - min) / (max - min + 1e-9), or 1 minus it."""
    require_columns(df, [column])
    x = F.col(column).cast("double")
    st = _stat(df, F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")))
    lo, hi = st["lo"], st["hi"]
    norm = (x - lo) / (hi - lo + F.lit(1e-9))
    name = name or (f"{column}_scale_rev" if reverse else f"{column}_scale")
    return df.withColumn(name, (F.lit(1.0) - norm) if reverse else norm)


def top_pct(df: DataFrame, column: str, pct: float = 10.0, name: str | None = None) -> DataFrame:
    """cf_top10pct: x >= the (1 - pct/100) quantile; null rows are not flagged."""
    require_columns(df, [column])
    thr = _quantile(df, column, 1 - pct / 100.0)
    return df.withColumn(name or f"{column}_top", F.coalesce(F.col(column).cast("double") >= thr, F.lit(False)))


def bottom_pct(df: DataFrame, column: str, pct: float = 10.0, name: str | None = None) -> DataFrame:
    """cf_bottom10pct: x <= the pct/100 quantile."""
    require_columns(df, [column])
    thr = _quantile(df, column, pct / 100.0)
    return df.withColumn(name or f"{column}_bottom", F.coalesce(F.col(column).cast("double") <= thr, F.lit(False)))


def above_average(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """cf_above_avg: strictly greater than the mean."""
    m = _stat(df, F.avg(F.col(column).cast("double")))
    return df.withColumn(name or f"{column}_above_avg", F.coalesce(F.col(column) > m, F.lit(False)))


def below_average(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """cf_below_avg: strictly less than the mean."""
    m = _stat(df, F.avg(F.col(column).cast("double")))
    return df.withColumn(name or f"{column}_below_avg", F.coalesce(F.col(column) < m, F.lit(False)))


def duplicates(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """cf_duplicates: the value occurs more than once in the column (nulls included).

    Counts per value come from a partial-aggregated ``groupBy``; only values with
    count > 1 are joined back (null-safe), so a hot value is one small row on the
    build side and AQE's skew handling splits the big side.
    """
    require_columns(df, [column])
    name = name or f"{column}_dup"
    dups = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1).select(
        F.col(column).alias("__v"), F.lit(True).alias(name)
    )
    j = df.join(dups, df[column].eqNullSafe(dups["__v"]), "left").drop("__v")
    return j.withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def blanks(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """cf_blanks: the value is null."""
    return df.withColumn(name or f"{column}_blank", F.col(column).isNull())
