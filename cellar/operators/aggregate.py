"""Grouping, pivots and spreadsheet aggregates.

Null rules: group keys that are null are dropped (pandas ``groupby``), and the
sum of an all-null group is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import round_num, numeric_columns, require_columns, text_columns

_FUNCS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0).cast("double")),
    "mean": lambda c: F.avg(c),
    "count": lambda c: F.count(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def _drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    pred = None
    for k in keys:
        p = F.col(k).isNotNull()
        pred = p if pred is None else pred & p
    return df.filter(pred) if pred is not None else df


def groupby_multi(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    funcs: Sequence[str] = ("sum", "mean", "count"),
    decimals: int | None = 2,
) -> DataFrame:
    """agg_groupby_multi: flat ``<col>_<func>`` names, rounded like the reference."""
    require_columns(df, [*keys, *values])
    aggs = []
    for v in values:
        for f in funcs:
            e = _FUNCS[f](F.col(v))
            if decimals is not None and f != "count":
                e = round_num(e.cast("double"), decimals)
            aggs.append(e.alias(f"{v}_{f}"))
    return _drop_null_keys(df, keys).groupBy(*keys).agg(*aggs)


def pivot(df: DataFrame, key: str, value: str, func: str = "sum") -> DataFrame:
    """agg_pivot: one key, one value, one function; column ``<func>(<value>)``."""
    require_columns(df, [key, value])
    if func not in _FUNCS:
        raise ValueError(f"unknown aggregate {func!r}")
    return _drop_null_keys(df, [key]).groupBy(key).agg(_FUNCS[func](F.col(value)).alias(f"{func}({value})")).orderBy(key)


_KEY_HINTS = ("dept", "department", "category", "region", "type")


def default_group_column(df: DataFrame) -> str:
    cats = text_columns(df)
    if not cats:
        raise ValueError("no text column to group by")
    for c in cats:
        if any(h in c.lower() for h in _KEY_HINTS):
            return c
    return cats[0]


def pivot_smc(df: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """agg_pivot_smc: Total / Average / Count per key (key picked by name hints)."""
    key = key or default_group_column(df)
    value = value or numeric_columns(df)[0]
    return (
        _drop_null_keys(df, [key])
        .groupBy(key)
        .agg(
            F.coalesce(F.sum(value), F.lit(0)).alias("Total"),
            F.avg(value).alias("Average"),
            F.count(value).alias("Count"),
        )
    )


def value_counts(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """agg_value_counts: frequency per non-null value, most frequent first."""
    require_columns(df, [column])
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias(name))
        .orderBy(F.desc(name), F.asc(column))
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """top_values / ch_bar_counts: the n most frequent values (ties: smaller value)."""
    return value_counts(df, column).limit(n)


def _operand_parts(df: DataFrame, operands: Sequence) -> tuple[list[Column], list[float]]:
    cols, consts = [], []
    for o in operands:
        if isinstance(o, str) and o in df.columns:
            cols.append(F.col(o).cast("double"))
        else:
            consts.append(float(o))
    return cols, consts


def sheet_aggregates(df: DataFrame, operands: Sequence) -> DataFrame:
    """agg_sheet_sum/_average/_min/_max/_count over columns and constants together.

    COUNT counts non-null numbers; AVERAGE is total sum / total count.
    """
    cols, consts = _operand_parts(df, operands)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [
            F.sum(c).alias(f"s{i}"),
            F.count(c).alias(f"n{i}"),
            F.min(c).alias(f"lo{i}"),
            F.max(c).alias(f"hi{i}"),
        ]
    if not aggs:
        aggs = [F.count(F.lit(1)).alias("_unused")]
    one = df.agg(*aggs)
    k = len(cols)
    s = sum((F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in range(k)), F.lit(float(sum(consts))))
    n = sum((F.col(f"n{i}") for i in range(k)), F.lit(len(consts)).cast("bigint"))
    lows = [F.col(f"lo{i}") for i in range(k)] + [F.lit(v) for v in consts]
    highs = [F.col(f"hi{i}") for i in range(k)] + [F.lit(v) for v in consts]
    lo = lows[0] if len(lows) == 1 else F.least(*lows)
    hi = highs[0] if len(highs) == 1 else F.greatest(*highs)
    return one.select(
        s.alias("sheet_sum"),
        F.try_divide(s, n).alias("sheet_average"),
        lo.cast("double").alias("sheet_min"),
        hi.cast("double").alias("sheet_max"),
        n.alias("sheet_count"),
    )


def union_all(*dfs: DataFrame) -> DataFrame:
    """set_union_all: append rows by column name."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct(df: DataFrame) -> DataFrame:
    """set_distinct: full-row de-duplication (null equals null)."""
    return df.dropDuplicates()


def distinct_report(df: DataFrame) -> DataFrame:
    """How many rows went in set_distinct: rows, distinct rows, removed."""
    n_distinct = df.dropDuplicates().select(F.count(F.lit(1))).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", n_distinct.alias("n_distinct"), (F.col("n_rows") - n_distinct).alias("n_removed")
    )
