"""Sorts, top-k, previews, lookups and table edits.

Lookups are joins: the lookup side is reduced to one row per key first (the
first row in the caller's order), then joined. No broadcast hint is given for
a side whose size grows with the data; AQE switches to a broadcast at run time
when the measured size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import require_columns
from cellar.operators.ordered import row_position


def sort_multi(df: DataFrame, columns: Sequence[str], ascending: Sequence[bool] | bool = True) -> DataFrame:
    """srt_multi: many columns, direction per column, nulls always last."""
    require_columns(df, columns)
    asc = [ascending] * len(columns) if isinstance(ascending, bool) else list(ascending)
    keys = [F.asc_nulls_last(c) if a else F.desc_nulls_last(c) for c, a in zip(columns, asc)]
    return df.orderBy(*keys)


def sort_by_x(df: DataFrame, x: str, y: str | None = None) -> DataFrame:
    """srt_by_x: the rows of a line series ordered by x."""
    cols = [x] + ([y] if y else [])
    return df.select(*cols).orderBy(F.asc_nulls_last(x))


def top_n(df: DataFrame, value: str, n: int = 10, tie_keys: Sequence[str] = ()) -> DataFrame:
    """top_n: the n largest rows by ``value``; nulls never win; ties to the earlier key.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, only n rows per task reach the final merge.
    """
    require_columns(df, [value, *tie_keys])
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), *[F.asc_nulls_last(k) for k in tie_keys]).limit(n)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """preview: first n rows in the given order."""
    return df.orderBy(*[F.asc_nulls_last(c) for c in order_by]).limit(n)


def vlookup(
    df: DataFrame,
    value: str,
    lookup: DataFrame,
    lookup_col: str,
    return_col: str,
    order_by: str,
    name: str = "vlookup",
    if_missing=None,
) -> DataFrame:
    """jn_vlookup (XLOOKUP with ``if_missing``): first lookup row whose key equals the value as text.

    The lookup side is reduced to one row per key with ``min_by(return, order)``
    (partial aggregation before the shuffle), then left-joined on the text key.
    """
    require_columns(df, [value])
    require_columns(lookup, [lookup_col, return_col, order_by])
    first = lookup.groupBy(F.col(lookup_col).cast("string").alias("__key")).agg(
        F.min_by(F.col(return_col), F.col(order_by)).alias(name)
    )
    out = df.join(first, df[value].cast("string") == first["__key"], "left").drop("__key")
    if if_missing is not None:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(if_missing)))
    return out


def match(
    df: DataFrame,
    value: str,
    lookup: DataFrame,
    lookup_col: str,
    order_by: Sequence[str],
    name: str = "match",
) -> DataFrame:
    """jn_match: 1-based position of the first lookup row equal (as text) to the value."""
    pos = row_position(lookup.select(*{lookup_col, *order_by}), order_by, name="__pos")
    first = pos.groupBy(F.col(lookup_col).cast("string").alias("__key")).agg(F.min("__pos").alias(name))
    return df.join(first, df[value].cast("string") == first["__key"], "left").drop("__key")


def index(
    df: DataFrame,
    row_col: str,
    lookup: DataFrame,
    column: str,
    order_by: Sequence[str],
    name: str = "index",
) -> DataFrame:
    """jn_index: the cell of ``column`` at the 1-based row number held in ``row_col``."""
    require_columns(lookup, [column, *order_by])
    pos = row_position(lookup.select(*{column, *order_by}), order_by, name="__pos")
    cells = pos.select(F.col("__pos"), F.col(column).alias(name))
    return df.join(cells, df[row_col] == cells["__pos"], "left").drop("__pos")


# ---------------------------------------------------------------- edits


def add_null_row(df: DataFrame) -> DataFrame:
    """edit_add_null_row: append one all-null row."""
    spark = df.sparkSession
    empty = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema)
    return df.unionByName(empty)


def drop_last_row(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """edit_drop_last_row: remove the last row in the given (unique) order.

    The last key is one row from TakeOrdered; it is removed with a left-anti
    join against that single row (a broadcast of a proven one-row side).
    """
    last = df.select(*order_by).orderBy(*[F.desc_nulls_first(c) for c in order_by]).limit(1)
    cond = [df[c].eqNullSafe(last[c]) for c in order_by]
    return df.join(F.broadcast(last), on=cond, how="left_anti")


def add_column(df: DataFrame, name: str) -> DataFrame:
    """edit_add_column: add an empty text column."""
    return df.withColumn(name, F.lit(None).cast("string"))


def drop_last_column(df: DataFrame) -> DataFrame:
    """edit_drop_last_column."""
    return df.drop(df.columns[-1])


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """edit_rename_column."""
    require_columns(df, [old])
    return df.withColumnRenamed(old, new)


def apply_overlay(base: DataFrame, changes: DataFrame, key: str, deleted_col: str = "__deleted") -> DataFrame:
    """edit_apply_overlay: apply keyed cell changes, inserts and deletes to a table.

    ``changes`` has the key, any subset of the base columns (null = unchanged)
    and a boolean ``deleted_col``. A full outer join on the key keeps new keys
    (inserted rows), ``coalesce(new, old)`` applies edits, deletes are filtered.
    """
    cols = [c for c in base.columns if c != key]
    ch = changes
    for c in cols:
        if c not in ch.columns:
            ch = ch.withColumn(c, F.lit(None).cast(base.schema[c].dataType))
    if deleted_col not in ch.columns:
        ch = ch.withColumn(deleted_col, F.lit(False))
    ch = ch.select(key, *[F.col(c).alias(f"__new_{c}") for c in cols], F.col(deleted_col).alias("__del"))
    j = base.join(ch, on=key, how="full_outer")
    out = j.filter(~F.coalesce(F.col("__del"), F.lit(False)))
    return out.select(key, *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) for c in cols])
