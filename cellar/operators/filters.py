"""Row filters.

Every filter is a plain ``DataFrame.filter`` with a predicate Catalyst can push
into the Parquet scan: comparisons are written against the bare column, never
against a function of it, wherever the semantics allow.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import clean_nan, round_num, ne_keep_null, require_columns


_NUM_OPS = {
    "gt": lambda c, v: c > v,
    ">": lambda c, v: c > v,
    "lt": lambda c, v: c < v,
    "<": lambda c, v: c < v,
    "ge": lambda c, v: c >= v,
    ">=": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
    "<=": lambda c, v: c <= v,
    "eq": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "ne": ne_keep_null,
    "!=": ne_keep_null,
}


def numeric_predicate(column: str, op: str, value) -> Column:
    if op not in _NUM_OPS:
        raise ValueError(f"unknown operator {op!r}; use one of {sorted(_NUM_OPS)}")
    return _NUM_OPS[op](F.col(column), F.lit(value))


def num_filter(df: DataFrame, column: str, op: str, value) -> DataFrame:
    """flt_num_gt/_lt/_ge/_le/_eq/_ne. ``ne`` keeps nulls like pandas."""
    require_columns(df, [column])
    return df.filter(numeric_predicate(column, op, value))


def between(df: DataFrame, column: str, lo, hi) -> DataFrame:
    """flt_num_between: inclusive range."""
    require_columns(df, [column])
    return df.filter(F.col(column).between(lo, hi))


def _text(column: str, case_sensitive: bool) -> Column:
    c = F.col(column)
    return c if case_sensitive else F.lower(c)


def _val(value: str, case_sensitive: bool) -> Column:
    return F.lit(value) if case_sensitive else F.lower(F.lit(value))


def text_contains(df: DataFrame, column: str, value: str, case_sensitive: bool = False) -> DataFrame:
    """flt_text_contains: literal substring (the regex form is ``text_regex``)."""
    require_columns(df, [column])
    return df.filter(F.contains(_text(column, case_sensitive), _val(value, case_sensitive)))


def text_equals(df: DataFrame, column: str, value: str) -> DataFrame:
    require_columns(df, [column])
    return df.filter(F.lower(F.col(column)) == F.lower(F.lit(value)))


def text_startswith(df: DataFrame, column: str, value: str, case_sensitive: bool = True) -> DataFrame:
    require_columns(df, [column])
    if case_sensitive:  # bare column keeps the StringStartsWith pushdown
        return df.filter(F.col(column).startswith(value))
    return df.filter(F.startswith(F.lower(F.col(column)), F.lower(F.lit(value))))


def text_endswith(df: DataFrame, column: str, value: str, case_sensitive: bool = True) -> DataFrame:
    require_columns(df, [column])
    if case_sensitive:
        return df.filter(F.col(column).endswith(value))
    return df.filter(F.endswith(F.lower(F.col(column)), F.lower(F.lit(value))))


def text_regex(df: DataFrame, column: str, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """flt_text_regex: Java regex search anywhere in the value."""
    require_columns(df, [column])
    p = pattern if case_sensitive else "(?i)" + pattern
    return df.filter(F.col(column).rlike(p))


def isin(df: DataFrame, column: str, values: Sequence, include_null: bool = False) -> DataFrame:
    """flt_isin: keep chosen values; optionally also nulls. One IN predicate, pushed into the scan."""
    require_columns(df, [column])
    vals = [v for v in values if v is not None]
    pred = F.col(column).isin(vals) if vals else F.lit(False)
    return df.filter(pred | F.col(column).isNull() if include_null else pred)


def isin_table(df: DataFrame, column: str, keys: DataFrame, include_null: bool = False) -> DataFrame:
    """flt_isin for values held in a table (first column of ``keys``): a semi join that Spark sizes by itself."""
    require_columns(df, [column])
    k = keys.select(keys[keys.columns[0]].alias("__key"))
    match = F.col(column) == F.col("__key")
    if not include_null:
        return df.join(k, match, "left_semi")
    k = k.unionAll(df.sparkSession.range(1).select(F.lit(None).cast(k.schema["__key"].dataType)))
    return df.join(k, F.col(column).eqNullSafe(F.col("__key")), "left_semi")


def _as_date(d) -> _dt.date:
    if isinstance(d, _dt.datetime):
        return d.date()
    if isinstance(d, _dt.date):
        return d
    return _dt.date.fromisoformat(str(d)[:10])


def date_range(df: DataFrame, column: str, start, end) -> DataFrame:
    """flt_date_range: whole days start..end inclusive, as c >= start AND c < end+1.

    Text columns are parsed with ``try_to_timestamp`` first (no pushdown then).
    """
    require_columns(df, [column])
    lo = _dt.datetime.combine(_as_date(start), _dt.time())
    hi = _dt.datetime.combine(_as_date(end) + _dt.timedelta(days=1), _dt.time())
    c = F.col(column)
    if df.schema[column].dataType.simpleString() == "string":
        c = F.try_to_timestamp(c)
    return df.filter((c >= F.lit(lo)) & (c < F.lit(hi)))


def last_n_days(df: DataFrame, column: str, n: int, as_of) -> DataFrame:
    """flt_last_n_days: c >= as_of - n days (as_of is a parameter, not now())."""
    require_columns(df, [column])
    as_of_ts = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.combine(_as_date(as_of), _dt.time())
    return df.filter(F.col(column) >= F.lit(as_of_ts - _dt.timedelta(days=n)))


def this_year(df: DataFrame, column: str, as_of) -> DataFrame:
    """flt_this_year: year(c) = year(as_of), written as a pushable range."""
    require_columns(df, [column])
    y = _as_date(as_of).year
    lo, hi = _dt.datetime(y, 1, 1), _dt.datetime(y + 1, 1, 1)
    return df.filter((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))


def expression(df: DataFrame, predicate_sql: str) -> DataFrame:
    """flt_expression: free predicate text in Spark SQL syntax."""
    return df.filter(F.expr(predicate_sql))


def search_predicate(column: str, value: str) -> Column:
    return F.contains(F.lower(F.col(column).cast("string")), F.lower(F.lit(value)))


def search(df: DataFrame, column: str, value: str) -> DataFrame:
    """flt_search: case-insensitive substring in a column of any type."""
    require_columns(df, [column])
    return df.filter(search_predicate(column, value))


def quick(
    df: DataFrame,
    num_column: str | None = None,
    lo=None,
    hi=None,
    cat_column: str | None = None,
    values: Sequence | None = None,
    include_null: bool = False,
) -> DataFrame:
    """flt_quick: numeric range, then a value list, both chained filters."""
    out = df
    if num_column is not None:
        out = between(out, num_column, lo, hi)
    if cat_column is not None and values is not None:
        out = isin(out, cat_column, values, include_null=include_null)
    return out


def summary(base: DataFrame, predicate: Column | str) -> DataFrame:
    """flt_summary: rows before / after / removed, % remaining, column count.

    One pass over the base table: ``count(*)`` and ``count_if(pred)``.
    """
    pred = F.expr(predicate) if isinstance(predicate, str) else predicate
    agg = base.agg(F.count(F.lit(1)).alias("rows_before"), F.count_if(F.coalesce(pred, F.lit(False))).alias("rows_after"))
    return agg.select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
        round_num(F.try_divide(F.col("rows_after") * 100.0, F.col("rows_before")), 2).alias("pct_remaining"),
        F.lit(len(base.columns)).cast("bigint").alias("n_columns"),
    )


def duplicates(df: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """flt_duplicates: every member of fully duplicated rows.

    Group on all columns (map-side partial counts, so a hot row costs one
    counter per task), keep groups with count > 1, then re-expand each group to
    its count. The expansion is done in two levels with a round-robin shuffle
    in between so a row repeated a third of the table is spread over tasks.
    """
    cols = df.columns
    grouped = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    chunks = grouped.withColumn(
        "__chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / chunk).cast("int")))
    )
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = chunks.repartition(n_parts)  # round-robin: chunks of one hot row land on many tasks
    rows = spread.withColumn(
        "__i",
        F.explode(
            F.sequence(F.lit(1), F.least(F.lit(chunk).cast("bigint"), F.col("__n") - F.col("__chunk") * chunk).cast("int"))
        ),
    )
    return rows.select(*cols)


def outliers_iqr(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """flt_outliers_iqr: rows outside [Q1 - k*IQR, Q3 + k*IQR].

    Q1 and Q3 are exact distributed quantiles (no task holds the whole column),
    delivered as one struct-valued scalar subquery, so the big side is filtered
    in place with no join at all.
    """
    from cellar.operators.quantiles import column_quantiles

    require_columns(df, [column])
    c = clean_nan(F.col(column).cast("double"))  # a missing value is no outlier
    q = column_quantiles(df, [column], [0.25, 0.75])
    quart = q.agg(
        F.struct(
            F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
            F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"),
        )
    ).scalar()
    q1, q3 = quart["q1"], quart["q3"]
    iqr = q3 - q1
    return df.filter((c < q1 - F.lit(k) * iqr) | (c > q3 + F.lit(k) * iqr))
