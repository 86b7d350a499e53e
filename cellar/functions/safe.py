"""Null, division and type helpers shared by all operators.

The rules follow SURVEY §1: inequality keeps nulls, group sums of all-null
groups are 0, sorts put nulls last, division by zero yields NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.FloatType,
    T.DoubleType,
    T.DecimalType,
)
DATETIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_or_col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def div(a, b) -> Column:
    """a / b, NULL when b is 0 or NULL (pandas would give inf/NaN)."""
    return F.try_divide(lit_or_col(a), lit_or_col(b))


def ne_keep_null(c: Column, v) -> Column:
    """pandas ``col != v`` is true for missing values."""
    return ~c.eqNullSafe(lit_or_col(v))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


def type_class(dt: T.DataType) -> str:
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "text"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def require_columns(df: DataFrame, cols: Iterable[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}; have {df.columns}")


def as_double(c: Column) -> Column:
    return c.cast("double")


def clean_nan(c: Column) -> Column:
    """NaN -> NULL so that pandas-style 'missing' covers both."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def nan_as_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """NaN -> NULL in the given (default: all) float columns: one notion of "missing" for an operator."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    floats &= set(df.columns if columns is None else columns)
    return df.withColumns({c: clean_nan(F.col(c)) for c in floats}) if floats else df


def round_num(c, decimals: int = 0) -> Column:
    """Round the binary value (scaled), half away from zero — DuckDB's rule.

    Spark's ``round`` rounds the shortest decimal text of a double, so 70.695
    (binary 70.69499999...) becomes 70.70 there but 70.69 in pandas and DuckDB.
    Scaling first and rounding the product agrees with pandas except on exact
    binary ties (x.5 after scaling), where pandas/NumPy round half to even.
    """
    x = col(c).cast("double")
    p = float(10**decimals)
    # from 2^52 on a double has no fraction: nothing to round, and floor (a bigint) would saturate
    scaled = F.abs(x) * F.lit(p)
    return F.when(scaled < F.lit(float(2**52)), F.signum(x) * F.floor(scaled + F.lit(0.5)) / F.lit(p)).otherwise(x)


def has_substring(c: Column, s: str) -> Column:
    """``c`` contains the literal ``s`` (LIKE '%s%', which plans as a fast contains)."""
    esc = s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.like(f"%{esc}%")


def compact(arr: Column, element_type: str = "string") -> Column:
    """Drop nulls from an array of distinct values, keeping order.

    ``array_compact`` is a lambda ``filter`` (interpreted, outside whole-stage
    codegen); ``array_except(arr, [NULL])`` is code-generated.
    """
    return F.array_except(arr, F.array(F.lit(None).cast(element_type)))


def explode_nonempty(arr: Column) -> Column:
    """``explode`` without the inferred ``size(arr) > 0`` filter.

    For ``explode`` the optimizer adds that filter below the projections and so
    evaluates an expensive array expression twice; ``explode_outer`` (plus a
    null filter by the caller) evaluates it once.
    """
    return F.explode_outer(arr)
