"""Ordered operators without a single-task global window.

``Window.orderBy`` without ``partitionBy`` moves every row into one task. All
row-order operators here use a *bucketed prefix scan* instead:

1. Range cut points of the full order key (partition keys first, then order
   keys, ending in a unique key) are taken from a Bernoulli sample whose rate
   is set from the row count, so all tasks together send about
   ``SAMPLE_PER_BUCKET`` rows a bucket to the driver, however many tasks there
   are; every later evaluation assigns the same buckets.
2. Each row gets ``bucket`` = number of cut points <= its key (binary CASE
   tree, O(log buckets) compares, stays in codegen). Because the key ends in a
   unique column, a hot value is split across buckets like any other range.
3. A plain window per (partition, bucket) computes local running values.
4. Per-(partition, bucket) totals (a table of about buckets + groups rows) get
   their exclusive running offsets from a window partitioned by the partition
   keys, and are joined back on (partition, bucket).

Order is ascending with nulls last on every key; pass a negated numeric column
for descending order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellar.functions.safe import clean_nan, nan_as_null, round_num, require_columns

SAMPLE_PER_BUCKET = 64
# One bucket is one window task: buckets follow the number of rows.
ROWS_PER_BUCKET = 1_000_000
# Upper bound on range buckets: the CASE tree has log2(n) depth; beyond codegen
# size limits Spark evaluates it interpreted, still O(log n) per row. Beyond
# MAX_BUCKETS * ROWS_PER_BUCKET rows the buckets grow (windows sort with spill).
MAX_BUCKETS = 16384

_BUCKET = "__bkt"


@dataclass(frozen=True)
class Scan:
    """One running value: kind is sum | count | last | next."""

    kind: str
    expr: Column
    name: str


def _default_buckets(rows: int, slots: int) -> int:
    """Enough buckets for the rows, and at small sizes enough for the session's cores; at least two,
    so that the bucket is never a constant the optimizer could fold out of a join key."""
    return min(MAX_BUCKETS, max(2, -(-rows // ROWS_PER_BUCKET), min(slots, -(-rows // 1000))))


def _zero(dt: T.DataType):
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast("timestamp").cast(dt)
    if isinstance(dt, T.DateType):
        return F.lit("1970-01-01").cast("date")
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(dt)


def _key_fields(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, Column, T.DataType]]:
    out = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        out.append((f"n{i}", F.col(c).isNull(), T.BooleanType()))
        out.append((f"v{i}", F.coalesce(F.col(c), _zero(dt)), dt))
    return out


def _key_struct(fields) -> Column:
    return F.struct(*[e.alias(n) for n, e, _ in fields])


def _lit_struct(fields, values) -> Column:
    return F.struct(*[F.lit(v).cast(dt).alias(n) for (n, _, dt), v in zip(fields, values)])


def _case_tree(key: Column, fields, cuts: list, lo: int, hi: int) -> Column:
    """Number of cuts[0:len] that are <= key, for cuts sorted ascending."""
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    return F.when(key >= _lit_struct(fields, cuts[mid]), _case_tree(key, fields, cuts, mid + 1, hi)).otherwise(
        _case_tree(key, fields, cuts, lo, mid)
    )


def with_buckets(df: DataFrame, key_cols: Sequence[str], n_buckets: int | None = None, seed: int = 17) -> DataFrame:
    """Add ``__bkt``: a range bucket of the composite key ``key_cols``.

    Cut points come from one bounded sample collected to the driver (about
    SAMPLE_PER_BUCKET rows per bucket over all tasks); the result is a literal
    expression, so re-evaluating the DataFrame yields the same buckets.
    """
    rows = df.count()  # no column is read beyond what the plan itself needs
    n = n_buckets or _default_buckets(rows, df.sparkSession.sparkContext.defaultParallelism)
    fields = _key_fields(df, key_cols)
    key = _key_struct(fields)
    if n <= 1:
        return df.withColumn(_BUCKET, F.lit(0))
    rate = n * SAMPLE_PER_BUCKET / max(rows, 1)
    sample = df.select(key.alias("k"))
    if rate < 1:
        sample = sample.where(F.rand(seed) < rate)
    keys = sorted(tuple(r["k"]) for r in sample.collect())
    if not keys:
        return df.withColumn(_BUCKET, F.lit(0))
    cuts = []
    for i in range(1, n):
        k = keys[min(len(keys) - 1, (i * len(keys)) // n)]
        if not cuts or k > cuts[-1]:
            cuts.append(k)
    return df.withColumn(_BUCKET, _case_tree(key, fields, cuts, 0, len(cuts)))


def prefix_scan(
    df: DataFrame,
    order_by: Sequence[str],
    scans: Sequence[Scan],
    partition_by: Sequence[str] = (),
    n_buckets: int | None = None,
) -> DataFrame:
    """Running values over rows ordered by ``order_by`` (asc, nulls last).

    ``order_by`` must end in a unique key (per partition). ``sum`` and
    ``count`` are inclusive running aggregates of non-null values; ``last`` is
    the last non-null value at or before the row (forward fill); ``next`` is the
    first non-null value at or after the row (backward fill).
    """
    part = list(partition_by)
    order = list(order_by)
    require_columns(df, part + order)
    b = with_buckets(df, part + order, n_buckets)
    fields = _key_fields(df, order)
    ordkey = _key_struct(fields)
    b = b.withColumn("__ord", ordkey)
    for i, s in enumerate(scans):
        b = b.withColumn(f"__x{i}", s.expr)

    grp = part + [_BUCKET]
    w_local = Window.partitionBy(*grp).orderBy("__ord")
    upto = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if any(s.kind == "next" for s in scans):
        # read backwards from the same places: Spark evaluates a frame up to the last row anew for every row
        b = b.withColumn("__at", F.row_number().over(w_local))
    from_end = Window.partitionBy(*grp).orderBy(F.col("__at").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    totals_aggs = []
    for i, s in enumerate(scans):
        x = F.col(f"__x{i}")
        if s.kind == "sum":
            b = b.withColumn(f"__l{i}", F.sum(x).over(upto))
            totals_aggs.append(F.sum(x).alias(f"__t{i}"))
        elif s.kind == "count":
            b = b.withColumn(f"__l{i}", F.count(x).over(upto))
            totals_aggs.append(F.count(x).alias(f"__t{i}"))
        elif s.kind == "last":
            b = b.withColumn(f"__l{i}", F.last(x, ignorenulls=True).over(upto))
            totals_aggs.append(F.max(F.when(x.isNotNull(), F.struct(F.col("__ord").alias("o"), x.alias("x")))).getField("x").alias(f"__t{i}"))
        elif s.kind == "next":
            b = b.withColumn(f"__l{i}", F.last(x, ignorenulls=True).over(from_end))
            totals_aggs.append(F.min(F.when(x.isNotNull(), F.struct(F.col("__ord").alias("o"), x.alias("x")))).getField("x").alias(f"__t{i}"))
        else:
            raise ValueError(f"unknown scan kind {s.kind}")

    totals = b.groupBy(*grp).agg(*totals_aggs)
    w_tot = Window.partitionBy(*part)
    before = w_tot.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    later = w_tot.orderBy(F.col(_BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    offs = []
    for i, s in enumerate(scans):
        t = F.col(f"__t{i}")
        if s.kind in ("sum", "count"):
            offs.append(F.sum(t).over(before).alias(f"__o{i}"))
        elif s.kind == "last":
            offs.append(F.last(t, ignorenulls=True).over(before).alias(f"__o{i}"))
        else:
            offs.append(F.last(t, ignorenulls=True).over(later).alias(f"__o{i}"))
    # totals has one row per (partition, bucket): about buckets + groups rows.
    offsets = totals.select(*grp, *offs)
    if not part:  # at most one row per bucket: a proven bound, broadcast it
        offsets = F.broadcast(offsets)
    joined = b.join(offsets, on=grp, how="left")
    out_cols = []
    for i, s in enumerate(scans):
        loc, off = F.col(f"__l{i}"), F.col(f"__o{i}")
        if s.kind == "sum":
            v = F.when(loc.isNull() & off.isNull(), F.lit(None)).otherwise(F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0)))
        elif s.kind == "count":
            v = loc + F.coalesce(off, F.lit(0))
        else:
            v = F.coalesce(loc, off)
        out_cols.append(v.alias(s.name))
    keep = [c for c in df.columns]
    return joined.select(*[F.col(c) for c in keep], *out_cols, F.col("__ord"), F.col(_BUCKET))


def _finish(df: DataFrame, base_cols: Sequence[str], extra: Sequence[Column]) -> DataFrame:
    return df.select(*[F.col(c) for c in base_cols], *extra)


# --------------------------------------------------------------------------
# Operators
# --------------------------------------------------------------------------


def running_totals(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    decimals: int = 2,
    n_buckets: int | None = None,
    total_decimals: int | None = None,
) -> DataFrame:
    """win_running_total, win_running_avg, win_pct_contribution in one pass.

    Running total is null on a null row and continues after it; the running
    average shows the mean so far (pandas ``expanding().mean()``); the
    contribution divides by the (partition) total from a grouped aggregate.
    """
    x = clean_nan(F.col(value).cast("double"))
    s = prefix_scan(
        df,
        order_by,
        [Scan("sum", x, "__rs"), Scan("count", x, "__rc")],
        partition_by=partition_by,
        n_buckets=n_buckets,
    )
    if partition_by:
        tot = df.groupBy(*partition_by).agg(F.sum(x).alias("__tot"))
        s = s.join(tot, on=list(partition_by), how="left")
        total = F.col("__tot")
    else:
        total = df.select(F.sum(x)).scalar()
    return _finish(
        s,
        df.columns,
        [
            F.when(x.isNull(), F.lit(None))
            .otherwise(F.col("__rs") if total_decimals is None else round_num("__rs", total_decimals))
            .alias(f"{value}_running_total"),
            round_num(F.try_divide(F.col("__rs"), F.col("__rc")), decimals).alias(f"{value}_running_avg"),
            round_num(F.try_divide(x * 100.0, total), decimals).alias(f"{value}_pct_contribution"),
        ],
    )


def pct_contribution(df: DataFrame, value: str, partition_by: Sequence[str] = (), decimals: int = 2) -> DataFrame:
    """win_pct_contribution on its own: each value's share of the (partition) total in percent.

    One sum; nothing is ordered. The sums of partitions are joined by key, where
    null keys are one partition.
    """
    x = clean_nan(F.col(value).cast("double"))
    out = f"{value}_pct_contribution"
    if not partition_by:
        total = df.select(F.sum(x)).scalar()
        return df.withColumn(out, round_num(F.try_divide(x * 100.0, total), decimals))
    tot = df.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(partition_by)]).agg(F.sum(x).alias("__tot"))
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(partition_by)]
    return df.join(tot, on, "left").select(*df.columns, round_num(F.try_divide(x * 100.0, F.col("__tot")), decimals).alias(out))


def row_position(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str = "row_pos") -> DataFrame:
    """win_row_position: 1-based row number in (partition, order)."""
    s = prefix_scan(df, order_by, [Scan("count", F.lit(1), name)], partition_by=partition_by)
    return _finish(s, df.columns, [F.col(name).cast("bigint").alias(name)])


def fill_forward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """tool_fill_forward: carry the last non-null value down (pandas ffill)."""
    scans = [Scan("last", F.col(c), f"__ff_{c}") for c in columns]
    s = prefix_scan(df, order_by, scans, partition_by=partition_by)
    return s.select(*[F.col(f"__ff_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_backward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """tool_fill_backward: take the next non-null value (pandas bfill)."""
    scans = [Scan("next", F.col(c), f"__bf_{c}") for c in columns]
    s = prefix_scan(df, order_by, scans, partition_by=partition_by)
    return s.select(*[F.col(f"__bf_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def pct_change(
    df: DataFrame,
    value: str,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    name: str | None = None,
) -> DataFrame:
    """win_pct_change: growth % to the previous row after padding nulls forward.

    ``(cur / prev - 1) * 100`` with cur and prev forward-filled; division by
    zero gives NULL instead of inf. The previous padded value of a bucket's
    first row is the carried value of earlier buckets.
    """
    name = name or f"{value}_pct_change"
    x = F.col(value).cast("double")
    s = prefix_scan(df, order_by, [Scan("last", x, "__ff")], partition_by=partition_by)
    w = Window.partitionBy(*partition_by, _BUCKET).orderBy("__ord")
    s = s.withColumn("__prev_local", F.lag("__ff").over(w)).withColumn("__rn", F.row_number().over(w))
    # carry for a bucket's first row: padded value at the last row of the previous
    # bucket of the same partition (totals table: about buckets + groups rows).
    last_ff = F.max(F.struct(F.col("__ord").alias("o"), F.col("__ff").alias("v"))).getField("v")
    tot = s.groupBy(*partition_by, _BUCKET).agg(last_ff.alias("__last_ff"))
    w_t = (Window.partitionBy(*partition_by) if partition_by else Window.partitionBy()).orderBy(_BUCKET)
    tot = tot.select(*partition_by, _BUCKET, F.lag("__last_ff").over(w_t).alias("__carry"))
    out = s.join(tot, on=[*partition_by, _BUCKET], how="left")
    prev = F.when(F.col("__rn") == 1, F.col("__carry")).otherwise(F.col("__prev_local"))
    return _finish(out, df.columns, [((F.try_divide(F.col("__ff"), prev) - 1) * 100).alias(name)])


def _value_ranks(df: DataFrame, value: str, partition_by: Sequence[str], descending: bool) -> DataFrame:
    """Distinct values per partition with dense rank and rows before (bucketed scan).

    Ranks are computed on the distinct-value table, then joined back on value:
    the raw rows are never sorted as one global sequence.
    """
    part = list(partition_by)
    key = F.col(value)  # its own type: a double would tie integers above 2^53
    if descending:
        whole = isinstance(df.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        key = F.bitwise_not(key) if whole else -key
    vc = (
        nan_as_null(df, [value]).filter(F.col(value).isNotNull())
        .groupBy(*part, value)
        .agg(F.count(F.lit(1)).alias("__cnt"))
        .withColumn("__k", key)
    )
    s = prefix_scan(
        vc,
        ["__k"],
        [Scan("count", F.lit(1), "__dense"), Scan("sum", F.col("__cnt"), "__cum")],
        partition_by=part,
    )
    n = vc.groupBy(*part).agg(F.sum("__cnt").alias("__n")) if part else None
    out = s.select(*part, value, "__cnt", "__dense", (F.col("__cum") - F.col("__cnt")).alias("__before"))
    if part:
        out = out.join(n, on=part, how="left")
    else:
        out = out.withColumn("__n", vc.select(F.sum("__cnt")).scalar())
    return out


def dense_rank(
    df: DataFrame,
    value: str,
    ascending: bool = False,
    partition_by: Sequence[str] = (),
    name: str = "rank",
) -> DataFrame:
    """win_dense_rank: dense rank of ``value`` (desc by default); null value -> null rank."""
    r = _value_ranks(df, value, partition_by, descending=not ascending)
    r = r.select(*partition_by, value, F.col("__dense").cast("bigint").alias(name))
    return df.join(r, on=[*partition_by, value], how="left")


def percentile_rank(df: DataFrame, value: str, partition_by: Sequence[str] = (), name: str = "percentile", decimals: int = 1) -> DataFrame:
    """win_percentile_rank: average rank of ties / non-null count x 100 (ascending).

    pandas ``rank(pct=True)``; not ``percent_rank``.
    """
    r = _value_ranks(df, value, partition_by, descending=False)
    avg_rank = F.col("__before") + (F.col("__cnt") + 1) / 2.0
    r = r.select(*partition_by, value, round_num(avg_rank * 100.0 / F.col("__n"), decimals).alias(name))
    return df.join(r, on=[*partition_by, value], how="left")
