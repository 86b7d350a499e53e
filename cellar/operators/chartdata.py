"""The aggregates behind each chart. Drawing is not built.

Every chart reduces the table to a small result with grouped aggregates; the
only per-row outputs are the scatter points and the missing-value matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellar.functions.safe import clean_nan, numeric_columns, require_columns, round_num
from cellar.operators.ordered import Scan, prefix_scan
from cellar.operators.group_quantiles import group_quantiles
from cellar.operators.profile import corr_long, long_values
from cellar.operators.quantiles import column_quantiles


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """1-based equal-width bin, the maximum lands in the last bin."""
    raw = F.floor((x - lo) * F.lit(bins) / (hi - lo)).cast("int") + 1
    return F.when(hi == lo, F.lit(1)).otherwise(F.least(F.lit(bins), raw))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """ch_histogram: equal-width bins over [min, max] plus the column mean and median."""
    require_columns(df, [column])
    x = clean_nan(F.col(column).cast("double"))
    # one aggregate for min / max / mean: a single struct-valued scalar subquery
    st = df.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("m"))).scalar()
    lo, hi, mean = st["lo"], st["hi"], st["m"]
    median = column_quantiles(df, [column], [0.5]).select("q").scalar()
    width = (hi - lo) / F.lit(bins)
    counts = df.filter(x.isNotNull()).groupBy(_bin(x, lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("lower"),
        (lo + F.col("bin") * width).alias("upper"),
        "count",
        mean.alias("mean"),
        median.alias("median"),
    )


def scatter(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """ch_scatter: all (x, y[, color]) points with both coordinates present."""
    cols = [x, y] + ([color] if color else [])
    require_columns(df, cols)
    return df.select(*cols).filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def trendline(df: DataFrame, x: str, y: str) -> DataFrame:
    """ch_trendline: OLS slope, intercept and r^2 with the number of points (null where there are too few)."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    agg = df.agg(
        F.regr_count(ys, xs).alias("n_points"),
        F.regr_slope(ys, xs).alias("slope"),
        F.regr_intercept(ys, xs).alias("intercept"),
        F.regr_r2(ys, xs).alias("r2"),
    )
    return agg


def box(df: DataFrame, column: str, group: str | None = None, k: float = 1.5) -> DataFrame:
    """ch_box: quartiles, whiskers within k*IQR of the box, outlier count; optionally per group.

    Quartiles are exact (``column_quantiles``, ``group_quantiles``); whiskers and
    outliers are counted where the rows are, against the fences of their group.
    Rows with a null group are left out.
    """
    probs = [0.25, 0.5, 0.75]
    if group:
        q = group_quantiles(df, [group], column, probs)
        quart = q.select(F.col(group).alias("__g"), *[F.col("qs")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))])
        rows = df.select(F.col(group).alias("__g"), clean_nan(F.col(column).cast("double")).alias("value")).na.drop()
    else:
        # key on the unpivoted column name: it comes out of a generator, so the
        # optimizer cannot fold the key away and turn the join into a cross join
        q = column_quantiles(df, [column], probs).groupBy(F.col("column").alias("__g"))
        quart = q.agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n) for p, n in zip(probs, ("q1", "median", "q3"))])
        rows = long_values(df, [column]).withColumnRenamed("column", "__g")
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col("value") >= F.col("q1") - F.lit(k) * iqr) & (F.col("value") <= F.col("q3") + F.lit(k) * iqr)
    out = rows.join(quart, "__g").groupBy("__g", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("value"))).alias("upper_whisker"),
        F.count_if(~inside).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return out.withColumnRenamed("__g", group) if group else out.drop("__g")


def series(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """ch_series: y summed by x (and colour) — stacked bar / line / area data."""
    keys = [x] + ([color] if color else [])
    require_columns(df, keys + [y])
    return df.groupBy(*keys).agg(F.coalesce(F.sum(y), F.lit(0)).alias(f"sum_{y}"))


def corr_heatmap(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """ch_corr_heatmap: correlation long form at 2 dp."""
    return corr_long(df, cols, decimals=2)


def missing_matrix(df: DataFrame, key: str) -> DataFrame:
    """ch_missing_matrix: 0/1 per row for the columns that contain nulls.

    Which columns have nulls is decided by one aggregate (a list of at most
    ``len(df.columns)`` names reaches the driver).
    """
    cols = [c for c in df.columns if c != key]
    flags = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    with_nulls = [c for c in cols if flags[c]]
    return df.select(key, *[F.col(c).isNull().cast("int").alias(c) for c in with_nulls])


def distributions(df: DataFrame, columns: Sequence[str] | None = None, kind: str = "histogram", bins: int = 30) -> DataFrame:
    """ch_distributions: histogram (or box) of several columns in one long result."""
    cols = list(columns or numeric_columns(df))
    if kind == "box":
        q = column_quantiles(df, cols, [0.25, 0.5, 0.75])
        return q.groupBy("column").agg(
            F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
            F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("median"),
            F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"),
        )
    lv = long_values(df, cols)
    rng = lv.groupBy("column").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    # one row per column: a broadcast whose size is the number of columns
    j = lv.join(F.broadcast(rng), "column")
    b = _bin(F.col("value"), F.col("__lo"), F.col("__hi"), bins)
    counts = j.groupBy("column", b.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("count"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    return counts.select(
        "column",
        "bin",
        (F.col("__lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("__lo") + F.col("bin") * width).alias("upper"),
        "count",
    )


def pie(df: DataFrame, label: str, value: str, decimals: int = 2) -> DataFrame:
    """ch_pie: sum by label and its share of the total (%)."""
    s = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.coalesce(F.sum(value), F.lit(0)).alias(f"sum_{value}"))
    total = df.filter(F.col(label).isNotNull()).select(F.sum(value)).scalar()
    return s.withColumn("share_pct", round_num(F.try_divide(F.col(f"sum_{value}") * 100.0, total), decimals))


def waterfall(df: DataFrame, label: str, value: str) -> DataFrame:
    """ch_waterfall: sum by label in label order, with the running base before each step."""
    s = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.coalesce(F.sum(value), F.lit(0)).cast("double").alias(f"sum_{value}"))
    r = prefix_scan(s, [label], [Scan("sum", F.col(f"sum_{value}"), "__cum")])
    return r.select(
        label,
        f"sum_{value}",
        (F.col("__cum") - F.col(f"sum_{value}")).alias("base"),
        F.col("__cum").alias("end"),
    )


def funnel(df: DataFrame, label: str, value: str) -> DataFrame:
    """ch_funnel: sum by label, largest first."""
    s = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.coalesce(F.sum(value), F.lit(0)).alias(f"sum_{value}"))
    return s.orderBy(F.desc(f"sum_{value}"), label)
