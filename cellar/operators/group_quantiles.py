"""Exact quantiles of many groups at once, with no table of their values.

Groups of up to PIECE_ROWS rows use Spark's exact ``percentile`` aggregate,
whose buffer their size bounds. The others, of which there are at most rows /
PIECE_ROWS, are narrowed: cut points per group from a mergeable sketch, rows
counted per (group, piece), and only the pieces that hold a wanted rank are kept
and cut again, until they are small enough to sort. A value equal to a cut point
is a piece of its own, so a hot value is never sorted. The tables of ranges stay
in Spark: nothing but "is any left" reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellar.functions.safe import clean_nan, require_columns
from cellar.operators.quantiles import CUTS
from cellar.session import materialize

#: rows of a group that an exact aggregate holds, and of a range that is sorted
PIECE_ROWS = 200_000
GRID = [(i + 0.5) / CUTS for i in range(CUTS)]


def _inside() -> Column:
    """The row's value lies strictly within its range (open where an end is null)."""
    return (F.col("lo").isNull() | (F.col("x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("x") < F.col("hi")))


def _within(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the range of their group that they lie in; the join is on the group alone."""
    return rows.join(ranges, keys).where(_inside())


def _held(start: Column, n: Column) -> Column:
    return F.filter("ranks", lambda r: (r >= start) & (r < start + n))


def _narrow(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cuts ranges(keys, lo, hi, before, n, ranks): (found(keys, rank, v), smaller ranges)."""
    one = [*keys, "before"]  # names a range: those of a group start at different ranks
    sketch = _within(rows, ranges, keys).groupBy(*one).agg(F.percentile_approx("x", GRID, 1000).alias("cuts"))
    cut = materialize(ranges.join(sketch.select(*one, F.array_sort(F.array_distinct("cuts")).alias("cuts")), one))
    below = F.size(F.filter("cuts", lambda c: c < F.col("x")))
    # odd pieces are cut points, even ones lie between two
    piece = below * 2 + F.array_contains("cuts", F.col("x")).cast("int")
    counts = _within(rows, cut, keys).groupBy(*one, piece.alias("piece")).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*one).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    starts = counts.select(*one, "piece", "m", (F.col("before") + upto - F.col("m")).alias("start"))
    at = starts.join(cut, one).withColumn("ranks", _held(F.col("start"), F.col("m"))).where(F.size("ranks") > 0)
    at = materialize(at.withColumn("k", F.floor(F.col("piece") / 2).cast("int")))
    found = at.where("piece % 2 = 1").select(*keys, F.explode("ranks").alias("rank"), F.col("cuts")[F.col("k")].alias("v"))
    lo = F.when(F.col("k") > 0, F.try_element_at("cuts", F.greatest(F.col("k"), F.lit(1)))).otherwise(F.col("lo"))
    hi = F.coalesce(F.get("cuts", F.col("k")), F.col("hi"))
    return found, at.where("piece % 2 = 0").select(*keys, lo.alias("lo"), hi.alias("hi"), F.col("start").alias("before"), F.col("m").alias("n"), "ranks")


def group_quantiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(by..., n, qs): the linearly interpolated quantiles ``probs`` of ``value`` in each group.

    NaN and null values do not count, rows with a null group key are left out,
    and a group without values has no row.
    """
    require_columns(df, [*by, value])
    keys, probs = [f"k{i}" for i in range(len(by))], [float(p) for p in probs]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], clean_nan(F.col(value).cast("double")).alias("x")).na.drop()
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    big = materialize(sizes.where(F.col("n") > piece_rows))
    small = rows.join(big.select(*keys), keys, "left_anti").groupBy(*keys)
    out = small.agg(F.count(F.lit(1)).alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in probs])).alias("qs"))
    if not big.isEmpty():
        out = out.unionByName(_big_groups(rows, big, keys, probs, piece_rows))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], "n", "qs")


def _big_groups(rows: DataFrame, big: DataFrame, keys: list[str], probs: list[float], piece_rows: int) -> DataFrame:
    place = [(F.col("n") - 1) * F.lit(p) for p in probs]
    ends = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in place]))))
    nothing = F.lit(None).cast("double")
    ranges = materialize(big.select(*keys, nothing.alias("lo"), nothing.alias("hi"), F.lit(0).cast("long").alias("before"), "n", ends.alias("ranks")))
    values = []
    while not ranges.where(F.col("n") > piece_rows).isEmpty():
        found, smaller = _narrow(rows, ranges.where(F.col("n") > piece_rows), keys)
        values.append(found)
        ranges = materialize(ranges.where(F.col("n") <= piece_rows).unionByName(smaller))
    # at most piece_rows rows of a range are sorted
    one = [*keys, "before"]
    held = _within(rows, ranges.drop("n"), keys).groupBy(*one, "x", "ranks").agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*one).orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("start", F.col("before") + upto - F.col("m"))
    values.append(held.select(*keys, F.explode(_held(F.col("start"), F.col("m"))).alias("rank"), F.col("x").alias("v")))
    found = values[0]
    for v in values[1:]:
        found = found.unionByName(v)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two entries a quantile
    low, high = [F.col("at")[F.floor(h)] for h in place], [F.col("at")[F.ceil(h)] for h in place]
    qs = F.array(*[a + (b - a) * (h - F.floor(h)) for a, b, h in zip(low, high, place)])
    return big.join(by_rank, keys).select(*keys, "n", qs.alias("qs"))
