"""Exact quantiles of whole columns without shuffling their values.

The target ranks are narrowed to small value ranges by counting: cut points
from a mergeable sketch split a range, one count per range, added up in each task,
finds the piece that holds each rank, and the pieces are split again until they
hold few rows. A value equal to a cut point is a piece of its own, so a hot value
needs no sorting at all. Only the rows of the last pieces are sorted. What
reaches the driver is a count per piece, bounded by columns x targets x cuts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellar.functions.safe import clean_nan, require_columns

CUTS = 64
PIECE_ROWS = 1_000_000


@dataclass
class _Range:
    """Values of ``column`` strictly between lo and hi; ``before`` values are smaller; ``ranks`` are wanted."""

    column: str
    lo: float
    hi: float
    before: int
    rows: int
    ranks: list[int]

    def inside(self, x: Column) -> Column:
        cond = x.isNotNull()
        if self.lo != -math.inf:
            cond &= x > F.lit(self.lo)
        if self.hi != math.inf:
            cond &= x < F.lit(self.hi)
        return cond


def _count_task(ranges: list[_Range], cuts: list[list[float]]):
    """Rows (r, p, n): values of range r in piece p. p is twice the number of cuts below a value, plus 1 where it is a cut."""

    def task(batches):
        total = [np.zeros(2 * len(c) + 1, np.int64) for c in cuts]
        for b in batches:
            for i, (r, c) in enumerate(zip(ranges, cuts)):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                x = x[~np.isnan(x)]
                if r.lo != -math.inf:
                    x = x[x > r.lo]
                if r.hi != math.inf:
                    x = x[x < r.hi]
                total[i] += np.bincount(np.searchsorted(c, x, "left") + np.searchsorted(c, x, "right"), minlength=len(total[i]))
        for i, n in enumerate(total):
            p = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), i, np.int32)), pa.array(p.astype(np.int32)), pa.array(n[p])], names=["r", "p", "n"])

    return task


def _split(df: DataFrame, ranges: list[_Range], known: dict[tuple[str, int], float]) -> list[_Range]:
    """One counting pass over all ranges: found ranks go to ``known``, the rest to smaller ranges."""
    x = {r.column: clean_nan(F.col(r.column).cast("double")) for r in ranges}
    grid = [(i + 0.5) / CUTS for i in range(CUTS)]
    row = df.agg(*[F.percentile_approx(F.when(r.inside(x[r.column]), x[r.column]), grid, 1000).alias(f"c{i}") for i, r in enumerate(ranges)]).first()
    cuts = [sorted(set(row[f"c{i}"])) for i in range(len(ranges))]
    values = df.select(*[x[r.column].alias(f"x{i}") for i, r in enumerate(ranges)])
    counted = values.mapInArrow(_count_task(ranges, cuts), "r int, p int, n long").groupBy("r", "p").agg(F.sum("n").alias("n"))
    by_range: dict[int, list[tuple[int, int]]] = {}
    for c in counted.collect():  # at most 2 * CUTS + 1 rows a range
        by_range.setdefault(c["r"], []).append((c["p"], c["n"]))
    out = []
    for i, r in enumerate(ranges):
        before = r.before
        for p, n in sorted(by_range.get(i, [])):
            ranks = [k for k in r.ranks if before <= k < before + n]
            if ranks and p % 2:
                known.update({(r.column, k): cuts[i][p // 2] for k in ranks})
            elif ranks:
                c = p // 2
                out.append(_Range(r.column, cuts[i][c - 1] if c else r.lo, cuts[i][c] if c < len(cuts[i]) else r.hi, before, n, ranks))
            before += n
    return out


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, p, q): exact linear-interpolated quantiles; NaN and null do not count.

    A column without values has no rows. The result is a small local table
    (columns x probabilities); the passes over the data run when it is built.
    """
    cols = list(columns)
    require_columns(df, cols)
    n = df.agg(*[F.count(clean_nan(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    size = {c: n[f"n{i}"] for i, c in enumerate(cols)}
    at = {(c, p): (size[c] - 1) * p for c in cols if size[c] for p in probs}
    known: dict[tuple[str, int], float] = {}
    ranges = []
    for c in cols:
        if size[c]:
            ranks = sorted({k for p in probs for k in (math.floor(at[c, p]), math.ceil(at[c, p]))})
            ranges.append(_Range(c, -math.inf, math.inf, 0, size[c], ranks))
    while any(r.rows > PIECE_ROWS for r in ranges):
        small = [r for r in ranges if r.rows <= PIECE_ROWS]
        ranges = small + _split(df, [r for r in ranges if r.rows > PIECE_ROWS], known)
    if ranges:
        known |= _sorted_ranks(df, ranges)
    rows = [(c, float(p), known[c, math.floor(h)] + (known[c, math.ceil(h)] - known[c, math.floor(h)]) * (h - math.floor(h))) for (c, p), h in at.items()]
    return df.sparkSession.createDataFrame(rows, "column string, p double, q double")


def _sorted_ranks(df: DataFrame, ranges: list[_Range]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks of small ranges: at most PIECE_ROWS rows are sorted for each."""
    items = []
    for i, r in enumerate(ranges):
        x = clean_nan(F.col(r.column).cast("double"))
        items.append(F.struct(F.lit(i).alias("r"), F.when(r.inside(x), x).alias("v")))
    vals = df.select(F.explode(F.array(*items)).alias("s")).select("s.*").where("v IS NOT NULL").groupBy("r", "v").agg(F.count(F.lit(1)).alias("n"))
    start = F.element_at(F.array(*[F.lit(r.before) for r in ranges]), F.col("r") + 1)
    end = start + F.sum("n").over(Window.partitionBy("r").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.element_at(F.array(*[F.array(*[F.lit(int(k)) for k in r.ranks]).cast("array<bigint>") for r in ranges]), F.col("r") + 1)
    held = vals.select("r", "v", "n", end.alias("e"), wanted.alias("k")).select("r", "v", F.explode(F.filter("k", lambda k: (k < F.col("e")) & (k >= F.col("e") - F.col("n")))).alias("k"))
    return {(ranges[h["r"]].column, h["k"]): h["v"] for h in held.collect()}  # a row per wanted rank
