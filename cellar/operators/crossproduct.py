"""Correlations of many columns from blocked cross products.

Every task adds up, for each pair of column blocks, six small matrices over its
rows: the rows with both values, the sums, the sums of squares and the products,
each taken where both values are present. The matrices are merged as a tree, so
what is shuffled is a few matrices a task, whatever the number of rows. Values
are taken from their column's mean, so that large offsets cost no digits.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: columns in a block, and cells of all matrices that a task holds in one pass over the rows
BLOCK, PASS_CELLS = 64, 6 << 20
#: first-level groups of the merge: a group holds the matrices of one in so many tasks
FAN = 1024
SUMS = 6


def _column(arr: pa.Array) -> np.ndarray:
    return arr.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _product_task(starts: list[tuple[int, int]], at: dict[int, tuple[int, int]], means: np.ndarray):
    """``starts``: pairs of blocks; ``at``: where each block's columns lie in the batch."""

    def task(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            x = np.stack([_column(c) for c in b.columns], axis=1)
            there = ~np.isnan(x)
            z = np.where(there, x - means, 0.0)
            m = there.astype(np.float64)
            sq = z * z
            for i, j in starts:
                p, q = slice(*at[i]), slice(*at[j])
                mi, mj, zi, zj = m[:, p].T, m[:, q], z[:, p].T, z[:, q]
                now = np.stack([mi @ mj, zi @ mj, mi @ zj, sq[:, p].T @ mj, mi @ sq[:, q], zi @ zj])
                total[i, j] = total[i, j] + now if (i, j) in total else now
        if total:
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in total], "j": [j for _, j in total], "sums": [v.ravel() for v in total.values()]}, _SCHEMA)

    return task


_SCHEMA = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("sums", pa.list_(pa.float64()))])


def _merge(table: pa.Table) -> pa.Table:
    """The sum of the matrices of one group."""
    rows = table.column("sums").combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    flat = rows.flatten().to_numpy().reshape(table.num_rows, -1)
    return pa.Table.from_pydict({"i": table.column("i")[:1], "j": table.column("j")[:1], "sums": [flat.sum(axis=0)]}, _SCHEMA)


def _corr_task(names: list[str]):
    d = len(names)

    def task(batches):
        for b in batches:
            for r in range(b.num_rows):
                i, j = b.column(0)[r].as_py(), b.column(1)[r].as_py()
                h, w = min(BLOCK, d - i), min(BLOCK, d - j)
                n, sx, sy, sxx, syy, sxy = b.column(2)[r].values.to_numpy().reshape(SUMS, h, w)
                with np.errstate(all="ignore"):
                    vx, vy, c = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2, sxy / n - (sx / n) * (sy / n)
                    # a side without variance, but for rounding, has no correlation
                    none = (n == 0) | (vx <= 1e-13 * sxx / n) | (vy <= 1e-13 * syy / n)
                    corr = np.clip(c / np.sqrt(vx * vy), -1.0, 1.0)
                p, q = np.nonzero(np.add.outer(np.arange(h) + i, -(np.arange(w) + j)) < 0)
                out = pa.array(corr[p, q], pa.float64(), mask=none[p, q])
                yield pa.RecordBatch.from_arrays([pa.array([names[i + k] for k in p], pa.string()), pa.array([names[j + k] for k in q], pa.string()), out], names=["var1", "var2", "corr"])

    return task


def blocked_correlations(df: DataFrame, columns: Sequence[str], block: int = BLOCK, pass_cells: int = PASS_CELLS) -> DataFrame:
    """(var1, var2, corr) of every pair of columns, var1 before var2, over the rows where both are present.

    corr is null where a side is constant over those rows. Passes over the rows
    are taken in groups of block pairs that fit ``pass_cells``, and read only
    the columns of these; a few hundred columns need one.
    """
    names = list(columns)
    if block != BLOCK:
        raise ValueError(f"blocks have {BLOCK} columns")
    x = [F.col(c).cast("double") for c in names]
    first = df.agg(*[F.avg(F.when(~F.isnan(v), v)).alias(f"m{k}") for k, v in enumerate(x)]).first()
    means = np.array([0.0 if v is None else v for v in first])
    starts = range(0, len(names), block)
    pairs = [(i, j) for i in starts for j in starts if i <= j]
    per_pass = max(1, pass_cells // (SUMS * block * block))
    out = None
    for k in range(0, len(pairs), per_pass):
        now = pairs[k : k + per_pass]
        used = sorted({s for p in now for s in p})
        cols = [c for s in used for c in range(s, min(s + block, len(names)))]
        at = {s: (cols.index(s), cols.index(s) + min(block, len(names) - s)) for s in used}
        rows = df.select(*[x[c].alias(f"x{c}") for c in cols]).mapInArrow(_product_task(now, at, means[cols]), "i int, j int, sums array<double>")
        sums = rows.groupBy("i", "j", (F.spark_partition_id() % FAN).alias("g")).applyInArrow(lambda t: _merge(t.drop_columns(["g"]) if "g" in t.column_names else t), "i int, j int, sums array<double>")
        sums = sums.groupBy("i", "j").applyInArrow(_merge, "i int, j int, sums array<double>")
        part = sums.mapInArrow(_corr_task(names), "var1 string, var2 string, corr double")
        out = part if out is None else out.unionAll(part)
    return out
