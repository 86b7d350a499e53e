"""Correlations from blocked cross products."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellar.operators import crossproduct as CP
from cellar.operators import profile as PR


def _naive(x, i, j):
    both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
    a, b = x[both, i], x[both, j]
    if len(a) < 1 or np.ptp(a) == 0 or np.ptp(b) == 0:
        return None
    return float(np.corrcoef(a, b)[0, 1])


@pytest.fixture(scope="module")
def many(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 20))
    x = np.concatenate([base @ rng.normal(size=(20, 8)) for _ in range(37)] + [rng.normal(size=(400, 4))], axis=1)  # 300 columns
    x[:, 5] += 1e9
    x[:, 6] = 7.1
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 7] = np.nan
    x[1:, 8] = np.nan
    rows = [(i, [None if math.isnan(v) and k % 2 else float(v) for k, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    return x, df.select(*[F.col("x")[k].alias(f"c{k}") for k in range(x.shape[1])]).repartition(6)


def test_300_columns_in_one_run_equal_the_pairwise_form(many):
    x, df = many
    got = {(r["var1"], r["var2"]): r["corr"] for r in PR.corr_long(df, decimals=None).collect()}
    assert len(got) == 300 * 299 // 2
    for (a, b), r in got.items():
        want = _naive(x, int(a[1:]), int(b[1:]))
        assert (r is None) == (want is None), (a, b, r, want)
        assert r is None or abs(r - want) < (1e-6 if "c5" in (a, b) else 1e-9), (a, b, r, want)


def test_passes_over_column_blocks_give_the_same(many):
    _, df = many
    cols = df.columns[:150]
    one = sorted(map(tuple, CP.blocked_correlations(df, cols).collect()), key=repr)
    several = sorted(map(tuple, CP.blocked_correlations(df, cols, pass_cells=2 * 6 * 64 * 64).collect()), key=repr)
    assert [r[:2] for r in one] == [r[:2] for r in several]
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for (*_, a), (*_, b) in zip(one, several))


def test_no_rows(many):
    _, df = many
    assert PR.corr_long(df.where("false")).where("corr is not null").count() == 0
