"""Column statistics by plans whose cost per row stays small: no row per value, no sort of texts, few aggregates."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cellar.operators import frequent as FR
from cellar.operators import profile as PR
from cellar.operators import quantiles as QU

COLS = [f"c{i}" for i in range(6)]


def _rows(n=400):
    r = np.random.default_rng(5)
    x = r.normal(1000, 3, (n, len(COLS)))
    x[:, 1] = x[:, 0] * 2 + r.normal(0, 1, n)
    x[:, 5] = 7.5  # constant
    gone = r.random((n, len(COLS))) < 0.1
    return [tuple(None if g else float(v) for v, g in zip(row, miss)) for row, miss in zip(x, gone)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS))


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_outliers_are_counted_without_a_row_per_value(spark):
    rows = [(float(i), None, float(i % 2), math.nan if i == 3 else 1.0, -1e6 if i < 2 else 0.0, None if i else 4.0) for i in range(100)]
    out = PR.outlier_counts(_frame(spark, rows), COLS, "iqr")
    assert {r["column"]: r["outliers"] for r in out.collect()} == {"c0": 0, "c2": 0, "c3": 0, "c4": 2, "c5": 0}
    assert "Join" not in _plan(out)
    assert PR.outlier_counts(_frame(spark, []), COLS, "iqr").count() == 0


def test_correlations_of_many_columns_are_no_wide_aggregate(spark):
    rows = _rows()
    df = _frame(spark, rows)
    out = PR.corr_long(df, COLS, None)
    assert "MapInArrow" in _plan(out)
    got = {(r["var1"], r["var2"]): r["corr"] for r in out.collect()}
    x = np.array(rows, float)
    assert len(got) == 15
    for i, a in enumerate(COLS):
        for j in range(i + 1, len(COLS)):
            ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 5 in (i, j):
                assert got[a, COLS[j]] is None
            else:
                assert got[a, COLS[j]] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-9)


def test_correlations_of_columns_with_nan_or_infinity(spark):
    # such values count as values in tables of few columns: their pairs have no number
    rows = _rows()
    rows[0] = (math.nan, 1.0, math.inf, 1.0, 1.0, 7.5)
    got = {(r["var1"], r["var2"]): r["corr"] for r in PR.corr_long(_frame(spark, rows), COLS, None).collect()}
    assert len(got) == 15
    assert math.isnan(got["c0", "c1"]) and math.isnan(got["c2", "c3"]) and math.isfinite(got["c1", "c3"])


def test_pieces_are_counted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(QU, "PIECE_ROWS", 10)
    values = [0.0, -0.0, 1.0, 1.0, 1.0, 2.5, math.inf, -math.inf, math.nan, None] * 12 + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    kept = np.sort([v for v in values if v is not None and not math.isnan(v)])
    probs = [0.1, 0.3, 0.5, 0.77, 0.9]
    got = {r["p"]: r["q"] for r in QU.column_quantiles(df, ["x"], probs).collect()}
    assert got == pytest.approx({p: float(np.quantile(kept, p)) for p in probs})
    r = [QU._Range("x", -math.inf, math.inf, 0, 10, [0])]
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"x0": pa.array([0.5, 1.0, 1.0, 1.5, 2.0, 3.0, None, math.nan])})
    out = next(QU._count_task(r, [[1.0, 2.0]])(iter([b])))
    assert out.to_pydict() == {"r": [0] * 5, "p": [0, 1, 2, 3, 4], "n": [1, 2, 1, 1, 1]}


def test_text_digests_are_not_sorted(spark):
    df = spark.createDataFrame([("a" * 40, None), ("a" * 40, "x"), ("b", "x"), (None, "y")], "s string, t string")
    assert "SortAggregate" not in _plan(FR.digest_counts(df, ["s", "t"], prefix=True), "sparkPlan")
    got = {r["column"]: (r["count"], r["unique"], r["top_value"], r["top_count"]) for r in FR.text_summary(df, ["s", "t"]).collect()}
    assert got == {"s": (3, 2, "a" * 40, 2), "t": (3, 2, "x", 2)}
