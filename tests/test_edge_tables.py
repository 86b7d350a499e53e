"""Hand-made edge tables (FIXTURES §4): nulls, ties, constants, empty, one row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellar.operators import aggregate as A
from cellar.operators import filters as FL
from cellar.operators import flags as FG
from cellar.operators import profile as P
from cellar.operators.quantiles import column_quantiles
from cellar.functions.safe import round_num


@pytest.fixture
def numbers(spark):
    vals = [1.0, 2.0, 2.0, 3.0, None, 10.0]
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "k int, x double")


def test_ne_keeps_nulls(numbers):
    out = FL.num_filter(numbers, "x", "ne", 2.0)
    assert sorted(r.k for r in out.collect()) == [0, 3, 4, 5]


def test_unknown_column_and_operator_raise(numbers):
    with pytest.raises(ValueError):
        FL.num_filter(numbers, "nope", "gt", 1)
    with pytest.raises(ValueError):
        FL.num_filter(numbers, "x", "~", 1)


def test_numeric_profile_matches_pandas(spark, numbers):
    prof = P.numeric_profile(numbers, ["x"]).first()
    s = pd.Series([1.0, 2.0, 2.0, 3.0, 10.0])
    assert prof["count"] == 5 and prof["missing"] == 1
    assert prof["mean"] == round(s.mean(), 3)
    assert prof["median"] == round(s.median(), 3)
    assert prof["mode"] == 2.0
    assert prof["std"] == round(s.std(), 3)
    assert prof["q1"] == round(s.quantile(0.25), 3) and prof["q3"] == round(s.quantile(0.75), 3)
    # population skewness / excess kurtosis (SciPy defaults)
    m = s.mean()
    m2, m3, m4 = ((s - m) ** 2).mean(), ((s - m) ** 3).mean(), ((s - m) ** 4).mean()
    assert prof["skewness"] == pytest.approx(round(m3 / m2**1.5, 3), abs=1e-3)
    assert prof["kurtosis"] == pytest.approx(round(m4 / m2**2 - 3, 3), abs=1e-3)
    assert prof["outliers"] == 1  # 10 is outside Q3 + 1.5 IQR


def test_mode_tie_goes_to_smallest(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,)], "x double")
    assert P.numeric_profile(df, ["x"]).first()["mode"] == 1.0


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(2.0, float(i)) for i in range(5)], "c double, y double")
    assert P.corr_long(df, ["c", "y"]).first()["corr"] is None


def test_group_sum_null_keys_dropped_and_all_null_sum_zero(spark):
    df = spark.createDataFrame([("a", None), (None, 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    out = {r["k"]: r["sum(v)"] for r in A.pivot(df, "k", "v", "sum").collect()}
    assert out == {"a": 0.0, "b": 2.0}


def test_empty_and_single_row(spark):
    empty = spark.createDataFrame([], "x double")
    assert P.numeric_profile(empty, ["x"]).count() == 0
    one = spark.createDataFrame([(5.0,)], "x double")
    r = P.numeric_profile(one, ["x"]).first()
    assert r["median"] == 5.0 and r["q1"] == 5.0 and r["outliers"] == 0


def test_exact_quantiles_match_numpy_with_heavy_ties(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.integers(0, 5, 1000).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in column_quantiles(df, ["x"], probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(float(np.quantile(vals, p)), rel=1e-12, abs=1e-12)


def test_round_num_rounds_the_binary_value():
    # 70.695 is stored as 70.69499999..., pandas/NumPy and DuckDB give 70.69
    assert round(70.695, 2) == 70.69


def test_round_num_column(spark):
    df = spark.createDataFrame([(70.695,), (-2.5,), (0.125,)], "x double")
    got = [r[0] for r in df.select(round_num("x", 2)).collect()]
    assert got == [70.69, -2.5, 0.13]


def test_flags_on_nulls(spark, numbers):
    out = FG.blanks(FG.above_average(numbers, "x"), "x")
    r = {row.k: (row.x_above_avg, row.x_blank) for row in out.collect()}
    assert r[4] == (False, True)
    assert r[5] == (True, False)  # 10 > mean 3.6


def test_duplicates_expand_hot_rows(spark):
    rows = [("a", 1)] * 5 + [("b", 2)] * 2 + [("c", 3)]
    df = spark.createDataFrame(rows, "s string, n int")
    out = FL.duplicates(df, chunk=2)  # tiny chunk exercises the two-level expansion
    assert sorted(tuple(r) for r in out.collect()) == sorted([("a", 1)] * 5 + [("b", 2)] * 2)


def test_isin_long_list_uses_semi_join(spark):
    df = spark.range(5000).withColumn("k", F.col("id") % 1700)
    vals = list(range(0, 1700, 2))
    small = FL.isin(df, "k", vals[:10]).count()
    big = FL.isin(df, "k", vals).count()  # > ISIN_LITERAL_LIMIT values
    assert small == df.filter(F.col("k").isin(vals[:10])).count()
    assert big == df.filter(F.col("k") % 2 == 0).count()


def test_sheet_aggregates_mix_columns_and_constants(spark, numbers):
    r = A.sheet_aggregates(numbers, ["x", 5]).first()
    assert r["sheet_sum"] == 23.0 and r["sheet_count"] == 6
    assert r["sheet_average"] == pytest.approx(23.0 / 6)
    assert r["sheet_min"] == 1.0 and r["sheet_max"] == 10.0


def test_text_fixtures(spark):
    from cellar.operators import cleaning as CL

    texts = ["C++, java", "  x ", "", "None", "ÄÖÜ", "y" * 1500, "a||b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in CL.clean_strings(df).collect()]
    assert got == ["C++, java", "x", None, None, "", "y" * 1500, "a||b"]
    parts = CL.split_column(df.limit(7), "t", "||").filter(F.col("t") == "a||b").first()
    assert (parts["t_part1"], parts["t_part2"]) == ("a", "b")


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    m = P.missing(df).first()
    assert m["missing_count"] == 2 and math.isclose(m["missing_pct"], 66.67)
