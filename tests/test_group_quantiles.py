"""Quantiles of many groups, narrowed for large ones."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellar.operators import chartdata as C
from cellar.operators.group_quantiles import group_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [("hot", float(v)) for v in np.round(rng.normal(size=30000), 3)]
    rows += [("one value", 4.0)] * 9000 + [("two values", float(i % 2)) for i in range(9000)]
    rows += [("even", float(i)) for i in range(9000)] + [(f"g{i % 700}", float(v)) for i, v in enumerate(rng.exponential(size=6000))]
    rows += [("single", 1.5), ("missing", None), ("nan", float("nan")), (None, 3.0), ("mixed", None), ("mixed", 2.0), ("mixed", float("nan"))]
    return rows, spark.createDataFrame(rows, "g string, x double").repartition(7)


@pytest.mark.parametrize("piece_rows", [200_000, 500, 40])
def test_equal_to_a_sort_of_each_group(table, piece_rows):
    rows, df = table
    values = {}
    for g, x in rows:
        if g is not None and x is not None and x == x:
            values.setdefault(g, []).append(x)
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "x", PROBS, piece_rows).collect()}
    assert set(got) == set(values)
    for g, v in values.items():
        assert got[g]["n"] == len(v) and np.allclose(got[g]["qs"], np.quantile(v, PROBS), rtol=1e-12, atol=1e-12), g


def test_several_keys_and_no_rows(spark, table):
    _, df = table
    two = df.withColumn("h", F.length("g") % 2)
    a = {(r["g"], r["h"]): r["qs"] for r in group_quantiles(two, ["g", "h"], "x", [0.5], 1000).collect()}
    b = {r["g"]: r["qs"] for r in group_quantiles(df, ["g"], "x", [0.5]).collect()}
    assert {g: q for (g, _), q in a.items()} == b
    assert group_quantiles(df.where("false"), ["g"], "x", PROBS).count() == 0
    # columns with the names used inside
    odd = df.select(F.col("g").alias("k0"), F.col("x").alias("lo"), F.lit(1).alias("x"), F.lit(2).alias("ranks"))
    assert {r["k0"]: r["qs"] for r in group_quantiles(odd, ["k0"], "lo", [0.5], 1000).collect()} == b


def test_box_of_one_hot_group(table):
    rows, df = table
    hot = np.array([x for g, x in rows if g == "hot"])
    r = C.box(df, "x", "g").where("g = 'hot'").first()
    q1, q3 = np.quantile(hot, [0.25, 0.75])
    fits = (hot >= q1 - 1.5 * (q3 - q1)) & (hot <= q3 + 1.5 * (q3 - q1))
    assert (r["n"], r["n_outliers"]) == (len(hot), (~fits).sum()) and np.isclose(r["lower_whisker"], hot[fits].min()) and np.isclose(r["upper_whisker"], hot[fits].max())
