"""Modes by hash slots, text columns by digests, cleaning without loss, long white space."""

from __future__ import annotations

import collections
import random
import time

import pytest
from pyspark.sql import functions as F

from cellar.operators import cleaning as CL
from cellar.operators import frequent as FR
from cellar.operators import profile as PR
from cellar.operators import textmine as TM


def _mode(values):
    n = collections.Counter(v for v in values if v is not None and v == v)
    return min(((-c, v) for v, c in n.items()), default=(0, None))


COLUMNS = {
    "hot": lambda r, i: float(r.choice([1.5, 2.5, 2.5, r.random()])),
    "distinct": lambda r, i: float(i) * 3.7 + 1,
    "tied": lambda r, i: float(i % 40),
    "rare": lambda r, i: float(i // 2 if i < 900 else i),
    "missing": lambda r, i: None,
    "nans": lambda r, i: float("nan") if i % 2 else float(-(i % 4)),
    "zeros": lambda r, i: [0.0, -0.0, 7.0, 7.0, float(i)][i % 5],
}


@pytest.mark.parametrize("slots,round_rows", [(1024, 10**9), (16, 400), (1, 1)])
def test_modes_equal_a_full_count(spark, slots, round_rows):
    r = random.Random(3)
    rows = [tuple(f(r, i) for f in COLUMNS.values()) for i in range(1500)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLUMNS))
    got = FR.column_modes(df, list(COLUMNS), slots=slots, round_rows=round_rows)
    for k, c in enumerate(COLUMNS):
        less, v = _mode(row[k] for row in rows)
        assert (got[c][1], got[c][0]) == (-less, v), c


def test_modes_of_every_type(spark):
    df = spark.createDataFrame(
        [(1, "b", True, 1.0), (2, "a", False, 1.0), (2, "b", None, None), (1, "a", None, None)], "i int, s string, b boolean, d double"
    ).withColumn("t", F.expr("timestamp_ntz'2020-01-01 00:00:00'")).withColumn("m", F.col("i").cast("decimal(9,2)"))
    got = FR.column_modes(df, df.columns)
    assert (got["i"], got["s"], got["b"], got["d"]) == ((1, 2), ("a", 2), (False, 1), (1.0, 2))
    filled = CL.fill_mode(df)
    assert [r["b"] for r in filled.orderBy("i", "s").collect()].count(False) == 3 and filled.dtypes == df.dtypes
    assert FR.column_modes(df.where("false"), ["i", "s"]) == {"i": (None, 0), "s": (None, 0)}
    assert CL.fill_mode(df, []).collect() == df.collect()


def test_most_slots_are_never_counted_by_value(spark):
    df = spark.range(100000).select(F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.col("id").cast("double")).alias("x"))
    spark.sparkContext.setJobGroup("modes", "modes")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("modes"))
    assert FR.column_modes(df, ["x"])["x"] == (5.0, 33335)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("modes")) - before
    assert jobs <= 6  # the totals and one round: no slot but the first can hold a more frequent value


def test_text_summary_of_long_tied_and_missing_texts(spark):
    long = "the same long beginning of several texts "
    cols = {
        "tied": [long + x for x in "cbacba"] + [None],
        "short": ["x", "y", "y", "x", "", "", None],
        "hot": [long] * 4 + [long + "z"] * 3,
        "none": [None] * 7,
        "distinct": [f"{long}{9 - i}" for i in range(7)],
        "uni": ["é" * 40, "é" * 40, "é" * 39, "é" * 39, "z", None, "é" * 31],
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"`{c}` string" for c in cols))
    got = {r["column"]: tuple(r)[1:] for r in FR.text_summary(df, list(cols)).collect()}
    for c, v in cols.items():
        n = collections.Counter(x for x in v if x is not None)
        if not n:
            assert c not in got
            continue
        best = min((-k, t.encode()) for t, k in n.items())
        assert got[c] == (sum(n.values()), len(n), best[1].decode(), -best[0]), c
    assert {r["column"]: r["n"] for r in FR.distinct_counts(df, list(cols)).collect()} == {c: got[c][1] for c in got}


def test_no_exchange_of_unfiltered_values_or_texts(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    plan = FR.digest_counts(df, ["s"])._jdf.queryExecution().executedPlan().toString()
    exchange = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchange and all("hashpartitioning(column" in e and "h1" in e and "h2" in e for e in exchange)
    profile = PR.numeric_profile(df, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [column" not in profile or "value" not in profile.split("Aggregate [column")[1].split("]")[0]


def test_numbers_and_remarks_are_both_kept(spark):
    df = spark.createDataFrame([(v,) for v in ["1", "2", "3", "4", "5", "6", "see note", "n/a", None]], "v string")
    out = CL.coerce_numeric(df)
    assert out.columns == ["v", "v_text"]
    assert [tuple(r) for r in out.collect()] == [(1.0, None), (2.0, None), (3.0, None), (4.0, None), (5.0, None), (6.0, None), (None, "see note"), (None, "n/a"), (None, None)]
    assert CL.coerce_numeric(df.where("v < '9'")).columns == ["v"]
    clash = CL.coerce_numeric(df.withColumn("v_text", F.lit("x")), ["v"])
    assert clash.columns == ["v", "v_text", "v_text_1"]


def test_fill_zero_by_type(spark):
    df = spark.createDataFrame([(None, None, None, None)], "i int, b boolean, s string, d date")
    assert tuple(CL.fill_zero(df).first()) == (0, False, "0", None)
    with pytest.raises(ValueError):
        CL.fill_zero(df, ["d"])


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, " \t\r\n" * 250_000])
def test_long_white_space_is_linear(spark, run):
    rows = [("a" + run + "b", 1), (run + "certified" + run + "nurse" + run, 2), (run, 3)]
    df = spark.createDataFrame(rows, "text string, doc_id long")
    start = time.time()
    assert [r[0] for r in CL.clean_strings(df, ["text"]).orderBy("doc_id").collect()] == ["a" + run + "b", "certified" + run + "nurse", None]
    assert CL.trim_all(df).where("doc_id = 3").first()["text"] == ""
    assert CL.detect_dates(df).count() == 3 and CL.clean_pipeline(df).count() == 3
    assert TM.analyze(df).where("doc_id = 2").first()["certifications"][-1].split() == ["Certified", "Nurse"]
    assert time.time() - start < 60
