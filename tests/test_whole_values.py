"""Nothing is cut, and large or missing numbers stay right."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cellar.functions.safe import round_num
from cellar.operators import chartdata as CH
from cellar.operators import cleaning as CL
from cellar.operators import filters as FL
from cellar.operators import ordered as OR
from cellar.operators import textmine as TM
from cellar.sources import files as SF
from cellar.sources import jobs as J


def test_long_text_is_kept(spark):
    df = spark.createDataFrame([("x" * 5000,)], "t string")
    assert len(CL.clean_strings(df).first()["t"]) == 5000


def test_notes_after_dates_are_kept(spark):
    rows = [(i, "2024-01-%02d" % (i + 1) if i < 15 else f"note {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "k int, v string")
    assert CL.detect_dates(df).count() == CL.detect_dates(df).where("v IS NOT NULL").count() == 30
    part = CL.detect_dates(df, min_ratio=0.4)
    assert part.columns == ["k", "v", "v_text"]
    assert part.where("v_text LIKE 'note%'").count() == 15 and part.where("v IS NOT NULL").count() == 15


@pytest.mark.parametrize("text", ["31/12/2023", "2023/12/31", "Dec 31, 2023", "2023-12-31T10:00:00.250", "2023-12-31T10:00:00Z", "2023-12-31T10:00:00.250+01:00"])
def test_more_date_forms(spark, text):
    out = CL.detect_dates(spark.createDataFrame([(text,)], "v string"))
    assert out.schema["v"].dataType.typeName() == "timestamp_ntz" and out.first()["v"].year == 2023


def test_names_are_distinct():
    assert CL.dedupe_names(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert [CL.clean_name(x, 3) for x in ("a  b", "2x", "***", " a-b ", "é!")] == ["a_b", "col_2x", "column_3", "a-b", "é"]


def test_tables_keep_their_names(spark):
    base = SF.scratch_dir(spark, "names")
    names = ["n" * 31 + "1", "n" * 31 + "2"]
    assert SF.write_all_tables({names[0]: spark.range(3), names[1]: spark.range(7)}, base) == names
    assert [spark.read.parquet(f"{base}/{n}").count() for n in names] == [3, 7]
    with pytest.raises(ValueError):
        SF.write_all_tables({"a": spark.range(1), "A": spark.range(1)}, base)


def test_only_the_heading_row_is_taken_out(spark):
    rows = [("#", "Job Title", "Company"), ("1", "Job Title", "Odd Inc"), ("2", "Analyst", "Acme")]
    path = SF.scratch_dir(spark, "heads")
    spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).write.option("header", True).csv(path)
    out = J.load_job_table(spark, path)
    assert out.columns == ["#", "Job Title", "Company"] and out.count() == 2


def test_isin_has_one_path(spark):
    df = spark.createDataFrame([(i if i % 10 else None,) for i in range(3000)], "k int")
    keys = spark.range(1500).select(F.col("id").cast("int").alias("x"))
    for nulls in (False, True):
        a, b = FL.isin(df, "k", list(range(1500)), nulls), FL.isin_table(df, "k", keys, nulls)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("text", ["certified " + "word " * 20000, "word " * 20000, "word " * 20000 + "certified", "x" * 100000])
def test_mining_long_texts(spark, text):
    a = TM.analyze(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert a["certifications"] == []


def test_all_certifications(spark):
    text = ". ".join(f"certified expert number{i}" for i in range(15))
    a = TM.analyze(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert len(a["certifications"]) == 15


@pytest.mark.parametrize("x,d,want", [(1e17, 2, 1e17), (5e18, 3, 5e18), (2e11, 8, 2e11), (1e300, 2, 1e300), (-1e17, 2, -1e17), (-2.345678, 3, -2.346), (1234567890123.456, 1, 1234567890123.5)])
def test_rounding_large_numbers(spark, x, d, want):
    assert spark.range(1).select(round_num(F.lit(x), d).alias("r")).first()["r"] == want


def test_rounding_nan(spark):
    assert math.isnan(spark.range(1).select(round_num(F.lit(float("nan")), 2).alias("r")).first()["r"])


def test_rank_of_integers_beyond_double(spark):
    big = 2**53
    df = spark.createDataFrame([(big + 1,), (big,), (big + 2,), (None,)], "v bigint")
    got = {r["v"]: r["rank"] for r in OR.dense_rank(df, "v").collect()}
    assert got == {big + 2: 1, big + 1: 2, big: 3, None: None}


def test_nan_is_missing(spark):
    nan = float("nan")
    df = spark.createDataFrame([(i, float(i)) for i in range(20)] + [(20, nan), (21, None), (22, 22.0)], "k int, v double")
    assert CH.histogram(df, "v", 4).agg(F.sum("count")).first()[0] == 21
    assert FL.outliers_iqr(df, "v").count() == 0
    run = {r["k"]: r["v_running_total"] for r in OR.running_totals(df, "v", ["k"]).collect()}
    assert run[20] is None and run[22] == sum(range(20)) + 22
    filled = {r["k"]: r["v"] for r in CL.fill_mean(df, ["v"]).collect()}
    assert filled[20] == filled[21] == pytest.approx((190 + 22) / 21)


def test_buckets_over_many_partitions(spark):
    df = spark.range(0, 40000, 1, 400).withColumn("v", F.rand(3))
    b = OR.with_buckets(df, ["v", "id"], 16).groupBy("__bkt").count().collect()
    assert len(b) == 16 and max(r["count"] for r in b) < 4 * 40000 / 16


def test_quantiles_narrow_to_small_pieces(spark, monkeypatch):
    import numpy as np

    from cellar.operators import quantiles as QU

    monkeypatch.setattr(QU, "PIECE_ROWS", 50)
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.normal(0, 1, 4000), np.full(3000, 0.25), [1e300, -1e300]])
    rows = [(float(x), float(i % 7), None if i % 3 else float("nan"), None) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, none double, nul double").repartition(9)
    got = {(r["column"], r["p"]): r["q"] for r in QU.column_quantiles(df, ["a", "b", "none", "nul"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert set(c for c, _ in got) == {"a", "b"}
    for p in (0.0, 0.1, 0.25, 0.5, 0.9, 1.0):
        assert got["a", p] == pytest.approx(np.quantile(a, p)) and got["b", p] == pytest.approx(np.quantile([i % 7 for i in range(len(a))], p))
