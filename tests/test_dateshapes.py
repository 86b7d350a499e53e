"""Dates by the shapes of all values of a column."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellar.operators import cleaning as CL
from cellar.operators import dateshapes as DS

D = dt.datetime
CASES = {
    "widths": (["1/2/2021", "13/02/2021", "3/11/2021"], [D(2021, 2, 1), D(2021, 2, 13), D(2021, 11, 3)]),
    "month_first": (["1/2/2021", "02/13/2021", None], [D(2021, 1, 2), D(2021, 2, 13), None]),
    "two_digit_year": (["31.12.99", "01.01.21", "5.6.07"], [D(2099, 12, 31), D(2021, 1, 1), D(2007, 6, 5)]),
    "names": (["Jan 5, 2021", "5 January 2021", "05-Jan-2021"], [D(2021, 1, 5)] * 3),
    "weekday": (["Tuesday, 5 January 2021", "Tue 5 jan 2021", "MAY 5, 2021"], [D(2021, 1, 5), D(2021, 1, 5), D(2021, 5, 5)]),
    "clock": (["1/2/2021 5:06 PM", "1/13/2021 12:00 AM", "1/13/2021 12:30pm"], [D(2021, 1, 2, 17, 6), D(2021, 1, 13), D(2021, 1, 13, 12, 30)]),
    "offsets": (["2021-01-05T10:00:00Z", "2021-01-05T10:00:00.250+02:00", "2021-01-05 10:00:00 -0330"], [D(2021, 1, 5, 10), D(2021, 1, 5, 8, 0, 0, 250000), D(2021, 1, 5, 13, 30)]),
    "mixed": (["20210105", "2021-01-06", "2021/1/7 23:59"], [D(2021, 1, 5), D(2021, 1, 6), D(2021, 1, 7, 23, 59)]),
}
NOT = {
    "conflict": ["13/2/2021", "2/13/2021", None],
    "bad_day": ["31/2/2021", "1/3/2021", "20/3/2021"],
    "numbers": ["20210105", "20210106", "12345678"],
    "parts": ["12-34-5678", "a 1/2/2021", "1/2/2021 x"],
    "versions": ["1.2.3", "1.10.12", "2.0.0"],
    "remark": ["Jan 5, 2021", "soon", "Jan 6, 2021"],
}


def _frame(spark, columns):
    rows = list(zip(*columns.values()))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_columns_of_dates(spark):
    out = CL.detect_dates(_frame(spark, {c: v for c, (v, _) in CASES.items()}))
    for c, (_, want) in CASES.items():
        assert dict(out.dtypes)[c] == "timestamp_ntz", c
        assert [r[c] for r in out.select(c).collect()] == want, c


def test_columns_that_are_no_dates_stay(spark):
    df = _frame(spark, NOT)
    out = CL.detect_dates(df)
    assert out.dtypes == df.dtypes and out.collect() == df.collect()


def test_open_order_is_reported_and_can_be_told(spark):
    df = _frame(spark, {"d": ["1/2/2021", "3/4/2021 5:00"]})
    assert DS.infer_shapes(df, ["d"])["d"].ambiguous
    assert [r["d"] for r in CL.detect_dates(df).collect()] == [D(2021, 1, 2), D(2021, 3, 4, 5)]
    assert [r["d"] for r in CL.detect_dates(df, day_first=True).collect()] == [D(2021, 2, 1), D(2021, 4, 3, 5)]
    assert not DS.infer_shapes(df, ["d"], day_first=True)["d"].ambiguous
    rows = {r["pattern"]: (r["n"], r["ambiguous"]) for r in DS.date_shapes(df, ["d"]).collect()}
    assert rows == {"M/d/yyyy": (1, True), "M/d/yyyy H:mm": (1, True)}


@pytest.mark.parametrize("s", ["", "9", "999", "99999", "9-9", "99/99/999", "9999-99-99T", "99:99", "9999-99-99 99"])
def test_shapes_that_are_no_dates(s):
    assert DS.pattern_of(s) is None


def test_many_shapes_are_never_gathered(spark):
    df = spark.range(3000).selectExpr("concat(repeat('1', cast(id % 40 as int) + 1), repeat('-', cast(id / 100 as int))) as t")
    assert DS.infer_shapes(df, ["t"]) == {}


def test_shapes_of_values_with_and_without_letters(spark):
    given = {
        "05/11/2021": "99/99/9999", "2021-01-05 10:00:00 +01:00": "9999-99-99 99:99:99" + DS.ZONE, "2021-01-05T10:00:00Z": "9999-99-99" + DS.T_MARK + "99:99:99" + DS.ZONE,
        "Monday, 3  May 2021": "9 " + DS.SHORT_MONTH + " 9999", "january 3, 2021 4:05 pm": DS.LONG_MONTH + " 9, 9999 9:99 " + DS.HALF, "x1": "a9", "no digit": None,
    }
    df = spark.createDataFrame([(t,) for t in given], "t string").select("t", DS.plain(F.col("t")).alias("v"))
    assert {r["t"]: r["s"] for r in df.select("t", DS.shape(F.col("v")).alias("s")).collect()} == given


def test_shapes_are_counted_in_one_pass_over_the_rows(spark):
    # the shapes were counted anew for each of the two uses of their table
    read = spark.sparkContext.accumulator(0)

    def task(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("05/11/2021",), ("25/1/2021",)], "t string").mapInArrow(task, "t string")
    found = DS.infer_shapes(df, ["t"])
    assert set(found["t"].patterns.values()) == {"dd/MM/yyyy", "dd/M/yyyy"} and not found["t"].ambiguous
    assert read.value == 2
