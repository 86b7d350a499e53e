"""CSV records with line breaks in quoted cells, over several splits of a file."""

from __future__ import annotations

import csv

import pytest
from pyspark.sql import functions as F

from cellar.sources import csvtext as CT
from cellar.sources import files as SF

TEXTS = [
    "plain", "a\nb", "\n", "\n\n\nx", 'say "x"', '"', '""', '"\n"', 'a",\n"b', "x,y", " lead and trail ", "tab\tx", "é\nñ", "long\n" * 300,
    'many "quotes"\n' * 50, "back\\slash", 'end\\"', "5\" pipe", "last",
]


def _back(spark, path, **kw):
    return [tuple(r) for r in SF.read_csv(spark, path, clean=False, schema="id int, text string, n int", **kw).orderBy("id").collect()]


@pytest.mark.parametrize("split", ["128m", "4k", "300"])
def test_round_trip_of_any_text(spark, split):
    rows = [(i, t, i) for i, t in enumerate(TEXTS * 20)] + [(9000, None, None), (9001, None, 1)]
    given = [*rows[:-1], (9001, "", 1)]  # an empty text comes back as missing
    path = SF.write_csv(spark.createDataFrame(given, "id int, text string, n int").repartition(3), SF.scratch_dir(spark, "t-csv"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        n = CT.split_states(CT.lines(spark, path, "UTF-8"))
        assert n.count() > (3 if split != "128m" else 0) and (split == "128m" or n.where("inside").count() > 0)
        assert _back(spark, path) == rows
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_record_longer_than_several_splits_and_crlf_files(spark, tmp_path):
    rows = [(0, "a"), (1, "line\r\n" * 400), (2, 'q"\r\n"'), (3, "z")]
    for k in range(2):
        with open(tmp_path / f"{k}.csv", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\r\n")
            w.writerow(["id", "a \n name"])
            w.writerows([(i + 10 * k, t) for i, t in rows])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        got = SF.read_csv(spark, str(tmp_path), clean=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got.columns == ["id", "a \n name"] and dict(got.dtypes)["id"] == "int"
    assert sorted(map(tuple, got.collect())) == sorted((i + 10 * k, t) for k in range(2) for i, t in rows)


def test_latin1_with_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('id,t\n1,"é\nñ"\n2,ü\n'.encode("latin-1"))
    assert sorted(map(tuple, SF.read_csv(spark, str(tmp_path), clean=False).collect())) == [(1, "é\nñ"), (2, "ü")]


def test_without_line_breaks_spark_reads_the_files(spark):
    path = SF.write_csv(spark.range(5).withColumn("t", F.lit('a "b", c')), SF.scratch_dir(spark, "t-csv"))
    df = SF.read_csv(spark, path, clean=False)
    assert "FileScan csv" in df._jdf.queryExecution().toString() and df.count() == 5


def test_only_ends_of_splits_are_shuffled(spark):
    path = SF.write_csv(spark.range(2000).withColumn("t", F.lit("a\nb")).coalesce(1), SF.scratch_dir(spark, "t-csv"))
    every = CT.lines(spark, path, "UTF-8")
    rec = CT.records(every, CT.split_states(every))
    assert rec.count() == 2001 and rec.where("header").count() == 1
    # the window and the grouping read the pieces at split ends only
    cut = every.select("split").distinct().count()
    assert cut >= 1
