"""Generators (property checks), file sources/sinks and the streaming wrapper."""

from __future__ import annotations

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from cellar.operators import cleaning as CL
from cellar.sources import files as SF
from cellar.sources import jobs as J
from cellar.streaming import stateless as ST

SF_SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_round_trip_with_cleaning(spark):
    df = spark.createDataFrame(
        [(1, " 2021-01-05 ", "12", "  a "), (2, "2021-02-05", "x", None), (3, "2021-03-07", "7.5", "nan")],
        "id int, `when` string, `amount ($)` string, label string",
    )
    path = SF.write_csv(df, SF.scratch_dir(spark, "t-csv"))
    out = SF.read_csv(spark, path).orderBy("id")
    # the one value of amount that is no number is kept beside it
    assert out.columns == ["id", "when", "amount", "label", "amount_text"]
    assert [x["amount_text"] for x in out.collect()] == [None, "x", None]
    r = out.collect()
    # the CSV reader may already type it as a date; either way it is no longer text
    assert r[0]["when"].isoformat()[:10] == "2021-01-05"
    assert [x["amount"] for x in r] == [12.0, None, 7.5]
    assert [x["label"] for x in r] == ["a", None, None]


def test_job_table_header_promotion(spark):
    rows = [("#", "Job Title", "Company Name"), ("1", "Data Scientist", "Acme"), ("2", "Backend Developer", "Initech")]
    path = SF.scratch_dir(spark, "jobs")
    spark.createDataFrame(rows, "a string, b string, c string").coalesce(1).write.option("header", True).csv(path)
    jobs = J.load_job_table(spark, path)
    assert jobs.columns == ["#", "Job Title", "Company Name"]
    assert jobs.count() == 2


def test_default_jobs_table(spark):
    jobs = J.default_jobs(spark)
    assert jobs.count() == 8
    assert jobs.filter(F.col("title") == "Data Scientist").first()["education_required"] == "Masters"


def test_stream_runs_stateless_operator(spark):
    out = ST.run(spark, f"{SF_SMALL}/events.parquet", lambda s: CL.clean_strings(s.select("event_id", "event_type")))
    assert out.count() == spark.read.parquet(f"{SF_SMALL}/events.parquet").count()


def test_documents_are_written_by_the_tasks_alone(spark):
    # a commit by the driver moved every file
    given = [("a", "x"), ("b/c=d%", "two\nlines\n"), (None, "no key"), ("e", None), ("a", "y")]
    path = SF.write_documents(spark.createDataFrame(given, "doc_id string, text string"), SF.scratch_dir(spark, "docs"))
    assert not any(f.getPath().getName().startswith("_") for f in _files(spark, path))
    back = SF.read_text_corpus(spark, path, id_col="doc_id", record_end=True)
    got = sorted(((r[0] or "", r[1]) for r in back.collect()))
    assert got in ([("", "no key"), ("a", a), ("b/c=d%", "two\nlines\n"), ("e", "")] for a in ("x\ny", "y\nx"))


def test_documents_are_listed_and_read_by_the_tasks(spark):
    # the driver kept an entry for every file, and its reader took a few files a task
    docs = spark.range(300).select((F.col("id") * 7).alias("doc_id"), F.expr("concat('text ', id, repeat('\\n', int(id % 3)))").alias("text"))
    path = SF.write_documents(docs, SF.scratch_dir(spark, "docs"))
    back = SF.read_text_corpus(spark, path, id_col="doc_id", record_end=True)
    assert not any("doc_id=" in f for f in back.inputFiles())
    assert back.schema.simpleString() == "struct<doc_id:int,text:string>"
    assert _rows(back) == _rows(docs)


@pytest.mark.parametrize(
    ("files", "by_tasks"),
    [
        ({"k=007/a.txt": b"x\n", "k=-2/b.txt": b"\n\n", "k=3/c.txt": b"", "k=5/.c.txt": b"no", "_SUCCESS": b""}, True),
        ({"k=1/a.txt": b"\xff\x00\xe2\x82", "k=9999999999/a.txt": b"\xef\xbb\xbfb", "k=__HIVE_DEFAULT_PARTITION__/a.txt": b"c"}, True),
        ({"k=1/a.txt": b"1", "k=1/b.txt": b"2", "k=a%2Fb%%41/c.txt": b"3", "k=a=b/c.txt": b"4"}, True),
        ({"k=2020-01-01/a.txt": b"x"}, False),
        ({"k=1/a.txt": b"x", "k=1.5/a.txt": b"y"}, False),
        ({"k=__HIVE_DEFAULT_PARTITION__/a.txt": b"x"}, False),
        ({"k=1/a.txt": b"x", "k=2/b.txt.gz": gzip.compress(b"packed")}, False),
        ({"k=1/j=2/a.txt": b"x"}, False),
        ({"K=1/a.txt": b"x"}, False),
        ({"a.txt": b"x", "b.txt": b"y"}, False),
    ],
)
def test_document_folders_read_as_by_spark(spark, tmp_path, files, by_tasks):
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    back = SF.read_text_corpus(spark, str(tmp_path), id_col="k")
    plain = spark.read.text(str(tmp_path), wholetext=True)
    key = F.col("k") if "k" in plain.columns else F.col("_metadata.file_path").alias("path")
    plain = plain.select(key, F.col("value").alias("text"))
    exact = lambda df: sorted(map(repr, df.withColumn("text", F.hex("text")).collect()))
    assert back.schema.simpleString() == plain.schema.simpleString()
    assert exact(back) == exact(plain)
    assert any(f"/{n}" in f for n in files for f in back.inputFiles()) != by_tasks


def _files(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)


def test_stream_reads_a_table_of_part_files(spark):
    path = SF.scratch_dir(spark, "stream-parts") + "/documents.parquet"
    spark.createDataFrame([(1, " a "), (2, None), (3, "b@c.org")], "doc_id long, text string").repartition(3).write.parquet(path)
    out = ST.run(spark, path, lambda s: CL.clean_strings(s, ["text"]))
    assert sorted(out.collect()) == [(1, "a"), (2, None), (3, "b@c.org")]


def test_sink_all_tables_skips_empty_and_keeps_whole_names(spark):
    base = SF.scratch_dir(spark, "tables-t")
    names = SF.write_all_tables(
        {"a" * 40: spark.range(3), "empty": spark.range(0)},
        base,
    )
    assert names == ["a" * 40]


def test_materialize_uses_the_session_checkpoint_folder(spark):
    from cellar.session import materialize

    folder = spark.conf.get("spark.checkpoint.dir")
    m = materialize(spark.range(10).withColumn("x", F.col("id") * 2))
    assert m.count() == 10
    assert all(folder.rstrip("/") in f for f in m.inputFiles())


def test_materialize_frees_the_shuffles_behind_it(spark):
    from cellar.session import materialize

    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    kept = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager
    files = lambda: sum(1 for f in kept().getAllBlocks().mkString("|").split("|") if f.startswith("shuffle_"))
    n = files()
    m = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert files() <= n and m.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == before
