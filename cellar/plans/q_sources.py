"""Query bindings: sources, sinks and streaming round trips.

Each query writes a given table with a sink into a fresh folder under the
cluster's checkpoint folder, reads it back with the matching source, and
returns the result, so reader and writer are both exercised on whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import cleaning as CL
from cellar.operators import filters as FL
from cellar.operators import textmine as TM
from cellar.plans.q_findings import _CUST_COLS, _report_sql
from cellar.plans.registry import register
from cellar.session import table
from cellar.sources import files as SF
from cellar.sources import jobs as JO
from cellar.streaming import stateless as ST


@register(
    "src_csv",
    """SELECT CAST(o_orderkey AS SMALLINT) AS o_orderkey, CAST(o_custkey AS SMALLINT) AS o_custkey, o_orderstatus,
              o_totalprice, o_orderdate, o_orderpriority FROM orders""",
)
def q_src_csv(spark, d):
    path = SF.write_csv(table(spark, d, "orders"), SF.scratch_dir(spark, "csv"))
    out = SF.read_csv(spark, path)
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@register("src_csv_line_breaks", "SELECT doc_id, text, '\"' || text || '\",' || chr(10) || chr(10) || 'x' AS quoted, lang, n_chars FROM documents")
def q_src_csv_line_breaks(spark, d):
    # whole texts with line breaks, separators and quotes go through the sink and come back row for row
    docs = table(spark, d, "documents").withColumn("quoted", F.expr("""'"' || text || '",\\n\\nx'""")).select("doc_id", "text", "quoted", "lang", "n_chars")
    path = SF.write_csv(docs, SF.scratch_dir(spark, "csv-lines"))
    return SF.read_csv(spark, path, clean=False, schema="doc_id long, text string, quoted string, lang string, n_chars long")


@register(
    "src_csv_latin1",
    """SELECT CAST(n_nationkey AS TINYINT) AS n_nationkey, n_name || 'é' AS n_name, CAST(n_regionkey AS TINYINT) AS n_regionkey FROM nation""",
)
def q_src_csv_latin1(spark, d):
    # a Latin-1 file: the encoding check finds invalid UTF-8 and reads it as ISO-8859-1
    n = table(spark, d, "nation").withColumn("n_name", F.concat("n_name", F.lit("é")))
    path = SF.scratch_dir(spark, "csv-latin1")
    n.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    out = SF.read_csv(spark, path, clean=False)
    return CL.narrow_types(out)


@register(
    "src_job_table",
    """SELECT CAST(p_partkey AS VARCHAR) AS "#", p_name AS "Job Title", p_brand AS "Company Name" FROM part
       UNION ALL SELECT 'x', 'Job Title', 'a row that is no heading'""",
)
def q_src_job_table(spark, d):
    # four files, each with a heading row first; one row holds the heading's word and must stay
    p = table(spark, d, "part").select(
        (F.col("p_partkey") % 4).cast("int").alias("file"), F.lit(1).alias("body"),
        F.col("p_partkey").cast("string").alias("a"), F.col("p_name").alias("b"), F.col("p_brand").alias("c"),
    )
    odd = spark.createDataFrame([(1, 1, "x", "Job Title", "a row that is no heading")], p.schema)
    heads = spark.range(4).select(F.col("id").cast("int").alias("file"), F.lit(0).alias("body"), F.lit("#").alias("a"), F.lit("Job Title").alias("b"), F.lit("Company Name").alias("c"))
    rows = p.unionAll(odd).unionAll(heads).repartitionById(4, F.col("file")).sortWithinPartitions("file", "body").drop("file", "body")
    return JO.load_job_table(spark, SF.write_csv(rows, SF.scratch_dir(spark, "jobs")))


@register("src_text_corpus", "SELECT doc_id, text || repeat(chr(10), (doc_id % 3)::INTEGER) AS text FROM documents")
def q_src_text(spark, d):
    docs = table(spark, d, "documents").withColumn("text", F.expr("text || repeat('\\n', int(doc_id % 3))"))
    path = SF.write_documents(docs, SF.scratch_dir(spark, "corpus"))
    return SF.read_text_corpus(spark, path, id_col="doc_id", record_end=True).withColumn("doc_id", F.col("doc_id").cast("bigint"))


@register("sink_csv", "SELECT * FROM lineitem")
def q_sink_csv(spark, d):
    li = table(spark, d, "lineitem")
    path = SF.write_csv(li, SF.scratch_dir(spark, "sink"))
    return spark.read.schema(li.schema).option("header", True).csv(path)


@register(
    "sink_all_tables",
    "SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region_name_that_is_longer_than_31_chars', count(*) FROM region UNION ALL SELECT 'region_name_that_is_longer_than_31_chars_too', count(*) FROM part",
)
def q_sink_all(spark, d):
    tables = {
        "nation": table(spark, d, "nation"),
        "region_name_that_is_longer_than_31_chars": table(spark, d, "region"),
        "region_name_that_is_longer_than_31_chars_too": table(spark, d, "part"),
        "empty": table(spark, d, "region").filter(F.lit(False)),
    }
    base = SF.scratch_dir(spark, "tables")
    names = SF.write_all_tables(tables, base)
    out = None
    for n in names:
        part = spark.read.parquet(f"{base}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@register("sink_report", f"SELECT report || chr(10) AS value FROM ({_report_sql('customer', _CUST_COLS)})")
def q_sink_report(spark, d):
    from cellar.operators.findings import report

    path = SF.write_report(report(table(spark, d, "customer")), SF.scratch_dir(spark, "report"))
    return spark.read.text(path, wholetext=True)


@register(
    "stream_flt_text_contains",
    "SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'red')",
)
def q_stream_filter(spark, d):
    return ST.run(spark, f"{d}/part.parquet", lambda s: FL.text_contains(s.select("p_partkey", "p_name", "p_type"), "p_name", "RED"))


@register(
    "stream_clean_strings",
    """SELECT doc_id, regexp_replace(
         CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') IN ('nan', 'None', '<NA>', 'null', 'NaT', '') THEN NULL
              ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, '[^\\x00-\\x7F]+', '', 'g') AS text FROM documents""",
)
def q_stream_clean(spark, d):
    return ST.run(spark, f"{d}/documents.parquet", lambda s: CL.clean_strings(s.select("doc_id", "text"), ["text"]))


@register(
    "stream_txt_contact",
    """SELECT doc_id, nullif(regexp_extract(text, '(^|[^\\p{L}\\p{N}_])([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,})($|[^\\p{L}\\p{N}_])', 2), '') AS email
       FROM documents""",
)
def q_stream_contact(spark, d):
    return ST.run(
        spark,
        f"{d}/documents.parquet",
        lambda s: s.select("doc_id", TM.contact_info(F.col("text"))["email"].alias("email")),
    )
