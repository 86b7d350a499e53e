"""Query bindings: cleaning and shaping. Dirty input is derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import cleaning as CL
from cellar.plans.registry import register
from cellar.session import table

# events with a mangled event_type: tokens, padding, empties, non-ASCII
_DIRTY_EV_SQL = """(SELECT event_id,
  CASE event_id % 7 WHEN 0 THEN 'nan' WHEN 1 THEN '  ' || event_type || ' ' WHEN 2 THEN '' WHEN 3 THEN 'None'
                    WHEN 4 THEN event_type || 'é' WHEN 5 THEN 'ü' ELSE event_type END AS etype,
  value FROM events)"""


def _dirty_events(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 7
    et = (
        F.when(k == 0, F.lit("nan"))
        .when(k == 1, F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")))
        .when(k == 2, F.lit(""))
        .when(k == 3, F.lit("None"))
        .when(k == 4, F.concat(F.col("event_type"), F.lit("é")))
        .when(k == 5, F.lit("ü"))
        .otherwise(F.col("event_type"))
    )
    return e.select("event_id", et.alias("etype"), "value")


@register(
    "clean_drop_empty_rows",
    """SELECT * FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS a,
                             CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS b FROM events)
       WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def q_drop_rows(spark, d):
    e = table(spark, d, "events")
    nul = F.col("event_id") % 10 == 0
    df = e.select(F.when(nul, None).otherwise(F.col("event_type")).alias("a"), F.when(nul, None).otherwise(F.col("value")).alias("b"))
    return CL.drop_empty_rows(df)


@register("clean_drop_empty_cols", "SELECT o_orderkey, o_totalprice FROM orders")
def q_drop_cols(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lit(None).cast("string").alias("empty"), "o_totalprice")
    return CL.drop_empty_cols(o)


_CLEAN_SQL = """regexp_replace(
     CASE WHEN regexp_replace({c}, '^\\s+|\\s+$', '', 'g') IN ('nan', 'None', '<NA>', 'null', 'NaT', '') THEN NULL
          ELSE regexp_replace({c}, '^\\s+|\\s+$', '', 'g') END, '[^\\x00-\\x7F]+', '', 'g')"""


@register("clean_strings", f"SELECT event_id, {_CLEAN_SQL.format(c='etype')} AS etype, value FROM {_DIRTY_EV_SQL}")
def q_clean_strings(spark, d):
    return CL.clean_strings(_dirty_events(spark, d))


@register("clean_strings_documents", f"SELECT doc_id, {_CLEAN_SQL.format(c='text')} AS text, lang FROM documents")
def q_clean_docs(spark, d):
    return CL.clean_strings(table(spark, d, "documents").select("doc_id", "text", "lang"), ["text"])


@register(
    "clean_stringify_nested",
    """SELECT o_orderkey, CAST(to_json({'key': o_custkey, 'status': o_orderstatus}) AS VARCHAR) AS s,
              CAST(to_json([o_custkey, o_orderkey]) AS VARCHAR) AS a FROM orders""",
)
def q_stringify(spark, d):
    o = table(spark, d, "orders")
    s = F.struct(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return CL.stringify_nested(o.select("o_orderkey", s.alias("s"), F.array("o_custkey", "o_orderkey").alias("a")))


_NAMES = ["Order Key", "total price ($)", "2nd-col", "  status  ", "status", "***"]


@register(
    "clean_names",
    """SELECT o_orderkey AS "Order_Key", o_totalprice AS total_price, o_custkey AS "col_2nd-col",
              o_orderstatus AS status, o_orderpriority AS status_1, o_orderdate AS column_5 FROM orders""",
)
def q_names(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return CL.clean_names(o.toDF(*_NAMES))


_DATES_SQL = """(SELECT o_orderkey,
   CASE WHEN o_orderkey % 97 = 50 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso_txt,
   strftime(o_orderdate, '%m/%d/%Y') AS us_txt,
   strftime(o_orderdate, '%Y') AS year_txt,
   o_orderpriority FROM orders)"""


def _dates_df(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 97 == 50, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("iso_txt"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_txt"),
        F.date_format("o_orderdate", "yyyy").alias("year_txt"),
        "o_orderpriority",
    )


@register(
    "clean_detect_dates",
    f"""SELECT o_orderkey, iso_txt, try_strptime(us_txt, '%m/%d/%Y') AS us_txt,
               try_strptime(year_txt, '%Y') AS year_txt, o_orderpriority FROM {_DATES_SQL}""",
)
def q_dates(spark, d):
    return CL.detect_dates(_dates_df(spark, d))


@register(
    "clean_lost_date_values",
    f"""SELECT 'iso_txt' AS "column", 'yyyy-MM-dd' AS date_format, count(*) FILTER (WHERE iso_txt = 'n/a') AS lost FROM {_DATES_SQL}
        UNION ALL SELECT 'us_txt', 'MM/dd/yyyy', 0 UNION ALL SELECT 'year_txt', 'yyyy', 0""",
)
def q_lost(spark, d):
    return CL.lost_date_values(_dates_df(spark, d))


@register(
    "clean_detect_dates_ratio",
    f"""SELECT o_orderkey, try_strptime(iso_txt, '%Y-%m-%d') AS iso_txt, CASE WHEN iso_txt = 'n/a' THEN iso_txt END AS iso_txt_text FROM {_DATES_SQL}""",
)
def q_dates_ratio(spark, d):
    return CL.detect_dates(_dates_df(spark, d).select("o_orderkey", "iso_txt"), min_ratio=0.9)


_NUMTXT_SQL = """(SELECT event_id,
   CASE WHEN event_id % 3 = 0 THEN 'junk' ELSE CAST(value AS VARCHAR) END AS v66,
   CASE WHEN event_id % 5 < 3 THEN 'x' || CAST(user_id AS VARCHAR) ELSE CAST(user_id AS VARCHAR) END AS v40,
   CASE WHEN event_id % 4 = 0 THEN 'nan' ELSE ' ' || CAST(user_id AS VARCHAR) END AS v75 FROM events)"""


def _numtxt_df(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.lit("junk")).otherwise(F.col("value").cast("string")).alias("v66"),
        F.when(F.col("event_id") % 5 < 3, F.concat(F.lit("x"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string")).alias("v40"),
        F.when(F.col("event_id") % 4 == 0, F.lit("nan")).otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("v75"),
    )


@register(
    "clean_coerce_numeric",
    f"""SELECT event_id, CASE WHEN v66 = 'junk' THEN NULL ELSE CAST(v66 AS DOUBLE) END AS v66, v40,
               CASE WHEN v75 = 'nan' THEN NULL ELSE CAST(trim(v75) AS DOUBLE) END AS v75,
               CASE WHEN v66 = 'junk' THEN v66 END AS v66_text, CASE WHEN v75 = 'nan' THEN v75 END AS v75_text FROM {_NUMTXT_SQL}""",
)
def q_coerce(spark, d):
    return CL.coerce_numeric(_numtxt_df(spark, d), ["v66", "v40", "v75"])


@register(
    "clean_narrow_types",
    """SELECT CAST(p_partkey AS SMALLINT) AS p_partkey, CAST(p_size AS TINYINT) AS p_size,
              CAST(p_size - 100 AS TINYINT) AS neg, CAST(p_partkey * 100000 AS INTEGER) AS big, p_retailprice FROM part""",
)
def q_narrow(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", "p_size", (F.col("p_size") - 100).alias("neg"), (F.col("p_partkey") * 100000).alias("big"), "p_retailprice"
    )
    return CL.narrow_types(p)


_PIPE_SQL = """(SELECT event_id AS "Event ID",
   CASE WHEN event_id % 11 = 0 THEN 'null' ELSE '  ' || event_type || '  ' END AS "event type",
   CASE WHEN event_id % 13 = 0 THEN 'junk' ELSE CAST(value AS VARCHAR) END AS "value ($)",
   CASE WHEN event_id % 17 = 15 THEN 'bad' ELSE strftime(ts, '%Y-%m-%d') END AS "day",
   strftime(ts, '%d/%m/%Y') AS us_day,
   CAST(NULL AS VARCHAR) AS empty_col,
   user_id FROM events)"""


@register(
    "clean_pipeline",
    f"""SELECT CAST("Event ID" AS SMALLINT) AS "Event_ID",
        CASE WHEN trim("event type") IN ('nan','None','<NA>','null','NaT','') THEN NULL ELSE trim("event type") END AS event_type,
        CASE WHEN "value ($)" = 'junk' THEN NULL ELSE CAST("value ($)" AS DOUBLE) END AS value,
        "day", try_strptime(us_day, '%d/%m/%Y') AS us_day,
        CAST(user_id AS SMALLINT) AS user_id, CASE WHEN "value ($)" = 'junk' THEN 'junk' END AS value_text
        FROM {_PIPE_SQL}""",
)
def q_pipeline(spark, d):
    e = table(spark, d, "events")
    df = e.select(
        F.col("event_id").alias("Event ID"),
        F.when(F.col("event_id") % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit("  "), F.col("event_type"), F.lit("  "))).alias("event type"),
        F.when(F.col("event_id") % 13 == 0, F.lit("junk")).otherwise(F.col("value").cast("string")).alias("value ($)"),
        F.when(F.col("event_id") % 17 == 15, F.lit("bad")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
        F.date_format("ts", "dd/MM/yyyy").alias("us_day"),
        F.lit(None).cast("string").alias("empty_col"),
        "user_id",
    )
    return CL.clean_pipeline(df)


@register("tool_trim_all", "SELECT event_id, regexp_replace(etype, '^\\s+|\\s+$', '', 'g') AS etype, value FROM " + _DIRTY_EV_SQL)
def q_trim(spark, d):
    return CL.trim_all(_dirty_events(spark, d))


@register(
    "tool_text_to_number",
    f"SELECT event_id, CASE WHEN v66 = 'junk' THEN NULL ELSE CAST(v66 AS DOUBLE) END AS v66, v40, v75 FROM {_NUMTXT_SQL}",
)
def q_text_num(spark, d):
    return CL.text_to_number(_numtxt_df(spark, d), "v66")


@register(
    "tool_replace_values",
    f"SELECT event_id, CASE WHEN etype = 'None' THEN 'missing' ELSE etype END AS etype, value FROM {_DIRTY_EV_SQL}",
)
def q_replace(spark, d):
    return CL.replace_values(_dirty_events(spark, d), "None", "missing")


@register(
    "tool_split_column",
    """SELECT p_partkey, p_name, string_split(p_name, ' ')[1] AS p_name_part1, string_split(p_name, ' ')[2] AS p_name_part2
       FROM part""",
)
def q_split(spark, d):
    return CL.split_column(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", " ")


@register(
    "tool_split_column_multichar",
    """SELECT p_partkey, p_brand, string_split(p_brand, 'nd#')[1] AS p_brand_part1, string_split(p_brand, 'nd#')[2] AS p_brand_part2
       FROM part""",
)
def q_split_multi(spark, d):
    return CL.split_column(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "nd#")


@register(
    "tool_merge_columns",
    """SELECT n_nationkey, n_name, r_name, concat_ws(' / ', n_name, r_name) AS "Merged"
       FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def q_merge(spark, d):
    n = table(spark, d, "nation")
    r = table(spark, d, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    return CL.merge_columns(j, ["n_name", "r_name"], " / ")


_FILL_SRC = "(SELECT event_id, user_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"


def _fill_df(spark, d):
    e = table(spark, d, "events")
    return e.select(
        "event_id",
        "user_id",
        F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("event_type")).alias("event_type"),
    )


@register(
    "tool_fill_mean",
    f"SELECT event_id, user_id, round(coalesce(value, (SELECT avg(value) FROM {_FILL_SRC})), 6) AS value, event_type FROM {_FILL_SRC}",
)
def q_fill_mean(spark, d):
    out = CL.fill_mean(_fill_df(spark, d), ["value"])
    return out.withColumn("value", F.round("value", 6))


@register(
    "tool_fill_median",
    f"SELECT event_id, user_id, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {_FILL_SRC})) AS value, event_type FROM {_FILL_SRC}",
)
def q_fill_median(spark, d):
    return CL.fill_median(_fill_df(spark, d), ["value"])


@register(
    "tool_fill_mode",
    f"""SELECT event_id, user_id,
        coalesce(value, (SELECT first(v ORDER BY n DESC, v) FROM (SELECT value v, count(*) n FROM {_FILL_SRC} WHERE value IS NOT NULL GROUP BY 1))) AS value,
        coalesce(event_type, (SELECT first(v ORDER BY n DESC, v) FROM (SELECT event_type v, count(*) n FROM {_FILL_SRC} WHERE event_type IS NOT NULL GROUP BY 1))) AS event_type
        FROM {_FILL_SRC}""",
)
def q_fill_mode(spark, d):
    return CL.fill_mode(_fill_df(spark, d), ["value", "event_type"])


@register(
    "tool_fill_zero",
    f"SELECT event_id, user_id, coalesce(value, 0) AS value, coalesce(event_type, '0') AS event_type FROM {_FILL_SRC}",
)
def q_fill_zero(spark, d):
    return CL.fill_zero(_fill_df(spark, d))


@register(
    "clean_dedupe_names",
    "SELECT o_orderkey AS total, o_totalprice AS total_1, o_custkey AS total_2, o_orderstatus AS status FROM orders",
)
def q_dedupe(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    return CL.clean_names(o.toDF("total", "total", " total ", "status"))


# one column of mixed shapes (day first, as some days are above 12), one that a 12-hour clock and month names make
_SHAPED_SQL = """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS loose,
       CAST(l_shipdate AS TIMESTAMP) + to_minutes(CAST(l_linenumber * 97 AS BIGINT)) AS clock FROM lineitem"""


@register("clean_detect_dates_shapes", _SHAPED_SQL)
def q_date_shapes(spark, d):
    li = table(spark, d, "lineitem")
    day, k = F.col("l_shipdate").cast("timestamp_ntz"), F.col("l_orderkey") % 4
    at = day + F.make_dt_interval(mins=(F.col("l_linenumber") * 97).cast("int"))
    loose = F.when(k == 0, F.date_format(day, "d/M/yyyy")).when(k == 1, F.date_format(day, "dd/MM/yyyy")).when(k == 2, F.date_format(day, "EEEE, d MMMM yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    clock = F.when(k == 0, F.date_format(at, "MMM d, yyyy h:mm a")).when(k == 1, F.date_format(at, "MMMM d, yyyy hh:mm:ss a")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    out = CL.detect_dates(li.select("l_orderkey", "l_linenumber", loose.alias("loose"), clock.alias("clock")))
    return out.select("l_orderkey", "l_linenumber", F.col("loose").cast("timestamp_ntz").alias("loose"), F.col("clock").cast("timestamp_ntz").alias("clock"))
