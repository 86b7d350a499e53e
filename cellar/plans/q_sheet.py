"""Query bindings: sort / top-k, lookups, table edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import aggregate as A
from cellar.operators import sheet as S
from cellar.plans.registry import register
from cellar.session import table

_O = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@register("srt_multi", f"SELECT {_O} FROM orders ORDER BY o_orderpriority ASC NULLS LAST, o_totalprice DESC NULLS LAST")
def q_sort(spark, d):
    return S.sort_multi(_orders(spark, d), ["o_orderpriority", "o_totalprice"], [True, False])


@register("top_n", f"SELECT {_O} FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_top_n(spark, d):
    return S.top_n(_orders(spark, d), "o_totalprice", 10, ["o_orderkey"])


@register("top_n_25", f"SELECT {_O} FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q_top_n25(spark, d):
    return S.top_n(_orders(spark, d), "o_totalprice", 25, ["o_orderkey"])


@register(
    "top_values",
    "SELECT l_partkey, count(*) AS count FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey ORDER BY count DESC, l_partkey LIMIT 20",
)
def q_top_values(spark, d):
    return A.top_values(table(spark, d, "lineitem"), "l_partkey", 20)


@register("preview", f"SELECT {_O} FROM orders ORDER BY o_orderkey LIMIT 10")
def q_preview(spark, d):
    return S.preview(_orders(spark, d), ["o_orderkey"], 10)


@register("preview_20", "SELECT event_id, ts, event_type, value FROM events ORDER BY ts, event_id LIMIT 20")
def q_preview20(spark, d):
    return S.preview(table(spark, d, "events").select("event_id", "ts", "event_type", "value"), ["ts", "event_id"], 20)


@register("srt_by_x", "SELECT ts, value FROM events ORDER BY ts")
def q_sort_x(spark, d):
    return S.sort_by_x(table(spark, d, "events"), "ts", "value")


@register(
    "jn_vlookup",
    """SELECT c_custkey, c_nationkey, v AS vlookup FROM customer
       LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS k, arg_min(n_name, n_nationkey) AS v FROM nation GROUP BY 1)
       ON CAST(c_nationkey AS VARCHAR) = k""",
)
def q_vlookup(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return S.vlookup(c, "c_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name", "n_nationkey")


@register(
    "jn_xlookup_default",
    """SELECT s_suppkey, s_nationkey, coalesce(v, '#N/A') AS vlookup FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 1000 ELSE s_nationkey END AS s_nationkey FROM supplier)
       LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS k, arg_min(n_name, n_nationkey) AS v FROM nation GROUP BY 1)
       ON CAST(s_nationkey AS VARCHAR) = k""",
)
def q_xlookup(spark, d):
    # every third supplier asks for a key that no nation has
    s = table(spark, d, "supplier").select(
        "s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 1000).otherwise(F.col("s_nationkey")).alias("s_nationkey")
    )
    n = table(spark, d, "nation")
    return S.vlookup(s, "s_nationkey", n, "n_nationkey", "n_name", "n_nationkey", if_missing="#N/A")


@register(
    "jn_match",
    """SELECT c_custkey, c_nationkey, m AS match FROM customer
       LEFT JOIN (SELECT CAST(n_nationkey AS VARCHAR) AS k, min(p) AS m FROM
                   (SELECT n_nationkey, row_number() OVER (ORDER BY n_name, n_nationkey) AS p FROM nation) GROUP BY 1)
       ON CAST(c_nationkey AS VARCHAR) = k""",
)
def q_match(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return S.match(c, "c_nationkey", table(spark, d, "nation"), "n_nationkey", ["n_name", "n_nationkey"])


@register(
    "jn_index",
    """SELECT o_orderkey, o_custkey * 2 AS row_no, c_name AS "index" FROM orders
       LEFT JOIN (SELECT c_name, row_number() OVER (ORDER BY c_custkey) AS p FROM customer) ON o_custkey * 2 = p""",
)
def q_index(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("row_no"))
    return S.index(o, "row_no", table(spark, d, "customer"), "c_name", ["c_custkey"])


@register(
    "edit_add_null_row",
    "SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, NULL",
)
def q_add_row(spark, d):
    return S.add_null_row(table(spark, d, "region"))


@register(
    "edit_drop_last_row",
    "SELECT * FROM nation WHERE n_nationkey <> (SELECT max(n_nationkey) FROM nation)",
)
def q_drop_last_row(spark, d):
    return S.drop_last_row(table(spark, d, "nation"), ["n_nationkey"])


@register("edit_add_column", "SELECT r_regionkey, r_name, CAST(NULL AS VARCHAR) AS notes FROM region")
def q_add_col(spark, d):
    return S.add_column(table(spark, d, "region"), "notes")


@register("edit_drop_last_column", "SELECT n_nationkey, n_name FROM nation")
def q_drop_col(spark, d):
    return S.drop_last_column(table(spark, d, "nation"))


@register("edit_rename_column", "SELECT r_regionkey, r_name AS region_name FROM region")
def q_rename(spark, d):
    return S.rename_column(table(spark, d, "region"), "r_name", "region_name")


@register(
    "edit_apply_overlay",
    """WITH ch AS (
         SELECT r_regionkey AS n_nationkey, r_name AS new_name, CAST(NULL AS INTEGER) AS new_region, false AS del FROM region
         UNION ALL SELECT 100 + r_regionkey, 'NEW ' || r_name, r_regionkey, false FROM region
         UNION ALL SELECT n_nationkey, NULL, NULL, true FROM nation WHERE n_nationkey >= 20)
       SELECT coalesce(n.n_nationkey, ch.n_nationkey) AS n_nationkey, coalesce(ch.new_name, n.n_name) AS n_name,
              coalesce(ch.new_region, n.n_regionkey) AS n_regionkey
       FROM nation n FULL OUTER JOIN ch ON n.n_nationkey = ch.n_nationkey
       WHERE NOT coalesce(ch.del, false)""",
)
def q_overlay(spark, d):
    r = table(spark, d, "region")
    n = table(spark, d, "nation")
    edits = r.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"), F.lit(False).alias("__deleted"))
    inserts = r.select(
        (F.col("r_regionkey") + 100).alias("n_nationkey"),
        F.concat(F.lit("NEW "), F.col("r_name")).alias("n_name"),
        F.col("r_regionkey").alias("n_regionkey"),
        F.lit(False).alias("__deleted"),
    )
    deletes = n.filter(F.col("n_nationkey") >= 20).select("n_nationkey", F.lit(True).alias("__deleted"))
    changes = edits.unionByName(inserts, allowMissingColumns=True).unionByName(deletes, allowMissingColumns=True)
    return S.apply_overlay(n, changes, "n_nationkey")
