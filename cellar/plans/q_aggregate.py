"""Query bindings: grouping, pivots, sheet aggregates, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.operators import aggregate as A
from cellar.operators import filters as FL
from cellar.plans.registry import register
from cellar.session import table


def _lineitem_nulls(spark, d):
    """lineitem with derived nulls (the test tables have none)."""
    return table(spark, d, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))


@register(
    "agg_groupby_multi",
    """
    SELECT l_returnflag, l_linestatus,
           round(coalesce(sum(l_quantity), 0), 2) AS l_quantity_sum,
           round(avg(l_quantity), 2) AS l_quantity_mean,
           count(l_quantity) AS l_quantity_count,
           round(coalesce(sum(l_extendedprice), 0), 2) AS l_extendedprice_sum,
           round(avg(l_extendedprice), 2) AS l_extendedprice_mean,
           count(l_extendedprice) AS l_extendedprice_count,
           round(coalesce(sum(nullif(l_discount, 0)), 0), 2) AS l_discount_sum,
           round(avg(nullif(l_discount, 0)), 2) AS l_discount_mean,
           count(nullif(l_discount, 0)) AS l_discount_count
    FROM lineitem
    GROUP BY l_returnflag, l_linestatus
    """,
)
def q_groupby_multi(spark, d):
    return A.groupby_multi(_lineitem_nulls(spark, d), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount"])


@register(
    "agg_pivot",
    """
    SELECT c_mktsegment, coalesce(sum(c_acctbal), 0) AS "sum(c_acctbal)"
    FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment
    """,
)
def q_pivot(spark, d):
    return A.pivot(table(spark, d, "customer"), "c_mktsegment", "c_acctbal", "sum").withColumn(
        "sum(c_acctbal)", F.round("sum(c_acctbal)", 4)
    )


def _pivot_fn(func, sql_expr):
    @register(
        f"agg_pivot_{func}",
        f"""
        SELECT l_returnflag, {sql_expr} AS "{func}(l_discount)"
        FROM lineitem GROUP BY l_returnflag
        """,
    )
    def q(spark, d):
        out = A.pivot(_lineitem_nulls(spark, d), "l_returnflag", "l_discount", func)
        col = f"{func}(l_discount)"
        return out.withColumn(col, F.round(F.col(col), 6) if func != "count" else F.col(col))

    return q


_pivot_fn("mean", "round(avg(nullif(l_discount, 0)), 6)")
_pivot_fn("count", "count(nullif(l_discount, 0))")
_pivot_fn("min", "round(min(nullif(l_discount, 0)), 6)")
_pivot_fn("max", "round(max(nullif(l_discount, 0)), 6)")


@register(
    "agg_pivot_smc",
    """
    SELECT p_type, round(coalesce(sum(p_retailprice), 0), 4) AS "Total",
           round(avg(p_retailprice), 4) AS "Average", count(p_retailprice) AS "Count"
    FROM part WHERE p_type IS NOT NULL GROUP BY p_type
    """,
)
def q_pivot_smc(spark, d):
    # the key is picked by name hint ('type'), the value is the first numeric column
    part = table(spark, d, "part").select("p_name", "p_brand", "p_type", "p_retailprice", "p_size")
    out = A.pivot_smc(part)
    return out.select("p_type", F.round("Total", 4).alias("Total"), F.round("Average", 4).alias("Average"), "Count")


@register(
    "agg_value_counts",
    """
    SELECT o_orderpriority, count(*) AS count FROM orders
    WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority
    """,
)
def q_value_counts(spark, d):
    return A.value_counts(table(spark, d, "orders"), "o_orderpriority")


_SHEET_SQL = """
SELECT round(coalesce(sum(l_quantity), 0) + coalesce(sum(nullif(l_discount, 0)), 0) + 100.0, 4) AS sheet_sum,
       round((coalesce(sum(l_quantity), 0) + coalesce(sum(nullif(l_discount, 0)), 0) + 100.0)
             / (count(l_quantity) + count(nullif(l_discount, 0)) + 1), 6) AS sheet_average,
       least(min(l_quantity), min(nullif(l_discount, 0)), 100.0) AS sheet_min,
       greatest(max(l_quantity), max(nullif(l_discount, 0)), 100.0) AS sheet_max,
       count(l_quantity) + count(nullif(l_discount, 0)) + 1 AS sheet_count
FROM lineitem
"""


@register("agg_sheet_functions", _SHEET_SQL)
def q_sheet(spark, d):
    out = A.sheet_aggregates(_lineitem_nulls(spark, d), ["l_quantity", "l_discount", 100])
    return out.select(
        F.round("sheet_sum", 4).alias("sheet_sum"),
        F.round("sheet_average", 6).alias("sheet_average"),
        "sheet_min",
        "sheet_max",
        "sheet_count",
    )


@register(
    "set_union_all",
    """
    SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem
    UNION ALL
    SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem
    """,
)
def q_union(spark, d):
    li = table(spark, d, "lineitem")
    a = li.select("l_returnflag", "l_linestatus", "l_linenumber")
    return A.union_all(a, a)


@register(
    "set_distinct",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
)
def q_distinct(spark, d):
    return A.distinct(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


@register(
    "set_distinct_report",
    """
    SELECT count(*) AS n_rows,
           (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)) AS n_distinct,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem)) AS n_removed
    FROM lineitem
    """,
)
def q_distinct_report(spark, d):
    return A.distinct_report(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def _sheet_fn(key: str, col: str):
    @register(key, f"SELECT {col} FROM ({_SHEET_SQL})")
    def q(spark, d):
        return q_sheet(spark, d).select(col)

    return q


for _k, _c in [("agg_sheet_sum", "sheet_sum"), ("agg_sheet_average", "sheet_average"), ("agg_sheet_min", "sheet_min"),
               ("agg_sheet_max", "sheet_max"), ("agg_sheet_count", "sheet_count")]:
    _sheet_fn(_k, _c)
