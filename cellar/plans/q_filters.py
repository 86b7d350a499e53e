"""Query bindings: filters and predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from cellar.operators import filters as FL
from cellar.plans.registry import register
from cellar.session import table

_LI_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]
_LI_SQL = "l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0) AS l_discount, l_returnflag"


def _li(spark, d):
    return (
        table(spark, d, "lineitem")
        .withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
        .select(*_LI_COLS)
    )


_OPS = {"gt": (">", 30), "lt": ("<", 10), "ge": (">=", 30), "le": ("<=", 10), "eq": ("=", 25)}

for _name, (_sym, _v) in _OPS.items():

    def _mk(op=_name, v=_v, sym=_sym):
        @register(f"flt_num_{op}", f"SELECT {_LI_SQL} FROM lineitem WHERE l_quantity {sym} {v}")
        def q(spark, d):
            return FL.num_filter(_li(spark, d), "l_quantity", op, v)

        return q

    _mk()


@register(
    "flt_num_ne",
    f"SELECT {_LI_SQL} FROM lineitem WHERE nullif(l_discount, 0) IS DISTINCT FROM 0.05",
)
def q_ne(spark, d):
    # pandas != keeps missing values: the derived nulls stay in the result
    return FL.num_filter(_li(spark, d), "l_discount", "ne", 0.05)


@register("flt_num_between", f"SELECT {_LI_SQL} FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def q_between(spark, d):
    return FL.between(_li(spark, d), "l_quantity", 10, 20)


_PART_SQL = "SELECT p_partkey, p_name, p_type FROM part"


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_type")


@register("flt_text_contains", f"{_PART_SQL} WHERE contains(lower(p_name), 'red')")
def q_contains(spark, d):
    return FL.text_contains(_part(spark, d), "p_name", "RED")


@register("flt_text_equals", f"{_PART_SQL} WHERE lower(p_type) = 'economy'")
def q_equals(spark, d):
    return FL.text_equals(_part(spark, d), "p_type", "Economy")


@register("flt_text_starts", f"{_PART_SQL} WHERE starts_with(p_name, 'blue')")
def q_starts(spark, d):
    return FL.text_startswith(_part(spark, d), "p_name", "blue")


@register("flt_text_starts_nocase", f"{_PART_SQL} WHERE starts_with(lower(p_name), 'blue')")
def q_starts_nc(spark, d):
    return FL.text_startswith(_part(spark, d), "p_name", "BLUE", case_sensitive=False)


@register("flt_text_ends", f"{_PART_SQL} WHERE ends_with(p_name, 'bolt')")
def q_ends(spark, d):
    return FL.text_endswith(_part(spark, d), "p_name", "bolt")


@register("flt_text_regex", f"{_PART_SQL} WHERE regexp_matches(p_name, '^(red|blue) [a-z]+t$')")
def q_regex(spark, d):
    return FL.text_regex(_part(spark, d), "p_name", "^(red|blue) [a-z]+t$")


_ORD_SQL = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def _orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"
    )


@register("flt_isin", f"SELECT {_ORD_SQL} FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def q_isin(spark, d):
    return FL.isin(_orders(spark, d), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@register(
    "flt_isin_with_null",
    """
    SELECT o_orderkey, st FROM (
      SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS st FROM orders)
    WHERE st IN ('F') OR st IS NULL
    """,
)
def q_isin_null(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderstatus")).alias("st")
    )
    return FL.isin(o, "st", ["F"], include_null=True)


@register(
    "flt_date_range",
    f"SELECT {_ORD_SQL} FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01' AND o_orderdate < TIMESTAMP '1996-10-01'",
)
def q_date_range(spark, d):
    return FL.date_range(_orders(spark, d), "o_orderdate", "1996-03-01", "1996-09-30")


@register(
    "flt_last_n_days",
    "SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'",
)
def q_last_n(spark, d):
    ev = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    return FL.last_n_days(ev, "ts", 7, dt.datetime(2024, 1, 31))


@register("flt_this_year", f"SELECT {_ORD_SQL} FROM orders WHERE year(o_orderdate) = 1997")
def q_this_year(spark, d):
    return FL.this_year(_orders(spark, d), "o_orderdate", dt.date(1997, 6, 15))


_EXPR = "l_quantity > 10 AND l_discount BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'R')"


@register(
    "flt_expression",
    f"SELECT {_LI_SQL} FROM lineitem WHERE l_quantity > 10 AND nullif(l_discount, 0) BETWEEN 0.02 AND 0.05 AND l_returnflag IN ('A', 'R')",
)
def q_expression(spark, d):
    return FL.expression(_li(spark, d), _EXPR)


@register("flt_search", f"SELECT {_ORD_SQL} FROM orders WHERE contains(CAST(o_orderkey AS VARCHAR), '77')")
def q_search(spark, d):
    return FL.search(_orders(spark, d), "o_orderkey", "77")


@register("flt_search_text", f"SELECT {_ORD_SQL} FROM orders WHERE contains(lower(o_orderpriority), 'urg')")
def q_search_text(spark, d):
    return FL.search(_orders(spark, d), "o_orderpriority", "URG")


@register(
    "flt_quick",
    f"SELECT {_ORD_SQL} FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 AND o_orderstatus IN ('F', 'O')",
)
def q_quick(spark, d):
    return FL.quick(_orders(spark, d), "o_totalprice", 100000, 300000, "o_orderstatus", ["F", "O"])


@register(
    "flt_summary",
    """
    SELECT count(*) AS rows_before,
           count(*) FILTER (WHERE o_totalprice > 200000) AS rows_after,
           count(*) - count(*) FILTER (WHERE o_totalprice > 200000) AS rows_removed,
           round(count(*) FILTER (WHERE o_totalprice > 200000) * 100.0 / count(*), 2) AS pct_remaining,
           CAST(6 AS BIGINT) AS n_columns
    FROM orders
    """,
)
def q_summary(spark, d):
    return FL.summary(table(spark, d, "orders"), F.col("o_totalprice") > 200000)


@register(
    "flt_duplicates",
    """
    SELECT p_brand, p_type, p_size FROM (
      SELECT p_brand, p_type, p_size, count(*) OVER (PARTITION BY p_brand, p_type, p_size) AS c FROM part)
    WHERE c > 1
    """,
)
def q_duplicates(spark, d):
    return FL.duplicates(table(spark, d, "part").select("p_brand", "p_type", "p_size"))


@register(
    "flt_outliers_iqr",
    """
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    SELECT event_id, value FROM events, q
    WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
    """,
)
def q_outliers(spark, d):
    return FL.outliers_iqr(table(spark, d, "events").select("event_id", "value"), "value")
