"""Query bindings: spreadsheet functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellar.functions import sheet as X
from cellar.plans.registry import register
from cellar.session import table


def _part(spark, d):
    return table(spark, d, "part")


@register(
    "fn_math",
    """SELECT p_partkey, round(p_retailprice / 7, 2) AS r, abs(p_retailprice - 1500) AS a, power(p_size, 2) AS pw,
              CASE WHEN p_size - 20 >= 0 THEN sqrt(p_size - 20) END AS sq,
              round(abs(p_retailprice / -3), 1) AS nested
       FROM part""",
)
def q_math(spark, d):
    p = _part(spark, d)
    return p.select(
        "p_partkey",
        X.fn_round(F.col("p_retailprice") / 7, 2).alias("r"),
        X.fn_abs(F.col("p_retailprice") - 1500).alias("a"),
        X.fn_power("p_size", 2).alias("pw"),
        X.fn_sqrt(F.col("p_size") - 20).alias("sq"),
        X.fn_round(X.fn_abs(F.col("p_retailprice") / -3), 1).alias("nested"),
    )


@register(
    "fn_logic",
    """SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS size_class,
              (p_size > 10 AND p_retailprice < 1500) AS both_, (p_size > 45 OR p_retailprice > 2000) AS either,
              NOT (p_size > 10) AS neg, CASE WHEN p_size % 2 <> 0 THEN 'odd' ELSE 'even' END AS parity
       FROM part""",
)
def q_logic(spark, d):
    p = _part(spark, d)
    return p.select(
        "p_partkey",
        X.fn_if(F.col("p_size") > 25, "big", "small").alias("size_class"),
        X.fn_and(F.col("p_size") > 10, F.col("p_retailprice") < 1500).alias("both_"),
        X.fn_or(F.col("p_size") > 45, F.col("p_retailprice") > 2000).alias("either"),
        X.fn_not(F.col("p_size") > 10).alias("neg"),
        X.fn_if(F.col("p_size") % 2, "odd", "even").alias("parity"),
    )


@register(
    "fn_text",
    """SELECT p_partkey, p_name || '-' || CAST(p_size AS VARCHAR) AS cat, left(p_name, 3) AS l3, right(p_name, 4) AS r4,
              substring(p_name, 2, 5) AS mid, CAST(length(p_name) AS INTEGER) AS len, upper(p_name) AS up, lower(p_brand) AS low,
              regexp_replace('  ' || p_type || ' ', '^\\s+|\\s+$', '', 'g') AS trimmed, right(p_name, 0) AS r0
       FROM part""",
)
def q_text(spark, d):
    p = _part(spark, d)
    return p.select(
        "p_partkey",
        X.fn_concat(F.col("p_name"), "-", F.col("p_size")).alias("cat"),
        X.fn_left("p_name", 3).alias("l3"),
        X.fn_right("p_name", 4).alias("r4"),
        X.fn_mid("p_name", 2, 5).alias("mid"),
        X.fn_len("p_name").alias("len"),
        X.fn_upper("p_name").alias("up"),
        X.fn_lower("p_brand").alias("low"),
        X.fn_trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"),
        X.fn_right("p_name", 0).alias("r0"),
    )


@register(
    "fn_title",
    r"""SELECT p_partkey,
        array_to_string(list_transform(regexp_extract_all(p_name || '.js x-' || p_brand, '(\p{L}+|\P{L}+)', 1),
            lambda w: CASE WHEN regexp_matches(w, '^\p{L}') THEN upper(w[1]) || lower(w[2:]) ELSE w END), '') AS title
        FROM part""",
)
def q_title(spark, d):
    p = _part(spark, d)
    return p.select("p_partkey", X.fn_title(F.concat(F.col("p_name"), F.lit(".js x-"), F.col("p_brand"))).alias("title"))


@register(
    "fn_dates",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd,
              CAST(year(CAST(CAST(o_orderdate AS DATE) AS VARCHAR)::TIMESTAMP) AS INTEGER) AS y_text
       FROM orders""",
)
def q_dates(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        X.fn_year("o_orderdate").alias("y"),
        X.fn_month("o_orderdate").alias("m"),
        X.fn_day("o_orderdate").alias("dd"),
        X.fn_year(F.date_format("o_orderdate", "yyyy-MM-dd"), is_text=True).alias("y_text"),
    )


@register(
    "fn_datedif",
    """SELECT l_orderkey, l_linenumber,
              CAST(floor(date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0) AS BIGINT) AS days,
              CAST((year(l_shipdate) - year(o_orderdate)) * 12 + month(l_shipdate) - month(o_orderdate) AS INTEGER) AS months,
              CAST(year(l_shipdate) - year(o_orderdate) AS INTEGER) AS years
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def q_datedif(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        "l_orderkey",
        "l_linenumber",
        X.fn_datedif("o_orderdate", "l_shipdate", "D").alias("days"),
        X.fn_datedif("o_orderdate", "l_shipdate", "M").alias("months"),
        X.fn_datedif("o_orderdate", "l_shipdate", "Y").alias("years"),
    )


@register(
    "fn_profit_margin",
    """SELECT l_orderkey, l_linenumber,
              round((l_extendedprice * (1 - l_discount) - l_extendedprice * l_tax) / nullif(l_extendedprice, 0) * 100, 2) AS profit_margin
       FROM lineitem""",
)
def q_margin(spark, d):
    li = table(spark, d, "lineitem")
    profit = F.col("l_extendedprice") * (1 - F.col("l_discount")) - F.col("l_extendedprice") * F.col("l_tax")
    return li.select("l_orderkey", "l_linenumber", X.fn_profit_margin(profit, "l_extendedprice").alias("profit_margin"))


@register("fn_today_now", "SELECT r_regionkey, CAST(current_date AS VARCHAR) AS today, true AS recent FROM region")
def q_today(spark, d):
    # the time itself differs by the run: checked to lie within the last hour
    recent = F.abs(F.unix_timestamp(X.fn_now(), "yyyy-MM-dd HH:mm:ss") - F.unix_timestamp()) < 3600
    return table(spark, d, "region").select("r_regionkey", X.fn_today().alias("today"), recent.alias("recent"))


# ---------------------------------------------------------------- one query per function ID
# Each projects one function's column(s) from the grouped queries above (same
# builders, same tables), so every SURVEY §2.9 ID has its own registered check.

_PER_ID = {
    "fn_round": ("fn_math", ["p_partkey", "r"]),
    "fn_abs": ("fn_math", ["p_partkey", "a"]),
    "fn_power": ("fn_math", ["p_partkey", "pw"]),
    "fn_sqrt": ("fn_math", ["p_partkey", "sq"]),
    "fn_if": ("fn_logic", ["p_partkey", "size_class", "parity"]),
    "fn_and": ("fn_logic", ["p_partkey", "both_"]),
    "fn_or": ("fn_logic", ["p_partkey", "either"]),
    "fn_not": ("fn_logic", ["p_partkey", "neg"]),
    "fn_concat": ("fn_text", ["p_partkey", "cat"]),
    "fn_left": ("fn_text", ["p_partkey", "l3"]),
    "fn_right": ("fn_text", ["p_partkey", "r4", "r0"]),
    "fn_mid": ("fn_text", ["p_partkey", "mid"]),
    "fn_len": ("fn_text", ["p_partkey", "len"]),
    "fn_upper": ("fn_text", ["p_partkey", "up"]),
    "fn_lower": ("fn_text", ["p_partkey", "low"]),
    "fn_trim": ("fn_text", ["p_partkey", "trimmed"]),
    "fn_year": ("fn_dates", ["o_orderkey", "y", "y_text"]),
    "fn_month": ("fn_dates", ["o_orderkey", "m"]),
    "fn_day": ("fn_dates", ["o_orderkey", "dd"]),
    "fn_datedif_d": ("fn_datedif", ["l_orderkey", "l_linenumber", "days"]),
    "fn_datedif_m": ("fn_datedif", ["l_orderkey", "l_linenumber", "months"]),
    "fn_datedif_y": ("fn_datedif", ["l_orderkey", "l_linenumber", "years"]),
}


def _register_per_id() -> None:
    from cellar.plans.registry import REGISTRY

    for key, (group, cols) in _PER_ID.items():
        base = REGISTRY[group]
        sql = f"SELECT {', '.join(cols)} FROM ({base.sql})"

        def fn(spark, d, _b=base.fn, _c=tuple(cols)):
            return _b(spark, d).select(*_c)

        register(key, sql)(fn)


_register_per_id()


@register("fn_today", "SELECT r_regionkey, CAST(current_date AS VARCHAR) AS today FROM region")
def q_today_only(spark, d):
    return table(spark, d, "region").select("r_regionkey", X.fn_today().alias("today"))


@register("fn_now", "SELECT r_regionkey, true AS recent FROM region")
def q_now_only(spark, d):
    recent = F.abs(F.unix_timestamp(X.fn_now(), "yyyy-MM-dd HH:mm:ss") - F.unix_timestamp()) < 3600
    return table(spark, d, "region").select("r_regionkey", recent.alias("recent"))
